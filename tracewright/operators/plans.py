"""Plans of transformations to apply to programs, as a relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import materialised

NAMES_A_ROW = 100
FEW_ROWS = 1_000  # rows of names that are broadcast


def label_plans(programs: DataFrame, pool: DataFrame, length: int = 1) -> DataFrame:
    """(program, steps, label): every ordered choice of length different names for every program.

    programs are (program, label); the label of a plan is the program's label and the names, joined by '_',
    without a label just the names.  pool has one column of names.  Each program is also kept plain, with
    label Ident and no steps.  Choices are added step by step from the names not yet taken.
    The names lie in rows of about NAMES_A_ROW, dealt by a hash; each choice meets each of these rows by its number.
    """
    name = pool.columns[0]
    names = materialised(pool.select(F.col(name).alias("x")).where("x is not null").distinct())
    n_rows = 1 + names.count() // NAMES_A_ROW
    number = F.pmod(F.xxhash64("x"), F.lit(n_rows).cast("long")).alias("_row")
    listed = names.groupBy(number).agg(F.array_sort(F.collect_list("x")).alias("_pool"))
    listed = F.broadcast(listed) if n_rows <= FEW_ROWS else listed
    rows = programs.withColumn("_steps", F.array().cast("array<string>"))
    for _ in range(length):
        met = rows.withColumn("_row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rows - 1).cast("long"))))
        rows = met.join(listed, "_row").withColumn("_next", F.explode(F.array_except("_pool", "_steps"))).withColumn(
            "_steps", F.array_append("_steps", F.col("_next"))
        ).drop("_row", "_pool", "_next")
    joined = F.array_join("_steps", "_")
    planned = rows.select(
        "program", joined.alias("steps"),
        F.when(F.coalesce("label", F.lit("")) == "", joined).otherwise(F.concat_ws("_", "label", joined)).alias("label"),
    )
    return planned.unionByName(programs.select("program", F.lit("").alias("steps"), F.lit("Ident").alias("label")))
