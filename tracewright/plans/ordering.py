"""Order-dependent steps that stay parallel when one key holds a large share of the rows.

Two cases are kept apart:

* the rows have no position yet: ``row_numbers`` and ``global_index`` derive one from ordering columns.
  Keys that are heavy are cut into value ranges at split points taken from a bounded sample of the
  data.  Where no key is heavy the plan is the plain window.
* the rows have a position column (line number, step): ``lag_in_order``, ``carry_forward`` and
  ``segment`` cut every key into fixed runs of positions, and pass what crosses a cut through a table
  with one row per run.

The sample is the row with the smallest hash in each of ``SAMPLE_SIZE`` hash buckets: one map-side
combined aggregation of the key columns to ``SAMPLE_SIZE`` numbers, which are looked at while the plan is
made.  Split points then are constants of the plan, so a recomputed task makes the same cuts; which
points were taken decides how even the ranges are, never the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_SIZE = 1024  # rows in a key sample; also bounds every broadcast made here
HEAVY_HITS = 8  # a key with this many sampled rows (about 0.8 % of all rows) is split
FEW = SAMPLE_SIZE // 4  # a sample this small is that of a table of a few hundred different rows
RUN_LENGTH = 1 << 20  # positions per run of one key
ROWS_PER_TASK = 500_000  # of rows that are dealt by key; what a task holds does not grow with the table
UNDEALT = 100_000  # up to this many rows a table has the session's number of tasks

_LOW = 0xFFFFFFFF


# ---- samples -------------------------------------------------------------------------------------------


def _pick(keys: Sequence[str], order: Sequence[str]) -> tuple[Column, Column]:
    """Hash of a row, and the number by which rows are sampled: its upper half, then the hash of the keys."""
    row = F.xxhash64(*dict.fromkeys([*keys, *order]))
    key = F.hash(*keys) if keys else F.lit(0)
    upper = row.bitwiseAND(F.lit(-(1 << 32)).cast("bigint"))
    return row, upper.bitwiseOR(key.cast("bigint").bitwiseAND(F.lit(_LOW).cast("bigint")))


def _picks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[list[tuple[int, int]], int]:
    """(pick, hash of the keys) of at most SAMPLE_SIZE rows drawn evenly over the rows of df, and the number of its rows."""
    row, pick = _pick(keys, order)
    least = df.groupBy(F.pmod(row, F.lit(SAMPLE_SIZE))).agg(F.min(pick).alias("p"), F.count(F.lit(1)).alias("n")).collect()
    found = []
    for r in least:
        low = r["p"] & _LOW
        found.append((r["p"], low - (1 << 32) if low >= 1 << 31 else low))
    return found, sum(r["n"] for r in least)


def heavy_keys(df: DataFrame, keys: Sequence[str], row_id: Sequence[str]) -> dict[int, int]:
    """Hash of the keys (functions.hash) to sampled rows, for keys that hold a large share of the rows.

    At most SAMPLE_SIZE / HEAVY_HITS entries.  A key that shares the hash of a heavy one is treated like it.
    """
    return _heavy(_picks(df, keys, row_id)[0])


def _heavy(picks: list[tuple[int, int]]) -> dict[int, int]:
    return {key: n for key, n in Counter(key for _, key in picks).items() if n >= HEAVY_HITS}


def _split_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], picks: list[int]) -> Column:
    """Sorted array constant of the (keys, order) of the picked rows."""
    cols = list(dict.fromkeys([*keys, *order]))
    _, pick = _pick(keys, order)
    rows = (
        df.select(*cols, pick.alias("_pick"))
        .filter(F.col("_pick").isin(picks))
        .groupBy("_pick")
        .agg(F.min(F.struct(*cols)).alias("_at"))  # one row per pick
    )
    text = rows.agg(F.to_json(F.sort_array(F.collect_list("_at")))).first()[0]
    schema = T.ArrayType(T.StructType([df.schema[c] for c in cols]))
    return F.from_json(F.lit(text), schema)


def _range(cols: Sequence[str], points: Column) -> Column:
    """How many of the sorted split points are <= (cols), by halving."""
    at = F.struct(*cols)
    steps = F.array(*[F.lit(1 << b) for b in range(SAMPLE_SIZE.bit_length() - 1, -1, -1)])
    return F.aggregate(
        steps, F.lit(0), lambda p, s: F.when(F.get(points, p + s - 1) <= at, p + s).otherwise(p)
    )


# ---- positions from ordering columns -------------------------------------------------------------------


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, Column | None]:
    """df with _range, which cuts the rows of heavy keys into consecutive value ranges.

    All rows of any other key have one range.  Also gives a condition that holds for the rows of heavy
    keys, or None if nothing was cut.  Keys must be non-null.
    """
    cut, is_heavy, _ = _ranged(df, keys, order)
    return cut, is_heavy


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, Column | None, int]:
    """The same, and the number of rows."""
    picks, n = _picks(df, keys, order)
    heavy = _heavy(picks)
    if not heavy or len(picks) < FEW:
        return df.withColumn("_range", F.lit(0)), None, n
    points = _split_points(df, keys, order, [p for p, key in picks if key in heavy])
    cols = list(dict.fromkeys([*keys, *order]))
    is_heavy = F.hash(*keys).isin(list(heavy)) if keys else F.lit(True)
    return df.withColumn("_range", _range(cols, points)), is_heavy, n


def dealt(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """df of n rows dealt by keys to a number of tasks that grows with n; as it is where that needs none."""
    if n <= UNDEALT:
        return df
    return df.repartition(max(-(-n // ROWS_PER_TASK), df.sparkSession.sparkContext.defaultParallelism), *keys)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """row_number() over (partition by keys order by order), bigint, safe for heavy keys.

    Rows of a null key are one partition; rows that tie on order are numbered in any order, as row_number() does.
    Without heavy keys the rows stay dealt by keys alone, so windows and groups of these keys need no further shuffle.
    """
    keys = list(keys)
    cut, is_heavy, n = _ranged(df, keys, order)
    if is_heavy is None:
        alone = F.row_number().over(W.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)).cast("bigint")
        return (dealt(df, keys, n) if keys else df).withColumn(name, alone)
    local = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(*order)).cast("bigint")
    cut = dealt(cut, [*keys, "_range"], n)
    before = (
        cut.filter(is_heavy)
        .groupBy(*keys, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_before",
            F.sum("_n").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)),
        )
        .filter(F.col("_before").isNotNull())
        .drop("_n")
    )
    of_range = F.broadcast(before.select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("_range").alias("_of"), "_before"))
    same = F.col("_range") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return (
        cut.withColumn("_local", local)
        .join(of_range, same, "left")  # one row per range of a heavy key
        .drop("_of", *(f"_of_{k}" for k in keys))
        .withColumn(name, F.col("_local") + F.coalesce("_before", F.lit(0)))
        .drop("_local", "_before", "_range")
    )


def global_index(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """0-based position of every row in the total order given by unique ordering columns.

    Replaces an unpartitioned row_number(): rows are ranged by split points, numbered inside their
    range, and shifted by the sizes of the ranges before it (at most SAMPLE_SIZE + 1 counts).
    """
    cut, many = ranged(df, [], order)
    local = F.row_number().over(W.partitionBy("_range").orderBy(*order)).cast("bigint") - 1
    if many is None:  # a few hundred rows
        return cut.withColumn(name, local).drop("_range")
    before = (
        cut.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_before",
            F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)),
        )
        .drop("_n")
    )
    return (
        cut.withColumn("_local", local)
        .join(F.broadcast(before), "_range", "left")
        .withColumn(name, F.col("_local") + F.coalesce("_before", F.lit(0)))
        .drop("_local", "_before", "_range")
    )


# ---- steps along positions -----------------------------------------------------------------------------


def segment(position: str, run_length: int = RUN_LENGTH) -> Column:
    """Run number of a 1-based position column."""
    return F.floor((F.col(position) - 1) / F.lit(run_length)).cast("bigint")


def lag_in_order(
    df: DataFrame, keys: Sequence[str], position: str, column: str, name: str, run_length: int = RUN_LENGTH
) -> DataFrame:
    """lag(column) per key, for consecutive positions 1..n.

    The last row of every full run is also sent to the next run, so one shuffle is enough and no task
    sees more than run_length + 1 rows of a key.
    """
    run = segment(position, run_length)
    w = W.partitionBy(*keys, "_run").orderBy(position)
    sent_to = F.when(F.col(position) % run_length == 0, F.array(run, run + 1)).otherwise(F.array(run))
    return (
        df.withColumn("_run", F.explode_outer(sent_to))
        .withColumn(name, F.lag(column).over(w))
        .filter(F.col("_run") == run)
        .drop("_run")
    )


def carry_forward(
    df: DataFrame, keys: Sequence[str], position: str, value: Column, name: str, run_length: int = RUN_LENGTH,
    include_current: bool = True,
) -> DataFrame:
    """Last non-null value at or before each row (strictly before it if include_current is false).

    What enters a run from earlier runs of its key comes from a map-side combined table of one row per
    run, of which only the rows of keys longer than one run are left for the join.
    """
    keys = list(keys)
    run = segment(position, run_length)
    carried = (
        df.withColumn("_set", value)
        .groupBy(*keys, run.alias("_run"))
        .agg(F.max_by("_set", F.when(F.col("_set").isNotNull(), F.col(position))).alias("_last"))
        .withColumn(
            "_carry",
            F.last("_last", ignorenulls=True).over(
                W.partitionBy(*keys).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
            ),
        )
        .filter(F.col("_carry").isNotNull())
        .select(*keys, "_run", "_carry")
    )
    end = W.currentRow if include_current else -1
    w = W.partitionBy(*keys, "_run").orderBy(position).rowsBetween(W.unboundedPreceding, end)
    return (
        df.withColumn("_run", run)
        .withColumn("_set", value)
        .withColumn("_seen", F.last("_set", ignorenulls=True).over(w))
        .join(carried, [*keys, "_run"], "left")
        .withColumn(name, F.coalesce("_seen", "_carry"))
        .drop("_run", "_carry", "_set", "_seen")
    )
