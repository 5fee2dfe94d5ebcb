"""Equi-joins that spread heavy keys over many tasks, or need no shuffle of the large side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.plans.ordering import heavy_keys
from tracewright.session import materialised

MAX_BROADCAST_ROWS = 100_000


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], row_id: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on keys where a key may hold a large share of the left rows and few of the right.

    Keys of different types are compared, and dealt to salts, as their common type.

    Rows of a heavy left key are dealt to as many salts as the key has sampled rows (about 0.1 % of all
    rows per salt), and the right rows of that key are repeated once per salt.  Other keys keep one salt.
    Without heavy keys the plan is the plain join.  The heavy keys, at most ordering.SAMPLE_SIZE /
    HEAVY_HITS, are constants of the plan.  Works for inner, left, left_semi and left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join cannot keep unmatched right rows: {how}")
    keys = list(keys)
    both = left.select(*keys).limit(0).union(right.select(*keys).limit(0)).schema
    hashed = [F.col(k).cast(both[k].dataType) for k in keys]
    heavy = heavy_keys(left.withColumns(dict(zip(keys, hashed))), keys, row_id)
    if not heavy:
        return left.join(right, keys, how)
    of_key = F.create_map(*[F.lit(v) for pair in heavy.items() for v in pair])
    salts = F.coalesce(F.try_element_at(of_key, F.hash(*hashed)), F.lit(1))
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*row_id), salts).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")


def lookup_join(
    left: DataFrame, table: DataFrame, keys: Sequence[str], row_id: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join with a derived table that is usually small, such as a dictionary or a class list.

    The table is worked out once and counted: up to MAX_BROADCAST_ROWS narrow rows are broadcast, so that
    the left side stays where it is; a larger table is met by a salted join.
    """
    table = materialised(table)
    if table.count() <= MAX_BROADCAST_ROWS:
        return left.join(F.broadcast(table), list(keys), how)
    return salted_join(left, table, keys, row_id, how)
