"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, keep: list, array: Column, item: str, pos: str | None = None) -> DataFrame:
    """One row per item of a computed array, with 1-based positions as pos if asked for.

    The outer form is used because the plain one makes the optimizer add a test that the array is not
    empty, which works out the whole array a second time.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias("_pos", item)).filter(F.col("_pos").isNotNull())
    if pos is None:
        return rows.drop("_pos")
    kept = [c for c in rows.columns if c not in ("_pos", item)]
    return rows.select(*kept, (F.col("_pos") + 1).cast("bigint").alias(pos), item)
