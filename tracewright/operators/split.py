"""Cross-validation splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.plans.ordering import global_index
from tracewright.session import materialised


def fold_starts(n: int, k: int) -> list[int]:
    """First positions of folds 1 .. k-1: the first n mod k folds have one sample more than the others."""
    small, larger = divmod(n, k)
    return [f * small + min(f, larger) for f in range(1, k)]


def kfold_assign(samples: DataFrame, sample_id: str, k: int = 10) -> DataFrame:
    """Adds fold: contiguous, unshuffled folds in the order of a unique sample_id.

    Only ids are put in order, to find the k - 1 ids at which a fold starts.  A sample's fold is then a
    comparison with these constants, so its row is never moved.
    """
    ids = samples.select(sample_id)
    starts = fold_starts(ids.count(), k)
    at = global_index(ids, [sample_id], "_i").filter(F.col("_i").isin(starts)).collect()  # k - 1 ids
    found = {r["_i"]: r[sample_id] for r in at}
    kind = samples.schema[sample_id].dataType
    # A start past the last sample belongs to an empty fold.
    passed = [(F.col(sample_id) >= F.lit(found[p]).cast(kind)).cast("int") for p in starts if p in found]
    return samples.withColumn("fold", reduce(lambda a, b: a + b, passed, F.lit(0)))


def program_holdout(programs: DataFrame, k: int = 10, cycles: int | None = None) -> DataFrame:
    """(program, rank, cycle): the cycles in which each program is tested; it trains in all others.

    Programs are ranked by name; a cycle tests floor(P / k) neighbouring ranks.  The last P mod k programs
    are never tested when cycles == k, and have a null cycle.  cycles defaults to k.
    """
    cycles = k if cycles is None else cycles
    programs = materialised(programs.select("program"))
    n = programs.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = global_index(programs, ["program"], "rank").withColumn("_n", n)
    chunk = F.floor(F.col("_n") / F.lit(k)).cast("bigint")
    tested = F.filter(
        F.sequence(F.lit(0), F.lit(cycles - 1)),
        lambda c: (F.col("rank") >= (c * chunk) % F.col("_n")) & (F.col("rank") < (c * chunk) % F.col("_n") + chunk),
    )
    return ranked.select("program", "rank", F.explode_outer(tested).alias("cycle"))


def train_except_test(samples: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Training samples: all that are not in the test split."""
    return samples.join(test.select(key), key, "left_anti")


def split_sizes(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Sample counts per program, split or class."""
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
