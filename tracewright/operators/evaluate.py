"""Prediction tables to trends, confusion matrices and accuracies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.numbers import hundredths, rounded_ratio
from tracewright.functions.strings import class_letter, letter_mismatch
from tracewright.operators.encode import first_seen
from tracewright.plans.ordering import global_index
from tracewright.plans.skew import lookup_join
from tracewright.session import materialised

CLASS_BLOCK = 1_000  # names of classes in a list


def trend_counts(predictions: DataFrame, by: list[str] = ["param"]) -> DataFrame:
    """(*by, class_name, predicted, n)"""
    return predictions.groupBy(*by, "class_name", "predicted").agg(F.count(F.lit(1)).alias("n"))


def trend_merge(first: DataFrame, second: DataFrame, by: list[str] = ["param"]) -> DataFrame:
    """Add up two trend tables."""
    return first.unionByName(second).groupBy(*by, "class_name", "predicted").agg(F.sum("n").alias("n"))


def trends_ordered(trends: DataFrame, by: list[str] = ["param"]) -> DataFrame:
    """Most frequent first."""
    return trends.orderBy(*by, F.desc("n"), "class_name", "predicted")


def _class_blocks(trends: DataFrame, by: list[str], block: int) -> DataFrame:
    """(*by, blocks, at, classes): true and predicted classes, dealt by hash to `blocks` lists of about `block` names."""
    names = materialised(trends.select(*by, F.explode(F.array("class_name", "predicted")).alias("c")).filter(
        "c is not null").distinct())
    sizes = names.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    if by:
        dealt = lookup_join(names, sizes, by, [*by, "c"])
    else:
        dealt = names.withColumn("blocks", sizes.scalar())  # one row
    return dealt.groupBy(*by, "blocks", F.pmod(F.xxhash64("c"), "blocks").cast("int").alias("at")).agg(
        F.collect_list("c").alias("classes"))


def confusion_long(trends: DataFrame, by: list[str] = ["param"], block: int = CLASS_BLOCK) -> DataFrame:
    """(*by, class_name, predicted, n): every cell of the matrix, zeros included.

    The matrix is made in squares: each block of true classes meets each block of predicted ones in a row of its own,
    which holds about 2 * block names, so no row grows with the number of classes. Null names and keys have no cells.
    """
    blocks = materialised(_class_blocks(trends, by, block))
    rows = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = blocks.select(*by, F.col("at").alias("other"), F.col("classes").alias("predicted"))
    squares = rows.join(columns, [*by, "other"]).select(*by, F.explode("classes").alias("class_name"), "predicted")
    keys = [*by, "class_name", "predicted"]
    cells = squares.select(*by, "class_name", F.explode("predicted").alias("predicted"))
    return cells.join(trends, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def confusion_pivot(cells: DataFrame, classes: list[str], by: list[str] = []) -> DataFrame:
    """Matrix with one column per predicted class; by are the columns that tell matrices apart."""
    return (
        cells.groupBy(*by, "class_name").pivot("predicted", classes).agg(F.sum("n")).na.fill(0, subset=classes)
    )


def accuracy_modes(trends: DataFrame, by: list[str] = ["param"]) -> DataFrame:
    """(*by, mode, correct, total, accuracy): percent, 2 decimals.

    strict counts equal names; viceversa also names whose letters differ by at most one; jit also names that
    both contain Ji; both either of the two.
    """
    c, p, n = F.col("class_name"), F.col("predicted"), F.col("n")
    same = c == p
    near = letter_mismatch(c, p) <= 1
    jit = c.contains("Ji") & p.contains("Ji")
    modes = {"strict": same, "viceversa": same | near, "jit": same | jit, "both": same | near | jit}
    sums = trends.groupBy(*by).agg(
        F.sum("n").alias("total"),
        *[F.sum(F.when(hit, n).otherwise(F.lit(0))).cast("bigint").alias(mode) for mode, hit in modes.items()],
    )
    long = sums.unpivot([*by, "total"], list(modes), "mode", "correct")
    return long.select(
        *by, "mode", "correct", "total", rounded_ratio(F.col("correct") * 100, F.col("total")).alias("accuracy")
    )


def _hits() -> Column:
    return F.count_if(F.col("class_name") == F.col("predicted"))


def fold_accuracy(predictions: DataFrame, by: list[str] = ["param", "fold"]) -> DataFrame:
    """(*by, accuracy), 2 decimals."""
    return predictions.groupBy(*by).agg(rounded_ratio(_hits(), F.count(F.lit(1))).alias("accuracy"))


def sweep_curve(predictions: DataFrame, by: list[str] = ["param"], fold: str = "fold") -> DataFrame:
    """(*by, mean_accuracy): mean of the rounded fold accuracies, rounded again."""
    folds = predictions.groupBy(*by, fold).agg(hundredths(_hits(), F.count(F.lit(1))).alias("_h"))
    return folds.groupBy(*by).agg(rounded_ratio(F.sum("_h"), F.count(F.lit(1)) * 100).alias("mean_accuracy"))


# ---- classes -------------------------------------------------------------------------------------------


def class_index(train: DataFrame, test: DataFrame | None = None) -> DataFrame:
    """(class_name, class_idx) in first-seen order of sample_id; classes only in test come after."""
    rows = train.select("class_name", F.lit(0).alias("_phase"), "sample_id")
    if test is not None:
        rows = rows.unionByName(test.select("class_name", F.lit(1).alias("_phase"), "sample_id"))
    order = ["_phase", "sample_id"]
    seen = materialised(first_seen(rows, "class_name", order))
    return global_index(seen, order, "class_idx").select("class_name", "class_idx")


def with_class_index(samples: DataFrame, classes: DataFrame) -> DataFrame:
    """Samples with class_idx; one class may hold most samples."""
    return lookup_join(samples, classes, ["class_name"], ["sample_id"])


def class_letters(classes: DataFrame) -> DataFrame:
    """(class_name, rank, letter): alphabetical rank from 1 and its code letter."""
    ranked = global_index(materialised(classes.select("class_name").distinct()), ["class_name"], "_i")
    rank = F.col("_i") + 1
    return ranked.select("class_name", rank.alias("rank"), class_letter(rank).alias("letter"))


def class_alphabet(symbols: DataFrame, weight: str | None = None) -> DataFrame:
    """(class_name, symbol, n): the symbols seen in each class; weight is a column of counts already taken."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return symbols.groupBy("class_name", "symbol").agg(n.alias("n"))
