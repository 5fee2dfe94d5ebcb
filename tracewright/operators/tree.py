"""Decision trees, and the table of best first splits."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import IndexToString, StringIndexerModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.fixed_values import TREE_DEPTHS
from tracewright.operators import growth
from tracewright.operators.reduce import cells_of
from tracewright.session import materialised

MAX_TREE_CLASSES = 1000


def _check(criterion: str) -> str:
    if criterion not in ("gini", "entropy"):
        raise ValueError(f"unknown criterion {criterion!r}; use gini or entropy")
    return criterion


def class_list(samples: DataFrame) -> list[str]:
    """Class names in alphabetical order; refuses to go on beyond MAX_TREE_CLASSES."""
    names = [r[0] for r in samples.select("class_name").distinct().limit(MAX_TREE_CLASSES + 1).collect()]
    if len(names) > MAX_TREE_CLASSES:
        raise ValueError(f"more than {MAX_TREE_CLASSES} classes")
    return sorted(names)


# ---- trees ---------------------------------------------------------------------------------------------


def _prepared(samples: DataFrame, classes: list[str]) -> DataFrame:
    indexer = StringIndexerModel.from_labels(classes, inputCol="class_name", outputCol="_label")
    return indexer.transform(samples).withColumn("_v", array_to_vector("features"))


def _grown(train: DataFrame, classes: list[str], criterion: str, depth: int, max_bins: int, seed: int):
    """A function that adds predicted to prepared rows."""
    model = DecisionTreeClassifier(
        featuresCol="_v", labelCol="_label", predictionCol="_p", probabilityCol="", rawPredictionCol="",
        impurity=_check(criterion), maxDepth=depth, maxBins=max_bins, seed=seed,
    ).fit(train)
    names = IndexToString(inputCol="_p", outputCol="predicted", labels=classes)
    return lambda rows: names.transform(model.transform(rows)).drop("_v", "_label", "_p")


def fit_predict(
    train: DataFrame, test: DataFrame, criterion: str = "gini", depth: int = 8, max_bins: int = 256, seed: int = 0
) -> DataFrame:
    """Test samples with predicted, from a tree grown on the training samples.

    Thresholds are taken between at most max_bins quantiles of a feature; raise it for features with more
    values that matter.  Classes that are only in test cannot be predicted.
    """
    classes = class_list(train)
    predict = _grown(_prepared(train, classes), classes, criterion, depth, max_bins, seed)
    return predict(test.withColumn("_v", array_to_vector("features")))


def sweep(
    train: DataFrame, test: DataFrame, classes: list[str], criterion: str, depths: list[int],
    max_bins: int = 256, seed: int = 0,
) -> DataFrame:
    """Test samples with param and predicted, for every depth; the training rows are kept while trees grow."""
    kept = _prepared(train, classes).select("_label", "_v").persist()
    rows = test.withColumn("_v", array_to_vector("features"))
    out = [
        _grown(kept, classes, criterion, depth, max_bins, seed)(rows).withColumn("param", F.lit(depth))
        for depth in depths
    ]
    kept.unpersist()
    return reduce(DataFrame.unionByName, out)


def kfold_predictions(
    samples: DataFrame, k: int, criterion: str = "gini", depths: list[int] = TREE_DEPTHS,
    max_bins: int = 256, seed: int = 0,
) -> DataFrame:
    """Predictions (sample_id, class_name, fold, param, predicted): every depth on every fold.

    The loop runs over folds and depths, never over rows.
    """
    classes = class_list(samples)
    out = [
        sweep(samples.filter(F.col("fold") != fold), samples.filter(F.col("fold") == fold), classes, criterion,
              depths, max_bins, seed)
        for fold in range(k)
    ]
    return reduce(DataFrame.unionByName, out).select("sample_id", "class_name", "fold", "param", "predicted")


# ---- best first splits ---------------------------------------------------------------------------------


def best_splits(samples: DataFrame, criterion: str = "gini") -> DataFrame:
    """(j, threshold, gain): the threshold of each feature that lowers the impurity most.

    Thresholds lie midway between neighbouring values; of equal gains the lowest threshold is taken. A feature of one
    value has no row. Class counts are summed per value first; classes are rows, so there may be any number of them.
    Samples without a class and missing values are not counted.
    """
    _check(criterion)
    known = cells_of(samples.filter("class_name is not null"), []).filter("x is not null")
    counts = materialised(known.groupBy("j", "x", "class_name").agg(F.count(F.lit(1)).alias("n")))
    best = growth.splits(counts, criterion, []).groupBy("j").agg(
        F.max(F.struct("gain", (-F.col("threshold")).alias("t"))).alias("_b"))
    return best.select("j", (-F.col("_b.t")).alias("threshold"), F.col("_b.gain").alias("gain"))
