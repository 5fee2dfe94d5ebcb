"""Multinomial naive Bayes with smoothed likelihoods and plain class shares as priors.

All models of an experiment (one per batch, that is fold or cycle, and swept parameter) come from one
pass of sums.  They are small tables; samples are scored in their own row, without a join or a shuffle.
"""

from __future__ import annotations

from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.fixed_values import BAYES_DIMENSIONS
from tracewright.functions.rows import exploded
from tracewright.operators.reduce import (
    anova,
    anova_f,
    class_counts,
    feature_sums,
    held_out_axes,
    principal_axes,
    projected,
    select_kbest,
)
from tracewright.plans.skew import salted_join
from tracewright.session import materialised

MAX_MODEL_NUMBERS = 2_000_000  # models of more numbers than this are joined to the samples, not sent to all tasks


# ---- training sums -------------------------------------------------------------------------------------


def held_out_sums(sums: DataFrame, counts: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Sums and counts of the training part of every batch 0..k-1: those of all samples minus the batch's own.

    sums and counts are per own batch (column batch, null for samples that are never held out).
    """
    batches = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("batch")
    whole = sums.groupBy("class_name", "j").agg(*[F.sum(c).alias(f"_{c}") for c in ("s", "ss", "sa")])
    train = (
        whole.select(batches, "*")
        .join(sums.filter("batch is not null"), ["batch", "class_name", "j"], "left")
        .select("batch", "class_name", "j",
                *[(F.col(f"_{c}") - F.coalesce(c, F.lit(0.0))).alias(c) for c in ("s", "ss", "sa")])
    )
    whole_n = counts.groupBy("class_name").agg(F.sum("n").alias("_n"))
    train_n = (
        whole_n.select(batches, "*")
        .join(counts.filter("batch is not null"), ["batch", "class_name"], "left")
        .select("batch", "class_name", (F.col("_n") - F.coalesce("n", F.lit(0))).alias("n"))
        .filter("n > 0")
    )
    return train.join(train_n.select("batch", "class_name"), ["batch", "class_name"], "left_semi"), train_n


# ---- models --------------------------------------------------------------------------------------------


def models(sums: DataFrame, counts: DataFrame, size: Column, masks: DataFrame | None = None) -> DataFrame:
    """(batch, param, class_name, log_prior, log_theta): one row per model and class.

    log_theta has one number per feature (size of them), 0 for features a mask (batch, param, j) leaves out.
    """
    if masks is None:
        chosen = sums.withColumn("param", F.lit(0))
    else:
        chosen = sums.join(masks, ["batch", "j"])
    per_class = chosen.groupBy("batch", "param", "class_name").agg(
        F.sum("sa").alias("_all"),
        F.count(F.lit(1)).alias("_j"),
        F.map_from_entries(F.collect_list(F.struct(F.col("j").cast("int"), "sa"))).alias("_m"),
    )
    shares = counts.groupBy("batch").agg(F.sum("n").alias("_n"))
    log_theta = F.transform(
        F.sequence(F.lit(1), F.col("_size")),
        lambda j: F.coalesce(
            F.log((F.try_element_at("_m", j) + 1.0) / (F.col("_all") + F.col("_j").cast("double"))), F.lit(0.0)
        ),
    )
    return (
        per_class.join(counts, ["batch", "class_name"])
        .join(shares, "batch")
        .withColumn("_size", size.cast("int"))
        .select(
            "batch", "param", "class_name",
            F.log(F.col("n").cast("double") / F.col("_n").cast("double")).alias("log_prior"),
            log_theta.alias("log_theta"),
        )
    )


def packed(model_rows: DataFrame) -> Column:
    """All models as one scalar: map of batch to array of (param, classes)."""
    by_param = model_rows.groupBy("batch", "param").agg(
        F.array_sort(F.collect_list(F.struct("class_name", "log_prior", "log_theta"))).alias("classes")
    )
    by_batch = by_param.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("param", "classes"))).alias("params"))
    return by_batch.agg(F.map_from_entries(F.collect_list(F.struct("batch", "params")))).scalar()


# ---- scoring -------------------------------------------------------------------------------------------


def scored(samples: DataFrame, model_rows: DataFrame) -> DataFrame:
    """One row per sample and parameter: (..., param, scores array of (class_name, score)).

    samples has batch and features; features are used by their size, whatever their sign.  Models up to
    MAX_MODEL_NUMBERS are put in front of every task; larger ones are joined to the samples by class.
    """
    model_rows = materialised(model_rows)
    numbers = model_rows.agg(F.sum(F.size("log_theta"))).first()[0] or 0
    sized = samples.withColumn("features", F.transform("features", F.abs))
    if numbers > MAX_MODEL_NUMBERS:
        return _scored_by_join(sized, model_rows)
    cols = [c for c in samples.columns if c != "features"]
    with_models = sized.withColumn("_models", F.element_at(packed(model_rows), F.col("batch")))
    result = F.expr(
        "transform(_models, m -> struct(m.param as param, transform(m.classes, c -> struct("
        "c.class_name as class_name, c.log_prior + aggregate(zip_with(features, c.log_theta, (a, b) -> a * b), 0D, "
        "(t, v) -> t + coalesce(v, 0D)) as score)) as scores))"
    )
    rows = with_models.select(*cols, result.alias("_r")).select(*cols, F.explode_outer("_r").alias("_r"))
    return rows.select(*cols, "_r.param", "_r.scores")


def _scored_by_join(samples: DataFrame, model_rows: DataFrame) -> DataFrame:
    """The same with one row per sample, parameter and feature, joined to the model's numbers of the feature.

    Samples get a number of their own, so equal ones stay apart; what no feature adds to scores the prior.
    """
    cols = [c for c in samples.columns if c != "features"]
    samples = materialised(samples.withColumn("_row", F.monotonically_increasing_id()))
    cells = exploded(samples, ["_row", "batch"], F.col("features"), "_x", "_j")
    numbers = exploded(model_rows, ["batch", "param", "class_name"], F.col("log_theta"), "_theta", "_j")
    of_feature = numbers.groupBy("batch", "_j", "param").agg(F.collect_list(F.struct("class_name", "_theta")).alias("_classes"))
    met = salted_join(cells, of_feature, ["batch", "_j"], ["_row", "_j"])
    parts = met.select("_row", "param", "_x", F.explode("_classes").alias("_c"))
    sums = parts.groupBy("_row", "param", F.col("_c.class_name").alias("_name")).agg(
        F.sum(F.col("_x") * F.col("_c._theta")).alias("_sum"))
    priors = model_rows.select("batch", "param", F.col("class_name").alias("_name"), "log_prior")
    asked = samples.drop("features").join(priors, "batch", "left").join(sums, ["_row", "param", "_name"], "left")
    score = F.struct(F.col("_name").alias("class_name"), (F.col("log_prior") + F.coalesce("_sum", F.lit(0.0))).alias("score"))
    listed = asked.groupBy("_row", *cols, "param").agg(
        F.array_sort(F.collect_list(F.when(F.col("_name").isNotNull(), score))).alias("scores"))
    return listed.select(*cols, "param", F.when(F.size("scores") > 0, F.col("scores")).alias("scores"))


def best_class(scores: Column) -> Column:
    """Class of the highest score; of equal scores (to 9 decimals) the first class."""
    best = F.aggregate(
        scores,
        F.struct(F.element_at(scores, 1)["class_name"].alias("c"), F.round(F.element_at(scores, 1)["score"], 9).alias("s")),
        lambda top, x: F.when(
            F.round(x["score"], 9) > top["s"], F.struct(x["class_name"].alias("c"), F.round(x["score"], 9).alias("s"))
        ).otherwise(top),
    )
    return best["c"]


def probabilities(scores: Column) -> Column:
    """array of (class_name, probability)"""
    top = F.array_max(F.transform(scores, lambda x: x["score"]))
    total = F.aggregate(scores, F.lit(0.0), lambda t, x: t + F.exp(x["score"] - top))
    return F.transform(
        scores, lambda x: F.struct(x["class_name"], (F.exp(x["score"] - top) / total).alias("probability"))
    )


def feature_count(sums: DataFrame) -> Column:
    return sums.agg(F.max("j").alias("d")).scalar()


# ---- experiments ---------------------------------------------------------------------------------------


def fit_predict(
    train: DataFrame, test: DataFrame, reduce_to: int | None = None, fit: str = "train"
) -> DataFrame:
    """Test samples with scores, from one model fitted on train.

    reduce_to keeps that many best features; fit="train" takes those of the training samples for both,
    fit="separate" picks the test columns from the test samples, so that column i may be another feature.
    """
    if fit not in ("train", "separate"):
        raise ValueError(f"unknown fit {fit!r}; use train or separate")
    if reduce_to is not None:
        scores = anova_f(train)
        test = select_kbest(test, reduce_to, scores if fit == "train" else None)
        train = select_kbest(train, reduce_to, scores)
    batch = F.lit(0).alias("batch")
    sums = materialised(feature_sums(train, []).select(batch, "*"))
    counts = class_counts(train, []).select(batch, "*")
    return scored(test.select("*", batch), models(sums, counts, feature_count(sums))).drop("batch", "param")


def fit_predict_ml(train: DataFrame, test: DataFrame) -> DataFrame:
    """Test samples with predicted, from Spark's own classifier, for very wide vectors.

    It smooths the class shares as well, so that its predictions may differ where classes are close.
    """
    classes = StringIndexer(inputCol="class_name", outputCol="_label", stringOrderType="alphabetAsc").fit(train)
    sized = lambda df: df.withColumn("_v", array_to_vector(F.transform("features", F.abs)))
    model = NaiveBayes(
        featuresCol="_v", labelCol="_label", predictionCol="_p", probabilityCol="", rawPredictionCol=""
    ).fit(classes.transform(sized(train)))
    names = IndexToString(inputCol="_p", outputCol="predicted", labels=classes.labels)
    return names.transform(model.transform(sized(test))).drop("_v", "_p")


def kfold_models(
    samples: DataFrame, k: int, params: list[int] | None = None, reduce_scope: str = "all"
) -> DataFrame:
    """Models of all folds (and of all numbers of kept features in params) from one pass over the samples.

    reduce_scope="all" selects features on all samples, before the split, as the swept experiment does;
    "train" selects them on the training part of each fold.
    """
    own = samples.withColumn("batch", F.col("fold"))
    sums = materialised(feature_sums(own, ["batch"]))  # folds x classes x features
    counts = materialised(class_counts(own, ["batch"]))
    train, train_n = held_out_sums(sums, counts, k)
    if params is None:
        return models(train, train_n, feature_count(sums))
    if reduce_scope == "all":
        whole = sums.groupBy("class_name", "j").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"))
        ranks = anova(whole, counts.groupBy("class_name").agg(F.sum("n").alias("n")))
        ranks = ranks.select(F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("batch"), "j", "rank")
    elif reduce_scope == "train":
        ranks = anova(train, train_n, ["batch"])
    else:
        raise ValueError(f"unknown reduce_scope {reduce_scope!r}; use all or train")
    return models(train, train_n, feature_count(sums), masks(ranks, params))


def component_scores(samples: DataFrame, k: int, params: list[int], reduce_scope: str = "all") -> DataFrame:
    """Every sample with the scores of the models of its fold on the first principal components, for each number in params.

    reduce_scope="all" takes the components of all samples, as the swept experiment does; "train" takes those of the training
    part of each fold, from the sums of all samples minus the fold's own, and places each sample on the axes of all folds.
    The axes are found once, for the largest number; fewer components are the first of them.
    """
    if reduce_scope not in ("all", "train"):
        raise ValueError(f"unknown reduce_scope {reduce_scope!r}; use all or train")
    if reduce_scope == "all":
        whole = samples.withColumn("_all", F.lit(0))
        placed = materialised(projected(whole, principal_axes(whole, max(params), "_all"), "_all").drop("_all"))
        own = placed.withColumn("batch", F.col("fold"))
        train, train_n = held_out_sums(
            materialised(feature_sums(own, ["batch"])), materialised(class_counts(own, ["batch"])), k)
        test = own
    else:
        axes = held_out_axes(samples, max(params), "fold")
        every = samples.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("batch"))
        placed = materialised(projected(every, axes, "batch").filter("features is not null"))
        train, train_n = fitted_sums(placed.filter("fold is null or fold <> batch"))
        test = placed.filter("fold = batch")
    return scored(test, component_models(train, train_n, params)).drop("batch")


def fitted_sums(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sums and counts of the samples of each batch."""
    return materialised(feature_sums(train, ["batch"])), materialised(class_counts(train, ["batch"]))


def component_models(sums: DataFrame, counts: DataFrame, params: list[int]) -> DataFrame:
    """Models on the first components, for each number of them in params."""
    ranks = sums.select("batch", "j").distinct().withColumn("rank", F.col("j"))
    return models(sums, counts, feature_count(sums), masks(ranks, params))


def masks(ranks: DataFrame, params: list[int]) -> DataFrame:
    """(batch, param, j): the features kept for each swept number of features."""
    wanted = F.explode(F.array(*[F.lit(p) for p in params])).alias("param")
    return ranks.select("batch", "j", "rank", wanted).filter("rank <= param").drop("rank")


def kfold_scores(
    samples: DataFrame, k: int, params: list[int] | None = None, reduce_scope: str = "all"
) -> DataFrame:
    """Every sample (sample_id, class_name, features, fold) with the scores of the model of its fold."""
    rows = kfold_models(samples, k, params, reduce_scope)
    return scored(samples.withColumn("batch", F.col("fold")), rows).drop("batch")


def predictions(scores: DataFrame) -> DataFrame:
    """Adds predicted."""
    return scores.withColumn("predicted", best_class(F.col("scores"))).drop("scores")


def sweep(
    samples: DataFrame, k: int = 10, params: list[int] = BAYES_DIMENSIONS, reduce_scope: str = "all",
    reduction: str = "selectkbest",
) -> DataFrame:
    """Predictions (sample_id, class_name, fold, param, predicted) for every number of kept features or components."""
    if reduction not in ("selectkbest", "pca"):
        raise ValueError(f"unknown reduction {reduction!r}; use selectkbest or pca")
    scores = component_scores if reduction == "pca" else kfold_scores
    return predictions(scores(samples, k, params, reduce_scope))
