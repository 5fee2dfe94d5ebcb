"""Feature selection by ANOVA F, and projection on principal components.

Samples are rows (sample_id, class_name, features array<double>); features are numbered from 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.rows import exploded
from tracewright.session import materialised


# ---- sums ----------------------------------------------------------------------------------------------


def cells_of(samples: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, class_name, j, x)"""
    return exploded(samples, [*keep, "class_name"], F.col("features"), "x", "j")


def feature_sums(samples: DataFrame, by: list[str]) -> DataFrame:
    """(*by, class_name, j, s, ss, sa): sums of x, x*x and |x| per feature.

    Whole vectors are added up, map-side first, so that no row per feature is made of the samples.
    """
    sums = Summarizer.metrics("sum", "normL2", "normL1").summary(array_to_vector("features"))
    vectors = samples.groupBy(*by, "class_name").agg(sums.alias("_s"))
    cells = F.arrays_zip(
        vector_to_array("_s.sum").alias("s"), vector_to_array("_s.normL2").alias("l2"),
        vector_to_array("_s.normL1").alias("sa"),
    )
    return exploded(vectors, [*by, "class_name"], cells, "_x", "j").select(
        *by, "class_name", "j", F.col("_x.s").alias("s"), (F.col("_x.l2") * F.col("_x.l2")).alias("ss"),
        F.col("_x.sa").alias("sa"),
    )


def class_counts(samples: DataFrame, by: list[str]) -> DataFrame:
    """(*by, class_name, n)"""
    return samples.groupBy(*by, "class_name").agg(F.count(F.lit(1)).alias("n"))


# ---- ANOVA ---------------------------------------------------------------------------------------------


ZERO_SHARE = 1e-12  # of the sum of squares: what is no more counts as 0


def anova(sums: DataFrame, counts: DataFrame, by: list[str] = []) -> DataFrame:
    """(*by, j, f_score, rank): F of between-class against within-class variance, best rank 1.

    A feature whose classes do not vary but differ has an infinite score and so the best rank; one without any variance
    has no score and comes last.  Of equal scores the higher feature wins.  Sums of squares are told from 0 by a
    tolerance relative to the feature's own, as the differences of sums seldom cancel exactly.
    """
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_c"))
    sums = sums.join(counts, [*by, "class_name"]).groupBy(*by, "j").agg(
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("_between"), F.sum("s").alias("_s"), F.sum("ss").alias("_ss")
    )
    if by:
        rows = sums.join(totals, by)
    else:
        rows = sums.withColumn("_t", totals.select(F.struct("_n", "_c")).scalar()).select("*", "_t.*").drop("_t")
    among = F.col("_between") - F.col("_s") * F.col("_s") / F.col("_n")
    inside = F.col("_ss") - F.col("_between")
    least = F.col("_ss") * ZERO_SHARE
    score = F.when(inside > least, (among / (F.col("_c") - 1)) / (inside / (F.col("_n") - F.col("_c")))).when(
        among > least, F.lit(float("inf")))
    # one row per feature
    rank = F.row_number().over(
        W.partitionBy(*(by or [F.lit(0)])).orderBy(F.round("f_score", 9).desc_nulls_last(), F.desc("j"))
    )
    return rows.withColumn("f_score", score).withColumn("rank", rank.cast("bigint")).select(
        *by, "j", "f_score", "rank"
    )


def anova_f(samples: DataFrame) -> DataFrame:
    return anova(feature_sums(samples, []), class_counts(samples, []))


def selected_features(scores: DataFrame, k: int) -> Column:
    """Numbers of the k best features in their original order, as a scalar."""
    return scores.filter(F.col("rank") <= k).agg(F.array_sort(F.collect_list("j")).alias("j")).scalar()


def select_kbest(samples: DataFrame, k: int, scores: DataFrame | None = None) -> DataFrame:
    """Features cut down to the k best, in their original order; all of them if there are not more than k."""
    kept = selected_features(anova_f(samples) if scores is None else scores, k)
    return samples.withColumn("_kept", kept).withColumn(
        "features", F.expr("transform(_kept, j -> features[cast(j - 1 as int)])")
    ).drop("_kept")


# ---- principal components ------------------------------------------------------------------------------


def _fit_pca(samples: DataFrame, k: int):
    vectors = samples.withColumn("_v", array_to_vector("features"))
    centre = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(vectors)
    centred = centre.transform(vectors)
    return PCA(k=k, inputCol="_c", outputCol="_p").fit(centred), centred


def pca_project(samples: DataFrame, k: int) -> DataFrame:
    """Features replaced by their k principal components, centred.

    A component points where its largest loading (by size) is positive.
    """
    model, centred = _fit_pca(samples, k)
    loadings = model.pc.toArray()  # features x k
    signs = [1.0 if max(loadings[:, c], key=abs) >= 0 else -1.0 for c in range(k)]
    turned = F.zip_with(vector_to_array("_p"), F.array(*[F.lit(s) for s in signs]), lambda v, s: v * s)
    return model.transform(centred).withColumn("features", turned).drop("_v", "_c", "_p")


def pca_explained(samples: DataFrame, k: int) -> DataFrame:
    """(component, ratio): share of the variance of each component."""
    model, _ = _fit_pca(samples, k)
    rows = [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance.toArray())]
    return samples.sparkSession.createDataFrame(rows, "component bigint, ratio double")


def projection(samples: DataFrame, dimension: int = 2) -> DataFrame:
    """(sample_id, x1, x2[, x3], class_name): the table behind a scatter plot."""
    projected = pca_project(samples, dimension)
    axes = [F.element_at("features", i + 1).alias(f"x{i + 1}") for i in range(dimension)]
    return projected.select("sample_id", *axes, "class_name")


def program_projection(samples: DataFrame, program: str, dimension: int = 2, separator: str = "_") -> DataFrame:
    """The same for one program, that is its original and its variants."""
    name = F.col("sample_id")
    return projection(samples.filter((name == program) | name.startswith(program + separator)), dimension)


# ---- axes of many batches ------------------------------------------------------------------------------

MAX_AXIS_NUMBERS = 8_000_000  # of all batches' axes together, 64 MB: they are sent to all tasks


def scatters(samples: DataFrame, batch: str) -> tuple[DataFrame, list[float]]:
    """(batch, sums): n, the sums and the products of all pairs of features, and the point they are taken from.

    A task adds up whole matrices of its rows, and the tasks' matrices are added, so nothing is made per pair of features.
    Sums are taken from the mean of all samples, as sums of large numbers would not leave their small differences.
    """
    rows = samples.filter("features is not null")
    mean = rows.select(Summarizer.mean(array_to_vector("features")).alias("m")).first()["m"]
    centre = [] if mean is None else mean.toArray().tolist()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[object, np.ndarray] = {}
        for part in batches:
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) - np.array(centre)
            own = part.column(0).to_pylist()
            for b in set(own):
                y = x[[o == b for o in own]]
                sums = np.concatenate([[len(y)], y.sum(0), (y.T @ y).ravel()])
                total[b] = total[b] + sums if b in total else sums
        for b, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([sums], pa.list_(pa.float64()))], ["batch", "sums"])

    parts = rows.select(F.col(batch).cast("long").alias("batch"), "features").mapInArrow(added, "batch long, sums array<double>")
    summed = parts.groupBy("batch").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    return materialised(summed), centre


def axes_of(sums: np.ndarray, centre: list[float], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the first k principal axes as columns, and all shares of the variance, from sums of `scatters`."""
    n, d = sums[0], len(centre)
    shift = sums[1:d + 1] / n
    values, axes = np.linalg.eigh(sums[d + 1:].reshape(d, d) / n - np.outer(shift, shift))
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1][:, :k]
    largest = axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])]
    return np.array(centre) + shift, axes * np.where(largest < 0, -1.0, 1.0), values / max(values.sum(), 1e-300)


def principal_axes(samples: DataFrame, k: int, batch: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and the first k axes of the samples of each batch; smaller k are a prefix of them."""
    sums, centre = scatters(samples, batch)
    return {r.batch: axes_of(np.array(r.sums), centre, k)[:2] for r in sums.toLocalIterator()}


def held_out_axes(samples: DataFrame, k: int, batch: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The same for the training part of each batch: the sums of all samples minus the batch's own."""
    sums, centre = scatters(samples, batch)
    whole = sums.select(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums")).first()["sums"]
    parts = sums.filter("batch is not null").toLocalIterator()  # one matrix at a time
    return {r.batch: axes_of(np.array(whole) - np.array(r.sums), centre, k)[:2] for r in parts if r.sums[0] < whole[0]}


def checked_axes(axes: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
    """Raises where the axes of all batches are too large to be sent to all tasks."""
    numbers = sum(a.size for _, a in axes.values())
    if numbers > MAX_AXIS_NUMBERS:
        raise ValueError(f"{numbers} numbers of axes; at most {MAX_AXIS_NUMBERS}")


def projected(samples: DataFrame, axes: dict[int, tuple[np.ndarray, np.ndarray]], batch: str) -> DataFrame:
    """Features replaced by their places on the axes of their batch; a batch without axes has null ones."""
    checked_axes(axes)
    shared = samples.sparkSession.sparkContext.broadcast(axes)

    @F.pandas_udf("array<double>")
    def onto(batches: pd.Series, features: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(features), dtype=object)
        for b in batches.dropna().unique():
            rows = np.flatnonzero((batches == b).to_numpy() & features.notna().to_numpy())
            if int(b) in shared.value and len(rows):
                mean, axes = shared.value[int(b)]
                places = (np.stack(features.iloc[rows].to_list()) - mean) @ axes
                for row, place in zip(rows, places):
                    out.iat[row] = place
        return out

    return samples.withColumn("features", onto(F.col(batch).cast("long"), "features"))


def reduce_features(samples: DataFrame, method: str, k: int) -> DataFrame:
    """selectkbest, pca or none."""
    method = method.lower()
    if method == "selectkbest":
        return select_kbest(samples, k)
    if method == "pca":
        return pca_project(samples, k)
    if method == "none":
        return samples
    raise ValueError(f"unknown reduction {method!r}; use selectkbest, pca or none")
