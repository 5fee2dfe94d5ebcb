"""Hierarchical clustering to as many clusters as there are classes, and how clusters meet classes."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.numbers import rounded_ratio

MICRO_CLUSTERS = 256  # summaries that are merged on the driver; never more


def ward_merge(sizes: np.ndarray, centres: np.ndarray, n_clusters: int) -> np.ndarray:
    """Cluster number of each summary, after merging the pair that adds least variance until n_clusters remain."""
    sizes, centres = sizes.astype(float).copy(), centres.astype(float).copy()
    member = np.arange(len(sizes))
    alive = list(range(len(sizes)))
    while len(alive) > max(n_clusters, 1):
        s, c = sizes[alive], centres[alive]
        cost = ((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2) * (s[:, None] * s[None, :]) / (s[:, None] + s[None, :])
        cost[np.tril_indices(len(alive))] = np.inf
        a, b = (alive[i] for i in np.unravel_index(np.argmin(cost), cost.shape))
        centres[a] = (sizes[a] * centres[a] + sizes[b] * centres[b]) / (sizes[a] + sizes[b])
        sizes[a] += sizes[b]
        member[member == b] = a
        alive.remove(b)
    return np.searchsorted(np.array(alive), member)


def _distinct_vectors(samples: DataFrame, limit: int) -> list | None:
    """The distinct vectors if there are at most limit of them.

    A sketch rules out data with many first, so that only data with few is made distinct.
    """
    about = samples.agg(F.approx_count_distinct(F.xxhash64("features"))).first()[0]
    if about > 2 * limit:
        return None
    few = [r[0] for r in samples.select("features").distinct().limit(limit + 1).collect()]
    return few if len(few) <= limit else None


def cluster_assign(
    samples: DataFrame, n_clusters: int | None = None, micro: int = MICRO_CLUSTERS, seed: int = 0,
    bisecting: bool = False,
) -> DataFrame:
    """samples (sample_id, class_name, features) with cluster, 0 .. n_clusters - 1.

    Samples are first gathered in at most `micro` k-means clusters, twice n_clusters at least, whose sizes and means are then merged
    by Ward's criterion.  With no more than `micro` distinct vectors each is its own micro cluster, which
    makes the result that of plain Ward clustering.  bisecting finds the micro clusters by halving.
    """
    if n_clusters is None:
        n_clusters = samples.select("class_name").distinct().count()
    micro = max(micro, 2 * n_clusters)
    few = _distinct_vectors(samples, micro)
    if few is not None:
        order = sorted(few)
        table = samples.sparkSession.createDataFrame(
            [(list(v), i) for i, v in enumerate(order)], "features array<double>, _micro int"
        )
        placed = samples.join(F.broadcast(table), "features")  # at most micro rows
    else:
        vectors = samples.withColumn("_v", array_to_vector("features"))
        finder = BisectingKMeans if bisecting else KMeans
        model = finder(k=micro, seed=seed, featuresCol="_v", predictionCol="_micro", maxIter=10).fit(vectors)
        placed = model.transform(vectors)
    vector = array_to_vector(F.col("features"))
    summary = (
        placed.groupBy("_micro").agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(vector).alias("mean"))
        .orderBy("_micro").collect()  # at most micro rows
    )
    merged = ward_merge(
        np.array([r["n"] for r in summary]), np.array([r["mean"].toArray() for r in summary]), n_clusters
    )
    mapping = F.create_map(*[F.lit(v) for r, c in zip(summary, merged) for v in (int(r["_micro"]), int(c))])
    return placed.withColumn("cluster", F.element_at(mapping, F.col("_micro").cast("int"))).select(
        *samples.columns, "cluster"
    )


def cluster_contingency(assigned: DataFrame) -> DataFrame:
    """(cluster, class_name, n)"""
    return assigned.groupBy("cluster", "class_name").agg(F.count(F.lit(1)).alias("n"))


def cluster_accuracy(assigned: DataFrame, class_idx: str = "class_idx") -> DataFrame:
    """(raw_accuracy, majority_accuracy), 2 decimals.

    raw compares cluster numbers with class numbers; majority lets each cluster stand for its most frequent
    class.
    """
    met = assigned.groupBy("cluster", class_idx).agg(F.count(F.lit(1)).alias("n"))
    per_cluster = met.groupBy("cluster").agg(
        F.max("n").alias("top"), F.sum("n").alias("n"),
        F.sum(F.when(F.col("cluster") == F.col(class_idx), F.col("n")).otherwise(F.lit(0))).alias("same"),
    )
    return per_cluster.agg(
        rounded_ratio(F.sum("same"), F.sum("n")).alias("raw_accuracy"),
        rounded_ratio(F.sum("top"), F.sum("n")).alias("majority_accuracy"),
    )
