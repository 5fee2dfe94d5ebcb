"""Principal components inside the naive Bayes experiments, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import bayes, holdout, reduce


def samples(spark, n=120, d=6, folds=4, partitions=3):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, d)) * np.arange(1, d + 1) + 1000
    rows = [(i, "abc"[i % 3], (x[i] + (i % 3)).tolist(), i * folds // n) for i in range(n)]
    df = spark.createDataFrame(rows, "sample_id long, class_name string, features array<double>, fold int")
    return df.repartition(partitions), rows


def plain_axes(x, k):
    x = np.array(x)
    _, s, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    axes = axes[:k].T
    return x.mean(0), axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(k)]), s ** 2 / (s ** 2).sum()


def plain_bayes(train, test):
    """Predicted class of each vector: multinomial with 1 added, class shares as priors."""
    classes = sorted({c for c, _ in train})
    best = []
    for x in test:
        scores = []
        for c in classes:
            of = np.abs([v for k, v in train if k == c])
            sums = of.sum(0)
            scores.append(round(np.log(len(of) / len(train)) + np.abs(x) @ np.log((sums + 1) / (sums.sum() + len(sums))), 9))
        best.append(classes[int(np.argmax(scores))])
    return best


@pytest.mark.parametrize("partitions", [1, 7])
def test_axes_of_each_batch(spark, partitions):
    df, rows = samples(spark, partitions=partitions)
    found = reduce.principal_axes(df, 3, "fold")
    apart = reduce.held_out_axes(df, 3, "fold")
    assert set(found) == set(apart) == {0, 1, 2, 3}
    for f in range(4):
        for got, x in ((found[f], [r[2] for r in rows if r[3] == f]), (apart[f], [r[2] for r in rows if r[3] != f])):
            mean, axes, _ = plain_axes(x, 3)
            assert np.allclose(got[0], mean) and np.allclose(got[1], axes, atol=1e-8)


def test_fewer_components_are_a_prefix(spark):
    df, _ = samples(spark)
    df = df.withColumn("_all", F.lit(0))
    many, few = reduce.principal_axes(df, 5, "_all")[0][1], reduce.principal_axes(df, 2, "_all")[0][1]
    assert np.allclose(many[:, :2], few)


def test_projected_leaves_null_vectors_and_unknown_batches(spark):
    df, _ = samples(spark)
    more = df.unionByName(spark.createDataFrame([(900, "a", None, 0), (901, "a", [1.0] * 6, 77), (902, "a", [1.0] * 6, None)], df.schema))
    got = {r.sample_id: r.features for r in reduce.projected(more, reduce.principal_axes(df, 2, "fold"), "fold").collect()}
    assert got[900] is got[901] is None and len(got[0]) == 2


@pytest.mark.parametrize("scope", ["all", "train"])
def test_sweep_on_components(spark, scope):
    df, rows = samples(spark)
    got = {(r.sample_id, r.param): r.predicted for r in bayes.sweep(df, 4, [2, 4], scope, "pca").collect()}
    assert len(got) == 2 * len(rows)
    for f in range(4):
        train, test = [r for r in rows if r[3] != f], [r for r in rows if r[3] == f]
        mean, axes, _ = plain_axes([r[2] for r in (rows if scope == "all" else train)], 4)
        for k in (2, 4):
            def on(r):
                return ((np.array(r[2]) - mean) @ axes)[:k]

            want = plain_bayes([(r[1], on(r)) for r in train], [on(r) for r in test])
            assert [got[r[0], k] for r in test] == want


def test_unknown_reduction(spark):
    df, _ = samples(spark)
    with pytest.raises(ValueError):
        bayes.sweep(df, 4, [2], reduction="lda")
    with pytest.raises(ValueError):
        bayes.sweep(df, 4, [2], "some", "pca")


@pytest.mark.parametrize("fit", ["train", "separate"])
def test_holdout_on_components(spark, fit):
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 4) if i % 5 else None, "xy"[i % 2]) for i in range(60)]
    members = spark.createDataFrame(rows, "sample_id long, own int, class_name string")
    cells = spark.createDataFrame(
        [(i, own, c, f"t{t}", int(rng.integers(1, 9))) for i, own, c in rows for t in range(8) if rng.random() < 0.7],
        "sample_id long, own int, class_name string, token string, tf long")
    got = holdout.holdout_components(cells, members, 4, 6, [2, 3], fit).collect()
    dense = {}
    for r in holdout.holdout_vectors(cells, members, 4, 6, fit).collect():
        dense.setdefault((r.cycle, r.split), []).append((r.sample_id, r.class_name, np.array(r.features)))
    assert len(got) == 2 * sum(1 for r in rows if r[1] is not None)
    for cycle in range(4):
        parts = {}
        for split in ("train", "test"):
            mean, axes, _ = plain_axes([x for _, _, x in dense[cycle, split if fit == "separate" else "train"]], 3)
            parts[split] = [(i, c, (x - mean) @ axes) for i, c, x in dense[cycle, split]]
        for k in (2, 3):
            want = plain_bayes([(c, x[:k]) for _, c, x in parts["train"]], [x[:k] for _, _, x in parts["test"]])
            found = {r.sample_id: r.predicted for r in got if r.cycle == cycle and r.param == k}
            assert [found[i] for i, _, _ in parts["test"]] == want
