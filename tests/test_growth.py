"""Trees that grow together, against a plain recursive one."""

import math
import random

import numpy as np
import pytest

from tracewright.operators import growth, subtrees, tree


def impurity(classes, criterion):
    n = len(classes)
    shares = [classes.count(c) / n for c in set(classes)]
    return 1 - sum(p * p for p in shares) if criterion == "gini" else -sum(p * math.log2(p) for p in shares)


def plain_split(rows, criterion):
    """(gain, feature, threshold) of the best split of (class, vector) rows, or None."""
    best, classes = None, [c for c, _ in rows]
    for j in range(len(rows[0][1])):
        values = sorted({x[j] for _, x in rows})
        for a, b in zip(values, values[1:]):
            left, right = [c for c, x in rows if x[j] <= a], [c for c, x in rows if x[j] > a]
            gain = round(impurity(classes, criterion) - len(left) / len(rows) * impurity(left, criterion)
                         - len(right) / len(rows) * impurity(right, criterion), 9)
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, j, (a + b) / 2)
    return best


def plain_predicted(rows, vector, criterion, depth):
    for _ in range(depth):
        split = plain_split(rows, criterion)
        if split is None:
            break
        rows = [(c, x) for c, x in rows if (x[split[1]] <= split[2]) == (vector[split[1]] <= split[2])]
    classes = [c for c, _ in rows]
    return min(set(classes), key=lambda c: (-classes.count(c), c))


def samples(n=90, k=3):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        x = [float(rng.randrange(6)), rng.random(), float(rng.randrange(2))]
        rows.append((i, "abcd"[(int(x[0]) + rng.randrange(2)) % 4], x, i * k // n))
    return rows


SCHEMA = "sample_id long, class_name string, features array<double>, fold int"


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
@pytest.mark.parametrize("few", [growth.FEW_CELLS, 0])
def test_kfold(spark, criterion, few, monkeypatch):
    splits = growth.best_splits
    monkeypatch.setattr(growth, "best_splits", lambda cells, c, keys: splits(cells, c, keys, few))
    rows = samples()
    got = {(r.sample_id, r.param): r.predicted for r in growth.kfold_predictions(
        spark.createDataFrame(rows, SCHEMA), 3, criterion, [1, 3, 4]).collect()}
    assert len(got) == 3 * len(rows)
    for f in range(3):
        train = [(r[1], r[2]) for r in rows if r[3] != f]
        for r in [r for r in rows if r[3] == f][::4]:
            assert [got[r[0], d] for d in (1, 3, 4)] == [plain_predicted(train, r[2], criterion, d) for d in (1, 3, 4)]


def test_deep_trees_end_at_pure_nodes_and_equal_vectors(spark):
    rows = [(i, "ab"[i % 2], [float(i // 2)], 0) for i in range(20)] + [(99, "c", [50.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.sample_id: r.predicted for r in growth.fit_predict(df, df, "gini", 40).collect()}
    assert got[99] == "c" and all(got[i] == "a" for i in range(20))


def test_many_classes_null_vectors_and_batches_without_rows(spark):
    rows = [(i, f"c{i:04d}", [float(i), 1.0], 0) for i in range(1500)] + [(5000, "x", None, 0), (5001, None, [3.2, 1.0], 7)]
    df = spark.createDataFrame(rows, SCHEMA)
    train = df.selectExpr("0 as batch", "sample_id < 1500 as train", "class_name", "features")
    trees = growth.grown(train, "entropy", 2)
    assert len(trees[0]) == 7
    tested = df.selectExpr("sample_id", "class_name", "features", "fold as batch")
    got = {r.sample_id: r.predicted for r in growth.predicted(tested, trees, [2]).collect()}
    assert got[5000] is got[5001] is None and got[0] == "c0000" and len(got) == len(rows)


def test_holdout_and_bad_arguments(spark):
    rows = [(c, s, 10 * c + i, "ab"[i % 2], [float(i % 2), 0.5]) for c in range(3) for i in range(8) for s in ("train", "test")]
    df = spark.createDataFrame(rows, "cycle int, split string, sample_id long, class_name string, features array<double>")
    got = growth.holdout_predictions(df, "gini", [1, 2]).collect()
    assert len(got) == 48 and all(r.predicted == r.class_name for r in got)
    with pytest.raises(ValueError):
        growth.grown(df, "other", 2)
    with pytest.raises(ValueError):
        growth.grown(df, "gini", 100)


def test_best_first_splits_with_any_number_of_classes(spark):
    rows = [(i, f"c{i % 1001}", [float(i % 1001), 5.0, float(i % 1001 >= 400)]) for i in range(2002)]
    samples = spark.createDataFrame(rows, "sample_id int, class_name string, features array<double>")
    got = {r.j: (r.threshold, r.gain) for r in tree.best_splits(samples, "gini").collect()}
    # 1 - 1/1001 - (400 (1 - 1/400) + 601 (1 - 1/601)) / 1001 for every cut: the lowest is taken
    assert got == {1: (0.5, round(1 / 1001, 9)), 3: (0.5, round(1 / 1001, 9))}
    blank = samples.limit(0)
    assert tree.best_splits(blank, "entropy").count() == 0


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
@pytest.mark.parametrize("cells", [0, 120, growth.LOCAL_CELLS])
def test_levels_and_subtrees_give_the_same_trees(spark, criterion, cells, monkeypatch):
    """Nodes of more than `cells` values grow level by level, the others in one task: all, some and none of them."""
    monkeypatch.setattr(growth, "LOCAL_CELLS", cells)
    rows = samples(120)
    got = {(r.sample_id, r.param): r.predicted for r in growth.kfold_predictions(
        spark.createDataFrame(rows, SCHEMA), 3, criterion, [0, 2, 5]).collect()}
    for f in range(3):
        train = [(r[1], r[2]) for r in rows if r[3] != f]
        for r in [r for r in rows if r[3] == f][::4]:
            assert [got[r[0], d] for d in (0, 2, 5)] == [plain_predicted(train, r[2], criterion, d) for d in (0, 2, 5)]


def test_a_small_tree_needs_no_pass_for_each_level(spark, monkeypatch):
    """Sixteen levels on a few rows: their values are never exploded and shuffled by level."""
    monkeypatch.setattr(growth, "best_splits", lambda *_: pytest.fail("a level of its own"))
    df = spark.createDataFrame(samples(), SCHEMA)
    assert growth.kfold_predictions(df, 3, "entropy", [16]).count() == 90


@pytest.mark.parametrize("cells", [0, growth.LOCAL_CELLS])
def test_missing_values_and_classes(spark, cells, monkeypatch):
    monkeypatch.setattr(growth, "LOCAL_CELLS", cells)
    rows = [(i, [None, "b", "c"][i // 10], [float(i // 10) if i % 4 else None, float("nan") if i % 5 == 0 else 1.0], 0) for i in range(30)]
    train = spark.createDataFrame(rows, SCHEMA).selectExpr("0 as batch", "true as train", "class_name", "features")
    tree_ = growth.grown(train, "gini", 1)[0]
    assert tree_[1][:4] == (None, 1, 0.5, 0.0) and tree_[2][0] is None and tree_[3][0] in ("b", "c")


def test_thresholds_between_all_values_where_features_have_many(spark):
    """6 000 values of a feature: the second split lies midway to a value that only another node has."""
    rows = [(i, "a" if i < 3000 else "b", [float(i), float(i % 2)], 0) for i in range(6000)]
    rows += [(9000, "c", [2999.5, 5.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    train = df.selectExpr("0 as batch", "true as train", "class_name", "features")
    trees = growth.grown(train, "gini", 2)
    moved = growth.between_all(train, trees)
    assert trees[0][1][1:3] == moved[0][1][1:3] == (1, 2999.25)
    tested = spark.createDataFrame([(1, "?", [2999.1, 0.0]), (2, "?", [2999.4, 0.0])], "sample_id long, class_name string, features array<double>")
    got = {r.sample_id: r.predicted for r in growth.fit_predict(df, tested, "gini", 1, between="all").collect()}
    assert got == {1: "a", 2: "b"}


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_large_nodes_need_no_class_counts_of_all_batches(spark, criterion, monkeypatch):
    """Levels of large nodes, in ranges of 40 rows, of values that repeat and values that do not; also where one value is in most rows."""
    monkeypatch.setattr(growth, "LOCAL_CELLS", 100)
    monkeypatch.setattr(growth, "RANGE_ROWS", 40)
    monkeypatch.setattr(growth, "best_splits", lambda *_: pytest.fail("a table of class counts for each level"))
    rng = random.Random(7)
    rows = [(i, c, [*x, 0.0 if rng.random() < 0.8 else rng.random()], f) for i, c, x, f in samples(150)]
    got = {(r.sample_id, r.param): r.predicted for r in growth.kfold_predictions(
        spark.createDataFrame(rows, SCHEMA), 3, criterion, [0, 2, 5]).collect()}
    for f in range(3):
        train = [(r[1], r[2]) for r in rows if r[3] != f]
        for r in [r for r in rows if r[3] == f][::4]:
            assert [got[r[0], d] for d in (0, 2, 5)] == [plain_predicted(train, r[2], criterion, d) for d in (0, 2, 5)]


@pytest.mark.parametrize("rows_a_range", [30, growth.RANGE_ROWS])
def test_large_nodes_with_missing_values_repeated_rows_and_few_or_many_batches(spark, rows_a_range, monkeypatch):
    """Trees of large nodes are those of small ones, whatever the ranges."""
    rng = random.Random(11)
    rows = [(b, rng.random() < 0.8, rng.choice(["a", "b", "c", None]),
             [rng.choice([None, float("nan"), 1.0, 2.0, 3.0]), rng.random(), float(rng.random() < 0.1)]) for b in (3, 8) for _ in range(120)]
    rows += rows[:60] + [(8, True, "a", None), (9, False, "a", [1.0, 1.0, 1.0]), (None, True, "b", [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "batch int, train boolean, class_name string, features array<double>")
    small = growth.grown(df, "entropy", 4)
    monkeypatch.setattr(growth, "LOCAL_CELLS", 0)
    monkeypatch.setattr(growth, "RANGE_ROWS", rows_a_range)
    assert growth.grown(df, "entropy", 4) == small and set(small) == {3, 8} and len(small[3]) > 8


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_sums_of_more_rows_than_the_table_has(criterion, monkeypatch):
    rng = np.random.default_rng(3)
    x, codes = rng.integers(0, 30, (400, 3)).astype(float), rng.integers(0, 4, 400)
    looked_up = subtrees.subtree(x, codes, criterion, 5)
    monkeypatch.setattr(subtrees, "TABLE", 0)
    assert subtrees.subtree(x, codes, criterion, 5) == looked_up


def test_vectors_without_values_and_of_different_lengths(spark, monkeypatch):
    monkeypatch.setattr(growth, "LOCAL_CELLS", 0)
    empty = spark.createDataFrame([(0, True, c, []) for c in "abb"], "batch int, train boolean, class_name string, features array<double>")
    assert growth.grown(empty, "gini", 3) == {0: {1: ("b", 0, 0.0, 0.0)}}
    mixed = empty.union(spark.createDataFrame([(0, True, "c", [1.0, 2.0])], empty.schema)).coalesce(1)
    with pytest.raises(Exception, match="vectors of 0 and 2 values"):
        growth.grown(mixed, "gini", 3)
