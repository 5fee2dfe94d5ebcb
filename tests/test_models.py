"""Selection, classification, projections, clusters and Markov models against plain computations."""

import itertools

import numpy as np
import pytest
from pyspark.ml.feature import UnivariateFeatureSelector
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tracewright.operators import bayes, cluster, hmm, holdout, reduce, split, text, tree

N, D = 120, 6


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, N)
    x = rng.normal(size=(N, D)) + y[:, None] * np.array([0.1, 0, 1.5, 0, 0.7, 0.3])
    return x.round(3), y


@pytest.fixture(scope="module")
def samples(spark, data):
    x, y = data
    rows = [(i, str(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "sample_id bigint, class_name string, features array<double>")


def f_scores(x, y):
    out = []
    for j in range(x.shape[1]):
        groups = [x[y == c, j] for c in np.unique(y)]
        between = sum(len(g) * (g.mean() - x[:, j].mean()) ** 2 for g in groups) / (len(groups) - 1)
        within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(x) - len(groups))
        out.append(between / within)
    return np.array(out)


def bayes_predict(xtr, ytr, xte):
    xtr, xte = np.abs(xtr), np.abs(xte)
    classes = np.unique(ytr)
    s = np.stack([xtr[ytr == c].sum(axis=0) for c in classes])
    theta = np.log((s + 1) / (s.sum(axis=1, keepdims=True) + xtr.shape[1]))
    prior = np.log([np.mean(ytr == c) for c in classes])
    joint = xte @ theta.T + prior
    p = np.exp(joint - joint.max(axis=1, keepdims=True))
    return classes[joint.argmax(axis=1)], p / p.sum(axis=1, keepdims=True)


def test_anova(samples, data):
    got = {r.j: (r.f_score, r["rank"]) for r in reduce.anova_f(samples).collect()}
    want = f_scores(*data)
    assert [got[j + 1][0] for j in range(D)] == pytest.approx(want)
    assert sorted(range(D), key=lambda j: -want[j]) == sorted(range(D), key=lambda j: got[j + 1][1])
    kept = reduce.select_kbest(samples, 3).orderBy("sample_id").collect()
    columns = sorted(np.argsort(-want)[:3])
    assert np.array([r.features for r in kept]).tolist() == data[0][:, columns].tolist()
    spark_choice = UnivariateFeatureSelector(featuresCol="v", labelCol="l", outputCol="o").setFeatureType(
        "continuous").setLabelType("categorical").setSelectionThreshold(3)
    fitted = spark_choice.fit(samples.withColumn("v", array_to_vector("features")).withColumn("l", F.col("class_name").cast("double")))
    assert sorted(fitted.selectedFeatures) == columns


def test_select_of_more_than_all_changes_nothing(samples):
    same = reduce.select_kbest(samples, 99).exceptAll(samples)
    assert same.count() == 0


def test_equal_scores_go_to_the_higher_feature(spark):
    rows = [(i, str(i % 2), [float(i % 2) + i * 0.01, float(i % 2) + i * 0.01, 1.0]) for i in range(6)]
    df = spark.createDataFrame(rows, "sample_id int, class_name string, features array<double>")
    got = {r["rank"]: (r.j, r.f_score) for r in reduce.anova_f(df).collect()}
    assert got[1][0] == 2 and got[2][0] == 1 and got[3] == (3, None)


def test_bayes(samples, data):
    x, y = data
    train, test = samples.filter("sample_id < 90"), samples.filter("sample_id >= 90")
    rows = bayes.fit_predict(train, test).orderBy("sample_id")
    labels, proba = bayes_predict(x[:90], y[:90], x[90:])
    assert [int(r.predicted) for r in bayes.predictions(rows).orderBy("sample_id").collect()] == labels.tolist()
    got = [[p[1] for p in r.p] for r in rows.select("sample_id", bayes.probabilities(F.col("scores")).alias("p")).orderBy("sample_id").collect()]
    assert np.allclose(got, proba)


def test_large_models_are_joined(samples, monkeypatch):
    folded = split.kfold_assign(samples, "sample_id", 4)
    small = bayes.sweep(folded, 4, [2, 5]).select("sample_id", "param", "predicted").collect()
    monkeypatch.setattr(bayes, "MAX_MODEL_NUMBERS", 10)
    large = bayes.sweep(folded, 4, [2, 5]).select("sample_id", "param", "predicted").collect()
    assert sorted(small) == sorted(large) and len(small) == 2 * N


def test_joined_models_keep_equal_and_empty_samples(samples, monkeypatch):
    one = samples.filter("sample_id = 95").withColumn("batch", F.lit(0))
    asked = one.unionByName(one).unionByName(one.withColumn("features", F.array().cast("array<double>")))
    model = samples.sparkSession.createDataFrame(
        [(0, 1, "a", -0.5, [-1.0, -2.0]), (0, 1, "b", -1.0, [-2.0, -0.5])],
        "batch int, param int, class_name string, log_prior double, log_theta array<double>")

    def listed():
        return sorted(str([(s.class_name, round(s.score, 9)) for s in sorted(r.scores)]) for r in bayes.scored(asked, model).collect())

    small = listed()
    monkeypatch.setattr(bayes, "MAX_MODEL_NUMBERS", 1)
    assert listed() == small and len(small) == 3


def test_bayes_of_the_ml_library(samples):
    train, test = samples.filter("sample_id < 90"), samples.filter("sample_id >= 90")
    exact = {r.sample_id: r.predicted for r in bayes.predictions(bayes.fit_predict(train, test)).collect()}
    other = {r.sample_id: r.predicted for r in bayes.fit_predict_ml(train, test).collect()}
    assert exact.keys() == other.keys() and sum(exact[i] == other[i] for i in exact) >= 28


@pytest.mark.parametrize("fit", ["train", "separate"])
def test_bayes_after_selection(samples, data, fit):
    x, y = data
    train, test = samples.filter("sample_id < 90"), samples.filter("sample_id >= 90")
    tr = sorted(np.argsort(-f_scores(x[:90], y[:90]))[:2])
    te = tr if fit == "train" else sorted(np.argsort(-f_scores(x[90:], y[90:]))[:2])
    labels, _ = bayes_predict(x[:90][:, tr], y[:90], x[90:][:, te])
    got = bayes.predictions(bayes.fit_predict(train, test, 2, fit)).orderBy("sample_id").collect()
    assert [int(r.predicted) for r in got] == labels.tolist()


@pytest.mark.parametrize("scope", ["all", "train"])
def test_bayes_sweep(samples, data, scope):
    x, y = data
    folded = split.kfold_assign(samples, "sample_id", 7)
    fold = np.array([r.fold for r in folded.orderBy("sample_id").collect()])
    got = {(r.sample_id, r.param): int(r.predicted) for r in bayes.sweep(folded, 7, [2, 4, 99], scope).collect()}
    assert len(got) == 3 * N
    for f, k in itertools.product(range(7), [2, 4, 99]):
        tr, te = fold != f, fold == f
        rank = np.argsort(-(f_scores(x, y) if scope == "all" else f_scores(x[tr], y[tr])))
        columns = sorted(rank[:k])
        labels, _ = bayes_predict(x[tr][:, columns], y[tr], x[te][:, columns])
        assert [got[(int(i), k)] for i in np.nonzero(te)[0]] == labels.tolist()


def impurity(y, criterion):
    if len(y) == 0:
        return 0.0
    p = np.unique(y, return_counts=True)[1] / len(y)
    return 1 - (p**2).sum() if criterion == "gini" else -(p * np.log2(p)).sum()


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_best_splits(samples, data, criterion):
    x, y = data
    for r in tree.best_splits(samples, criterion).collect():
        v = x[:, r.j - 1]
        cuts = np.unique(v)
        gains = []
        for t in (cuts[1:] + cuts[:-1]) / 2:
            l, right = y[v <= t], y[v > t]
            gains.append((round(impurity(y, criterion) - len(l) / N * impurity(l, criterion) - len(right) / N * impurity(right, criterion), 9), -t))
        best = max(gains)
        assert r.gain == pytest.approx(best[0], abs=1e-8) and r.threshold == pytest.approx(-best[1])


def test_first_split_of_a_tree_is_the_best_split(samples, data):
    x, y = data
    best = max(tree.best_splits(samples, "gini").collect(), key=lambda r: r.gain)
    got = tree.fit_predict(samples, samples, "gini", 1).collect()
    left = {r.predicted for r in got if r.features[best.j - 1] <= best.threshold}
    right = {r.predicted for r in got if r.features[best.j - 1] > best.threshold}
    assert len(left) == 1 and len(right) == 1
    with pytest.raises(ValueError):
        tree.best_splits(samples, "other")


def test_tree_sweep(samples):
    folded = split.kfold_assign(samples, "sample_id", 3)
    got = tree.kfold_predictions(folded, 3, "gini", [1, 12]).collect()
    assert len(got) == 2 * N
    # a deep tree on its own training rows is right everywhere
    fitted = tree.fit_predict(samples, samples, "gini", 16).collect()
    assert all(r.predicted == r.class_name for r in fitted)


def test_pca(samples, data):
    x, _ = data
    got = np.array([r.features for r in reduce.pca_project(samples, D).orderBy("sample_id").collect()])
    assert np.allclose(got.mean(axis=0), 0)
    cov = np.cov(got.T)
    assert np.allclose(cov, np.diag(np.diag(cov)), atol=1e-9)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose(np.diag(cov), values)
    ratios = [r.ratio for r in reduce.pca_explained(samples, D).orderBy("component").collect()]
    assert np.allclose(ratios, values / values.sum())
    flat = reduce.projection(samples, 3)
    assert flat.columns == ["sample_id", "x1", "x2", "x3", "class_name"]
    named = samples.withColumn("sample_id", F.when(F.col("sample_id") < 5, "p").otherwise(F.concat(F.lit("p"), F.col("sample_id") % 2, F.lit("_"), "sample_id")))
    assert reduce.program_projection(named, "p1").count() == sum(i % 2 for i in range(5, N))
    assert reduce.reduce_features(samples, "none", 2) is samples
    with pytest.raises(ValueError):
        reduce.reduce_features(samples, "tsne", 2)


# ---- held-out programs ---------------------------------------------------------------------------------


@pytest.mark.parametrize("fit", ["separate", "train"])
def test_tfidf_of_batches_is_that_of_each_batch_alone(spark, fit):
    rng = np.random.default_rng(4)
    bodies = [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 9))) for _ in range(40)]
    own = [None if i % 7 == 6 else i % 3 for i in range(40)]
    rows = [(i, own[i], b) for i, b in enumerate(bodies)]
    docs = spark.createDataFrame(rows, "sample_id int, own int, text string")
    cells = text.term_freq(docs.select("sample_id", "own", text.whitespace_tokens(F.col("text")).alias("tokens")))
    got = {(r.cycle, r.split, r.sample_id, r["rank"]): r.weight for r in holdout.tfidf_batch(cells, docs, 3, 4, fit).collect()}
    want = {}
    for c in range(3):
        batches = {"train": [i for i in range(40) if own[i] != c], "test": [i for i in range(40) if own[i] == c]}
        vocab = {}
        for name, ids in batches.items():
            df = {t: sum(t in bodies[i].split() for i in ids) for t in "abcdefgh"}
            top = sorted((t for t in df if df[t]), key=lambda t: (-df[t], t))[:4]
            vocab[name] = {t: (k + 1, np.log((1 + len(ids)) / (1 + df[t])) + 1) for k, t in enumerate(top)}
        for name, ids in batches.items():
            v = vocab["train" if fit == "train" else name]
            for i in ids:
                raw = {v[t][0]: bodies[i].split().count(t) * v[t][1] for t in set(bodies[i].split()) if t in v}
                norm = np.sqrt(sum(w * w for w in raw.values()))
                want.update({(c, name, i, j): w / norm for j, w in raw.items()})
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


# ---- clusters ------------------------------------------------------------------------------------------


def ward(x, k):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        a, b = min(itertools.combinations(range(len(groups)), 2), key=lambda p: (
            len(groups[p[0]]) * len(groups[p[1]]) / (len(groups[p[0]]) + len(groups[p[1]]))
            * ((x[groups[p[0]]].mean(axis=0) - x[groups[p[1]]].mean(axis=0)) ** 2).sum()))
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


def test_few_vectors_give_plain_ward(samples, data):
    got = {}
    for r in cluster.cluster_assign(samples.filter("sample_id < 40"), 4).collect():
        got.setdefault(r.cluster, set()).add(r.sample_id)
    assert {frozenset(g) for g in got.values()} == ward(data[0][:40], 4) and sorted(got) == [0, 1, 2, 3]


def test_micro_clusters(spark):
    rng = np.random.default_rng(1)
    rows = [(i, str(i % 3), (rng.normal(size=2) * 0.1 + 5 * np.array([i % 3 == 0, i % 3 == 1])).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "sample_id bigint, class_name string, features array<double>")
    got = cluster.cluster_assign(df, micro=20)
    assert got.count() == 300
    pairs = {(r.class_name, r.cluster) for r in got.collect()}
    assert len(pairs) == 3
    halved = {(r.class_name, r.cluster) for r in cluster.cluster_assign(df, micro=20, bisecting=True).collect()}
    assert len(halved) == 3
    accuracy = cluster.cluster_accuracy(got.withColumn("class_idx", F.col("class_name").cast("int"))).first()
    assert accuracy.majority_accuracy == 1.0


def test_as_many_clusters_as_asked(spark):
    rng = np.random.default_rng(2)
    rows = [(i, str(i % 30), rng.normal(size=2).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "sample_id bigint, class_name string, features array<double>")
    assert cluster.cluster_assign(df, micro=20).select("cluster").distinct().count() == 30


def test_separating_features_rank_first(spark):
    rng = np.random.default_rng(3)
    rows = [(i, str(i % 2), [float(rng.normal()), 0.1 * (i % 2) + 0.3, 1 / 3, i % 2 + 1e-3 * rng.normal()]) for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id bigint, class_name string, features array<double>")
    got = {r.rank: r.j for r in reduce.anova_f(df).collect()}
    first = min(got.values())
    assert [got[k] - first for k in (1, 2, 3, 4)] == [1, 3, 0, 2]


# ---- Markov models -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def symbols(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(24):
        name = "xyz"[i % 3]
        letters = {"x": "ab", "y": "bc", "z": "abc"}[name]
        n = 1 if i == 5 else int(rng.integers(2, 30))
        rows += [(f"s{i}", name, t + 1, letters[int(rng.integers(len(letters)))]) for t in range(n)]
    return spark.createDataFrame(rows, "sample_id string, class_name string, step bigint, symbol string")


def forward(sequence, model):
    """Log-likelihood by the plain recursion."""
    index = {s: i for i, s in enumerate(model.alphabet)}
    a, total = np.eye(len(model.transition))[0], 0.0
    for s in sequence:
        if s in index:
            a = (a @ model.transition) * model.emission[:, index[s]]
            if a.sum() == 0:
                return -np.inf
            total += np.log(a.sum())
            a = a / a.sum()
    return total


def test_likelihoods(symbols):
    sequences = {}
    for r in symbols.orderBy("sample_id", "step").collect():
        sequences.setdefault(r.sample_id, []).append(r.symbol)
    models = hmm.start_models(hmm.chunks(symbols, 4), seed=1)
    for chunk, block in ((1000, 8), (4, 1000), (3, 2), (1, 3)):
        got = hmm.log_likelihoods(hmm.chunks(symbols, chunk), models, block).collect()
        assert len(got) == 24 * 3
        for r in got:
            assert r.loglik == pytest.approx(forward(sequences[r.sample_id], models[r.model]))


def test_training_does_not_depend_on_chunks_and_raises_the_likelihood(symbols):
    whole = hmm.chunks(symbols, 1000)
    one, cut = hmm.train(whole, 2, seed=1), hmm.train(hmm.chunks(symbols, 3), 2, seed=1, block=2)
    for name in one:
        assert np.allclose(one[name].transition, cut[name].transition)
        assert np.allclose(one[name].emission, cut[name].emission)
    totals = []
    for n in range(4):
        models = hmm.train(whole, n, seed=1)
        own = hmm.log_likelihoods(whole, models).join(symbols.select("sample_id", F.col("class_name").alias("model")).distinct(), ["sample_id", "model"])
        totals.append({r.model: r.t for r in own.groupBy("model").agg(F.sum("loglik").alias("t")).collect()})
    for before, after in itertools.pairwise(totals):
        assert all(after[m] >= before[m] - 1e-9 for m in before)


def test_similarity(symbols):
    got = hmm.hmm_similarity(symbols, n_iter=1, chunk=5, block=2)
    assert got.count() == 24 * 3 and got.filter("loglik is null").count() == 0


def test_batch_weights_are_taken_from_each_sample_once(spark, capsys):
    """Norms of all cycles come from a sample's own cells: no shuffle or window of cells that are repeated per cycle."""
    from tracewright.operators import holdout

    rows = [(i, i % 4 if i % 5 else None, t, 1 + (i * t) % 3) for i in range(40) for t in range(1 + i % 3)]
    cells = spark.createDataFrame(rows, "sample_id long, own int, token int, tf long").withColumn("token", F.col("token").cast("string"))
    samples = cells.select("sample_id", "own").distinct()
    weights = holdout.tfidf_batch(cells.repartition(4, "sample_id"), samples, 4, 2, "train")
    weights.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(sample_id") == 1 and plan.index("Generate") < plan.index("Window")
    got = weights.collect()
    for cycle in range(4):
        sizes = {}
        for r in got:
            if r.cycle == cycle:
                assert (r.split == "test") == (r.own == cycle)
                sizes[r.sample_id] = sizes.get(r.sample_id, 0) + r.weight ** 2
        assert len(sizes) == 40 and all(abs(s - 1) < 1e-9 for s in sizes.values())
