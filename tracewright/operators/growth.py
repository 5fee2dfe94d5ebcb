"""Decision trees of many batches (folds or cycles), grown together level by level with exact thresholds.

Rows are (batch, train, class_name, features): training rows of a batch grow its tree. Nodes of more than LOCAL_CELLS values split
level by level: each feature of the rows of all of them, in all batches, is brought together in ranges of its values and searched
there (`columns`); a row that is in many batches is sent once. The rows of a smaller node are then
brought together once, whichever level it is on, and the tree below it grows where they are (`subtrees`). Nodes keep
their majority class, so the predictions of every smaller depth are read off the inner nodes of the one tree.

* The impurity of both sides of all thresholds comes from running sums: adding n rows of a class that has l so far changes the sum
  of f(count of class) by f(l + n) - f(l), with f(n) = n * n (gini) or n * log2(n) (entropy). So classes are rows, not columns,
  and there may be any number of them. Values are cut into ranges where rows are many; a range starts from the sums before it.
* A threshold lies midway between neighbouring values of the node, or of the batch (`between_all`). Of equal gains (to 9 decimals) the first feature and then the
  lowest threshold is taken; a node that is pure or gains nothing is a leaf. Of equally frequent classes the first one is predicted.
* A tree is a model: a few numbers for each node. Rows find their node in Arrow batches, a whole level of a batch at a time.

Null vectors take no part in growing and have a null prediction, as have rows of a batch without training rows. The vectors of
all rows must have the same length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.fixed_values import TREE_DEPTHS
from tracewright.functions.rows import exploded
from tracewright.operators import columns
from tracewright.operators.subtrees import grown_below
from tracewright.plans.ordering import global_index, ranged
from tracewright.plans.skew import lookup_join
from tracewright.session import materialised

MAX_NODES = 5_000_000  # of all trees together; they are sent to all tasks
FEW_CELLS = 10_000_000  # class counts of values, some 500 MB; a sort of them spills at worst
LOCAL_CELLS = 8_000_000  # values of a node whose subtree grows in one task: 64 MB, and some five times that while it grows
RANGE_ROWS = 1_000_000  # rows in a range of a feature's values; a task holds them for all batches, some 250 MB for ten
DEEPEST = 60  # nodes are numbered 1, 2n and 2n + 1

Tree = dict[int, tuple]  # node to (class, feature from 1 or 0, threshold, value of the node next below the threshold)


# ---- finding nodes -------------------------------------------------------------------------------------


def _packed(trees: dict[int, Tree]) -> dict[int, columns.Packed]:
    packed = {}
    for batch, tree in trees.items():
        nodes = np.array(sorted(tree), np.int64)
        packed[batch] = (nodes, np.array([tree[n][1] for n in nodes]), np.array([tree[n][2] for n in nodes], float))
    return packed


def placed(rows: DataFrame, trees: dict[int, Tree], depth: int) -> DataFrame:
    """rows with _node: where a row stands after at most `depth` splits; null without a tree or a vector."""
    shared = rows.sparkSession.sparkContext.broadcast(_packed(trees))
    descended = columns.descended

    @F.pandas_udf("long")
    def node(batches: pd.Series, features: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(batches), dtype="Int64")
        for b in batches.dropna().unique():
            at = np.flatnonzero((batches == b).to_numpy() & features.notna().to_numpy())
            if int(b) not in shared.value or not len(at):
                continue
            out.iloc[at] = descended(np.stack(features.iloc[at].to_list()), shared.value[int(b)], depth)
        return out

    return rows.withColumn("_node", node(F.col("batch").cast("long"), "features"))


# ---- splits --------------------------------------------------------------------------------------------


def _weight(n: Column, criterion: str) -> Column:
    n = n.cast("double")
    return n * n if criterion == "gini" else F.when(n > 0, n * F.log2(n)).otherwise(0.0)


def _impurity(total: Column, n: Column, criterion: str) -> Column:
    """From the sum of the weights of n rows' classes."""
    return 1 - total / (n * n) if criterion == "gini" else F.log2(n) - total / n


def _steps(before: Column, n: Column, total: Column, criterion: str) -> dict[str, Column]:
    """What n rows of a class change in the sums of the weights to the left and to the right of a threshold."""
    rest = total - before
    return {"_dl": _weight(before + n, criterion) - _weight(before, criterion),
            "_dr": _weight(rest - n, criterion) - _weight(rest, criterion)}


_UPTO = W.unboundedPreceding


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("_n", "_dl", "_dr")]


def _running(cells: DataFrame, of: list[str], criterion: str) -> DataFrame:
    """(*of, x, _next, _n, _dl, _dr, _all, _whole): running sums at each value. One exchange serves all windows."""
    by_class = W.partitionBy(*of, "class_name")
    rising = by_class.orderBy("x").rowsBetween(_UPTO, -1)
    rows = cells.repartition(*of).withColumns({
        "_before": F.coalesce(F.sum("n").over(rising), F.lit(0)), "_total": F.sum("n").over(by_class)})
    values = rows.withColumns(_steps(F.col("_before"), F.col("n"), F.col("_total"), criterion)).withColumnRenamed("n", "_n").groupBy(
        *of, "x").agg(*_sums())
    along, every = W.partitionBy(*of).orderBy("x"), W.partitionBy(*of)
    return values.select(*of, "x", F.lead("x").over(along).alias("_next"), F.sum("_n").over(every).alias("_all"),
                         F.sum("_dl").over(every).alias("_whole"),
                         *(F.sum(c).over(along.rowsBetween(_UPTO, 0)).alias(c) for c in ("_n", "_dl", "_dr")))


def _running_by_range(cells: DataFrame, of: list[str], criterion: str) -> DataFrame:
    """The same where a node may have any number of values: ranges of values are summed apart, and start from those before."""
    cut, _ = ranged(cells, of, ["x"])
    rising = W.partitionBy(*of, "class_name").orderBy("_range").rowsBetween(_UPTO, -1)
    by_class = cut.groupBy(*of, "_range", "class_name").agg(F.sum("n").alias("_n")).withColumns({
        "_before": F.coalesce(F.sum("_n").over(rising), F.lit(0)),
        "_total": F.sum("_n").over(W.partitionBy(*of, "class_name"))})
    ranges = by_class.withColumns(_steps(F.col("_before"), F.col("_n"), F.col("_total"), criterion)).groupBy(*of, "_range").agg(*_sums())
    firsts = cut.groupBy(*of, "_range").agg(F.min("x").alias("_first"))
    order, every = W.partitionBy(*of).orderBy("_range"), W.partitionBy(*of)  # at most as many rows as there are ranges
    sums = ranges.join(firsts, [*of, "_range"]).select(
        *of, "_range", F.sum("_n").over(every).alias("_all"), F.sum("_dl").over(every).alias("_whole"),
        F.lead("_first").over(order).alias("_next_first"),
        *(F.coalesce(F.sum(c).over(order.rowsBetween(_UPTO, -1)), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_dl", "_dr")))
    inside = W.partitionBy(*of, "_range", "class_name").orderBy("x").rowsBetween(_UPTO, -1)
    stepped = cut.join(by_class.drop("_n"), [*of, "_range", "class_name"]).withColumn(
        "_own", F.col("_before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    values = stepped.withColumns(_steps(F.col("_own"), F.col("n"), F.col("_total"), criterion)).withColumnRenamed("n", "_n").groupBy(
        *of, "_range", "x").agg(*_sums())
    along = W.partitionBy(*of, "_range").orderBy("x")
    running = values.select(*of, "_range", "x", F.lead("x").over(along).alias("_next"),
                            *(F.sum(c).over(along.rowsBetween(_UPTO, 0)).alias(c) for c in ("_n", "_dl", "_dr")))
    return running.join(sums, [*of, "_range"]).select(
        *of, "x", F.coalesce("_next", "_next_first").alias("_next"), "_all", "_whole",
        *((F.col(c) + F.col(f"{c}_before")).alias(c) for c in ("_n", "_dl", "_dr")))


def splits(cells: DataFrame, criterion: str, keys: list[str], few: int = FEW_CELLS) -> DataFrame:
    """(*keys, j, threshold, gain, low): every threshold of each feature in each node, gains to 9 decimals, low is the value below.

    cells are class counts (*keys, j, x, class_name, n). Up to `few` of them need no cut into ranges, as all would fit a
    task; both ways give the same.
    """
    of = [*keys, "j"]
    run = _running if cells.limit(few + 1).count() <= few else _running_by_range
    rows = run(cells, of, criterion).filter("_next is not null")
    whole, n, left = F.col("_whole"), F.col("_all").cast("double"), F.col("_n").cast("double")
    gain = _impurity(whole, n, criterion) - left / n * _impurity(F.col("_dl"), left, criterion) - (
        n - left) / n * _impurity(whole + F.col("_dr"), n - left, criterion)
    return rows.select(*of, ((F.col("x") + F.col("_next")) / 2).alias("threshold"), F.round(gain, 9).alias("gain"),
                       F.col("x").alias("low"))


def best_splits(cells: DataFrame, criterion: str, keys: list[str], few: int = FEW_CELLS) -> DataFrame:
    """(*keys, j, threshold, gain, low): the best split of each node; only splits that gain something are listed."""
    found = splits(cells, criterion, keys, few).select(
        *keys, F.struct((-F.col("gain")).alias("loss"), "j", F.col("threshold").alias("t"), "low").alias("_b"))
    best = found.groupBy(*keys).agg(F.min("_b").alias("_b")).filter("_b.loss < 0")
    return best.select(*keys, F.col("_b.j").alias("j"), F.col("_b.t").alias("threshold"), (-F.col("_b.loss")).alias("gain"),
                       F.col("_b.low").alias("low"))


# ---- growth --------------------------------------------------------------------------------------------


def _standing(train: DataFrame, trees: dict[int, Tree], level: int, nodes: list[tuple], give, schema: str) -> DataFrame:
    """What `give` makes of Arrow batches of training rows, their vectors and, for each tree, the places of their nodes in `nodes`."""
    shared = train.sparkSession.sparkContext.broadcast((_packed({b: trees[b] for b, _ in nodes}), nodes))
    vectors, standing = columns.vectors, columns.standing

    def run(batches):
        for rows in batches:
            if rows.num_rows:
                x = vectors(rows)
                yield from give(rows, x, standing(rows, x, shared.value[0], level, shared.value[1]))

    return train.mapInArrow(run, schema)


def _node_counts(train: DataFrame, trees: dict[int, Tree], level: int, nodes: list[tuple]):
    """(slot, n, classes, top) of each node that has rows: how many rows and classes, and the first most frequent class."""
    counted = columns.class_counts

    def give(rows, x, slots):
        yield counted(rows.column("class_name"), slots)

    found = _standing(train, trees, level, nodes, give, "slot long, class_name string, n long")
    counts = found.groupBy("slot", "class_name").agg(F.sum("n").alias("n"))
    return counts.groupBy("slot").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"),
                                      F.min(F.struct((-F.col("n")).alias("n"), "class_name")).alias("top")).toLocalIterator()


def _cuts(train: DataFrame, trees: dict[int, Tree], level: int, nodes: list[tuple], parts: int) -> list[np.ndarray]:
    """For each feature, values that cut the rows of the nodes into some `parts` ranges of like size, from a sample of 64 a range."""
    most = 64 * parts

    def give(rows, x, slots):
        at = np.flatnonzero((slots >= 0).any(axis=1))
        mixed = x[at].view(np.uint64) >> np.uint64(11)
        pick = (mixed * np.arange(1, 2 * x.shape[1], 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(axis=1).view(np.int64)
        least = np.argsort(pick, kind="stable")[:most]
        yield pa.RecordBatch.from_arrays([pa.array(pick[least]), rows.column("features").take(pa.array(at[least]))], ["pick", "features"])

    picked = _standing(train, trees, level, nodes, give, "pick long, features array<double>")
    sample = picked.orderBy("pick", "features").limit(most).collect()
    rows = np.array([r.features for r in sample], float)
    found = []
    for column in rows.T:
        v = np.sort(column[~np.isnan(column)])
        found.append(np.unique(v[[len(v) * i // parts for i in range(1, parts)]]) if len(v) else v)
    return found


def _before(blocks: DataFrame, trees: int, many: bool, parts: int) -> DataFrame:
    """(j, part, slot, code, before, total, next) of blocks: for all classes that a slot has, rows before the part and in all parts."""
    part_counts = columns.part_counts
    counts = materialised(blocks.groupBy("j", "part").applyInPandas(
        lambda rows: part_counts(rows, trees, many), "j long, part long, slot long, code int, n long, first double"))
    keys = ["j", "slot", "code"]
    none = counts.select(*keys).distinct().select(
        "j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "slot", "code",
        F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("first"))
    every = counts.unionByName(none).groupBy(*keys, "part").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    of_class = W.partitionBy(*keys)
    later = W.partitionBy("j", "slot").orderBy("part").rangeBetween(1, W.unboundedFollowing)
    return every.select(*keys, "part", F.coalesce(F.sum("n").over(of_class.orderBy("part").rowsBetween(_UPTO, -1)), F.lit(0)).alias("before"),
                        F.sum("n").over(of_class).alias("total"), F.min("first").over(later).alias("next"))


def _level_splits(train: DataFrame, trees: dict[int, Tree], level: int, nodes: list[tuple], criterion: str, width: int, parts: int):
    """(slot, j, threshold, low): the best split of each of the nodes, where one gains something."""
    cuts = _cuts(train, trees, level, nodes, parts) if parts > 1 else []
    made, best_of_part = columns.blocks, columns.best_of_part
    of_trees, many = len({b for b, _ in nodes}), len(nodes) >= 1 << 15

    def give(rows, x, slots):
        yield made(x, rows.column("code").to_numpy(zero_copy_only=False), slots, cuts)

    blocks = _standing(train, trees, level, nodes, give, "j long, part long, v binary, c binary, n binary, s binary")
    blocks = blocks.repartition(min(4 * max(width, 1) * parts, 4000), "j", "part")  # few rows, but of much work
    result = "slot long, loss double, j long, threshold double, low double"
    if parts == 1:
        found = blocks.groupBy("j", "part").applyInPandas(lambda rows: best_of_part(rows, of_trees, many, criterion), result)
    else:
        blocks = materialised(blocks)
        before = _before(blocks, of_trees, many, parts)
        found = blocks.groupBy("j", "part").cogroup(before.groupBy("j", "part")).applyInPandas(
            lambda rows, known: best_of_part(rows, of_trees, many, criterion, known) if len(rows) else pd.DataFrame(
                columns=["slot", "loss", "j", "threshold", "low"]), result)
    best = found.groupBy("slot").agg(F.min(F.struct("loss", "j", "threshold", "low")).alias("_b"))
    return best.select("slot", "_b.j", "_b.threshold", "_b.low").toLocalIterator()


def _grown_apart(train: DataFrame, trees: dict[int, Tree], level: int, roots: list[tuple], criterion: str, depth: int):
    """The nodes below small nodes (batch, node), each grown in the task that gets its rows."""

    def below(group: pd.DataFrame) -> pd.DataFrame:
        return grown_below(group, criterion, depth)

    def give(rows, x, slots):
        for t in range(slots.shape[1]):
            at = np.flatnonzero(slots[:, t] >= 0)
            batch, node = (np.array(a, np.int64)[slots[at, t]] for a in zip(*roots))
            kept = rows.select(["class_name", "features"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(batch), pa.array(node), *kept.columns], ["batch", "_node", "class_name", "features"])

    dealt = _standing(train, trees, level, roots, give, "batch long, _node long, class_name string, features array<double>").repartition(
        min(4 * len(roots), 4000), "batch", "_node")  # a number of its own: tasks are long, not their rows many
    nodes = dealt.groupBy("batch", "_node").applyInPandas(
        below, "batch long, _node long, class_name string, j long, threshold double, low double")
    return materialised(nodes).toLocalIterator()  # which would grow one partition after the other


def _coded(train: DataFrame) -> DataFrame:
    """train with code, a number for each class; -1 for none."""
    names = global_index(materialised(train.filter("class_name is not null").select("class_name").distinct()), ["class_name"], "code")
    joined = lookup_join(train, names, ["class_name"], ["features"], "left")
    return joined.withColumn("code", F.coalesce(F.col("code").cast("int"), F.lit(-1)))


def _check(criterion: str, depth: int) -> None:
    if criterion not in ("gini", "entropy"):
        raise ValueError(f"unknown criterion {criterion!r}; use gini or entropy")
    if not 0 <= depth <= DEEPEST:
        raise ValueError(f"a depth from 0 to {DEEPEST}")


def grown(rows: DataFrame, criterion: str, depth: int) -> dict[int, Tree]:
    """The trees of all batches, at most `depth` splits deep."""
    _check(criterion, depth)
    return _grown(rows.filter("train and batch is not null").withColumn("batches", F.array("batch")), criterion, depth)


def _grown(rows: DataFrame, criterion: str, depth: int) -> dict[int, Tree]:
    """The same from training rows (batches, class_name, features), each with the batches that it is in."""
    _check(criterion, depth)
    train = rows.filter("features is not null").select(
        F.col("batches").cast("array<bigint>").alias("batches"), "class_name", F.col("features").cast("array<double>").alias("features"))
    sizes = train.select(F.explode("batches").alias("batch"), F.size("features").alias("p")).groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.max("p").alias("p")).collect()
    trees: dict[int, Tree] = {r.batch: {1: (None, 0, 0.0, 0.0)} for r in sizes}
    width = max((r.p for r in sizes), default=0)

    def is_small(n: int) -> bool:
        return 0 < n * width <= LOCAL_CELLS

    apart = [(r.batch, 1) for r in sizes if is_small(r.n)]
    reached = sorted((r.batch, 1) for r in sizes if not is_small(r.n))
    coded = _coded(train) if reached else train
    all_rows = train.count() if reached else 0
    level = 0
    while reached:
        large, rows_of = [], 0
        for r in _node_counts(train, trees, level, reached):  # a row for each node
            batch, node = reached[r.slot]
            trees[batch][node] = (r.top.class_name, 0, 0.0, 0.0)
            if is_small(r.n):
                apart.append((batch, node))
            elif r.classes > 1:
                large.append((batch, node))
                rows_of += r.n
        if level == depth or not large:
            break
        large.sort()
        parts = -(-min(rows_of, all_rows) // RANGE_ROWS)
        reached = []
        for r in _level_splits(coded, trees, level, large, criterion, width, parts):
            batch, node = large[r.slot]
            trees[batch][node] = (trees[batch][node][0], int(r.j), float(r.threshold), float(r.low))
            for child in (2 * node, 2 * node + 1):
                trees[batch][child] = (None, 0, 0.0, 0.0)
                reached.append((batch, child))
        reached.sort()
        level += 1
    if apart:
        for r in _grown_apart(train, {b: dict(t) for b, t in trees.items()}, level, sorted(apart), criterion, depth):
            trees[r.batch][r._node] = (r.class_name, r.j, r.threshold, r.low)
    if sum(map(len, trees.values())) > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} nodes; grow to a smaller depth")
    return trees


def between_all(rows: DataFrame, trees: dict[int, Tree]) -> dict[int, Tree]:
    """The trees with each threshold midway between the node's value below it and the next value of all training rows of the batch."""
    splits_of = {int(b): [(n, t[1], t[3]) for n, t in tree.items() if t[1]] for b, tree in trees.items()}
    shared = rows.sparkSession.sparkContext.broadcast(splits_of)

    def nearest(frames):
        for frame in frames:
            for b, part in frame.groupby("batch"):
                asked = shared.value.get(int(b), [])
                x = np.stack(part["features"].to_list())
                found = [np.where(x[:, j - 1] > low, x[:, j - 1], np.inf).min() for _, j, low in asked]
                yield pd.DataFrame({"batch": int(b), "node": [n for n, _, _ in asked], "above": found})

    train = rows.filter("train and features is not null and batch is not null").select("batch", "features")
    above = train.mapInPandas(nearest, "batch long, node long, above double").groupBy("batch", "node").agg(F.min("above").alias("above"))
    moved = {b: dict(tree) for b, tree in trees.items()}
    for r in above.toLocalIterator():  # a row for each split
        top, j, _, low = moved[r.batch][r.node]
        moved[r.batch][r.node] = (top, j, (low + r.above) / 2, low)
    return moved


def predicted(rows: DataFrame, trees: dict[int, Tree], depths: list[int]) -> DataFrame:
    """rows with param and predicted, a row for each depth: the class of the node where a row stands at that depth."""
    classes = {batch: {n: t[0] for n, t in tree.items()} for batch, tree in trees.items()}
    shared = rows.sparkSession.sparkContext.broadcast(classes)

    @F.pandas_udf("array<string>")
    def path(batches: pd.Series, nodes: pd.Series) -> pd.Series:
        out = []
        for b, n in zip(batches, nodes):
            if pd.isna(n):
                out.append([None] * len(depths))
                continue
            level = int(n).bit_length() - 1
            out.append([shared.value[int(b)][int(n) >> max(level - d, 0)] for d in depths])
        return pd.Series(out)

    deep = placed(rows, trees, max(depths))
    listed = F.arrays_zip(F.array(*(F.lit(d) for d in depths)).alias("param"),
                          path(F.col("batch").cast("long"), "_node").alias("predicted"))
    keep = [c for c in rows.columns if c != "features"]
    return exploded(deep, keep, listed, "_p").select(*keep, "_p.param", "_p.predicted")


def _trees(rows: DataFrame, criterion: str, depth: int, between: str, train: DataFrame | None = None) -> dict[int, Tree]:
    """The trees of rows (batch, train, class_name, features); train has the training rows once, with their batches."""
    if between not in ("node", "all"):
        raise ValueError(f"unknown values {between!r}; use node or all")
    trees = grown(rows, criterion, depth) if train is None else _grown(train, criterion, depth)
    return trees if between == "node" else between_all(rows, trees)


def kfold_predictions(
    samples: DataFrame, k: int, criterion: str = "gini", depths: list[int] = TREE_DEPTHS, between: str = "node"
) -> DataFrame:
    """Predictions (sample_id, class_name, fold, param, predicted): every depth on every fold, from one growth of k trees.

    Thresholds lie midway between neighbouring values of the node, or with between="all" of all training samples.
    """
    samples = materialised(samples)  # each level reads them
    batches = F.sequence(F.lit(0), F.lit(k - 1))
    rows = samples.select("class_name", "features", "fold", F.explode(batches).alias("batch")).withColumn(
        "train", F.coalesce(F.col("fold") != F.col("batch"), F.lit(True)))
    others = F.filter(batches, lambda b: F.coalesce(F.col("fold") != b, F.lit(True)))
    train = samples.select("class_name", "features", others.alias("batches"))
    tested = samples.filter(F.col("fold").between(0, k - 1)).select(
        "sample_id", "class_name", "fold", "features", F.col("fold").alias("batch"))
    return predicted(tested, _trees(rows, criterion, max(depths), between, train), depths).drop("batch")


def fit_predict(
    train: DataFrame, test: DataFrame, criterion: str = "gini", depth: int = 8, between: str = "node"
) -> DataFrame:
    """Test samples with predicted, from a tree grown on the training samples."""
    rows = materialised(train.select(F.lit(0).alias("batch"), F.lit(True).alias("train"), "class_name", "features"))
    trees = _trees(rows, criterion, depth, between)
    return predicted(test.withColumn("batch", F.lit(0)), trees, [depth]).drop("batch", "param")


def holdout_predictions(vectors: DataFrame, criterion: str = "gini", depths: list[int] = TREE_DEPTHS) -> DataFrame:
    """Predictions (sample_id, class_name, cycle, param, predicted) of vectors (cycle, split, sample_id, class_name, features)."""
    rows = materialised(vectors.withColumn("batch", F.col("cycle")).withColumn("train", F.col("split") == "train"))
    tested = rows.filter("split = 'test'").select("sample_id", "class_name", "cycle", "features", "batch")
    return predicted(tested, grown(rows, criterion, max(depths)), depths).drop("batch")
