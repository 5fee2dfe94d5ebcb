"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

* Tokens are runs of letters, of digits or of symbols, hashed into a fixed number of buckets; the shape of each run of
  letters (case and length) is a token, too.
* Random indexing: each bucket has a sparse random index vector of -1, 0 and 1; its word vector is that vector plus the
  sum of the index vectors of the tokens around it in the training texts, each at unit length.
* A document is the mean and mean square of its tokens' vectors, with a few numbers on repetition and length.
* A network with one hidden layer is trained in numpy; a temperature fitted on texts kept apart calibrates it, and the
  shares of the labels among all training rows set the base rate.

The fit reads a bounded sample of labelled rows: at most PER_CLASS of each label, those with the least hash of the id.
The whole table is scored with the broadcast model, whose size is fixed.

Defined results: a null text counts as empty and has a score like any other. Labels that are null are ignored; of
several labels of an id the greatest counts; of several texts of a labelled id the fit reads the least. A null id has no label: such rows
are scored, but never train (in the query, their held_out is null). Texts of any length are worked on in slices of tokens. Without rows of both labels the score is the share of label 1, or 0.5
without labels. Each row is judged by itself; further columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import summed_numbers, with_python_columns
from tracewright.llm.hashing import BASES, mixed, token_runs
from tracewright.session import materialised

PER_CLASS = 3000
BUCKETS = 1 << 14
SHAPES = 32
WIDTH = 64
NEAR = 2  # tokens on each side that make a context
HIDDEN = 32
LAGS = 4  # a token may equal the one so many places before
FIT_TASKS = 8
SLICE = 1 << 16  # tokens of a text whose contexts are summed at once


# ---- tokens and vectors --------------------------------------------------------------------------------


def token_ids(text: str | None) -> np.ndarray:
    """Bucket of each token, in order, with the shape of each run of letters behind it."""
    codes, kinds, sizes, capitals = token_runs(text)
    ids = (codes % np.uint64(BUCKETS)).astype(np.int64)
    words = np.flatnonzero(kinds == 1)
    case = np.where(capitals[words] == 0, 0, np.where(capitals[words] == sizes[words], 2, 1))
    shapes = BUCKETS + case * 8 + np.minimum(sizes[words], 7)
    return np.insert(ids, words + 1, shapes)


def index_vectors() -> np.ndarray:
    """The random index vector of every bucket: about one number in eight is -1 or 1."""
    out = np.empty((BUCKETS + SHAPES, WIDTH), np.int8)
    with np.errstate(over="ignore"):
        for start in range(0, len(out), 1024):
            part = out[start:start + 1024]
            place = np.arange(start * WIDTH, start * WIDTH + part.size, dtype=np.uint64)
            h = mixed(place * np.uint64(BASES[0]) + np.uint64(1)) >> np.uint64(60)
            part[:] = np.where(h == 0, 1, np.where(h == 1, -1, 0)).reshape(part.shape)
    return out


def context_sums(texts: Iterable[str | None], index: np.ndarray) -> np.ndarray:
    """Sums of the index vectors around each bucket's tokens."""
    sums = np.zeros(index.shape, np.int64)
    for text in texts:
        ids = token_ids(text)
        if len(ids) < 2:
            continue
        for start in range(0, len(ids), SLICE):
            stop = min(start + SLICE, len(ids))
            around = np.zeros((stop - start, WIDTH), np.int64)
            for off in range(1, min(NEAR, len(ids) - 1) + 1):
                low, high = min(max(start, off), stop), min(stop, len(ids) - off)
                around[low - start:] += index[ids[low - off:stop - off]]
                around[:max(0, high - start)] += index[ids[start + off:high + off]]
            np.add.at(sums, ids[start:stop], around)
    return sums


def word_vectors(sums: np.ndarray, index: np.ndarray) -> np.ndarray:
    def unit(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32)
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64)), 1e-9)[:, None]
        return x

    out = unit(index)
    out += unit(sums)
    return out


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    ids = token_ids(text)
    if not len(ids):
        return np.zeros(2 * WIDTH + 4 + LAGS, np.float32)
    counts = np.bincount(ids, minlength=len(vectors))
    at = np.flatnonzero(counts)
    share = (counts[at] / len(ids)).astype(np.float32)
    own = vectors[at]
    mean = share @ own
    more = [np.log1p(len(ids)), float((share ** 2).sum()), len(at) / len(ids), float(np.sqrt((mean ** 2).sum()))]
    again = [float((ids[lag:] == ids[:-lag]).sum()) / len(ids) for lag in range(1, LAGS + 1)]
    return np.concatenate([mean, share @ own ** 2, np.array(more + again, np.float32)])


# ---- network -------------------------------------------------------------------------------------------


def fit_network(x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 0.01, seed: int = 7) -> dict:
    """A standardised two-layer network fitted by Adam on the log loss."""
    rng = np.random.default_rng(seed)
    centre, spread = x.mean(0), x.std(0) + 1e-3
    z = (x - centre) / spread
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN),
         rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for start in range(0, len(z), 128):
            at = order[start:start + 128]
            h = np.tanh(z[at] @ p[0] + p[1])
            miss = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[at]) / len(at)
            back = np.outer(miss, p[2]) * (1 - h ** 2)
            slopes = [z[at].T @ back + 1e-4 * p[0], back.sum(0), h.T @ miss + 1e-4 * p[2], np.array([miss.sum()])]
            step += 1
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                p[i] = p[i] - rate * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    return {"centre": centre, "spread": spread, "layers": p, "temperature": 1.0, "offset": 0.0}


def logits(net: dict, x: np.ndarray) -> np.ndarray:
    w1, b1, w2, b2 = net["layers"]
    return np.tanh(((x - net["centre"]) / net["spread"]) @ w1 + b1) @ w2 + b2


def scores(net: dict, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits(net, x) / net["temperature"] + net["offset"], -500, 500)))


def calibrated(net: dict, x: np.ndarray, y: np.ndarray) -> dict:
    """The temperature with the least log loss on texts that the fit has not seen."""
    raw = logits(net, x)

    def loss(t: float) -> float:
        return float(np.logaddexp(0, np.where(y == 1, -raw, raw) / t).mean())

    return net | {"temperature": float(min(np.geomspace(0.25, 16, 61), key=loss))}


# ---- jobs ----------------------------------------------------------------------------------------------


def sampled_labels(labels: DataFrame, id_col: str, label_col: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(id, y) of at most per_class rows of each label, and how many there are."""
    one = labels.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(F.col(f"`{label_col}`")).alias("y"))
    one = materialised(one.where("id is not null and y in (0, 1)").withColumn("h", F.xxhash64("id")))
    sizes = {r.y: r["count"] for r in one.groupBy("y").count().collect()}
    parts = [one.where(F.col("y") == y).orderBy("h", "id").limit(per_class) for y in (0, 1)]
    return materialised(parts[0].unionByName(parts[1])), sizes


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_class: int = PER_CLASS,
) -> dict:
    """The model from labelled documents; its size does not depend on theirs."""
    chosen, sizes = sampled_labels(labels, id_col, label_col, per_class)
    total = sum(sizes.values())
    if len(sizes) < 2:
        return {"constant": sizes.get(1, 0) / total if total else 0.5}
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # Of rows that repeat an id, one text.
    texts = texts.join(F.broadcast(chosen.select("id", "y", "h")), "id").groupBy("id", "y", "h").agg(F.min("text").alias("text"))
    texts = materialised(texts.repartition(FIT_TASKS, "id"))

    def sums(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        index = index_vectors()
        out = np.zeros(index.shape, np.int64)
        for batch in batches:
            out += context_sums((t.as_py() for t in batch.column(0)), index)
        return out

    index = index_vectors()
    # Each task makes a whole table of sums, so there are at most FIT_TASKS, however many the session deals rows to.
    total_sums = summed_numbers(texts.select("text").coalesce(FIT_TASKS), sums, index.size).reshape(index.shape)
    vectors = word_vectors(total_sums, index)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def pool(rows: Iterable[dict]) -> Iterator[dict]:
        for row in rows:
            yield {"x": pooled(row["text"], shared.value).astype("<f4").tobytes()}

    fields = [("x", T.BinaryType())]  # packed, for the driver
    rows = with_python_columns(texts, {"text": F.col("text")}, fields, pool).select("row.h", "row.id", "row.y", "x")
    rows = sorted(rows.collect(), key=lambda r: (r.h, str(r.id), r.y, bytes(r.x)))  # at most 2 * per_class ids
    if len({r.y for r in rows}) < 2:
        return {"constant": sizes.get(1, 0) / total}
    x, y = np.array([np.frombuffer(r.x, "<f4") for r in rows], float), np.array([r.y for r in rows], float)
    apart = np.arange(len(y)) % 5 == 0
    if len(set(y[~apart])) < 2:
        apart[:] = False
    net = fit_network(x[~apart], y[~apart])
    if len(set(y[apart])) == 2:
        # The temperature comes from rows that the fit has not seen; the network is then fitted on all of them.
        net = fit_network(x, y) | {"temperature": calibrated(net, x[apart], y[apart])["temperature"]}
    # The sample may hold the labels in other shares than the table.
    net["offset"] = float(np.log(sizes[1] / sizes[0]) - np.log(y.sum() / (1 - y).sum()))
    return {"vectors": vectors, "net": net}


def scored(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """(row, score): each document as a struct with the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(rows: Iterable[dict]) -> Iterator[dict]:
        model = shared.value
        if "constant" in model:
            yield from ({"score": float(model["constant"])} for _ in rows)
            return
        x = [pooled(row["text"], model["vectors"]) for row in rows]
        yield from ({"score": float(s)} for s in scores(model["net"], np.array(x, np.float64))) if x else ()

    return with_python_columns(docs, {"text": F.col(f"`{text_col}`")}, [("score", T.DoubleType())], score)
