"""Similarity of symbol sequences to one hidden Markov model per class.

A sequence is cut into chunks of bounded length.  A model turns a chunk into a small matrix, and the
matrices of a sequence multiply in order, so a long sequence is worked on by many tasks: products of
blocks of chunks give what comes before and after every chunk, and each chunk then does its own
forward-backward pass.

Models have one state per class and a start state 0 that emits nothing and leads to the first state of
a sequence; so initial shares are the first row of the transition matrix.  Symbols a model does not know
are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.plans.ordering import segment
from tracewright.plans.skew import salted_join
from tracewright.session import ensure_checkpoint_dir

CHUNK = 4096  # symbols per chunk
BLOCK = 1024  # chunks per block
MAX_CLASSES = 200
MAX_MODEL_NUMBERS = 2_000_000  # all models together; they are sent to every task and gathered after every pass
WORK = 2_000_000  # numbers held at once in a task


@dataclass
class Model:
    transition: np.ndarray  # (states + 1, states + 1)
    emission: np.ndarray  # (states + 1, symbols)
    alphabet: list[str]


def chunks(symbols: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(sample_id, class_name, part, n_parts, symbols) from (sample_id, class_name, step, symbol), steps 1..n."""
    parts = symbols.groupBy("sample_id", "class_name", segment("step", chunk).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("step", "symbol")))["symbol"].alias("symbols")
    )
    n = symbols.groupBy("sample_id").agg((segment_of(F.max("step"), chunk) + 1).alias("n_parts"))
    return salted_join(parts, n, ["sample_id"], ["sample_id", "part"])


def segment_of(position, chunk):
    return F.floor((position - 1) / F.lit(chunk)).cast("bigint")


# ---- numpy on one batch of chunks ----------------------------------------------------------------------


def _encoded(sequences, alphabet: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Known symbols as numbers, padded with -1, and lengths."""
    index = {s: i for i, s in enumerate(alphabet)}
    coded = [[index[s] for s in seq if s in index] for seq in sequences]
    lengths = np.array([len(c) for c in coded], dtype=int)
    padded = np.full((len(coded), max(int(lengths.max(initial=0)), 1)), -1, dtype=int)
    for row, c in enumerate(coded):
        padded[row, : len(c)] = c
    return padded, lengths


def _slices(sequences, per_symbol: int, per_row: int) -> Iterator[np.ndarray]:
    """Row numbers in groups, short sequences first, whose padded size stays within WORK."""
    order = np.argsort([len(s) for s in sequences], kind="stable")
    group: list[int] = []
    for row in order:
        if group and (len(group) + 1) * ((len(sequences[row]) + 1) * per_symbol + per_row) > WORK:
            yield np.array(group)
            group = []
        group.append(row)
    if group:
        yield np.array(group)


def _products(coded: np.ndarray, lengths: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Scaled matrix of each chunk, and the logarithm of its scale."""
    n, states = len(coded), len(model.transition)
    matrix = np.broadcast_to(np.eye(states), (n, states, states)).copy()
    scale = np.zeros(n)
    for t in range(coded.shape[1]):
        on = np.nonzero(lengths > t)[0]
        if len(on) == 0:
            break
        step = (matrix[on] @ model.transition) * model.emission[:, coded[on, t]].T[:, None, :]
        total = step.sum(axis=(1, 2))
        total = np.where(total > 0, total, 1.0)
        matrix[on] = step / total[:, None, None]
        scale[on] += np.log(total)
    return matrix, scale


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(x)


def _start(states: int) -> np.ndarray:
    v = np.zeros(states)
    v[0] = 1.0
    return v


def _expected(coded, lengths, before, after, model: Model):
    """Expected transitions and emissions of chunks, given the state weights before and after each."""
    n, width = coded.shape
    states = len(model.transition)
    moves, emits = np.zeros_like(model.transition), np.zeros_like(model.emission)
    forward = np.zeros((width + 1, n, states))
    forward[0] = before / before.sum(axis=1, keepdims=True)
    for t in range(width):
        symbol = np.where(lengths > t, coded[:, t], 0)
        a = (forward[t] @ model.transition) * model.emission[:, symbol].T
        total = a.sum(axis=1, keepdims=True)
        a = a / np.where(total > 0, total, 1.0)
        forward[t + 1] = np.where((lengths > t)[:, None], a, forward[t])
    back = after / after.sum(axis=1, keepdims=True)
    for t in range(width - 1, -1, -1):
        on = lengths > t
        if not on.any():
            continue
        symbol = coded[on, t]
        weighted = model.emission[:, symbol].T * back[on]  # by state at t
        pair = forward[t][on][:, :, None] * model.transition[None] * weighted[:, None, :]
        total = pair.sum(axis=(1, 2), keepdims=True)
        pair = pair / np.where(total > 0, total, 1.0)
        moves += pair.sum(axis=0)
        np.add.at(emits.T, symbol, pair.sum(axis=1))
        b = weighted @ model.transition.T
        total = b.sum(axis=1, keepdims=True)
        back[on] = b / np.where(total > 0, total, 1.0)
    return moves, emits


# ---- products along sequences --------------------------------------------------------------------------

_PRODUCT = "sample_id string, model string, part bigint, scale double, matrix array<double>"


def _chunk_products(parts: DataFrame, models: dict[str, Model], own_only: bool) -> DataFrame:
    """Product of every chunk under every model, or only under the model of its class."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, model in models.items():
                mine = pdf[pdf["class_name"] == name] if own_only else pdf
                sequences = mine["symbols"].to_list()
                ids, numbers = mine["sample_id"].to_numpy(), mine["part"].to_numpy()
                for rows in _slices(sequences, 1, len(models) ** 2):
                    coded, lengths = _encoded([sequences[r] for r in rows], model.alphabet)
                    matrix, scale = _products(coded, lengths, model)
                    yield pd.DataFrame({
                        "sample_id": ids[rows], "model": name, "part": numbers[rows], "scale": scale,
                        "matrix": list(matrix.reshape(len(rows), -1)),
                    })

    return parts.select("sample_id", "class_name", "part", "symbols").mapInPandas(work, _PRODUCT)


def _multiplied(pdf: pd.DataFrame) -> tuple[np.ndarray, float]:
    states = int(round(len(pdf["matrix"].iloc[0]) ** 0.5))
    whole, scale = np.eye(states), float(pdf["scale"].sum())
    for flat in pdf["matrix"]:
        whole = whole @ np.asarray(flat).reshape(states, states)
        total = whole.sum() or 1.0
        whole, scale = whole / total, scale + float(np.log(total))
    return whole, scale


def _blocks(products: DataFrame, block: int) -> DataFrame:
    """Products of up to `block` neighbouring chunks; part becomes the block number."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        whole, scale = _multiplied(pdf)
        return pd.DataFrame({
            "sample_id": [pdf["sample_id"].iloc[0]], "model": [pdf["model"].iloc[0]],
            "part": [int(pdf["part"].iloc[0]) // block], "scale": [scale], "matrix": [whole.ravel()],
        })

    return products.groupBy("sample_id", "model", F.floor(F.col("part") / block).alias("_b")).applyInPandas(work, _PRODUCT)


def _edges(products: DataFrame, n_parts: int, block: int) -> DataFrame:
    """(sample_id, model, part, before, after): state weights on both sides of every chunk."""
    schema = "sample_id string, model string, part bigint, before array<double>, after array<double>"

    def inside(pdf: pd.DataFrame, before: np.ndarray, after: np.ndarray) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        states = len(before)
        mats = [np.asarray(m).reshape(states, states) for m in pdf["matrix"]]
        befores, afters = [before], [after]
        for m in mats[:-1]:
            v = befores[-1] @ m
            befores.append(v / (v.sum() or 1.0))
        for m in reversed(mats[1:]):
            v = m @ afters[-1]
            afters.append(v / (v.sum() or 1.0))
        return pd.DataFrame({
            "sample_id": pdf["sample_id"], "model": pdf["model"], "part": pdf["part"],
            "before": befores, "after": afters[::-1],
        })

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        states = int(round(len(pdf["matrix"].iloc[0]) ** 0.5))
        return inside(pdf, _start(states), np.ones(states))

    if n_parts <= block:
        return products.groupBy("sample_id", "model").applyInPandas(whole, schema)
    outer = _edges(_blocks(products, block), -(-n_parts // block), block).withColumnRenamed("part", "_b")

    def nested(pdf: pd.DataFrame) -> pd.DataFrame:
        return inside(pdf, np.asarray(pdf["before"].iloc[0]), np.asarray(pdf["after"].iloc[0]))

    return (
        products.withColumn("_b", F.floor(F.col("part") / block))
        .join(outer, ["sample_id", "model", "_b"])
        .groupBy("sample_id", "model", "_b")
        .applyInPandas(nested, schema)
    )


# ---- training and scoring ------------------------------------------------------------------------------


def start_models(parts: DataFrame, seed: int = 0) -> dict[str, Model]:
    """Random models: as many states as classes, the alphabet of the class."""
    letters = parts.select("class_name", F.explode_outer("symbols").alias("s")).distinct()
    rows = letters.groupBy("class_name").agg(F.count("s").alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    if sum((len(rows) + 1) * (len(rows) + 1 + r["n"]) for r in rows) > MAX_MODEL_NUMBERS:
        raise ValueError(f"models of more than {MAX_MODEL_NUMBERS} numbers: too many classes or symbols")
    alphabets: dict[str, list[str]] = {r["class_name"]: [] for r in rows}
    for r in letters.filter("s is not null").collect():  # classes x symbols, checked above
        alphabets[r["class_name"]].append(r["s"])
    rng = np.random.default_rng(seed)
    states = len(alphabets) + 1
    out = {}
    for name in sorted(alphabets):
        alphabet = sorted(alphabets[name])
        transition, emission = rng.random((states, states)), rng.random((states, max(len(alphabet), 1)))
        transition[:, 0] = 0.0
        emission[0, :] = 0.0
        transition /= transition.sum(axis=1, keepdims=True)
        emission[1:] /= emission[1:].sum(axis=1, keepdims=True)
        out[name] = Model(transition, emission, alphabet)
    return out


_COUNTS = "class_name string, kind string, i int, j int, value double"


def _expectations(parts: DataFrame, edges: DataFrame | None, models: dict[str, Model]) -> DataFrame:
    """Expected counts summed over all chunks, and the log-likelihood of single-chunk sequences."""
    states = len(models) + 1
    if edges is None:
        rows = parts.withColumn("before", F.lit(None).cast("array<double>")).withColumn("after", F.col("before"))
    else:
        rows = parts.join(
            edges.withColumnRenamed("model", "class_name"), ["sample_id", "class_name", "part"], "left"
        )

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {name: [np.zeros_like(m.transition), np.zeros_like(m.emission)] for name, m in models.items()}
        for pdf in batches:
            for name, mine in pdf.groupby("class_name"):
                model = models[name]
                sequences = mine["symbols"].to_list()
                given_before, given_after = mine["before"].to_list(), mine["after"].to_list()
                for picked in _slices(sequences, states, states**2):
                    coded, lengths = _encoded([sequences[r] for r in picked], model.alphabet)
                    before = np.stack([
                        _start(states) if given_before[r] is None else np.asarray(given_before[r]) for r in picked
                    ])
                    after = np.stack([
                        np.ones(states) if given_after[r] is None else np.asarray(given_after[r]) for r in picked
                    ])
                    moves, emits = _expected(coded, lengths, before, after, model)
                    totals[name][0] += moves
                    totals[name][1] += emits
        out = []
        for name, (moves, emits) in totals.items():
            for kind, table in (("move", moves), ("emit", emits)):
                i, j = np.nonzero(table)
                out.append(pd.DataFrame({
                    "class_name": name, "kind": kind, "i": i.astype("int32"), "j": j.astype("int32"),
                    "value": table[i, j],
                }))
        yield pd.concat(out, ignore_index=True)

    return (
        rows.select("class_name", "symbols", "before", "after")
        .mapInPandas(work, _COUNTS)
        .groupBy("class_name", "kind", "i", "j")
        .agg(F.sum("value").alias("value"))
    )


def train(parts: DataFrame, n_iter: int = 10, seed: int = 0, block: int = BLOCK) -> dict[str, Model]:
    """Baum-Welch on the sequences of each class: n_iter passes over the chunks.

    What comes back to the driver per pass are the expected counts, states x (states + symbols) per class.
    """
    longest = parts.agg(F.max("n_parts")).first()[0] or 0
    models = start_models(parts, seed)
    for _ in range(n_iter):
        edges = None
        if longest > 1:
            long = parts.filter("n_parts > 1")
            edges = _edges(_chunk_products(long, models, own_only=True), longest, block)
        counted: dict[str, list[np.ndarray]] = {
            name: [np.zeros_like(m.transition), np.zeros_like(m.emission)] for name, m in models.items()
        }
        for r in _expectations(parts, edges, models).collect():
            counted[r["class_name"]][0 if r["kind"] == "move" else 1][r["i"], r["j"]] = r["value"]
        for name, (moves, emits) in counted.items():
            old = models[name]
            models[name] = Model(_rows(moves, old.transition), _rows(emits, old.emission), old.alphabet)
    return models


def _rows(counts: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Counts to shares per row; rows never used keep their old values."""
    total = counts.sum(axis=1, keepdims=True)
    return np.where(total > 0, counts / np.where(total > 0, total, 1.0), old)


def log_likelihoods(parts: DataFrame, models: dict[str, Model], block: int = BLOCK) -> DataFrame:
    """(sample_id, model, loglik): every sequence under the model of every class."""
    longest = parts.agg(F.max("n_parts")).first()[0] or 0
    states = len(models) + 1
    schema = "sample_id string, model string, loglik double"

    def single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            matrices = np.stack([np.asarray(m).reshape(states, states) for m in pdf["matrix"]]) if len(pdf) else np.zeros((0, states, states))
            yield pd.DataFrame({
                "sample_id": pdf["sample_id"], "model": pdf["model"],
                "loglik": _log(matrices[:, 0, :].sum(axis=1)) + pdf["scale"].to_numpy(),
            })

    short = _chunk_products(parts.filter("n_parts = 1"), models, own_only=False)
    out = short.mapInPandas(single, schema)
    if longest > 1:
        products = _chunk_products(parts.filter("n_parts > 1"), models, own_only=False)
        while longest > 1:
            products = _blocks(products, block)
            longest = -(-longest // block)
        out = out.unionByName(products.mapInPandas(single, schema))
    return out


def hmm_similarity(
    symbols: DataFrame, n_iter: int = 10, seed: int = 0, chunk: int = CHUNK, block: int = BLOCK
) -> DataFrame:
    """(sample_id, model, loglik) from symbols (sample_id, class_name, step, symbol).

    The chunks are read in every pass, so they are written to the checkpoint folder first.
    """
    ensure_checkpoint_dir(symbols.sparkSession)
    typed = symbols.withColumn("sample_id", F.col("sample_id").cast("string"))
    parts = chunks(typed, chunk).checkpoint()
    return log_likelihoods(parts, train(parts, n_iter, seed, block), block)
