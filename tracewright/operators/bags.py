"""Sums and vectors of whole samples in all cycles of a held-out experiment, a batch of samples at a time (see `holdout`).

A sample is one row with all its tokens, so its weights and norms in every cycle need no row per cycle. Part 2 * c is the training
part of cycle c, part 2 * c + 1 its test part.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package


class Columns:
    """Token, idf and place (from 0, or -1) of the columns of all parts, from rows (part, token, rank, idf)."""

    def __init__(self, rows: list[tuple], cycles: int, k: int):
        self.tokens = sorted({r[1] for r in rows if r[1] is not None})
        at = {t: i for i, t in enumerate(self.tokens)}
        self.cycles, self.k = cycles, k
        self.idf = np.zeros((2 * cycles, len(at) + 1))  # the last one is for tokens of no column
        self.place = np.full((2 * cycles, len(at) + 1), -1, np.int64)
        for part, token, rank, idf in rows:
            if token is not None:
                self.idf[part, at[token]], self.place[part, at[token]] = idf, rank - 1


class Samples:
    """A batch of samples (own, class_name, tokens, tf, ...)."""

    def __init__(self, rows: pa.RecordBatch, columns: Columns):
        self.columns, self.n = columns, rows.num_rows
        own = rows.column("own")
        self.own = pc.fill_null(own, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        tokens, tf = rows.column("tokens"), rows.column("tf")
        self.row = np.repeat(np.arange(self.n), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
        tokens = tokens.flatten()
        found = pc.fill_null(pc.index_in(tokens, value_set=pa.array(columns.tokens, tokens.type)), len(columns.tokens))
        self.token = found.to_numpy(zero_copy_only=False)
        self.tf = tf.flatten().to_numpy(zero_copy_only=False).astype(float)

    def cells(self, part: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, weight) of the kept rows, each in its part."""
        row, token, tf = self.row, self.token, self.tf
        if not keep.all():
            at = keep[row]
            row, token, tf = row[at], token[at], tf[at]
        place = self.columns.place[part[row], token]
        at = place >= 0
        row, place = row[at], place[at]
        weight = tf[at] * self.columns.idf[part[row], token[at]]
        norm = np.sqrt(np.bincount(row, weight * weight, self.n))[row]
        return row, place, np.divide(weight, norm, out=np.zeros(len(weight)), where=norm > 0)

    def dense(self, part: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """Vectors of the kept rows, zeros included."""
        row, place, weight = self.cells(part, keep)
        x = np.zeros((self.n, self.columns.k))
        x[row, place] = weight
        return x[keep]


def _arrays(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    flat = pa.array(np.ascontiguousarray(values, float).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)


def class_sums(batches: Iterator[pa.RecordBatch], columns: Columns, axes: dict | None = None) -> Iterator[pa.RecordBatch]:
    """(batch, class_name, sums): of the training samples of each cycle and class, sums of x, x * x and |x|, and the number of cells.

    With axes of the parts, x are the places of a sample on them.
    """
    k = columns.k if axes is None else max((a.shape[1] for _, a in axes.values()), default=0)
    total: dict[object, np.ndarray] = {}
    kind = pa.string()
    for rows in batches:
        samples, names = Samples(rows, columns), rows.column("class_name").dictionary_encode("encode")
        kind, listed = rows.column("class_name").type, names.dictionary.to_pylist()
        of = names.indices.to_numpy(zero_copy_only=False)
        for name in listed:
            total.setdefault(name, np.zeros((columns.cycles, 4, k)))
        for c in range(columns.cycles):
            keep, part = samples.own != c, np.full(samples.n, 2 * c)
            if axes is None:
                row, place, x = samples.cells(part, keep)
                at, size = of[row] * k + place, len(listed) * k
                sums = [np.bincount(at, v, size).reshape(-1, k) for v in (x, x * x, np.abs(x), np.ones(len(x)))]
            elif 2 * c in axes:
                mean, axis = axes[2 * c]
                x = (samples.dense(part, keep) - mean) @ axis
                member = np.zeros((len(listed), len(x)))
                member[of[keep], np.arange(len(x))] = 1
                sums = [member @ v for v in (x, x * x, np.abs(x), np.ones_like(x))]
            else:
                continue
            for i, name in enumerate(listed):
                total[name][c] += [s[i] for s in sums]
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.tile(np.arange(columns.cycles, dtype=np.int32), len(total))),
             pa.array([name for name in total for _ in range(columns.cycles)], kind),
             _arrays(np.concatenate(list(total.values())).reshape(-1, 4 * k))], ["batch", "class_name", "sums"])


def part_products(batches: Iterator[pa.RecordBatch], columns: Columns, tests: bool) -> Iterator[pa.RecordBatch]:
    """(batch, sums): n, the sums and the products of all pairs of columns of each training part, and of each test part if asked."""
    total: dict[int, np.ndarray] = {}
    for rows in batches:
        samples = Samples(rows, columns)
        for part in range(0, 2 * columns.cycles, 1 if tests else 2):
            x = samples.dense(np.full(samples.n, part), (samples.own == part // 2) == (part % 2 == 1))
            if len(x):
                sums = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
                total[part] = total[part] + sums if part in total else sums
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int64()), _arrays(np.stack(list(total.values())))], ["batch", "sums"])


def test_vectors(batches: Iterator[pa.RecordBatch], columns: Columns, axes: dict | None, separate: bool) -> Iterator[pa.RecordBatch]:
    """(sample_id, class_name, own, features): the vectors of samples in the cycle that tests them, or with axes their places on them.

    Of a cycle that is none of the experiment's, a vector is all zeros; without axes of its part, a sample has no row.
    """
    for rows in batches:
        samples = Samples(rows, columns)
        inside = (samples.own >= 0) & (samples.own < columns.cycles)
        x = np.zeros((samples.n, columns.k))
        x[inside] = samples.dense(np.where(inside, 2 * samples.own + 1, 0), inside)
        kept = np.arange(samples.n)
        if axes is not None:
            part = 2 * samples.own + separate
            kept = np.flatnonzero(inside & np.isin(part, list(axes)))
            places = np.zeros((samples.n, max((a.shape[1] for _, a in axes.values()), default=0)))
            for p in np.unique(part[kept]):
                mean, axis = axes[int(p)]
                places[part == p] = (x[part == p] - mean) @ axis
            x = places[kept]
        named = [rows.column(c).take(pa.array(kept)) for c in ("sample_id", "class_name", "own")]
        yield pa.RecordBatch.from_arrays([*named, _arrays(x)], ["sample_id", "class_name", "own", "features"])


def listed_models(rows: list) -> dict[int, list[tuple]]:
    """Batch to (param, classes in order, priors, a column of likelihoods per class), from rows of `bayes.models`."""
    found: dict[int, dict] = {}
    for r in rows:
        found.setdefault(r["batch"], {}).setdefault(r["param"], []).append((r["class_name"], r["log_prior"], r["log_theta"]))
    return {batch: [(param, [c[0] for c in of], np.array([c[1] for c in of]), np.array([c[2] for c in of], float).T)
                    for param, of in sorted((p, sorted(classes, key=lambda c: c[0])) for p, classes in params.items())]
            for batch, params in found.items()}


def predicted(vectors: Iterator[pa.RecordBatch], models: dict[int, list[tuple]]) -> Iterator[pa.RecordBatch]:
    """(sample_id, class_name, own, param, predicted): for each model of a sample's cycle the class of the highest score.

    Of equal scores (to 9 decimals) it is the first class. Without a model, a sample has one row without param.
    """
    for rows in vectors:
        own = rows.column("own").to_numpy(zero_copy_only=False)
        x = np.abs(rows.column("features").flatten().to_numpy(zero_copy_only=False)).reshape(rows.num_rows, -1)
        for batch in np.unique(own):
            at = np.flatnonzero(own == batch)
            named = [rows.column(c).take(pa.array(at)) for c in ("sample_id", "class_name", "own")]
            kind = rows.column("class_name").type
            for param, classes, prior, theta in models.get(int(batch), [(None, [None], np.zeros(1), np.zeros((x.shape[1], 1)))]):
                score = np.floor((x[at] @ theta + prior) * 1e9 + 0.5)
                best = pa.array(classes, kind).take(pa.array(score.argmax(1)))
                params = pa.array([param] * len(at), pa.int32())
                yield pa.RecordBatch.from_arrays([*named, params, best], ["sample_id", "class_name", "own", "param", "predicted"])


def cycle_vectors(batches: Iterator[pa.RecordBatch], columns: Columns, cycle: int, test: bool) -> Iterator[pa.RecordBatch]:
    """(sample_id, class_name, features) of the training or test samples of one cycle."""
    for rows in batches:
        samples = Samples(rows, columns)
        keep = (samples.own == cycle) == test
        x = samples.dense(np.full(samples.n, 2 * cycle + test), keep)
        named = [rows.column(c).filter(pa.array(keep)) for c in ("sample_id", "class_name")]
        yield pa.RecordBatch.from_arrays([*named, _arrays(x)], ["sample_id", "class_name", "features"])
