"""Rows of the large nodes of decision trees as columns: where rows stand, cells of a feature, best splits of a feature (see `growth`).

A cell is a value, a class, a number of rows and for each of the trees the slot of the node where these rows stand, or -1. A
block has the cells of some rows for one feature, a part those of a range of its values.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

from tracewright.operators.subtrees import best_of_feature, sorting, weights

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package

Packed = tuple[np.ndarray, np.ndarray, np.ndarray]  # of a tree: its nodes in order, their features from 1 or 0, their thresholds


def descended(x: np.ndarray, tree: Packed, depth: int) -> np.ndarray:
    """The nodes that vectors reach after at most `depth` splits; every node that is reached is listed."""
    nodes, feature, threshold = tree
    here = np.ones(len(x), np.int64)
    for _ in range(depth):
        i = np.searchsorted(nodes, here)
        split = np.flatnonzero(feature[i] > 0)
        if not len(split):
            break
        right = ~(x[split, feature[i][split] - 1] <= threshold[i][split])
        here[split] = 2 * here[split] + right
    return here


def vectors(rows: pa.RecordBatch) -> np.ndarray:
    lengths = np.unique(rows.column("features").value_lengths().to_numpy(zero_copy_only=False))
    if len(lengths) > 1:
        raise ValueError(f"vectors of {lengths[0]} and {lengths[-1]} values")
    flat = rows.column("features").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows.num_rows, -1).astype(float)  # missing values are NaN


def standing(rows: pa.RecordBatch, x: np.ndarray, trees: dict[int, Packed], level: int, asked: list[tuple]) -> np.ndarray:
    """For each row and each tree of the asked nodes (batch, node), in order: the place of the row's node among the asked, or -1."""
    batches = sorted({b for b, _ in asked})
    slots = np.full((len(x), len(batches)), -1, np.int16 if len(asked) < 1 << 15 else np.int32)
    listed = rows.column("batches")
    owner = np.repeat(np.arange(len(x)), listed.value_lengths().to_numpy(zero_copy_only=False))
    member = listed.flatten().to_numpy(zero_copy_only=False)
    nodes = np.array([n for _, n in asked], np.int64)
    start = 0
    for t, b in enumerate(batches):
        here = owner[member == b]
        of_tree = nodes[start : start + sum(a == b for a, _ in asked)]
        reached = descended(x[here], trees[b], level)
        at = np.minimum(np.searchsorted(of_tree, reached), len(of_tree) - 1)
        slots[here, t] = np.where(of_tree[at] == reached, at + start, -1)
        start += len(of_tree)
    return slots


def class_counts(names: pa.Array, slots: np.ndarray) -> pa.RecordBatch:
    """(slot, class_name, n) of some rows."""
    known = names.dictionary_encode()
    codes = known.indices.fill_null(len(known.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
    width = len(known.dictionary) + 1
    at = slots >= 0
    key, n = np.unique((slots.astype(np.int64) * width + codes[:, None])[at], return_counts=True)
    code = pa.array(key % width, mask=key % width == width - 1)
    return pa.RecordBatch.from_arrays([pa.array(key // width), known.dictionary.take(code), pa.array(n)], ["slot", "class_name", "n"])


def _cells(v: np.ndarray, codes: np.ndarray, slots: np.ndarray) -> tuple:
    """(value, class, number, slots) of rows, in order of the values. Where values repeat, equal rows of a node are one cell."""
    order = np.argsort(v, kind="stable")
    v, codes, slots = v[order], codes[order], slots[order]
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    if 4 * len(first) > len(v):
        return v, codes, np.ones(len(v), np.int32), slots
    value = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(v)]))
    few, of = np.unique(codes, return_inverse=True)
    found = []
    for t in range(slots.shape[1]):
        at = np.flatnonzero(slots[:, t] >= 0)
        width = int(slots[:, t].max()) + 1
        key, n = np.unique((value[at] * width + slots[at, t]) * len(few) + of[at], return_counts=True)
        own = np.full((len(key), slots.shape[1]), -1, slots.dtype)
        own[:, t] = key // len(few) % max(width, 1)
        found.append((v[first][key // (len(few) * max(width, 1))], few[key % len(few)], n.astype(np.int32), own))
    if 2 * sum(len(c[0]) for c in found) > len(v):
        return v, codes, np.ones(len(v), np.int32), slots
    return tuple(map(np.concatenate, zip(*found)))


def blocks(x: np.ndarray, codes: np.ndarray, slots: np.ndarray, cuts: list[np.ndarray]) -> pa.RecordBatch:
    """(j, part, v, c, n, s) of some rows: the cells of each feature in each range of its values between the cuts. Missing values are left out."""
    here = (slots >= 0).any(axis=1)
    x, codes, slots = x[here], codes[here].astype(np.int32), slots[here]
    out: list[tuple] = []
    for j in range(x.shape[1]):
        known = ~np.isnan(x[:, j])
        if not known.any():
            continue
        cells = _cells(x[known, j], codes[known], slots[known])
        part = np.searchsorted(cuts[j], cells[0], side="right") if cuts else np.zeros(len(cells[0]), int)
        for r in np.unique(part):
            out.append((j + 1, int(r), *(c[part == r].tobytes() for c in cells)))
    columns = list(zip(*out)) or [[]] * 6
    types = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["j", "part", "v", "c", "n", "s"])


def _read(rows: pd.DataFrame, trees: int, many: bool) -> tuple:
    v, c, n, s = (np.frombuffer(b"".join(rows[k]), t) for k, t in (
        ("v", float), ("c", np.int32), ("n", np.int32), ("s", np.int32 if many else np.int16)))
    return v, c, n, s.reshape(len(v), trees)


def part_counts(rows: pd.DataFrame, trees: int, many: bool) -> pd.DataFrame:
    """(j, part, slot, code, n, first) of blocks of one part: numbers of rows, and the least value of a slot."""
    v, c, n, slots = _read(rows, trees, many)
    cell, tree = np.nonzero(slots >= 0)
    counted = pd.DataFrame({"slot": slots[cell, tree].astype(np.int64), "code": c[cell], "n": n[cell].astype(np.int64), "first": v[cell]})
    out = counted.groupby(["slot", "code"], as_index=False).agg({"n": "sum", "first": "min"})
    out.insert(0, "part", rows["part"].iloc[0])
    out.insert(0, "j", rows["j"].iloc[0])
    return out


def best_of_part(rows: pd.DataFrame, trees: int, many: bool, criterion: str, known: pd.DataFrame | None = None) -> pd.DataFrame:
    """(slot, loss, j, threshold, low) of the blocks of one part: its best split of each slot that has one.

    known has (slot, code, before, total, next) of all classes of its slots where a feature has several parts.
    """
    v, c, n, slots = _read(rows, trees, many)
    order = np.argsort(v, kind="stable")
    v, n, slots = v[order], n[order], slots[order]
    codes, c = np.unique(c if known is None else np.r_[c, known["code"]], return_inverse=True)
    if known is not None:
        c, of_known = c[: len(v)], c[len(v) :]
    c = c[order]
    found = []
    for t in range(trees):
        at = np.flatnonzero(slots[:, t] >= 0)
        if not len(at):
            continue
        s = slots[at, t].astype(np.int64)
        base = int(s.min())
        s -= base
        by_slot = sorting(s, int(s.max()))
        at, s = at[by_slot], s[by_slot]
        number = None if (n[at] == 1).all() else n[at].astype(np.int64)
        all_ = None
        if known is not None:
            own = known["slot"].to_numpy() - base
            own = np.flatnonzero((own >= 0) & (own <= s[-1]))
            own = own[np.lexsort((of_known[own], known["slot"].to_numpy()[own]))]
            of_slots = known.iloc[own]
            all_ = (of_slots["slot"].to_numpy() - base, of_known[own], of_slots["before"].to_numpy(), of_slots["total"].to_numpy(),
                    of_slots["next"].to_numpy(float))
        rows_of = int(len(at) if number is None else number.sum()) if all_ is None else int(all_[3].sum())
        best = best_of_feature(s, v[at], c[at], len(codes), *weights(rows_of, criterion), criterion, number, all_)
        if best is not None:
            gains = best[1] > 0
            found.append(pd.DataFrame({"slot": best[0][gains] + base, "loss": -best[1][gains], "threshold": best[2][gains], "low": best[3][gains]}))
    out = pd.concat(found, ignore_index=True) if found else pd.DataFrame({k: np.empty(0) for k in ("slot", "loss", "threshold", "low")})
    out["slot"] = out["slot"].astype(np.int64)
    out.insert(2, "j", int(rows["j"].iloc[0]))
    return out
