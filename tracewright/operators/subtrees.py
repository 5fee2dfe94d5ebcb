"""The subtree below one node of a decision tree, from the few rows of that node (see `growth`).

The sums are those of `growth.splits`: f(count of class) with f(n) = n * n (gini) or n * log2(n) (entropy), the latter as whole numbers
of 2^-k, so that equal class counts have equal sums in whatever order rows come. Missing values are not counted.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package

TABLE = 1 << 23  # up to this many rows f is looked up


def weights(n: int, criterion: str):
    """f(i) as whole numbers for arrays of 0 .. n, f(i + 1) - f(i) as a table or None, and what one of the numbers is worth."""
    def exact(i: np.ndarray) -> np.ndarray:
        return i * np.log2(np.maximum(i, 1))

    unit = 1.0 if criterion == "gini" else 2.0 ** (int(np.log2(float(exact(np.array(n))) + 1)) - 60)

    def f(i: np.ndarray) -> np.ndarray:
        return i * i if criterion == "gini" else np.rint(exact(i) / unit).astype(np.int64)

    if n > TABLE:
        return f, None, unit
    table = f(np.arange(n + 1, dtype=np.int64))
    return table.__getitem__, np.diff(table), unit


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)


def sorting(keys: np.ndarray, most: int) -> np.ndarray:
    """The stable order of keys from 0 to most; numpy sorts whole numbers of 16 bits in two passes."""
    return np.argsort(keys.astype(np.uint16) if most < 1 << 16 else keys, kind="stable")


def best_of_feature(s, v, c, classes: int, f, steps, unit: float, criterion: str, n=None, known=None):
    """(slots, gain, threshold, low) of the best threshold of each slot; rows (slot, value, class) are sorted by slot and value.

    n are the numbers of equal rows, None for one each. Rows may be a range of values of their slots only: known then is
    (slot, class, before, total, next) for all classes of these slots, sorted: how many rows lie before the range, how many there
    are in all, and the value next above the range or NaN.
    """
    size, slots = len(s), int(s[-1]) + 1
    by_class = sorting(c, classes - 1)
    by_class = by_class[sorting(s[by_class], slots - 1)]
    key = s[by_class].astype(np.int64) * classes + c[by_class]
    runs = _starts(key)
    sizes = np.diff(np.r_[runs, size])
    first = _starts(s)
    last = np.r_[first[1:], size] - 1
    of = np.repeat(np.arange(len(first)), last - first + 1)
    if n is None:
        passed, of_run = np.arange(size) - np.repeat(runs, sizes), sizes
        upto = np.arange(1, size + 1)
    else:
        passed, of_run = np.cumsum(n[by_class]) - n[by_class], np.add.reduceat(n[by_class], runs)
        passed = passed - np.repeat(passed[runs], sizes)
        upto = np.cumsum(n)
    if known is not None:
        k_slot, k_class, k_before, k_total, k_next = known
        at = np.searchsorted(k_slot * classes + k_class, key[runs])
        passed, of_run = passed + np.repeat(k_before[at], sizes), k_total[at]
    before, rest = np.empty(size, np.int64), np.empty(size, np.int64)
    before[by_class] = passed
    rest[by_class] = np.repeat(of_run, sizes) - passed
    if n is None and steps is not None:
        left, right = np.cumsum(steps[before]), np.cumsum(-steps[rest - 1])
    else:
        one = 1 if n is None else n
        left, right = np.cumsum(f(before + one) - f(before)), np.cumsum(f(rest - one) - f(rest))

    def ahead(sums: np.ndarray) -> np.ndarray:
        return np.r_[0, sums[last[:-1]]]

    if known is None:
        n_all = upto[last] - ahead(upto)
        whole = left[last] - ahead(left)
        n_start, left_start, right_start = -ahead(upto), -ahead(left), whole - ahead(right)
        cut = np.flatnonzero((s[1:] == s[:-1]) & (v[1:] != v[:-1]))
        above = v[cut + 1]
    else:
        at = np.searchsorted(k_slot, s[first])
        groups = _starts(k_slot)
        to = np.searchsorted(k_slot[groups], s[first])
        n_all, whole, n_start, left_start, right_start = (
            np.add.reduceat(x, groups)[to] for x in (k_total, f(k_total), k_before, f(k_before), f(k_total - k_before)))
        n_start, left_start, right_start = n_start - ahead(upto), left_start - ahead(left), right_start - ahead(right)
        following = np.r_[v[1:], np.nan]
        following[last] = k_next[at]
        cut = np.flatnonzero(~np.isnan(following) & (following != v))
        above = following[cut]
    if not len(cut):
        return None
    of = of[cut]
    all_, n_left = n_all[of], n_start[of] + upto[cut]
    n_right, in_left, in_right = all_ - n_left, left_start[of] + left[cut], right_start[of] + right[cut]
    if criterion == "gini":
        gain = (in_left / n_left + in_right / n_right - (whole / n_all)[of]) / all_
    else:
        gain = ((f(n_all) - whole)[of] - f(n_left) - f(n_right) + in_left + in_right) * unit / all_
    gain = np.floor(gain * 1e9 + 0.5) / 1e9
    groups = _starts(of)
    most = np.maximum.reduceat(gain, groups)
    best = np.flatnonzero(gain == np.repeat(most, np.diff(np.r_[groups, len(of)])))
    best = best[_starts(of[best])]  # the lowest threshold of equal gains
    at = cut[best]
    return s[at], gain[best], (v[at] + above[best]) / 2, v[at]


def subtree(x: np.ndarray, codes: np.ndarray, criterion: str, depth: int) -> list[tuple]:
    """(node, class code, feature from 1 or 0, threshold, low) of all nodes; the root is 1, low the value next below the threshold."""
    n, p = x.shape
    f, steps, unit = weights(n, criterion)
    classes = int(codes.max()) + 1
    columns = np.ascontiguousarray(x.T)
    orders = []
    for column in columns:
        order = np.argsort(column, kind="stable")
        orders.append(order[: n - int(np.isnan(column).sum())].astype(np.int32))
    node, live, found = np.ones(n, np.int64), np.arange(n), []
    for level in range(depth + 1):
        names, slot = np.unique(node[live], return_inverse=True)
        keys, counts = np.unique(slot * classes + codes[live], return_counts=True)
        owner, code = keys // classes, keys % classes
        by_count = np.lexsort((code, -counts, owner))
        top = code[by_count[_starts(owner[by_count])]]
        mixed = np.bincount(owner, minlength=len(names)) > 1
        feature, threshold, low = np.zeros(len(names), np.int64), np.zeros(len(names)), np.zeros(len(names))
        if level < depth and mixed.any():
            gains = np.zeros(len(names))
            slots = np.full(n, -1, np.int64)
            slots[live] = np.where(mixed[slot], slot, -1)
            for j in range(p):
                s = slots[orders[j]]
                order, s = orders[j][s >= 0], s[s >= 0]
                by_slot = sorting(s, len(names) - 1)
                orders[j] = order = order[by_slot]
                if not len(order):
                    continue
                best = best_of_feature(s[by_slot], columns[j][order], codes[order], classes, f, steps, unit, criterion)
                if best is None:
                    continue
                better = best[1] > gains[best[0]]
                at = best[0][better]
                gains[at], feature[at] = best[1][better], j + 1
                threshold[at], low[at] = best[2][better], best[3][better]
        found += zip(names.tolist(), top.tolist(), feature.tolist(), threshold.tolist(), low.tolist())
        split = feature[slot] > 0
        live, slot = live[split], slot[split]
        if not len(live):
            break
        right = ~(columns[feature[slot] - 1, live] <= threshold[slot])
        node[live] = 2 * node[live] + right
    return found


def grown_below(rows: pd.DataFrame, criterion: str, depth: int) -> pd.DataFrame:
    """The nodes (batch, node, class_name, j, threshold, low) of the tree below one node, of its rows (batch, _node, class_name, features)."""
    root = int(rows["_node"].iloc[0])
    level = root.bit_length() - 1
    known = sorted(rows["class_name"].dropna().unique())
    codes = pd.Categorical(rows["class_name"], categories=known).codes.astype(np.int64)
    names: list = known
    if (codes < 0).any():  # a missing class comes first
        codes, names = codes + 1, [None, *known]
    found = subtree(np.stack(rows["features"].to_list()).astype(float), codes, criterion, depth - level)
    out = pd.DataFrame(found, columns=["_node", "class_name", "j", "threshold", "low"])
    down = out["_node"].map(lambda m: m.bit_length() - 1)
    out["_node"] = [(root << d) + m - (1 << d) for m, d in zip(out["_node"], down)]
    out["class_name"] = out["class_name"].map(lambda c: names[c]).astype(object)
    out.insert(0, "batch", rows["batch"].iloc[0])
    return out
