"""Periodic runs of words (maximal repetitions) by seeds on diagonals.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least max(12, 2 * q) words
long, that cannot be made longer at either end without breaking the period. A document is one row, and all work is done
inside its row, so nothing is shuffled and a task's memory hangs on its longest text only.

* Index. A run of period q and length n has n - q >= max(12 - q, q) places whose word is equal to the one q places on, so
  a window of that many words occurs at lag q. The windows of six words serve the lags below 12, those of 12 words the
  lags 12 to 23, those of 24 words the lags 24 to 47, and so on: the window never outgrows the guaranteed overlap.
  Windows of 2 * k words are named by the pair of their halves, and only windows whose halves both occur twice can occur
  twice, so most texts are done after the six-word windows.
* Occurrence pairs. From 12 words on, an occurrence asks for earlier ones at the lags of its level only if no equal window
  starts within k / 2 words before it. Otherwise the window has a short period p and lies in a stretch of that
  period, and every run of a longer period has a seed that does ask: either one of its windows has no period up to k / 2,
  or its two periods lie in two different stretches of period p; then the copy of the run's first window starts less than
  p words into the second stretch, as two stretches share fewer than p words. So pairs stay in proportion to the
  text and its logarithm, also for a text that repeats one word, and no run is lost.
* Extension. Seeds of a lag are walked in order with a table of the furthest place that each lag has covered; a seed inside
  what is covered is skipped, any other is extended word by word to both sides. A stretch found at lag q that also has a
  proper divisor of q as period belongs to the run of that smaller period and is dropped.

Defined results: a null, empty or blank text has no words and no runs; equal rows give equal results; ids, nulls in other
columns and the columns' names do not matter, since rows are carried along as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import let, with_python_columns, ws_words
from tracewright.llm.hashing import BASES, mixed, run_hashes

LEAST = 12  # words of the shortest run
SEED = LEAST // 2  # least over q of max(LEAST - q, q)
BLOCK = 256  # words compared at once when a seed is extended; doubles as it goes on

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


# ---- seeds ---------------------------------------------------------------------------------------------


def _repeated(names: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names that occur twice or more, renumbered from 0, with their places; sorted by name, then place."""
    if not len(names):
        return names, at
    order = np.argsort(names, kind="stable")
    names, at = names[order], at[order]
    same = names[1:] == names[:-1]
    keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    names, at = names[keep], at[keep]
    return np.cumsum(np.concatenate([[0], names[1:] != names[:-1]]))[:len(names)], at


def _pairs(names: np.ndarray, at: np.ndarray, low: int, high: int, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, earlier place) of occurrences of a name that are low .. high - 1 places apart.

    Only later occurrences without another one within `apart` places before them ask. names and at are sorted.
    """
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    asks = np.ones(len(at), bool)
    if apart:
        asks[1:] = (names[1:] != names[:-1]) | (at[1:] - at[:-1] > apart)
    later = np.flatnonzero(asks)
    key = names * np.int64(2 * (at.max() + high + 1)) + at  # one line on which names lie far apart
    first = np.searchsorted(key, key[later] - (high - 1))
    last = np.searchsorted(key, key[later] - low, side="right")
    count = np.maximum(last - first, 0)
    asked = np.repeat(later, count)
    earlier = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    return at[asked] - at[earlier], at[earlier]


def seeds(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window, lag, place): the window at the place occurs again lag places on; sorted by lag, then place."""
    n = len(codes)
    with np.errstate(over="ignore"):
        grams = run_hashes(mixed(codes.astype(np.uint64) + np.uint64(1)), SEED, BASES[0])
    names, at = _repeated(grams, np.arange(len(grams), dtype=np.int64))
    k, low, apart = SEED, 1, 0
    while len(at):
        lags, places = _pairs(names, at, low, 2 * k, apart)
        order = np.lexsort((places, lags))
        yield k, lags[order], places[order]
        if 4 * k > n:  # the next lags start at 2 * k, and their runs have twice that
            return
        of = np.full(n, -1, np.int64)
        of[at] = names
        whole = at[at + k < n]
        whole = whole[of[whole + k] >= 0]
        names, at = _repeated(of[whole] * np.int64(n) + of[whole + k], whole)
        k, low, apart = 2 * k, 2 * k, k


# ---- extension -----------------------------------------------------------------------------------------


def _equal_from(codes: np.ndarray, i: int, j: int, end: int) -> int:
    """How many words from i on equal those from j on; j stays below end."""
    done, size = 0, BLOCK
    while j + done < end:
        m = min(size, end - j - done)
        off = np.flatnonzero(codes[i + done:i + done + m] != codes[j + done:j + done + m])
        if len(off):
            return done + int(off[0])
        done, size = done + m, size * 2
    return done


def _equal_before(codes: np.ndarray, i: int, j: int) -> int:
    """How many words before i equal those before j, for i < j."""
    done, size = 0, BLOCK
    while done < i:
        m = min(size, i - done)
        off = np.flatnonzero(codes[i - done - m:i - done] != codes[j - done - m:j - done])
        if len(off):
            return done + m - 1 - int(off[-1])
        done, size = done + m, size * 2
    return done


def _prime_factors(n: int) -> list[int]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return out + [n] if n > 1 else out


def find_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start, then period."""
    n, out = len(codes), []
    if n < LEAST:
        return out
    for _, lags, places in seeds(codes):
        covered: dict[int, int] = {}
        # Neighbours on a diagonal are one stretch: only its first seed is looked at.
        first = np.ones(len(lags), bool)
        first[1:] = (lags[1:] != lags[:-1]) | (places[1:] != places[:-1] + 1)
        for q, i in zip(lags[first].tolist(), places[first].tolist()):
            if i < covered.get(q, 0):
                continue
            start = i - _equal_before(codes, i, i + q)
            end = i + _equal_from(codes, i, i + q, n)  # word `end` differs from the one q on
            covered[q] = max(end, i + 1)
            length = end + q - start
            if length < max(LEAST, 2 * q):
                continue
            part = codes[start:start + length]
            if not any((part[q // f:] == part[:-(q // f)]).all() for f in _prime_factors(q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    numbers = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that lie in a run behind its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]


# ---- jobs ----------------------------------------------------------------------------------------------


def periodic_runs(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """(row, n_words, runs, collapsed): each row as a struct, the runs of its text, and its words without repetitions.

    text is the column `text` if none is given. The words that are left are joined by one space.
    """

    def found(rows: Iterable[dict]) -> Iterator[dict]:
        for row in rows:
            words = (row["text"] or b"").split()  # of bytes: at space, TAB, LF, VT, FF and CR
            runs = find_runs(word_numbers(words))
            yield {"n_words": len(words), "runs": [dict(zip(("start", "length", "period"), r)) for r in runs],
                   "left": b" ".join(collapsed(words, runs))}

    fields = [("n_words", T.LongType()), ("runs", T.ArrayType(RUN)), ("left", T.BinaryType())]
    text = F.col("`text`") if text is None else text
    out = with_python_columns(docs, {"text": text.cast("binary")}, fields, found)
    return out.select("row", "n_words", "runs", F.col("left").cast("string").alias("collapsed"))


def stretched(text: Column, id_: Column) -> Column:
    """The text of every tenth document (by the CRC of its id) with a periodic tail in place of its own words.

    From word a on, each word is one of the p words from a on, in turn; a and p come from the CRC and the length.
    """
    h = F.crc32(id_.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def of(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
        return let(F.struct(a.alias("a"), p.alias("p")), lambda s: F.array_join(F.transform(
            words, lambda w, i: F.when(i >= s["a"], F.get(words, s["a"] + (i - s["a"]) % s["p"])).otherwise(w)), " "))

    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), let(ws_words(text), of)).otherwise(text)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row its id, the number of runs, the longest one, and hashes of all runs and of the words left."""
    top = F.array_sort("runs", lambda x, y: F.when(x["length"] > y["length"], -1).when(x["length"] < y["length"], 1)
                       .when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1)
                       .when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    out = found.select(F.col(f"row.`{id_col}`").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
                       F.get(top, F.lit(0)).alias("top"),
                       F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("").alias("listed"), "collapsed")
    return out.select(
        "doc_id", "n_runs", "top.start", "top.length", "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def brute_force(text: str | None) -> list[tuple[int, int, int]]:
    """All runs from all lags, for tests."""
    words = (text or "").encode().split()
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            part = words[start:start + length]
            if length >= max(LEAST, 2 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))
