"""Collocations: the phrases of two to five words that score best in each language, by best-first branch and bound.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and those into words. With n words in a language and
f occurrences of a phrase, a cut of a phrase into two parts scores floor(1000 * f(phrase) * n / (f(first) * f(rest))), and the
phrase has the least score of its cuts. Phrases with f >= least are candidates; one that lies in a longer candidate that
occurs as often is dropped. The first `top` phrases of each language are wanted.

* Bounds. f(rest) >= f(phrase), so no phrase scores more than 1000 * n / f(first word), whatever follows: a prefix's least count
  of all, that of its first word, bounds all that can grow from it. Read from the other end, the last word bounds it alike.
* Frontier. Words are taken in order of that bound, the rarest frequent ones first, in waves that hold a growing share of a
  language's words. A wave grows prefixes word by word from its words, over frequent words only, and keeps what ends in one of
  its words. Everything outside the wave scores at most 1000 * n / (count of the next word), so a language is settled when
  `top` surviving phrases of the wave score more than that, ties included, or when the wave holds all its frequent words.
  Only languages that are not settled see another wave.
* A wave reads the documents three times: counts of what grows; for the candidates the words before and behind each occurrence (a
  phrase occurs in a longer one as often as by itself if and only if one word stands before, or behind, all its
  occurrences) and their text; counts of the first and last parts of the candidates.

Tasks count what they read before anything is shuffled, so a word in every document is one row a task. What steers the tasks are
bitmaps of 2^25 bits (4 MB) that say which hashes may be worth a row: their size is fixed, wrong positives cost rows that the
exact counts then drop, and nothing is lost when they fill up. Words and phrases are compared by 64-bit hashes. The arithmetic
of the scores is that of whole decimal numbers.

Defined results: null and empty texts have no words; a null language is `und`; repeated rows count as often as they stand; a
language without candidates has no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import few_or_joined
from tracewright.llm.hashing import BASES, LOWER, _power_tables, mixed
from tracewright.session import materialised

LEAST, TOP, LONGEST = 100, 2000, 5
WAVES = (0.15, 0.5, 1.0)  # share of a language's words that the frontier's words hold
BITS = 25
CHUNK = 1 << 22  # bytes that are cut into words at once
FLUSH = 1 << 20  # hashes that a task holds before it counts them
NO_WORD = -1

_SEPARATOR = np.zeros(256, np.int8)
_SEPARATOR[[0x20, 0x09]] = 1
_SEPARATOR[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LENGTH = [np.uint64(0x9E3779B97F4A7C15 * m % 2 ** 64) for m in range(LONGEST + 1)]


# ---- words and phrases of a text -----------------------------------------------------------------------


def _sliced_words(data: bytes) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(data, np.uint8)
    kind = _SEPARATOR[raw]
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = kind == 0
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _power_tables(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:len(raw)], out=sums[1:])
    codes = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(BASES[1]))
    cuts = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(kind == 2, out=cuts[1:])
    return codes, cuts[starts].astype(np.int64), starts, ends, cuts[-1]


def words_of(data: bytes, salt: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, number of the piece, start and end of each word; a long text is cut into slices between words."""
    parts, at, pieces, slice_ = [], 0, 0, 1 << 20
    while at < len(data):
        end = min(len(data), at + slice_)
        while end < len(data) and not _SEPARATOR[data[end]]:
            end += 1
        codes, piece, starts, ends, cuts = _sliced_words(data[at:end])
        parts.append((mixed(codes ^ salt), piece + pieces, starts + at, ends + at))
        at, pieces = end, pieces + int(cuts)
    if not parts:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(p) for p in zip(*parts))


def grown(codes: np.ndarray, piece: np.ndarray, first: np.ndarray, inner: np.ndarray, longest: int = LONGEST
          ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, hashes) of the phrases from two words on: they begin at `first`, and all their words are `inner`."""
    at = np.flatnonzero(first & inner)
    hashes = codes[at]
    for m in range(2, longest + 1):
        more = at + (m - 1)
        keep = more < len(codes)
        at, more, hashes = at[keep], more[keep], hashes[keep]
        keep = inner[more] & (piece[more] == piece[at])
        at, more = at[keep], more[keep]
        hashes = hashes[keep] * np.uint64(BASES[0]) + codes[more]
        yield m, at, mixed(hashes + _LENGTH[m])


def language_salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))


def texts_by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(language, lower-cased texts of it, with a line end between them) of a batch (text as bytes, language)."""
    texts: dict[str, list[bytes]] = {}
    for text, lang in zip(batch.column(0), batch.column(1)):
        text = text.as_py()
        if text:
            texts.setdefault(lang.as_py(), []).append(text)
    for lang, found in texts.items():
        held, size = [], 0
        for text in found:
            if held and size + len(text) > CHUNK:
                yield lang, b"\n".join(held).translate(LOWER)
                held, size = [], 0
            held.append(text)
            size += len(text) + 1
        yield lang, b"\n".join(held).translate(LOWER)


# ---- counts --------------------------------------------------------------------------------------------


class Bitmap:
    """Which hashes may be in a set: one bit for the last BITS bits of each."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64((1 << BITS) - 1)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bitmaps(keys: DataFrame, *which: Column) -> list[Bitmap]:
    """A bitmap of the column `h` of the rows for which each condition holds; 2^19 numbers each come to the driver."""
    at = F.col("h").bitwiseAND(F.lit((1 << BITS) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    sums = [F.bit_or(F.when(c, bit).otherwise(F.lit(0).cast("long"))).alias(f"b{i}") for i, c in enumerate(which)]
    rows = keys.groupBy(F.call_function("shiftright", at, F.lit(6)).cast("int").alias("at")).agg(*sums).toArrow()
    places, out = rows.column("at").to_numpy(), []
    for i in range(len(which)):
        words = np.zeros(1 << (BITS - 6), np.int64)
        words[places] = rows.column(f"b{i}").to_numpy()
        out.append(Bitmap(words.view(np.uint64)))
    return out


def counted(texts: DataFrame, hashes: Callable[[str, bytes], Iterator[np.ndarray]]) -> DataFrame:
    """(lang, h, f): how often `hashes` gives each hash for the texts of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                for s in range(0, len(keys), 1 << 16):
                    part = keys[s:s + (1 << 16)].view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(n[s:s + (1 << 16)].astype(np.int64))],
                        names=["lang", "h", "f"])
            held.clear()

        for batch in batches:
            for lang, data in texts_by_language(batch):
                with np.errstate(over="ignore"):
                    for part in hashes(lang, data):
                        held.setdefault(lang, []).append(part)
                        size += len(part)
                if size >= FLUSH:
                    yield from flushed()
                    size = 0
        yield from flushed()

    found = texts.mapInArrow(run, "lang string, h long, f long")
    return found.groupBy("lang", "h").agg(F.sum("f").alias("f"))


def _described(texts: DataFrame, shared) -> DataFrame:
    """(lang, h, m, phrase, drops): the candidates in the bitmap, and whether a longer one occurs as often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner_words, own_words, wanted = shared.value
        for batch in batches:
            for lang, data in texts_by_language(batch):
                with np.errstate(over="ignore"):
                    codes, piece, starts, ends = words_of(data, language_salt(lang))
                    if not len(codes):
                        continue
                    own, signed = own_words.holds(codes), codes.view(np.int64)
                    for m, at, hashes in grown(codes, piece, own, inner_words.holds(codes)):
                        keep = own[at + m - 1]
                        keep[keep] = wanted.holds(hashes[keep])
                        at, hashes = at[keep], hashes[keep]
                        if not len(at):
                            continue
                        order = np.argsort(hashes, kind="stable")
                        at, hashes = at[order], hashes[order]
                        head = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
                        ahead, behind = np.maximum(at - 1, 0), np.minimum(at + m, len(codes) - 1)
                        before = np.where((at > 0) & (piece[ahead] == piece[at]), signed[ahead], NO_WORD)
                        after = np.where((at + m < len(codes)) & (piece[behind] == piece[at]), signed[behind], NO_WORD)
                        sides = [pick.reduceat(x, head) for x in (before, after) for pick in (np.minimum, np.maximum)]
                        text = [b" ".join(data[starts[i + j]:ends[i + j]] for j in range(m)) for i in at[head].tolist()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(head), pa.string()), pa.array(hashes[head].view(np.int64)),
                             pa.array(np.full(len(head), m, np.int32)), pa.array(text, pa.binary()), *map(pa.array, sides)],
                            names=["lang", "h", "m", "phrase", "b0", "b1", "a0", "a1"])

    found = texts.mapInArrow(run, "lang string, h long, m int, phrase binary, b0 long, b1 long, a0 long, a1 long")
    sides = found.groupBy("lang", "h", "m").agg(F.min("phrase").alias("phrase"), F.min("b0").alias("b0"), F.max("b1").alias("b1"),
                                                F.min("a0").alias("a0"), F.max("a1").alias("a1"))
    always = (F.col("b0") == F.col("b1")) & (F.col("b0") != NO_WORD) | (F.col("a0") == F.col("a1")) & (F.col("a0") != NO_WORD)
    return sides.select("lang", "h", "m", "phrase", (always & (F.col("m") < LONGEST)).alias("drops"))


def _cuts(phrases: DataFrame) -> DataFrame:
    """(lang, h, k, first, rest): the hashes of both parts of each cut of phrases (lang, h, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, h, phrase in zip(*(c.to_pylist() for c in batch.columns)):
                with np.errstate(over="ignore"):
                    codes = words_of(phrase, language_salt(lang))[0]
                    every = np.ones(len(codes), bool)
                    of = {(int(i), 1): c for i, c in enumerate(codes)}
                    for m, at, hashes in grown(codes, np.zeros(len(codes), np.int64), every, every):
                        of.update({(int(i), m): x for i, x in zip(at, hashes)})
                rows += [(lang, h, k, of[0, k].view(np.int64), of[k, len(codes) - k].view(np.int64)) for k in range(1, len(codes))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                names=["lang", "h", "k", "first", "rest"])

    return phrases.select("lang", "h", "phrase").mapInArrow(run, "lang string, h long, k int, first long, rest long")


# ---- waves ---------------------------------------------------------------------------------------------


def frontier(words: DataFrame, totals: DataFrame, share: float) -> DataFrame:
    """(lang, n, most, bound): the largest count of the wave's words, and what a phrase with another word can score.

    The counts are taken in some 300 steps for a language. bound is null if the wave holds all words.
    """
    step = F.floor(8 * F.log2("f"))
    steps = words.groupBy("lang", step.alias("s")).agg(F.sum("f").alias("t"), F.max("f").alias("top"), F.min("f").alias("low"))
    upto = Window.partitionBy("lang").orderBy("s")
    listed = steps.join(totals, "lang").withColumns({"upto": F.sum("t").over(upto), "no": F.row_number().over(upto)})
    inside = (F.col("upto") <= share * F.col("n")) | (F.col("no") == 1) | F.lit(share >= 1)
    return listed.groupBy("lang", "n").agg(F.max(F.when(inside, F.col("top"))).alias("most"),
                                           F.min(F.when(~inside, F.col("low"))).alias("next")).select(
        "lang", "n", "most", F.expr("cast(1000 * cast(n as decimal(20, 0)) as decimal(38, 0)) div next").alias("bound"))


def scored(texts: DataFrame, words: DataFrame, wave: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, a, l, r, n, score, bound): the surviving candidates of a wave."""
    spark = texts.sparkSession
    limits = F.broadcast(wave)  # one row for each language
    ours = words.join(limits.select("lang", "most"), "lang")
    inner_words, own_words = bitmaps(ours, F.lit(True), F.col("f") <= F.col("most"))
    ends = spark.sparkContext.broadcast((inner_words, own_words))

    def growing(lang: str, data: bytes) -> Iterator[np.ndarray]:
        inner_words, own_words = ends.value
        codes, piece, _, _ = words_of(data, language_salt(lang))
        own = own_words.holds(codes)
        for m, at, hashes in grown(codes, piece, own, inner_words.holds(codes)):
            yield hashes[own[at + m - 1]]

    texts = texts.join(limits.select("lang"), "lang", "left_semi").select("text", "lang")
    counts = materialised(counted(texts, growing).where(F.col("f") >= least))
    described = spark.sparkContext.broadcast((inner_words, own_words, *bitmaps(counts, F.lit(True))))
    phrases = materialised(_described(texts, described).join(counts, ["lang", "h"]))
    cuts = materialised(_cuts(phrases))
    parts = cuts.select("lang", F.col("first").alias("h")).union(cuts.select("lang", "rest")).distinct()
    wanted = spark.sparkContext.broadcast((inner_words, *bitmaps(parts, F.lit(True))))

    def asked(lang: str, data: bytes) -> Iterator[np.ndarray]:
        inner_words, parts = wanted.value
        codes, piece, _, _ = words_of(data, language_salt(lang))
        every = inner_words.holds(codes)
        for _, _, hashes in grown(codes, piece, every, every, LONGEST - 1):
            yield hashes[parts.holds(hashes)]

    known = counted(texts, asked).join(parts, ["lang", "h"], "left_semi")
    known = materialised(known.union(ours.select("lang", "h", "f").join(parts, ["lang", "h"], "left_semi")))
    both = cuts.join(known.select("lang", F.col("h").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(
        known.select("lang", F.col("h").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    counted_cuts = both.join(phrases.where("not drops").select("lang", "h", "phrase", F.col("f").alias("a")), ["lang", "h"]).join(
        limits.select("lang", "n", "bound"), "lang")
    # Products of a and n, and of l and r, stay below 10^38 for up to 10^17 words.
    score = F.expr("cast(1000 * cast(a as decimal(18, 0)) * cast(n as decimal(18, 0)) as decimal(38, 0))"
                   " div cast(cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)) as decimal(38, 0))")
    best = counted_cuts.groupBy("lang", "h").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"), F.first("phrase").alias("phrase"),
        F.first("a").alias("a"), F.first("n").alias("n"), F.first("bound").alias("bound"))
    return best.select("lang", F.col("phrase").cast("string").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score", "bound")


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each language, with their rank; the rows of a language are first cut in 64 parts."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(64))).orderBy(*order)
    fewer = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    return fewer.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(
        F.col("rank") <= top)


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    top: int = TOP,
    waves: tuple[float, ...] = WAVES,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language."""
    texts = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text"),
                        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"))
    every = materialised(counted(texts, lambda lang, data: iter([words_of(data, language_salt(lang))[0]])))
    totals = materialised(every.groupBy("lang").agg(F.sum("f").alias("n")))
    words = every.where(F.col("f") >= least)
    done = None
    for share in (*(w for w in waves if w < 1), 1.0):
        wave = materialised(frontier(words, totals, share))
        found = materialised(ranked(scored(texts, words, wave, least), top))
        # Settled: the last wanted phrase scores more than anything outside the wave can, or nothing is outside.
        last = found.groupBy("lang").agg(F.count("*").alias("found"), F.min("score").alias("least"))
        settled = wave.join(last, "lang", "left").where(
            F.col("bound").isNull() | (F.col("found") >= top) & (F.col("least") > F.col("bound"))).select("lang")
        settled = materialised(settled)
        found = found.join(few_or_joined(settled), "lang", "left_semi")
        done = found if done is None else done.union(found)
        totals = materialised(totals.join(few_or_joined(settled), "lang", "left_anti"))
        words = words.join(few_or_joined(totals.select("lang")), "lang", "left_semi")
        if not words.take(1):
            break
    return done.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
