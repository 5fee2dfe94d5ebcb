"""Removal of passages that repeat across documents, by automata of confirmed phrases.

A window is `window` consecutive words of one document. A word goes if a window around it has a word sequence that also
starts in a document with a smaller id. Three steps, of which none looks at pairs of documents:

1. Confirm recurring passages. Each window has an anchor: of its 16-word phrases the one with the least hash, so
   equal windows have equal anchors and neighbours mostly share one (about one anchor in 18 words). Anchors of two or
   more documents are recurring, and only windows with such an anchor can repeat. Their 96-bit hashes are grouped, with partial
   sums, and each learns the smallest document it starts in. Documents that equal an earlier one as a whole skip this.
2. Compile sharded automata. A run of confirmed windows is covered by few of them, end to end. Those phrases, cut from
   the text, are the patterns of an Aho-Corasick automaton; a shard is a slice of documents with their phrases, of
   bounded size.
3. Stream the documents of the shard that have confirmed windows through its automaton. Every occurrence of a phrase in a document with an id above
   the phrase's first document marks its words.

Frequent passages stay harmless: grouping has partial aggregates, and joins that bring a result back to many rows are
plain sort-merge joins that adaptive execution may split. What a document needs is bounded by its own length.

Defined results: a null or empty text has no words; a row with a null id keeps all its words and repeats nothing; rows
with one id are one document for "smaller", each row judged by its own text; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewright.llm.hashing import BASES, mixed, run_hashes, sliding, word_codes
from tracewright.session import materialised

WINDOW = 50
ANCHOR = 16
SHARD_CHARS = 4 << 20  # of text that shares an automaton; one document may be longer


def window_anchors(codes: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """For each window the hash of its anchor, the least of its phrases; equal windows have equal anchors."""
    if len(codes) < window:
        return np.empty(0, np.uint64)
    return sliding(mixed(run_hashes(codes, anchor, BASES[0])), window - anchor + 1, np.minimum)


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    ends = column.offsets.to_numpy()
    for i in range(len(column)):
        yield values[ends[i]:ends[i + 1]]


# ---- 1: confirmed windows ------------------------------------------------------------------------------


def _anchor_lists(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(id, key, n, whole1, whole2, anchors): the distinct anchors of each document, and hashes of its whole text."""
    schema = T.StructType([
        docs.schema["id"], T.StructField("key", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("whole1", T.LongType()), T.StructField("whole2", T.LongType()),
        T.StructField("anchors", T.ArrayType(T.LongType())),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, whole, lists = [], ([], []), []
            with np.errstate(over="ignore"):
                for text in batch.column(2):
                    codes = word_codes(text.as_py())
                    n.append(len(codes))
                    for base, out in zip(BASES, whole):
                        h = run_hashes(codes, len(codes), base) if len(codes) else np.zeros(1, np.uint64)
                        out.append(int(mixed(h).view(np.int64)[0]))
                    lists.append(np.unique(window_anchors(codes, window, anchor)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(whole[0], pa.int64()),
                 pa.array(whole[1], pa.int64()), pa.array(lists, pa.list_(pa.int64()))], schema=arrow)

    return docs.select("id", "key", "_text").mapInArrow(run, schema)


def _candidates(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(id, key, windows): hashes and starts of the windows whose anchors recur; docs has `recurring` lists."""
    entry = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.IntegerType()),
                          T.StructField("at", T.IntegerType())])
    schema = T.StructType([docs.schema["id"], T.StructField("key", T.LongType()),
                           T.StructField("windows", T.ArrayType(entry))])
    arrow = to_arrow_schema(schema)

    def of(codes: np.ndarray, recurring: np.ndarray) -> list[np.ndarray]:
        starts = np.flatnonzero(np.isin(window_anchors(codes, window, anchor), recurring))
        h1, h2 = (mixed(run_hashes(codes, window, base)[starts]) for base in BASES)
        return [h1.view(np.int64), h2.astype(np.uint32).view(np.int32), starts.astype(np.int32)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, sizes = [], [0]
            with np.errstate(over="ignore"):
                for text, recurring in zip(batch.column(2), _lists(batch.column(3))):
                    codes = word_codes(text.as_py())
                    if len(codes) >= window:
                        parts.append(of(codes, recurring))
                        sizes.append(len(parts[-1][2]))
                    else:
                        sizes.append(0)
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [
                np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)]
            structs = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["h1", "h2", "at"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), structs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), lists.cast(arrow.field("windows").type)], schema=arrow)

    return docs.select("id", "key", "_text", "recurring").mapInArrow(run, schema).where(F.size("windows") > 0)


def confirmed_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(id, key, first, windows): for documents (id, key, _text) what a smaller document has, too.

    first is the smallest id with the same whole text, if it is smaller; otherwise windows lists (at, owner): the start
    of each window that also starts in a smaller document, and the smallest such document.
    """
    lists = materialised(_anchor_lists(docs.where("id is not null"), window, anchor))
    long = lists.where(F.col("n") >= window)
    same = long.groupBy("whole1", "whole2", "n").agg(F.min("id").alias("first"))
    copies = long.join(same, ["whole1", "whole2", "n"]).where("first < id").select("id", "key", "first").distinct()

    one = lists.select("id", "key", F.explode("anchors").alias("anchor"))
    recurring = one.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    marks = one.join(recurring.select("anchor"), "anchor").groupBy("id", "key").agg(
        F.collect_set("anchor").alias("recurring"))
    # Not written: the texts are shuffled once, and the windows come out of that shuffle once for each use.
    marked = docs.where("id is not null").join(marks, ["id", "key"]).join(copies, ["id", "key"], "left_anti")
    windows = _candidates(marked, window, anchor)

    each = windows.select("id", "key", F.inline("windows"))
    owners = each.groupBy("h1", "h2").agg(F.min("id").alias("owner"), F.max("id").alias("hi")).where("owner < hi")
    later = each.join(owners.select("h1", "h2", "owner"), ["h1", "h2"]).where("owner < id")
    spans = later.groupBy("id", "key").agg(F.collect_set(F.struct("at", "owner")).alias("windows"))
    return copies.withColumn("windows", F.lit(None).cast(spans.schema["windows"].dataType)).unionByName(
        spans.withColumn("first", F.lit(None).cast(docs.schema["id"].dataType)))


# ---- 2 and 3: automata ---------------------------------------------------------------------------------


def phrases(words: list[str], first, windows: list[dict] | None, window: int) -> Iterator[tuple[str, object]]:
    """(phrase, a smaller document that has it): windows that cover the repeated words, end to end."""
    if first is not None:
        chosen = [(at, first) for at in {*range(0, len(words) - window + 1, window), len(words) - window}]
    else:
        owner = {w["at"]: w["owner"] for w in windows or ()}
        chosen, run = [], sorted(owner)
        last = None  # the start chosen last
        for i, at in enumerate(run):
            ends = i + 1 == len(run) or run[i + 1] > at + 1
            if last is None or at - last >= window or ends:
                chosen.append((at, owner[at]))
                last = None if ends else at
    for at, who in chosen:
        yield " " + " ".join(words[at:at + window]) + " ", who


class Shard:
    """Documents and the phrases that they hold."""

    def __init__(self, window: int):
        self.window, self.docs, self.phrases, self.chars = window, [], {}, 0

    def add(self, doc_id, text: str | None, first, windows) -> None:
        words = [w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").split()]
        for phrase, owner in phrases(words, first, windows, self.window):
            if phrase not in self.phrases or owner < self.phrases[phrase]:
                self.phrases[phrase] = owner
        self.docs.append((doc_id, words, first is not None or windows is not None))
        self.chars += len(text or "")

    def removed(self) -> Iterator[tuple[list[str], np.ndarray]]:
        """Words of each document, and whether each goes."""
        automaton = ahocorasick.Automaton()
        for phrase, owner in self.phrases.items():
            automaton.add_word(phrase, owner)
        if self.phrases:
            automaton.make_automaton()
        for doc_id, words, repeats in self.docs:  # without a confirmed window there is nothing to find
            gone = np.zeros(len(words) + 1, np.int64)
            if repeats:
                ends = np.cumsum([len(w) + 1 for w in words])  # of the space behind each word
                for end, owner in automaton.iter(" " + " ".join(words) + " "):
                    if owner < doc_id:
                        last = int(np.searchsorted(ends, end))
                        gone[last + 1 - self.window] += 1
                        gone[last + 1] -= 1
            yield words, np.cumsum(gone[:-1]) > 0


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    anchor: int = ANCHOR,
    shard_chars: int = SHARD_CHARS,
) -> DataFrame:
    """(id_col, n_words, spans, kept): removed word spans [start, end), and the words left, joined by one space."""
    # A name of its own for the text: a column that keeps its name makes the two uses of the shuffled texts look different.
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("_text")).withColumn(
        "key", F.xxhash64(F.lit(2), "id", "_text"))
    known = confirmed_windows(base, window, anchor)
    found = base.where("id is not null").join(known, ["id", "key"], "left").select("id", "_text", "first", "windows")
    found = found.unionByName(base.where("id is null").select("id", "_text"), allowMissingColumns=True)
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.StringType()),
    ])
    arrow = to_arrow_schema(schema)

    def finished(shard: Shard) -> pa.RecordBatch:
        rows = []
        for (doc_id, *_), (words, gone) in zip(shard.docs, shard.removed()):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            rows.append((doc_id, len(words), edges.reshape(-1, 2).tolist(),
                         " ".join(w for w, g in zip(words, gone) if not g)))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(window)
        for batch in batches:
            for i in range(batch.num_rows):
                shard.add(*(batch.column(c)[i].as_py() for c in range(4)))
                if shard.chars >= shard_chars:
                    yield finished(shard)
                    shard = Shard(window)
        if shard.docs:
            yield finished(shard)

    return found.mapInArrow(run, schema)


def digests(cleaned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return cleaned.select(F.col(id_col).alias("doc_id"), "n_words", n_removed.alias("n_removed"),
                          F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(docs: Iterable[tuple], window: int = WINDOW) -> list[tuple]:
    """The digests from a table of all windows, for tests."""
    split = [(i, [w.decode() for w in (t or "").encode().split()]) for i, t in docs]
    first: dict[tuple, object] = {}
    for i, words in split:
        for s in range(len(words) - window + 1 if i is not None else 0):
            gram = tuple(words[s:s + window])
            first[gram] = min(first.get(gram, i), i)
    out = []
    for i, words in split:
        gone = set()
        for s in range(len(words) - window + 1 if i is not None else 0):
            if first[tuple(words[s:s + window])] < i:
                gone |= set(range(s, s + window))
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
