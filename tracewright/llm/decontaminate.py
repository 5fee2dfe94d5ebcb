"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a run of `window` consecutive words of a benchmark item, or the whole item if it has fewer words. For each
pattern length a table of two-word blocks says how far the search may shift; a block that ends patterns leads to the
bucket of those patterns, which are compared word by word.

The items are the query set. They are taken in blocks of bounded size: each block is collected, compiled and shipped to
the tasks, and the documents pass through the blocks one after the other. Documents are not shuffled.

Defined results: a null or empty text has no words and no hits; an item without words is in no document; rows of one
item_id are one item; a null item_id reads 'null'. Each document row is judged by itself, so repeated rows, null ids
and further columns change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import with_python_columns

WINDOW = 10
BLOCK_BYTES = 32 << 20  # of benchmark text that is compiled at once

# Bytes that stand between words become spaces, A-Z become a-z; bytes of other alphabets stay.
_WORD = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_BYTES = bytes(b if b in _WORD else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split() if text else []


def pattern_table(m: int, patterns: dict[tuple, set[str]]) -> dict:
    """Shift and bucket tables of patterns that all have m words."""
    block = min(2, m)
    far = m - block + 1
    shift: dict[tuple, int] = {}
    buckets: dict[tuple, list[tuple[tuple, set[str]]]] = {}
    for pattern, items in patterns.items():
        for end in range(block, m + 1):
            at = pattern[end - block:end]
            shift[at] = min(shift.get(at, far), m - end)
        buckets.setdefault(pattern[m - block:], []).append((pattern, items))
    return {"m": m, "block": block, "far": far, "shift": shift, "buckets": buckets}


def occurrences(table: dict, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
    """Start and items of each occurrence of a pattern of the table."""
    m, block, far, shift, buckets = (table[k] for k in ("m", "block", "far", "shift", "buckets"))
    end, n = m, len(words)
    while end <= n:
        at = tuple(words[end - block:end])
        step = shift.get(at, far)
        if step:
            end += step
            continue
        here = tuple(words[end - m:end])
        for pattern, items in buckets[at]:
            if pattern == here:
                yield end - m, items
        end += 1


def compile_items(items: Iterable[tuple[str, str | None]], window: int = WINDOW) -> list[dict]:
    by_length: dict[int, dict[tuple, set[str]]] = {}
    for item_id, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for start in range(len(words) - m + 1 if m else 0):
            by_length.setdefault(m, {}).setdefault(tuple(words[start:start + m]), set()).add(item_id)
    return [pattern_table(m, patterns) for m, patterns in sorted(by_length.items())]


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as few [start, end) that do not meet."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


FIELDS = [
    ("n_words", T.LongType()),
    ("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ("items", T.ArrayType(T.StringType())),
]


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(row, n_words, spans, items): each document as a struct, its words, hit word spans and items, both sorted."""
    sc = docs.sparkSession.sparkContext
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
                             F.col(item_text_col).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // block_bytes
    out = docs
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        tables = sc.broadcast(compile_items(((r.item, r.text) for r in part.toLocalIterator()), window))

        def search(rows: Iterable[dict], tables=tables, first=k == 0) -> Iterator[dict]:
            for row in rows:
                words = words_of(row["text"])
                spans = [] if first else [tuple(s) for s in row["spans"]]
                found = set() if first else set(row["items"])
                for t in tables.value:
                    for start, which in occurrences(t, words):
                        spans.append((start, start + t["m"]))
                        found |= which
                yield {"n_words": len(words), "spans": merged(spans), "items": sorted(found)}

        if k == 0:
            out = with_python_columns(docs, {"text": F.col(text_col)}, FIELDS, search)
        else:  # the row of the row: unpack it again
            inputs = {"text": F.col(f"row.`{text_col}`"), "spans": F.col("spans"), "items": F.col("items")}
            out = with_python_columns(out, inputs, FIELDS, search).select("row.row", "n_words", "spans", "items")
    return out


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: its words, hit words, items, and the hash of the sorted item ids."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select(
        F.col(f"row.`{id_col}`").alias("doc_id"), "n_words", n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """The documents without any occurrence, with their columns as they were."""
    found = find_items(docs, benchmark, text_col, **settings)
    return found.where(F.size("spans") == 0).select("row.*")


def brute_force(docs: Iterable[tuple], items: Iterable[tuple], window: int = WINDOW) -> list[tuple]:
    """The digests without tables, for tests."""
    compiled = [(str(i) if i is not None else "null", words_of(t)) for i, t in items]
    out = []
    for doc_id, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item, iw in compiled:
            m = min(window, len(iw))
            grams = {tuple(iw[s:s + m]) for s in range(len(iw) - m + 1)} if m else set()
            for s in range(len(words) - m + 1 if m else 0):
                if tuple(words[s:s + m]) in grams:
                    hit |= set(range(s, s + m))
                    found.add(item)
        names = ",".join(sorted(found)).encode()
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(names).hexdigest(), bool(hit)))
    return out
