"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of all labelled texts: each task keeps one array of counts per language and the arrays are
added up by key. The logarithms of the smoothed shares are broadcast as a matrix of languages by buckets; a document is a
sparse vector of bucket counts, scored by one product in numpy. Languages are taken in blocks, so that a matrix has a
bounded size however many languages there are.

Texts are read in slices, so a long text needs no more memory than a slice.

Defined results: a null text or one without letters is `und` with score 0, and so is everything if nothing is labelled.
Equal scores go to the language that comes first in order. Each row is judged by itself; further columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewright.llm.common import with_python_columns
from tracewright.llm.hashing import BASES, mixed
from tracewright.session import materialised

ORDERS = (1, 2, 3)
BITS = 13
SLICE = 1 << 20  # characters that are counted at once
BLOCK_LANGUAGES = 1024  # of 2^BITS four-byte numbers each: 32 MB a matrix
TASK_LANGUAGES = 256  # counted in a task before its sums are handed on
UNKNOWN = "und"

_PLAIN = np.arange(128, dtype=np.uint64)
_PLAIN[[c for c in range(128) if not chr(c).isalpha()]] = 32


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def bucket_counts(text: str, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> np.ndarray:
    """Counts of the n-grams of a text by bucket: lower case, runs of other ASCII characters as one space."""
    counts, overlap = np.zeros(1 << bits, np.int64), max(orders) - 1
    tail = np.empty(0, np.uint64)
    for start in range(0, len(text), SLICE):
        raw = text[start:start + SLICE].lower().encode("utf-32-le", "surrogatepass")
        chars = np.frombuffer(raw, np.uint32).astype(np.uint64)
        ascii_ = chars < 128
        chars[ascii_] = _PLAIN[chars[ascii_].astype(np.int64)]
        chars = np.concatenate([tail if start else np.full(1, 32, np.uint64), chars])
        with np.errstate(over="ignore"):
            for n in orders:
                # n-grams that lie in the tail as a whole were counted with the slice before.
                skip = max(0, len(tail) - n + 1) if start else 0
                size = len(chars) - n + 1
                if size <= skip:
                    continue
                code = np.full(size, n, np.uint64)
                for i in range(n):
                    code = code * np.uint64(BASES[0]) + chars[i:size + i]
                counts += np.bincount((mixed(code[skip:]) >> np.uint64(64 - bits)).astype(np.int64),
                                      minlength=1 << bits)
        tail = chars[-overlap:] if overlap else tail
    return counts


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(lang, n_docs, counts): documents and n-gram counts of each language, over all labelled texts."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("n_docs", T.LongType()),
                           T.StructField("counts", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def flush(sums: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([n for n, _ in sums.values()], pa.int64()),
             pa.array([c for _, c in sums.values()], arrow.field("counts").type)], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in sums and len(sums) >= TASK_LANGUAGES:
                    yield flush(sums)
                    sums = {}
                entry = sums.setdefault(lang, [0, np.zeros(1 << bits, np.int64)])
                entry[0] += 1
                entry[1] += bucket_counts(text.as_py(), bits=bits)
        yield flush(sums)

    lang, text = F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")
    parts = docs.select(lang, text).where("lang is not null and text is not null").mapInArrow(run, schema)
    cells = parts.select("lang", "n_docs", F.posexplode("counts").alias("bucket", "n"))
    sums = cells.groupBy("lang", "bucket").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    return sums.groupBy("lang").agg(
        F.max("n_docs").alias("n_docs"),
        F.transform(F.sort_array(F.collect_list(F.struct("bucket", "n"))), lambda x: x["n"]).alias("counts"))


FIELDS = [("lang_pred", T.StringType()), ("best", T.DoubleType()), ("total", T.DoubleType())]


def predicted(docs: DataFrame, model: DataFrame, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(row, lang_pred, score): each document as a struct, its likeliest language and that language's probability."""
    sc = docs.sparkSession.sparkContext
    model = materialised(model)
    names = sorted(r.lang for r in model.select("lang").toLocalIterator())
    out, first = docs, True
    for start in range(0, max(1, len(names)), BLOCK_LANGUAGES):
        block = names[start:start + BLOCK_LANGUAGES]
        shares = np.zeros((len(block), 1 << bits), np.float32)
        prior = np.zeros(len(block))
        for r in model.where(F.col("lang").isin(block)).toLocalIterator() if block else ():
            counts = np.array(r.counts, np.float64) + 1
            shares[block.index(r.lang)] = np.log(counts / counts.sum())
            prior[block.index(r.lang)] = np.log(r.n_docs)
        shared = sc.broadcast((block, shares, prior))

        def score(rows: Iterable[dict], shared=shared, first=first) -> Iterator[dict]:
            block, shares, prior = shared.value
            for row in rows:
                best = {"lang_pred": UNKNOWN, "best": float("-inf"), "total": float("-inf")} if first else {
                    k: row[k] for k in ("lang_pred", "best", "total")}
                if block and has_letter(row["text"]):
                    counts = bucket_counts(row["text"], bits=bits)
                    at = np.flatnonzero(counts)
                    logs = prior + shares[:, at].astype(np.float64) @ counts[at]
                    best["total"] = float(np.logaddexp.reduce(np.append(logs, best["total"])))
                    k = int(np.argmax(logs))
                    if logs[k] > best["best"]:
                        best["lang_pred"], best["best"] = block[k], float(logs[k])
                yield best

        if first:
            out = with_python_columns(docs, {"text": F.col(f"`{text_col}`")}, FIELDS, score)
        else:
            inputs = {"text": F.col(f"row.`{text_col}`"), **{n: F.col(n) for n, _ in FIELDS}}
            out = with_python_columns(out, inputs, FIELDS, score).select("row.row", *(n for n, _ in FIELDS))
        first = False
    sure = F.when(F.col("lang_pred") == UNKNOWN, 0.0).otherwise(F.least(F.exp(F.col("best") - F.col("total")), F.lit(1.0)))
    return out.select("row", "lang_pred", sure.alias("score"))


def brute_force_counts(text: str, orders: tuple[int, ...] = ORDERS) -> dict[str, int]:
    """Counts of the n-grams themselves, for tests."""
    plain = " " + "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text.lower())
    out: dict[str, int] = {}
    for n in orders:
        for i in range(len(plain) - n + 1):
            out[plain[i:i + n]] = out.get(plain[i:i + n], 0) + 1
    return out
