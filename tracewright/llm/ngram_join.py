"""N-gram Jaccard join by grouped prefixes, and the components of its links.

A document is the set of its distinct five-word shingles. Sets are ordered from rare to frequent shingles; two sets of
similarity t or more share one of their first n - ceil(t n) + 1 shingles, the prefix.

* Documents with identical sets are one set. Sets with identical prefixes and size are one group, and only groups are
  matched on prefix shingles, filtered by their sizes and by where the shingle stands in both prefixes.
* Group pairs are expanded to member sets and verified on the whole sets.
* Only connections are asked for, so the work stays near the number of rows even if a third of them are near copies:
  round 1 verifies each row of a bucket (a shingle, or a group) with one pivot of the bucket. Round 2 verifies all pairs
  of a bucket whose members round 1 has not connected. Every pair that passes the filters is then either verified or
  connected already, so no link between components is lost.
* The order of shingles comes from one fixed-size table of counts over all documents (2^20 numbers). It only steers how
  many rows meet: any order that is the same everywhere gives the same links.

Shingles and sets are 64-bit hashes of word sequences.

Defined results: a document without words (null or empty text) has an empty set and links with nothing; so does a row
with a null id, whose component is null. Rows that repeat an id are documents of their own with the same number. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracewright.llm.common import few_or_joined, summed_numbers
from tracewright.llm.components import components
from tracewright.llm.hashing import BASES, mixed, run_hashes, word_codes
from tracewright.session import materialised

SHINGLE = 5
PERCENT = 75
SKETCH_BITS = 20
HISTOGRAM = 128


# ---- sets ----------------------------------------------------------------------------------------------


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of the distinct k-word shingles; of the whole sequence, if it is shorter."""
    codes = word_codes(text, lower=True)
    if not len(codes):
        return codes
    return np.unique(mixed(run_hashes(codes, min(k, len(codes)), BASES[0]) + np.uint64(min(k, len(codes)))))


def set_code(shingles: np.ndarray) -> int:
    """A 64-bit code of a set."""
    return int(mixed(np.sum(mixed(shingles ^ np.uint64(BASES[1])), keepdims=True, dtype=np.uint64)).view(np.int64)[0])


def histogram(shingles: np.ndarray) -> bytes:
    """How many shingles of a set have each value of their top bits, as HISTOGRAM bytes (255 or more as 255)."""
    slots = (shingles >> np.uint64(64 - HISTOGRAM.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(slots, minlength=HISTOGRAM), 255).astype(np.uint8).tobytes()


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, code): the size and code of each document's set."""
    schema = T.StructType([docs.schema["id"], *(T.StructField(c, T.LongType()) for c in ("n", "code"))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                lists = [shingle_set(text.as_py(), k) for text in batch.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in lists], pa.int64()),
                     pa.array([set_code(s) if len(s) else 0 for s in lists], pa.int64())], schema=arrow)

    return docs.select("id", "text").mapInArrow(run, schema)


def shingle_counts(docs: DataFrame, k: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """How many documents have a shingle with each value of the lowest bits: a table of fixed size."""

    def count(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        counts, low = np.zeros(1 << bits, np.int64), np.uint64((1 << bits) - 1)
        with np.errstate(over="ignore"):
            for batch in batches:
                for text in batch.column(0):
                    np.add.at(counts, (shingle_set(text.as_py(), k) & low).astype(np.int64), 1)
        return counts

    return summed_numbers(docs.select("text"), count, 1 << bits)


def _prefixes(docs: DataFrame, counts: np.ndarray, k: int, percent: int) -> DataFrame:
    """(id, code, n, grp, hist, prefix): each set's code, size, group, histogram and prefix, rare shingles first."""
    schema = T.StructType([docs.schema["id"], *(T.StructField(c, T.LongType()) for c in ("code", "n", "grp")),
                           T.StructField("hist", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, low = shared.value, np.uint64(len(shared.value) - 1)
        with np.errstate(over="ignore"):
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    s = shingle_set(text.as_py(), k)
                    if not len(s):
                        continue
                    size = len(s) - (-(-percent * len(s) // 100)) + 1
                    first = s[np.lexsort((s, df[(s & low).astype(np.int64)]))[:size]]
                    grp = set_code(np.append(first, np.uint64(len(s))))
                    rows.append((doc_id, set_code(s), len(s), grp, histogram(s), first.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 6, arrow.types)], schema=arrow)

    return docs.select("id", "text").mapInArrow(run, schema)


def _whole_sets(docs: DataFrame, codes: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """(code, shingles) of the given codes: read again from one document of each."""
    one = sets.groupBy("code").agg(F.min("id").alias("id")).join(few_or_joined(codes), "code", "left_semi")
    schema = T.StructType([T.StructField("code", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                lists = [shingle_set(text.as_py(), k) for text in batch.column(0)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_code(s) if len(s) else 0 for s in lists], pa.int64()),
                     pa.array([s.view(np.int64) for s in lists], arrow.field(1).type)], schema=arrow)

    texts = docs.join(few_or_joined(one.select("id").distinct()), "id", "left_semi").select("text")
    return texts.mapInArrow(run, schema)  # repeated ids may repeat a set


# ---- links ---------------------------------------------------------------------------------------------


def _may_link(a: Column, b: Column, percent: int) -> Column:
    """Whether sets with (n, at) may reach the similarity: by size, and by what can follow a shared prefix shingle."""
    sizes = 100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"])
    most = F.least(a["n"] - a["at"], b["n"] - b["at"])
    return sizes & ((100 + percent) * most >= percent * (a["n"] + b["n"]))


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set codes that link.

    First the histograms of both sets bound what they can have in common, so whole sets are read for likely pairs only.
    """
    n, hist = members.select(F.col("code").alias("a"), F.col("n").alias("na"), F.col("hist").alias("ha")), members.select(
        F.col("code").alias("b"), F.col("n").alias("nb"), F.col("hist").alias("hb"))
    schema = "a long, b long"

    def likely(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(c).to_numpy() for c in (2, 3))
            ha, hb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HISTOGRAM) for c in (4, 5))
            low = np.minimum(ha, hb)
            most = low.sum(1, dtype=np.int64)
            most = np.where((low == 255).any(1), np.minimum(na, nb), np.minimum(most, np.minimum(na, nb)))
            keep = 100 * most >= percent * (na + nb - most)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    known = pairs.join(n, "a").join(hist, "b").select("a", "b", "na", "nb", "ha", "hb")
    pairs = materialised(known.mapInArrow(likely, schema))
    codes = pairs.select(F.col("a").alias("code")).union(pairs.select("b")).distinct()
    whole = _whole_sets(docs, codes, sets, k)
    both = pairs.join(whole.select(F.col("code").alias("a"), F.col("shingles").alias("sa")), "a").join(
        whole.select(F.col("code").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    links = both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")
    return materialised(links.distinct())


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def links(docs: DataFrame, sets: DataFrame, counts: np.ndarray, k: int, percent: int) -> DataFrame:
    """(a, b): links between set codes that connect all sets which the join connects."""
    prefixes = materialised(_prefixes(docs, counts, k, percent))
    members = materialised(prefixes.select("grp", "code", "n", "hist").dropDuplicates(["code"]))
    rows = prefixes.select("id", "grp", "n", F.posexplode("prefix").alias("at", "shingle")).withColumn(
        "place", F.shiftleft("n", 32) + F.col("at")).select("shingle", "id", "grp", "place")

    # Shingles of two or more groups, with the first document's group as pivot: copies are mostly near their original.
    shared = rows.groupBy("shingle").agg(F.min("id").alias("first"), F.min("grp").alias("lo"), F.max("grp").alias("hi"))
    buckets = materialised(rows.join(shared.where("lo < hi").select("shingle", "first"), "shingle").select(
        "shingle", "grp", F.shiftright("place", 32).alias("n"), F.col("place").bitwiseAND(2**32 - 1).alias("at"),
        (F.col("id") == F.col("first")).alias("leads")).groupBy("shingle", "grp", "n", "at").agg(F.max("leads").alias("leads")))
    heads = members.groupBy("grp").agg(F.min("code").alias("head"), F.max("code").alias("hi"))

    # Round 1: each row with its pivot.
    own = buckets.where("leads").groupBy("shingle").agg(F.min(F.struct("grp", "n", "at")).alias("pivot"))
    near = buckets.join(own, "shingle").where((F.col("grp") != F.col("pivot.grp"))
                                              & _may_link(F.struct("n", "at"), F.col("pivot"), percent))
    near = near.withColumn("pivot", F.col("pivot.grp"))
    near = near.select("grp", F.col("pivot").alias("other")).distinct()
    of = heads.select("grp", "head")
    across = near.join(of, "grp").join(of.select(F.col("grp").alias("other"), F.col("head").alias("pivot")), "other")
    inside = members.join(heads.where("head < hi").select("grp", "head"), "grp").where("code != head")
    pairs = across.select(*_pair("head", "pivot")).union(inside.select(*_pair("code", "head"))).distinct()
    first = _verified(pairs, docs, sets, members, k, percent)
    label = components(first)

    # Round 2: in buckets with several components, the rows outside the largest with all others.
    named = materialised(members.drop("hist").join(label.withColumnRenamed("node", "code"), "code", "left").withColumn(
        "component", F.coalesce("component", "code")))
    each = buckets.select("shingle", "grp", "at").join(named, "grp").select(
        F.col("shingle").alias("bucket"), "code", "n", "at", "component")
    each = each.union(named.join(heads.where("head < hi").select("grp"), "grp").select(
        F.xxhash64(F.lit("group"), "grp").alias("bucket"), "code", "n", F.lit(0).alias("at"), "component"))
    sizes = each.groupBy("bucket", "component").count()
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("count", "component"))["component"].alias("largest"),
                                          F.count("*").alias("parts")).where("parts > 1")
    open_rows = materialised(each.join(largest.select("bucket", "largest"), "bucket"))
    a, b = open_rows.where("component != largest").alias("a"), open_rows.alias("b")
    meet = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.component") != F.col("b.component"))
                  & _may_link(F.struct("a.n", "a.at"), F.struct("b.n", "b.at"), percent))
    second = _verified(meet.select(*_pair("a.code", "b.code")).distinct(), docs, sets, members, k, percent)
    return first.union(second)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = SHINGLE,
    percent: int = PERCENT,
    sketch_bits: int = SKETCH_BITS,
) -> DataFrame:
    """(id_col, n_shingles, component_id): the size of each document's set, and the least id that its links reach."""
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    known = base.where("id is not null")
    sets = materialised(_sets(known, k))
    counts = shingle_counts(known, k, sketch_bits)
    full = sets.where("n > 0")
    label = components(links(known, full, counts, k, percent))
    named = full.join(label.withColumnRenamed("node", "code"), "code", "left").select(
        "id", "n", F.coalesce("component", "code").alias("component"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    out = named.join(least, "component").select("id", "n", "component_id")
    out = out.unionByName(sets.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    unknown = base.where("id is null")
    if not unknown.isEmpty():
        kind = docs.schema[id_col].dataType
        out = out.unionByName(_sets(unknown, k).select(
            "id", "n", F.lit(None).cast(kind).alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents whose id is the least of their component, and those without an id."""
    gone = near_duplicates(docs, id_col, text_col, **settings).where(f"component_id < `{id_col}`")
    left = docs.join(few_or_joined(gone.select(f"`{id_col}`").distinct()), id_col, "left_anti")
    return left.select(*(f"`{c}`" for c in docs.columns))


def brute_force(docs: Iterable[tuple], k: int = SHINGLE, percent: int = PERCENT) -> list[tuple]:
    """The result from all pairs of sets of word sequences, for tests."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, text in docs:
        words = (text or "").translate(lower).encode().split()
        m = min(k, len(words))
        sets.append((i, {tuple(words[s:s + m]) for s in range(len(words) - m + 1)} if m else set()))
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, a) in enumerate(sets):
        for y, (j, b) in enumerate(sets[:x]):
            if i is None or j is None or not a or not b:
                continue
            common = len(a & b)
            if 100 * common >= percent * (len(a) + len(b) - common):
                root[find(x)] = find(y)
    least: dict[int, object] = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return [(i, len(s), least.get(find(x))) for x, (i, s) in enumerate(sets)]
