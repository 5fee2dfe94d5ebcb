"""Tokens, term counts, capped vocabularies and TF-IDF.

Documents hold their whole text in one row, so the terms of a document are counted inside the row; what
is shuffled are vocabulary counts and the few terms of each document that are in the capped vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.fixed_values import STOP_TOKENS
from tracewright.functions.rows import exploded
from tracewright.plans.skew import salted_join
from tracewright.session import materialised

MAX_BROADCAST_TOKENS = 100_000


# ---- tokens --------------------------------------------------------------------------------------------


def whitespace_tokens(text: Column) -> Column:
    """Lower-case runs of non-space, without the stop tokens."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: (w != "") & ~w.isin(STOP_TOKENS))


def word_tokens(text: Column) -> Column:
    """Lower-case runs of two or more letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def symbol_tokens(text: Column) -> Column:
    """Single characters, lower-case, without white space."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"\s+", ""), ""), lambda c: c != "")


def with_tokens(docs: DataFrame, doc_id: str, text: str, tokeniser=whitespace_tokens) -> DataFrame:
    """(doc_id, tokens)"""
    return docs.select(F.col(doc_id).alias("doc_id"), tokeniser(F.col(text)).alias("tokens"))


def tokens_long(tokens: DataFrame) -> DataFrame:
    """(doc_id, pos, token), positions from 1."""
    return exploded(tokens, ["doc_id"], F.col("tokens"), "token", "pos")


# ---- counts --------------------------------------------------------------------------------------------


def term_freq(tokens: DataFrame) -> DataFrame:
    """(doc_id, token, tf) without a shuffle: sort the tokens of a row and measure its runs."""
    others = [c for c in tokens.columns if c != "tokens"]
    starts = F.expr("filter(sequence(0, greatest(size(_t) - 1, 0)), i -> i = 0 or _t[i] <> _t[i - 1])")
    counted = F.expr(
        "transform(_at, (s, k) -> struct(get(_t, s) as token, "
        "cast(if(k + 1 < size(_at), _at[k + 1], size(_t)) - s as bigint) as tf))"
    )
    runs = tokens.withColumn("_t", F.sort_array("tokens")).withColumn("_at", starts).withColumn("_runs", counted)
    # A document without tokens has one run without a token.
    return exploded(runs, others, F.col("_runs"), "_e").select(*others, "_e.token", "_e.tf").filter("token is not null")


def doc_freq(tokens: DataFrame) -> DataFrame:
    """(token, df): documents containing each token."""
    return (
        exploded(tokens, [], F.array_distinct("tokens"), "token")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def dictionary_entries(tokens: DataFrame) -> DataFrame:
    """(token, df): what a batch adds to a stored dictionary. The row without a token counts all documents of the batch."""
    every = tokens.agg(F.count(F.lit(1)).alias("df")).select(F.lit(None).cast("string").alias("token"), "df")
    return doc_freq(tokens).filter("token is not null").unionByName(every)


def term_total(tokens: DataFrame) -> DataFrame:
    """(token, tf_total, df)"""
    return (
        term_freq(tokens).groupBy("token").agg(F.sum("tf").alias("tf_total"), F.count(F.lit(1)).alias("df"))
    )


# ---- vocabularies --------------------------------------------------------------------------------------


def vocab_topk(frequencies: DataFrame, k: int = 128) -> DataFrame:
    """(token, df, rank): the k tokens in most documents, ties by token; rank from 1."""
    top = frequencies.select("token", "df").orderBy(F.desc("df"), "token").limit(k)
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("df"), "token"))  # k rows
    return top.withColumn("rank", rank.cast("bigint"))


def vocab_topk_tf(totals: DataFrame, k: int = 1000) -> DataFrame:
    """(token, tf_total, df, rank): the k tokens with most occurrences, ranked alphabetically."""
    top = totals.orderBy(F.desc("tf_total"), "token").limit(k)
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("token"))  # k rows
    return top.withColumn("rank", rank.cast("bigint"))


def tf_matrix(tokens: DataFrame, vocabulary: DataFrame, k: int) -> DataFrame:
    """(doc_id, rank, token, df, tf): sparse counts of the vocabulary's tokens.

    k is the cap the vocabulary was made with: up to MAX_BROADCAST_TOKENS it is broadcast.
    """
    counts, kept = term_freq(tokens), vocabulary.select("token", "rank", "df")
    if k > MAX_BROADCAST_TOKENS:
        return salted_join(counts, kept, ["token"], ["doc_id", "token"])
    return counts.join(F.broadcast(kept), "token")


def densify(cells: DataFrame, size: int, value: str, ids: DataFrame | None = None) -> DataFrame:
    """(doc_id, features): sparse cells to arrays of the given size; ids adds documents without cells."""
    grouped = cells.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("rank").cast("int"), F.col(value).cast("double")))).alias("_m")
    )
    if ids is not None:
        grouped = ids.select("doc_id").join(grouped, "doc_id", "left")
    at = F.transform(
        F.sequence(F.lit(1), F.lit(size)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))
    )
    return grouped.select("doc_id", at.alias("features"))


# ---- weights -------------------------------------------------------------------------------------------


def smooth_idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs + F.lit(1)).cast("double") / (df + F.lit(1)).cast("double")) + F.lit(1.0)


def l2_normalised(cells: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Divide value by the root of the sum of its squares per key; all-zero rows stay zero."""
    norm = F.sqrt(F.sum(F.col(value) * F.col(value)).over(W.partitionBy(*keys)))
    return cells.withColumn("_norm", norm).withColumn(
        name, F.when(F.col("_norm") > 0, F.col(value) / F.col("_norm")).otherwise(F.lit(0.0))
    ).drop("_norm")


def tfidf(tokens: DataFrame, vocabulary: DataFrame, k: int, n_docs: Column | None = None) -> DataFrame:
    """(doc_id, token, rank, weight): sparse TF-IDF over a capped vocabulary, length 1 per document.

    The number of documents counts those without any token of the vocabulary too; where the vocabulary comes from other
    documents, n_docs is theirs.
    """
    n_docs = tokens.agg(F.count(F.lit(1)).alias("n")).scalar() if n_docs is None else n_docs
    weighted = tf_matrix(tokens, vocabulary, k).withColumn("_w", F.col("tf") * smooth_idf(n_docs, F.col("df")))
    return l2_normalised(weighted, ["doc_id"], "_w", "weight").select("doc_id", "token", "rank", "weight")


def tfidf_stored(tokens: DataFrame, dictionary: DataFrame, k: int = 128) -> DataFrame:
    """TF-IDF of documents by the frequencies of a stored dictionary (token, df, n), which they need not be in."""
    stored = materialised(dictionary)
    return tfidf(tokens, vocab_topk(stored, k), k, stored.agg(F.max("n").alias("n")).scalar())


def tfidf_topk(docs: DataFrame, doc_id: str, text: str, k: int = 128) -> DataFrame:
    """TF-IDF over the k tokens that are in most documents."""
    tokens = with_tokens(docs, doc_id, text, whitespace_tokens)
    return tfidf(tokens, vocab_topk(doc_freq(tokens), k), k)


def tfidf_topk_tf(tokens: DataFrame, k: int = 1000) -> DataFrame:
    """TF-IDF over the k tokens with most occurrences, columns in token order."""
    return tfidf(tokens, vocab_topk_tf(term_total(tokens), k), k)
