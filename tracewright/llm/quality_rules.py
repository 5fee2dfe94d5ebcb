"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

`measures` gives the counts of a text, `RULES` names a ratio of them and the range in which a clean text lies, and
`compile_rules` turns the table into one boolean column. Everything is a row-wise projection: no shuffle, no Python.

A text's repeated words are found in the row: the five-word windows are hashed (64 bits; windows of one text are
compared only with each other), and only a text in which two hashes are equal sorts them.

Defined results: a null or empty text has zero counts and fails the base rules; each row is judged by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import let, ws_words

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 5
PUNCTUATION = ".,;:!?"

# Frequent short words of the corpus languages; fixed values.
STOP_WORDS = (
    "the of and to in is that for it with as was on are by this be at from or an "
    "de la le les des et en un une du dans que est pour qui sur au avec pas par "
    "el los las y del se por con para una su al lo no "
    "der die und den von zu das mit sich ist im dem nicht ein eine auf für des"
).split()

# (name, numerator, denominator, least, most): a clean text's ratio lies in [least, most]; a bound may be None.
RULES = [
    ("mean word length", "word_chars", "n_words", 2.0, 12.0),
    ("symbols per word", "n_symbols", "n_words", None, 0.1),
    ("words with a letter", "n_alpha_words", "n_words", 0.6, None),
    ("shouted words", "n_upper_words", "n_words", None, 0.3),
    ("repeated lines", "n_dup_lines", "n_lines", None, 0.5),
    ("words per stop word and one", "n_words", "n_stop_words_and_one", None, 40.0),
    ("words per line", "n_words", "n_lines", 2.0, None),
]


def _repeat_words(words: Column) -> Column:
    """Words inside windows whose word sequence is in the text twice or more."""
    k = REPEAT_WINDOW

    def marked(hashes: Column) -> Column:
        # Hashes in order with their starts: equal neighbours are repeats. Starts in order: each covers up to k words.
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(pairs, lambda p: F.sort_array(F.transform(
            F.filter(p, lambda x, j: (F.get(p, j + 1)["h"] == x["h"]) | ((j > 0) & (F.get(p, j - 1)["h"] == x["h"]))),
            lambda x: x["i"])))
        return let(starts, lambda s: F.aggregate(
            F.transform(s, lambda at, j: F.least(F.coalesce(F.get(s, j + 1) - at, F.lit(k)), F.lit(k))),
            F.lit(0), lambda total, n: total + n))

    def of(codes: Column) -> Column:
        windows = F.transform(
            F.slice(codes, 1, F.greatest(F.size(codes) - (k - 1), F.lit(0))),
            lambda h, i: F.xxhash64(h, *(F.get(codes, i + j) for j in range(1, k))))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(marked(w)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, n_words, word_chars, n_symbols, ...): each row as a struct with the counts of its text."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.alias("text"),
                       ws_words(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return base.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x)).cast("long").alias("n_lines"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: F.upper(w) != F.lower(w))).cast("long").alias("n_alpha_words"),
        F.size(F.filter("words", lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.octet_length(w) > 2)))
        .cast("long").alias("n_upper_words"),
        (F.size(F.filter("words", lambda w: F.lower(F.btrim(w, F.lit(PUNCTUATION))).isin(STOP_WORDS))) + 1)
        .cast("long").alias("n_stop_words_and_one"),
    )


def compile_rules(rules: list[tuple] = RULES) -> Column:
    """Whether all ratios lie in their ranges; a ratio with denominator 0 breaks its rule."""
    verdict = F.lit(True)
    for _, above, below, least, most in rules:
        ratio = F.when(F.col(below) > 0, F.col(above) / F.col(below))
        inside = F.lit(True)
        if least is not None:
            inside = inside & (ratio >= least)
        if most is not None:
            inside = inside & (ratio <= most)
        verdict = verdict & F.coalesce(inside, F.lit(False))
    return verdict


def judged(docs: DataFrame, text_col: str = "text", rules: list[tuple] = RULES) -> DataFrame:
    """The measures with base_failed and kept."""
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measures(docs, text_col).withColumn("base_failed", base_failed).withColumn(
        "kept", ~F.col("base_failed") & compile_rules(rules))
