"""URL filter: rules on hosts and paths, and for other URLs a classifier on the words of their names.

* A rule (verdict, host, path) fits its host and all subdomains whose path starts with the rule's; the longest wins.
* Names are split into words by Viterbi search over a unigram model: all words of page titles, counted over all pages,
  together with the seed words, which have at least a thousandth of the mass each. Letters that no word explains cost
  more the longer they are, and come out as one piece.
* A multinomial naive Bayes classifier, trained on a short list of seed names, scores the words of host and path. Words
  outside its vocabulary say nothing.

The unigram table stays a DataFrame of any size. Each distinct name of hosts and paths is split once: a join gives it
those of its substrings that were counted as words, which is all that the search over the whole table could use. Long
names are cut into overlapping windows for that join, so no row holds more substrings than one window has.

Defined results: a null URL or one without `://` has empty host and path, no rule, and the verdict of no words at all,
allow. Each row is judged by itself, so repeated rows and further columns change nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import ascii_lower, few_or_joined, with_python_columns
from tracewright.session import materialised

BLOCK_SHARE = 0.2  # of URLs, before any word is seen
SEED_MASS = 1e-3
FEW_NAMES = 200_000  # names, or URLs by their names, that go back to the rows by a broadcast
WINDOW = 256  # letters of a name in which substrings start that one row makes
UNKNOWN = ""  # stands in the model for a letter without a word

# The rules of the production list: fixed values.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

# Names to learn from: fixed values; casino-win, free-bets, cheap-pills, adult-x, ads-track and spam-farm are hosts of the tables.
SEEDS = {
    "block": (
        "casino-win free-casino win-casino casino-bets free-bets best-bets sports-bets bets-win poker-win slots-casino "
        "cheap-pills buy-pills pills-online cheap-viagra online-pharmacy adult-x adult-cams x-cams xxx-adult porn-xxx "
        "ads-track ad-track click-track track-click ads-click banner-ads popup-ads spam-farm link-farm spam-links "
        "free-spam lottery-win free-prize win-prize payday-loans quick-loans cheap-replica replica-watches free-money "
        "crack-keygen warez-torrent hot-sex sex-chat gambling-tips betting-odds jackpot-win"),
    "allow": (
        "daily-news city-news news-archive tech-blog travel-blog food-blog science-journal open-library public-library "
        "school-library university-press research-institute health-clinic art-museum art-gallery music-review book-review "
        "film-review kitchen-recipes home-garden family-home football-club chess-club weather-report government-office "
        "docs-wiki help-forum learn-code photo-studio garden-farm organic-farm local-farm history-archive online-school "
        "language-school open-source software-docs community-forum local-weather travel-guide world-history"),
}


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, what).otherwise(verdict)
    return name, verdict


# ---- words ---------------------------------------------------------------------------------------------


def unigrams(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, count) of all words of the titles of all pages."""
    title = F.lower(F.regexp_extract(F.col(f"`{html_col}`"), r"(?i)<title[^>]*>([^<]*)", 1))
    words = pages.select(F.explode(F.split(title, r"[^\p{L}]+")).alias("word")).where("word != ''")
    return materialised(words.groupBy("word").count())


def seed_words() -> set[str]:
    return {w for names in SEEDS.values() for name in names.split() for w in name.split("-")}


def unigram_scale(counts: DataFrame) -> tuple[float, dict[str, float]]:
    """What all words weigh, seed words included, and the log shares of the seed words and of a letter without a word."""
    is_seed = F.col("word").isin(*seed_words())
    sums = counts.agg(F.sum("count").alias("total"), F.min(F.when(~is_seed, F.col("count"))).alias("least")).first()
    total = sums["total"] or 0
    seen = {r.word: r["count"] for r in counts.where(is_seed).collect()}
    full = {w: max(seen.get(w, 0), total * SEED_MASS, 1.0) for w in seed_words()}
    mass = total - sum(seen.values()) + sum(full.values())
    least = min([*full.values(), *([sums["least"]] if sums["least"] else [])])
    return mass, {w: math.log(c / mass) for w, c in full.items()} | {UNKNOWN: math.log(least / mass) - math.log(10)}


def word_tables(names: DataFrame, counts: DataFrame) -> DataFrame:
    """names (name) with `table`, the counts of those of its substrings that are words; null if none is.

    A name is cut into windows, each a row that makes its own substrings, so a row stays small however long the name is.
    """
    lengths = sorted(r.n for r in counts.select(F.char_length("word").alias("n")).distinct().collect()) or [1]
    code = F.md5("name").alias("code")
    size = F.char_length("name")
    windows = names.select(code, (size == 1).alias("whole"), F.explode(F.transform(
        F.sequence(F.lit(1), size, F.lit(WINDOW)), lambda at: F.substring("name", at, F.lit(WINDOW + lengths[-1] - 1)))).alias("window"))
    room = F.char_length("window")
    # A single letter is a word only if it is the whole name.
    fits = F.filter(F.array(*map(F.lit, lengths)), lambda n: (n <= room) & ((n > 1) | F.col("whole")))
    cut = F.flatten(F.transform(fits, lambda n: F.transform(
        F.sequence(F.lit(1), F.least(room - n + 1, F.lit(WINDOW))), lambda at: F.substring("window", at, n))))
    parts = windows.select("code", F.explode(F.array_distinct(cut)).alias("word"))
    known = few_or_joined(parts.select("word").distinct().join(counts, "word"), FEW_NAMES)
    found = parts.join(known, "word").distinct()
    tables = found.groupBy("code").agg(F.collect_list(F.struct("word", "count")).alias("table"))
    return names.withColumn("code", code).join(tables, "code", "left").drop("code")


def segmented(name: str, model: dict[str, float]) -> list[str]:
    """The likeliest words whose concatenation is name; letters without a word come together as one.

    A single letter is a word only if it is the whole name.
    """
    unknown, longest = model[UNKNOWN], max(1, *map(len, model))
    best, back = [0.0], [0]
    for end in range(1, len(name) + 1):
        top, start = -math.inf, end - 1
        for s in range(max(0, end - longest), end):
            part = model.get(name[s:end]) if end - s > 1 or len(name) == 1 else None
            if part is None:
                part = unknown * (end - s) if end - s == 1 else -math.inf
            if best[s] + part > top:
                top, start = best[s] + part, s
        best.append(top)
        back.append(start)
    spans, end, loose = [], len(name), False
    while end:
        start = back[end]
        if end - start == 1 and loose:
            spans[-1] = (start, spans[-1][1])
        else:
            spans.append((start, end))
        loose = end - start == 1
        end = start
    return [name[start:end] for start, end in reversed(spans)]


def names_of(host: Column, path: Column) -> Column:
    """The runs of letters of host and path, joined by spaces."""
    return F.array_join(F.regexp_extract_all(F.concat_ws(" ", host, F.lower(path)), F.lit(r"\p{L}+"), F.lit(0)), " ")


# ---- classifier ----------------------------------------------------------------------------------------


def bayes(share: float = BLOCK_SHARE) -> dict:
    """Prior odds of block, and the log ratio of each seed word's smoothed shares."""
    counts = {k: Counter(w for name in names.split() for w in name.split("-")) for k, names in SEEDS.items()}
    words = counts["block"].keys() | counts["allow"].keys()
    sums = {k: sum(c.values()) + 0.1 * len(words) for k, c in counts.items()}
    ratio = {w: math.log((counts["block"][w] + 0.1) / sums["block"]) - math.log((counts["allow"][w] + 0.1) / sums["allow"])
             for w in sorted(words)}
    return {"prior": math.log(share / (1 - share)), "ratio": ratio}


def split_names(names: DataFrame, counts: DataFrame, ratio: dict[str, float]) -> DataFrame:
    """(name, words, odds): each name with its likeliest words and the sum of their log ratios."""
    mass, fixed = unigram_scale(counts)

    def split(rows: Iterable[dict]) -> Iterator[dict]:
        for row in rows:
            own = {t["word"]: math.log(t["count"] / mass) for t in row["table"] or []}
            words = segmented(row["name"], own | fixed)
            yield {"words": words, "odds": sum(ratio.get(w, 0.0) for w in words)}

    fields = [("words", T.ArrayType(T.StringType())), ("odds", T.DoubleType())]
    tables = word_tables(names, counts)
    return with_python_columns(tables, {"name": F.col("name"), "table": F.col("table")}, fields, split).select(
        F.col("row.name").alias("name"), "words", "odds")


def judged(
    pages: DataFrame,
    counts: DataFrame,
    url_col: str = "url",
    rules: list[tuple] = RULES,
    share: float = BLOCK_SHARE,
) -> DataFrame:
    """(row, host, path, rule, verdict, words, odds): each page as a struct with its verdict and what it rests on."""
    nb = bayes(share)
    url = F.col(f"`{url_col}`")
    packed = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), host_of(url).alias("host"),
                          path_of(url).alias("path")).withColumn("names", names_of(F.col("host"), F.col("path")))
    # URLs with equal names are one row here, and so is a name that many of them have.
    listed = materialised(packed.select("names").where("names != ''").distinct())
    placed = listed.select("names", F.posexplode(F.split("names", " ")).alias("no", "name"))
    names = few_or_joined(split_names(materialised(placed.select("name").distinct()), counts, nb["ratio"]), FEW_NAMES)
    found = placed.join(names, "name").groupBy("names").agg(
        F.sort_array(F.collect_list(F.struct("no", "words", "odds"))).alias("parts"))
    found = few_or_joined(found.select(
        "names", F.flatten(F.col("parts.words")).alias("words"),
        F.aggregate("parts.odds", F.lit(float(nb["prior"])), lambda total, x: total + x).alias("odds")), FEW_NAMES)
    out = packed.join(found, "names", "left").select(
        "row", "host", "path", F.coalesce("words", F.array().cast("array<string>")).alias("words"),
        F.coalesce("odds", F.lit(float(nb["prior"]))).alias("odds"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("odds") > 0, "block").otherwise("allow")
    return out.select("row", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "words", "odds")
