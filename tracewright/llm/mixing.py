"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

* Documents are counted into cells of source, language and topic; the cells hold their words (tokens).
* Targets are shares of each dimension: given ones, or the dimension's own shares raised to a power below 1, which lifts
  rare values. A given share is met as it is; the values without one share what the given ones leave.
* Raking: the weights of the cells are scaled to the targets of one dimension after the other, until a round changes no
  weight by more than TOLERANCE of itself. Margins that contradict each other (a source of one language only, say) have
  no such end: the rounds stop when they move as much as the ones before, or at MOST_ROUNDS, and a warning says how much.
* Calibration: a document's probability is min(1, c * weight / tokens of its cell), with c such that the expected tokens
  are `budget` of all. Cells that reach 1 are full, and the rest takes what they leave.
* A document is kept if a hash of its id, as a number from 0 to 1, is below its probability. So the sample does not
  depend on order or partitions, and a larger budget keeps a superset.

Only the table of cells is worked on in rounds. Documents are counted into it with partial aggregates, so a source with a
third of all documents is one row a task; a round's window sums go over the cells of a value, one for each combination. Up
to CELLS_A_TASK cells lie in one partition, which serves the sums of every dimension, so their targets, rounds and passes
shuffle and broadcast nothing;
more cells are shuffled by the values of a dimension. Cells go back to the documents by a broadcast if they are few, else by
a shuffled join.

Defined results: null source or language is the value '' of its own; a null or empty text has no tokens and the topic
of no pattern. A cell without tokens has weight 0 and probability 1, as it costs nothing; so a corpus without any word
is kept whole. A null id hashes like the text
'null'. Repeated rows have equal ids and are kept or dropped together. Further columns are kept.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import FEW_ROWS, either_case, few_or_joined
from tracewright.session import materialised

TOLERANCE = 1e-9
STALLED = 1e-4
MOST_ROUNDS = 50
CELLS_A_TASK = 100_000
BUDGET = 0.8
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.8}

# (topic, pattern): the first pattern that a text holds names its topic; fixed values.
TOPICS = [
    ("licence", either_case("license under|licensed under|licence under|licenced under|rights reserved|copyright")),
    ("contact", r"@[A-Za-z0-9]|\+[0-9]+ \("),
    ("figures", r"[0-9][0-9]"),
]
NO_TOPIC = "prose"


def topic_of(text: Column, topics: list[tuple[str, str]] = TOPICS) -> Column:
    out = F.lit(NO_TOPIC)
    for name, pattern in reversed(topics):
        out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), name).otherwise(out)
    return out


def _marginal(cells: DataFrame, dim: str, power: float, given: dict[str, float], few: bool) -> DataFrame:
    """(dim, target): shares that add up to 1; given ones stay, the others are scaled to what they leave.

    Of few cells, which lie in one partition, the shares lie in one, too.
    """
    sums = materialised(cells.groupBy(dim).agg(F.sum("tokens").alias("t")))
    sums = sums.coalesce(1) if few else sums
    fixed = F.lit(None).cast("double")
    for value, share in given.items():
        fixed = F.when(F.col(dim) == value, F.lit(float(share))).otherwise(fixed)
    total = F.lit(sums.agg(F.sum("t").cast("double").alias("t")).first()["t"])
    shares = sums.select(dim, fixed.alias("fixed"), F.pow(F.col("t") / total, power).alias("own"))
    of = shares.agg(F.coalesce(F.sum("fixed"), F.lit(0.0)).alias("fixed"),
                    F.sum(F.when(F.col("fixed").isNull(), F.col("own"))).alias("own")).first()
    if of["fixed"] > 1 + 1e-9:
        raise ValueError(f"the given shares of {dim} add up to {of['fixed']}")
    if of["own"] is None:  # every value is given
        return shares.select(dim, (F.col("fixed") / of["fixed"]).alias("target"))
    rest = F.col("own") * ((1 - min(of["fixed"], 1.0)) / of["own"])
    return shares.select(dim, F.coalesce("fixed", rest).alias("target"))


def raked(
    cells: DataFrame,
    powers: dict[str, float] = POWERS,
    given: dict[str, dict[str, float]] | None = None,
    tolerance: float = TOLERANCE,
    most_rounds: int = MOST_ROUNDS,
) -> DataFrame:
    """cells (the dimensions, tokens > 0) with `weight`, shares of all tokens that follow the targets."""
    n = cells.count()
    parts, moved = 1 + n // CELLS_A_TASK, 0.0
    # One partition holds every value of every dimension, and the plan knows it: no sum, join or window then needs an exchange.
    cells = cells.coalesce(parts)
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    if not n:
        return out
    for dim, power in powers.items():
        target = _marginal(cells, dim, power, (given or {}).get(dim, {}), parts == 1).withColumnRenamed(
            "target", f"target of {dim}")
        out = out.join(target.hint("merge") if parts == 1 else few_or_joined(target), dim)
    out = materialised(out).coalesce(parts)
    for _ in range(most_rounds):
        out = out.withColumn("moved", F.lit(0.0))
        for dim in powers:
            # Window sums, not joins: the optimizer's size estimates of repeated joins grow with a power of the rounds.
            now = F.sum("weight").over(Window.partitionBy(dim))
            out = out.withColumn("factor", F.when(now > 0, F.col(f"target of {dim}") / now).otherwise(1.0)).withColumns({
                "weight": F.col("weight") * F.col("factor"),
                "moved": F.greatest("moved", F.abs(F.col("factor") - 1))}).drop("factor")
        out = materialised(out).coalesce(parts)  # one write a round
        before, moved = moved, out.agg(F.max("moved").alias("m")).first()["m"]
        out = out.drop("moved")
        if moved <= tolerance or abs(moved - before) <= STALLED * moved:
            break
    if moved > tolerance:
        warnings.warn(f"raking stopped where a round moves a margin by {moved:.3g} of itself")
    return out.drop(*(f"target of {d}" for d in powers))


def calibrated(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """cells with `probability`: min(1, c * weight / tokens), for an expected share `budget` of all tokens.

    c grows from pass to pass; each pass but the last finds further cells that are full. Without a cell that is open
    (no cells at all, or all of them full) there is nothing left to deal out, and c stays.
    """
    total = cells.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    c = 0.0
    while True:
        full = (c * F.col("weight") >= F.col("tokens")) if c else F.lit(False)
        left = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"),
                         F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not left["open"]:
            break
        again = (budget * total - left["full"]) / left["open"]
        if again <= c * (1 + 1e-12):
            break
        c = again
    return cells.withColumn("probability", F.least(F.lit(1.0), F.lit(float(c)) * F.col("weight") / F.col("tokens")))


def fraction(id_: Column) -> Column:
    """A number from 0 to 1 that hangs on the id alone: the first 52 bits of an MD5."""
    hexed = F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit("null")).cast("binary")), 1, 13)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(float(1 << 52))


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    powers: dict[str, float] = POWERS,
    given: dict[str, dict[str, float]] | None = None,
    budget: float = BUDGET,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """(row, tokens, topic, weight, probability, kept): each row as a struct with its cell's weight and its verdict."""
    text = F.col(f"`{text_col}`")
    n_words = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang"),
        topic_of(text).alias("topic"), n_words.cast("long").alias("tokens"),
        fraction(F.col(f"`{id_col}`")).alias("u"))
    dims = list(POWERS)
    cells = materialised(packed.groupBy(*dims).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"))
    fitted = calibrated(raked(cells, powers, given, tolerance), budget)
    found = packed.join(few_or_joined(fitted.select(*dims, "weight", "probability")), dims, "left")
    probability = F.coalesce("probability", F.lit(1.0))
    return found.select("row", "tokens", "topic", F.coalesce("weight", F.lit(0.0)).alias("weight"),
                        probability.alias("probability"), (F.col("u") < probability).alias("kept"))
