"""Secret scans: three patterns, and a comparison of two character Markov models, in DataFrame operations only.

* Patterns: a keyword with a value (`assign`), access keys (`access`) and long hexadecimal numbers (`hex`), each kind leftmost
  and without overlaps of its own. What a pattern takes but its rule then drops (a value that is too short, say) is used up.
* Models: the probability of each character after the one before it, for random strings and for ordinary identifiers, with
  half a count added everywhere. The random samples are the values that the patterns find and GENERATED digests in hexadecimal,
  base64 and capitals. The ordinary ones are the words that lie outside the patterns' finds, as they are and in capitals. Both
  come from SAMPLE documents, those with the smallest MD5 of their id, so training does not grow with the corpus.
* Candidates are runs of the alphabet with LEAST characters or more, outside `assign` finds and without an `access` or `hex`
  one; a run of more than LONGEST is cut into pieces of that size. A candidate is a secret (`markov`) if random strings
  are likelier by MARGIN thousandths of a nat a character: the log-likelihood ratio of the whole candidate decides.

The models are one table of whole numbers (about 70 by 70), a constant of the plan. The scan is a projection: no shuffle.

Defined results: a null or empty text has no spans; each row is judged by itself, so repeated rows get the same spans. Without
any documents the models come from the generated samples alone. Places count code points from 0, the end is exclusive.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import either_case, let, sums_before
from tracewright.session import materialised

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = either_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6

ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
ALPHABET_CLASS = "[A-Za-z0-9+/_=-]"
LEAST, LONGEST = 20, 1000
LEAST_SAMPLE = 4  # characters of an ordinary word; values from LEAST_RANDOM characters on
LEAST_RANDOM = 16
SAMPLE = 2000
GENERATED = 4000
MARGIN = 1000

SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


# ---- places of matches ---------------------------------------------------------------------------------


def _group(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _lengths(strings: Column) -> Column:
    return F.transform(strings, lambda x: F.char_length(x).cast("long"))


def _placed(gaps: Column, found: Column) -> Column:
    """(start, end) of each match, from the texts between the matches: one before each, and one behind the last."""
    def of(g: Column, m: Column) -> Column:
        steps = F.transform(m, lambda n, i: n + F.get(g, i))
        return let(sums_before(steps), lambda s: F.transform(s, lambda at, i: F.struct(
            (at + F.get(g, i)).alias("start"), (at + F.get(g, i) + F.get(m, i)).alias("end"))))

    return let(_lengths(gaps), lambda g: let(_lengths(found), lambda m: of(g, m)))


def _spans(text: Column, found: Column, pattern: str, kind: int, keep=None) -> Column:
    """The matches as spans; keep(i) says which of them pass."""
    def listed(places: Column) -> Column:
        spans = F.transform(places, lambda p, i: F.struct(
            p["start"].alias("start"), F.lit(kind).alias("kind"), p["end"].alias("end"),
            (keep(i) if keep else F.lit(True)).alias("passes")))
        return F.transform(F.filter(spans, lambda s: s["passes"]),
                           lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))

    none = F.array().cast(SPAN)
    return F.when(F.size(found) == 0, none).otherwise(let(_placed(F.split(text, pattern, -1), found), listed))


# ---- models --------------------------------------------------------------------------------------------


def sampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(token, weight, random): labelled strings, equal ones as one row."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).cast("binary")).alias("h"),
                       text.alias("text"), F.md5(text.cast("binary")).alias("t"))
    chosen = materialised(rows.orderBy("h", "t").limit(sample).select("text").repartition(8))
    values = F.concat(_group(F.col("text"), ASSIGN, 2), _group(F.col("text"), ACCESS), _group(F.col("text"), HEX))
    random = chosen.select(F.explode(values).alias("token")).where(F.char_length("token") >= LEAST_RANDOM)
    seed = F.md5(F.concat(F.lit("sample "), F.col("id").cast("string")).cast("binary"))
    base64 = F.base64(F.unhex(seed))
    made = chosen.sparkSession.range(GENERATED).select(
        F.when(F.col("id") % 4 == 0, seed).when(F.col("id") % 4 == 1, base64)
        .when(F.col("id") % 4 == 2, F.upper(F.translate(base64, "+/=", "")))
        .otherwise(F.translate(base64, "+/", "-_")).alias("token"))
    rest = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, " ")
    words = chosen.select(F.explode(_group(rest, ALPHABET_CLASS + f"{{{LEAST_SAMPLE},}}")).alias("token"))
    plain = words.groupBy("token").agg(F.count("*").alias("weight"))
    ordinary = plain.union(plain.select(F.upper("token"), "weight"))
    return random.union(made).groupBy("token").agg(F.count("*").alias("weight")).withColumn("random", F.lit(True)).union(
        ordinary.withColumn("random", F.lit(False)))


def learn(samples: DataFrame) -> DataFrame:
    """(at, ratio): thousandths of the log-likelihood ratio of a character after another one, for all pairs.

    at is the place of the character before (0: none) times the size of the alphabet and one, and the place of the character.
    """
    size = len(ALPHABET)
    chars = F.filter(F.split("token", ""), lambda c: c != "")
    steps = samples.select("random", "weight", F.posexplode(let(
        F.transform(chars, lambda c: F.instr(F.lit(ALPHABET), c)),
        lambda x: F.transform(x, lambda c, i: F.struct(F.when(i == 0, 0).otherwise(F.get(x, i - 1)).alias("a"), c.alias("b"))))))
    counts = steps.select("random", "weight", "col.*").where("b > 0").groupBy("a", "b").agg(
        F.sum(F.when(F.col("random"), F.col("weight")).otherwise(0)).alias("r"),
        F.sum(F.when(F.col("random"), 0).otherwise(F.col("weight"))).alias("o"))
    every = samples.sparkSession.range((size + 1) * size).select(
        F.floor(F.col("id") / size).cast("int").alias("a"), (F.col("id") % size + 1).cast("int").alias("b"))
    both = every.join(counts, ["a", "b"], "left").na.fill(0, ["r", "o"])
    sums = both.groupBy("a").agg(F.sum("r").alias("rs"), F.sum("o").alias("os"))

    def share(n: str, total: str) -> Column:
        return F.log((F.col(n) + 0.5) / (F.col(total) + 0.5 * size))

    return both.join(sums, "a").select((F.col("a") * (size + 1) + F.col("b")).alias("at"),
                                       F.floor(1000 * (share("r", "rs") - share("o", "os")) + 0.5).cast("long").alias("ratio"))


def table_of(model: DataFrame) -> list[int]:
    """The ratios of a model by their places: a list of fixed size."""
    out = [0] * (len(ALPHABET) + 1) ** 2
    for row in model.collect():  # one row for each pair of characters
        out[row["at"]] = row["ratio"]
    return out


def likeness(token: Column, table: list[int]) -> Column:
    """The log-likelihood ratio of a string of the alphabet, in thousandths: above 0, a random string is likelier."""
    numbers = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # one constant of the plan
    places = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    steps = let(places, lambda x: F.transform(
        x, lambda c, i: F.get(numbers, F.when(i == 0, 0).otherwise(F.get(x, i - 1)) * (len(ALPHABET) + 1) + c)))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda total, v: total + v)


# ---- scan ----------------------------------------------------------------------------------------------


def _likely(piece: Column, at: Column, table: list[int]) -> Column:
    """The candidates of a piece of text that the models take for random, as spans; the piece starts at `at`."""
    pattern = ALPHABET_CLASS + f"{{{LEAST},{LONGEST}}}"

    def chosen(tokens: Column) -> Column:
        def listed(places: Column) -> Column:
            spans = F.transform(places, lambda p, i: F.struct(p["start"].alias("start"), p["end"].alias("end"),
                                                              F.get(tokens, i).alias("token")))
            passed = F.filter(spans, lambda s: ~s["token"].rlike(HEX) & ~s["token"].rlike(ACCESS) & (
                likeness(s["token"], table) >= MARGIN * F.char_length(s["token"])))
            return F.transform(passed, lambda s: F.struct(
                (s["start"] + at).alias("start"), F.lit(KINDS.index("markov")).alias("kind"), (s["end"] + at).alias("end")))

        return let(_placed(F.split(piece, pattern, -1), tokens), listed)

    none = F.array().cast(SPAN)
    return let(_group(piece, pattern), lambda t: F.when(F.size(t) == 0, none).otherwise(chosen(t)))


def scanned(docs: DataFrame, table: list[int], text_col: str = "text") -> DataFrame:
    """(row, base, markov): each row as a struct with its spans (start, number of the kind, end), those of the patterns in order."""
    none = F.array().cast(SPAN)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                         F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    text = F.col("text")

    def all_of(values: Column) -> Column:
        """Spans of the patterns and of the models, from the values of all keywords."""
        matches = F.when(F.size(values) == 0, F.array().cast("array<string>")).otherwise(_group(text, ASSIGN))
        assign = let(matches, lambda m: _spans(text, m, ASSIGN, 0, lambda i: F.char_length(F.get(values, i)) >= LEAST_VALUE))
        # Candidates lie in the pieces between the keywords' matches; without any, the text is the only piece.
        def between(pieces: Column, m: Column) -> Column:
            steps = F.transform(pieces, lambda p, i: F.char_length(p) + F.coalesce(F.char_length(F.get(m, i)), F.lit(0)))
            return let(sums_before(steps), lambda at: F.flatten(F.transform(
                pieces, lambda p, i: _likely(p, F.get(at, i), table))))

        markov = F.when(F.size(values) == 0, _likely(text, F.lit(0).cast("long"), table)).otherwise(
            let(matches, lambda m: let(F.split(text, ASSIGN, -1), lambda p: between(p, m))))
        access = let(_group(text, ACCESS), lambda m: _spans(text, m, ACCESS, 1))
        hexes = let(_group(text, HEX), lambda m: _spans(text, m, HEX, 2))
        return F.struct(F.sort_array(F.concat(assign, access, hexes)).alias("base"), markov.alias("markov"))

    # Cheap tests first: a match needs a run of the alphabet that is long, or a sign between keyword and value.
    worth = text.rlike(ALPHABET_CLASS + f"{{{LEAST}}}") | text.rlike("[:=]")
    found = packed.select("row", F.when(worth, let(_group(text, ASSIGN, 2), all_of)).alias("found"))
    return found.select("row", F.coalesce("found.base", none).alias("base"), F.coalesce("found.markov", none).alias("markov"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    def n(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        F.col(f"row.`{id_col}`").alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat("base", "markov"))).alias("spans"))


def model_of(docs: DataFrame, **settings) -> list[int]:
    """The table of the models that are trained on samples of the documents."""
    return table_of(learn(materialised(sampled(docs, **settings))))
