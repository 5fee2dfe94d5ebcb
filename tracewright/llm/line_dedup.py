"""Line dedup by a segment-partition edit join, in built-in functions only.

A line goes if an equal line, or one within `edits` edits of code points, stands earlier in the corpus: in a document with
a smaller id, or further up in the same one. Lines without a word always stay and are compared with nothing; lines under
`least` code points are compared for equality only. `edits` is the same for lines of any length: with one edit a
line with a changed word is not found, only one with a changed character.

* Lines are grouped by a 96-bit hash; a partial aggregate finds the first place of each text.
* A text of length l is cut into edits + 1 segments. Within `edits` edits at least one segment of the shorter text stands
  unchanged in the longer one, moved by few places. Segments are the index, under their number, the length l and a hash.
* Each text probes the index for the lengths l - edits .. l with those of its substrings that multi-match-aware selection
  allows. Only hashes of two or more different texts are joined, and equal lines count once there. Texts that share a
  segment come out as a pair only if the parities of their words allow it. That is a condition inside the join: n texts of
  a segment are still compared n * n times.
* Pairs are verified by edit distance: bit vectors of the 2 * edits + 1 diagonals of the band, moved on by one character
  a step with whole-number operations (Hyyro's banded form of Myers' algorithm). Blocks of equal characters at both
  ends are stripped first.

A hot line is one row after the first aggregates; joins that bring a result back to all lines are plain sort-merge joins
that adaptive execution may split.

Defined results: a null text has no lines. Rows with a null id keep all lines and repeat nothing; rows that repeat id and
text are one document, so none of them goes for the other. Further columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import few_or_joined, let
from tracewright.session import materialised

EDITS = 1
LEAST = 20
BLOCK = 16  # characters that are compared at once when equal ends are stripped


# ---- edit distance -------------------------------------------------------------------------------------


def _equal_blocks(a: Column, b: Column, n: Column) -> Column:
    """How many leading blocks of BLOCK characters are equal, of the n that both texts have."""
    at = F.sequence(F.lit(1), n + 1)
    same = F.filter(at, lambda i: (i > n) | (F.substring(a, (i - 1) * BLOCK + 1, F.lit(BLOCK))
                                             != F.substring(b, (i - 1) * BLOCK + 1, F.lit(BLOCK))))
    return same[0] - 1


def _middle(a: Column, b: Column) -> Column:
    """Both texts without equal blocks at their ends, as a struct (x, y) with x no longer than y."""

    def blocks(x: Column, y: Column) -> Column:
        return F.floor(F.least(F.char_length(x), F.char_length(y)) / BLOCK).cast("int")

    def ordered(x: Column, y: Column) -> Column:
        short = F.char_length(x) <= F.char_length(y)
        return F.struct(F.when(short, x).otherwise(y).alias("x"), F.when(short, y).otherwise(x).alias("y"))

    def front(pair: Column) -> Column:
        cut = let(blocks(pair["x"], pair["y"]), lambda n: _equal_blocks(pair["x"], pair["y"], n) * BLOCK + 1)
        return let(cut, lambda k: F.struct(*(F.substring(pair[c], k, F.char_length(pair[c])).alias(c) for c in "xy")))

    def turned(pair: Column) -> Column:
        return F.struct(*(F.reverse(pair[c]).alias(c) for c in "xy"))

    # Equal blocks go at the front, the texts are turned round, and equal blocks go at the other end; turned texts are
    # as far apart as the texts.
    return let(let(let(ordered(a, b), front), turned), front)


def within(a: Column, b: Column, edits: int = EDITS) -> Column:
    """Whether the edit distance of two texts is at most `edits`, by bit vectors along a band.

    Column j of the band holds rows j - edits .. j + edits, a bit each. For each character of the longer text, `match` has
    the bits of the equal characters of the shorter one; vp and vn say where the distance grows or falls by one from row
    to row. The score follows the diagonal to row j and, once the shorter text has ended, its last row.
    """
    width = 2 * edits + 1
    full, top = (1 << width) - 1, 1 << (width - 1)

    def distance(xs: Column, ys: Column, m: Column, n: Column) -> Column:
        def step(state: Column, j: Column) -> Column:
            # j is the place in y, from 0. Bit k of the band is row j - edits + k of x, from 0.
            match = F.lit(0)
            for k in range(width):
                row = j + (k - edits)
                hit = (row >= 0) & (row < m) & (F.get(xs, F.greatest(row, F.lit(0))) == F.get(ys, j))
                match = match + F.when(F.coalesce(hit, F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0))
            vp, vn, score = state["vp"], state["vn"], state["score"]
            # On the diagonal the score never falls; behind it, it falls by at most one in each of 2 * edits columns.
            lost = score > 3 * edits

            def move(eq: Column) -> Column:
                d0 = (((eq.bitwiseAND(vp)) + vp).bitwiseXOR(vp)).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(F.lit(full))

                def then(d: Column) -> Column:
                    hp = vn.bitwiseOR(F.bitwise_not(d.bitwiseOR(vp))).bitwiseAND(F.lit(full))
                    hn = d.bitwiseAND(vp)
                    down = F.shiftright(d, 1)  # the band moves down by one row
                    vp2 = hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(F.lit(full))
                    vn2 = down.bitwiseAND(hp)
                    diagonal = F.when(d.bitwiseAND(F.lit(top)) > 0, 0).otherwise(1)
                    last = m - 1 - (j - edits)  # the bit of x's last row
                    bit = F.call_function("shiftleft", F.lit(1), F.greatest(last, F.lit(0)))
                    along = F.when(hp.bitwiseAND(bit) > 0, 1).otherwise(0) - F.when(hn.bitwiseAND(bit) > 0, 1).otherwise(0)
                    score2 = score + F.when(j + edits < m, diagonal).otherwise(along)
                    return F.struct(vp2.alias("vp"), vn2.alias("vn"), score2.cast("int").alias("score"))

                return let(d0, then)

            return F.when(lost, state).otherwise(let(match, move))

        # Before the first character the rows from 0 on grow by one each; the score is that of row `edits`, or m.
        rows = F.lit(full - ((1 << edits) - 1))
        begin = F.struct(rows.alias("vp"), F.lit(0).alias("vn"), F.least(m, F.lit(edits)).cast("int").alias("score"))
        return F.aggregate(F.sequence(F.lit(0), n - 1), begin, step, lambda s: s["score"])

    def of(pair: Column) -> Column:
        def sized(m: Column, n: Column) -> Column:
            chars = let(F.split(pair["x"], ""), lambda xs: let(F.split(pair["y"], ""), lambda ys: distance(xs, ys, m, n)))
            return F.when(n <= edits, True).when(m == 0, False).otherwise(chars <= edits)

        return let(F.char_length(pair["x"]), lambda m: let(F.char_length(pair["y"]), lambda n: sized(m, n)))

    far = F.abs(F.char_length(a) - F.char_length(b)) > edits
    return F.when(far, False).otherwise(let(_middle(a, b), of))


# ---- candidates ----------------------------------------------------------------------------------------


def segments(length: Column, edits: int = EDITS) -> list[tuple[Column, Column]]:
    """(start, size) of the edits + 1 segments of a text; starts from 1, the later segments one longer if it must be."""
    parts = edits + 1
    size = F.floor(length / parts).cast("int")
    longer = length - size * parts  # so many segments, the last ones, have one more
    out = []
    for i in range(parts):
        extra = F.greatest(F.lit(0), F.lit(i) - (parts - longer))
        out.append((i * size + extra + 1, size + F.when(F.lit(i) >= parts - longer, 1).otherwise(0)))
    return out


def _code(number: int, length: Column, piece: Column) -> Column:
    return F.xxhash64(F.lit(number), length, piece)


def segment_codes(text: Column, length: Column, edits: int = EDITS) -> Column:
    """The hashes under which a text stands in the index, edits + 1 of them, and behind them those under which it only asks.

    It asks for texts of lengths length - edits .. length; for its own length and places, standing is asking, too.
    """
    stands, asks = [], []
    for shorter in range(edits + 1):
        other = length - shorter
        for i, (at, size) in enumerate(segments(other, edits)):
            # Seen from the left, i edits may have moved the segment; seen from the right, edits - i; and no place twice.
            low, high = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
            for move in range(low, high + 1):
                start = at + move
                inside = (start >= 1) & (start + size - 1 <= length) & (other >= 1)
                code = F.when(inside, _code(i, other, F.substring(text, start, size)))
                (stands if shorter == move == 0 else asks).append(code)
    return F.array(*stands, *asks)


def parity(text: Column) -> Column:
    """64 bits, each the parity of the number of words with that hash: an edit changes three at most.

    It changes one word into another, one into two, or two into one.
    """
    return F.aggregate(F.split(text, " "), F.lit(0).cast("long"), lambda bits, word: bits.bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), F.hash(word))))


def lines_of(docs: DataFrame) -> DataFrame:
    """(id, key, no, line, c1, c2) of documents (id, key, text): every line with a word, and two hashes of it."""
    lines = docs.where("id is not null").select("id", "key", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumns(
        {"c1": F.xxhash64("line"), "c2": F.hash(F.lit(7), "line")})


def candidates(lines: DataFrame, edits: int, least: int) -> DataFrame:
    """(a, b): hashes c1 of texts that share a segment."""
    long = lines.select("c1", "line", F.char_length("line").alias("length")).where(F.col("length") >= least)
    listed = long.select("c1", parity(F.col("line")).alias("bits"), segment_codes(F.col("line"), F.col("length"), edits).alias("codes"))
    listed = materialised(listed)  # two passes read it: making hashes costs more than writing them
    codes = listed.select("c1", "bits", F.posexplode("codes").alias("pos", "at")).where("at is not null").select(
        "c1", "bits", "at", (F.col("pos") <= edits).alias("stands"))
    # Hashes of two or more texts, of which one stands in the index; equal lines count once.
    shared = codes.groupBy("at").agg(F.min("c1").alias("lo"), F.max("c1").alias("hi"), F.max("stands").alias("any"))
    rows = materialised(codes.join(shared.where("lo < hi and any").select("at"), "at").distinct())
    a = rows.where("stands").select("at", F.col("c1").alias("a"), F.col("bits").alias("bits_a"))
    # A segment may be that of many texts, but few of them can be near: their words tell.
    near = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits"))) <= 3 * edits
    pairs = a.join(rows.select("at", "bits", F.col("c1").alias("b")), "at").where((F.col("a") != F.col("b")) & near)
    return materialised(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def near_lines(docs: DataFrame, lines: DataFrame, places: DataFrame, edits: int, least: int) -> DataFrame:
    """(c1, c2) of the texts that are within `edits` edits of a text that stands earlier."""
    pairs = candidates(lines, edits, least)
    asked = pairs.select(F.col("a").alias("c1")).union(pairs.select("b")).distinct()
    wanted = places.join(few_or_joined(asked), "c1", "left_semi").select("c1", "c2", "first", "first.*")
    texts = materialised(docs.join(few_or_joined(wanted), ["id", "key"]).select(
        "c1", "c2", "first", F.get(F.split("text", "\n"), F.col("no")).alias("line")))

    def side(x: str) -> DataFrame:
        return texts.select(F.col("c1").alias(x), F.struct("c1", "c2").alias(f"code_{x}"),
                            F.col("first").alias(f"first_{x}"), F.col("line").alias(f"line_{x}"))

    # Few rows with much work each: dealt to all tasks.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").repartition(tasks, "a", "b").where(within(F.col("line_a"), F.col("line_b"), edits))
    later = F.when(F.col("first_a") < F.col("first_b"), F.col("code_b")).otherwise(F.col("code_a"))
    return both.select(later.alias("code")).select("code.*").distinct()


def repeated_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(id, key, gone) for documents (id, key, text) that lose lines: the numbers of those, from 0."""
    lines = lines_of(docs)
    place = F.struct("id", "key", "no")
    places = materialised(lines.groupBy("c1", "c2").agg(F.min(place).alias("first")))
    near = near_lines(docs, lines, places, edits, least).withColumn("near", F.lit(True))
    known = places.join(near, ["c1", "c2"], "left").select("c1", "c2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.select("id", "key", "no", "c1", "c2").join(known, ["c1", "c2"]).where(F.col("near") | (place != F.col("first")))
    return gone.groupBy("id", "key").agg(F.sort_array(F.collect_set("no")).alias("gone"))


def without_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(row, n_lines, gone, kept): each row as a struct, its lines, the numbers of removed ones or null, the text left."""
    text = F.col("text")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("id"),
                         F.col(f"`{text_col}`").alias("text")).withColumn("key", F.xxhash64("id", "text"))
    gone = repeated_lines(packed.select("id", "key", "text"), **settings)
    marked = packed.join(gone, ["id", "key"], "left")
    left = F.array_join(let(F.split(text, "\n"), lambda x: F.filter(
        x, lambda line, i: ~F.array_contains(F.col("gone"), i))), "\n")
    n_lines = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return marked.select("row", n_lines.cast("long").alias("n_lines"), "gone",
                         F.when(F.col("gone").isNull(), text).otherwise(left).alias("kept"))


def brute_force(docs: Iterable[tuple], edits: int = EDITS, least: int = LEAST) -> dict[tuple, list[int]]:
    """(id, text) to the numbers of removed lines, from all pairs of lines, for tests; ids are not null."""
    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    seen: list[str] = []
    out: dict[tuple, list[int]] = {}
    for doc_id, text in sorted({(i, t) for i, t in docs if t is not None}):
        for no, line in enumerate(text.split("\n")):
            if not line.strip(" \t\n\r\x0b\x0c"):
                continue
            near = line in seen or len(line) >= least and any(
                len(s) >= least and abs(len(s) - len(line)) <= edits and distance(s, line) <= edits for s in seen)
            if near:
                out.setdefault((doc_id, text), []).append(no)
            seen.append(line)
    return out
