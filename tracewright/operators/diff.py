"""Originals against their variants: pairing, line differences, positional differences, string distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.numbers import rounded_ratio
from tracewright.functions.rows import exploded
from tracewright.plans.skew import lookup_join, salted_join

TILE = 512  # strings compared with one another in one row


# ---- pairing -------------------------------------------------------------------------------------------


def with_program(samples: DataFrame, separator: str = "_") -> DataFrame:
    """Adds program: the sample name up to its first separator."""
    return samples.withColumn("program", F.substring_index("sample_id", separator, 1))


def originals(samples: DataFrame, separator: str = "_") -> DataFrame:
    """Samples without a separator in their name."""
    return samples.filter(~F.col("sample_id").contains(separator))


def variants(samples: DataFrame, separator: str = "_") -> DataFrame:
    return samples.filter(F.col("sample_id").contains(separator))


def variant_pairs(original: DataFrame, variant: DataFrame, variant_id: str) -> DataFrame:
    """Every variant (program, variant_id, content) with the content of its program's original.

    One program may own most of the variants: its original is repeated and its variants are spread.
    """
    return salted_join(
        variant, original.select("program", F.col("content").alias("original")), ["program"], ["program", variant_id]
    )


def prefix_join(programs: DataFrame, samples: DataFrame, separator: str = "-") -> DataFrame:
    """(program, sample_id) for samples named <program><separator>...; a sample may match several programs.

    Each sample is looked up under the text before every separator in its name, so this is an equi-join.
    """
    parts = F.split(F.col("sample_id"), f"\\Q{separator}\\E")
    prefixes = F.when(
        F.size(parts) > 1,
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), separator)),
    )
    keyed = exploded(samples, ["sample_id"], prefixes, "program")
    return salted_join(keyed, programs.select("program"), ["program"], ["sample_id"]).select("program", "sample_id")


# ---- differences ---------------------------------------------------------------------------------------


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_diff_arrays(pairs: DataFrame) -> DataFrame:
    """Adds lines: the distinct lines of content that are not lines of the original; '' is a line too."""
    return pairs.withColumn("lines", F.array_except(_lines(F.col("content")), _lines(F.col("original")))).drop(
        "content", "original"
    )


def line_diff(pairs: DataFrame) -> DataFrame:
    """One row per line of line_diff_arrays."""
    others = [c for c in pairs.columns if c not in ("content", "original")]
    return exploded(line_diff_arrays(pairs), others, F.col("lines"), "line")


def line_diff_steps(original: DataFrame, variant: DataFrame, variant_id: str) -> DataFrame:
    """(program, variant_id, line): the same as line_diff from one row per line, for listings too long for one row.

    original has (program, line), variant (program, variant_id, line). Repeated lines are one first, inside the tasks and
    then after a shuffle by key, so an often repeated line is a row a task; rows are matched by program and a hash of the
    line before the text is looked at. Variants of a program without an original are left out, as in variant_pairs.
    """
    coded = F.xxhash64("line").alias("_h")
    mine = variant.select("program", variant_id, coded, "line").distinct()
    base = original.select("program", coded, "line").distinct()
    mine = lookup_join(mine, original.select("program").distinct(), ["program"], ["program", variant_id, "_h"])
    return mine.join(base, ["program", "_h", "line"], "left_anti").select("program", variant_id, "line")


def positional_diff_arrays(pairs: DataFrame) -> DataFrame:
    """Adds symbols: content character by character, '_' where the original has the same at that place."""
    compared = F.expr(
        "transform(_v, (c, i) -> if(i < size(_o) and get(_o, i) = c, '_', c))"
    )
    chars = lambda c: F.filter(F.split(F.col(c), ""), lambda x: x != "")
    return (
        pairs.withColumn("_v", chars("content"))
        .withColumn("_o", chars("original"))
        .withColumn("symbols", compared)
        .drop("_v", "_o", "content", "original")
    )


def positional_diff(pairs: DataFrame) -> DataFrame:
    """One row per position: pos from 1, symbol."""
    others = [c for c in pairs.columns if c not in ("content", "original")]
    return exploded(positional_diff_arrays(pairs), others, F.col("symbols"), "symbol", "pos")


def positional_diff_steps(original: DataFrame, variant: DataFrame, variant_id: str) -> DataFrame:
    """The same for symbol tables (program, pos, symbol) of traces too long for one row."""
    base = original.select("program", "pos", F.col("symbol").alias("_o"))
    joined = salted_join(variant, base, ["program", "pos"], ["program", variant_id, "pos"], "left")
    same = F.coalesce(F.col("_o") == F.col("symbol"), F.lit(False))
    return joined.withColumn("symbol", F.when(same, "_").otherwise(F.col("symbol"))).drop("_o")


# ---- string distances ----------------------------------------------------------------------------------


def mean_levenshtein(rows: DataFrame, group: str, text: str, tile: int = TILE) -> DataFrame:
    """(group, n, mean_distance): mean edit distance over all pairs of a group's strings, 2 decimals.

    Groups of fewer than two strings give 0.  Equal strings are counted once with a weight.  The distinct
    strings of a group are cut into tiles of about `tile` strings; two tiles meet in one row, where the
    distances are summed up, so no row per pair is made and a large group is spread over many tasks.
    """
    strings = rows.groupBy(F.col(group).alias("g"), F.col(text).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    sizes = strings.groupBy("g").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("tiles"), F.sum("n").alias("total")
    )
    tiled = (
        salted_join(strings, sizes.select("g", "tiles"), ["g"], ["g", "s"])
        .groupBy("g", "tiles", F.pmod(F.xxhash64("s"), F.col("tiles")).cast("int").alias("i"))
        .agg(F.collect_list(F.struct("s", "n")).alias("items"))
    )
    meetings = (
        tiled.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .groupBy("g", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
        .agg(F.collect_list(F.struct("i", "items")).alias("two"))
    )
    # One tile meeting itself: each unordered pair once.  A tile whose partner is empty meets nobody.
    distance = F.expr(
        "case when lo = hi then aggregate(two[0].items, 0L, (a, x) -> a + aggregate(two[0].items, 0L, (b, y) -> "
        "b + if(x.s < y.s, x.n * y.n * levenshtein(x.s, y.s), 0L))) "
        "when size(two) = 2 then aggregate(two[0].items, 0L, (a, x) -> a + aggregate(two[1].items, 0L, (b, y) -> "
        "b + x.n * y.n * levenshtein(x.s, y.s))) else 0L end"
    )
    sums = meetings.groupBy("g").agg(F.sum(distance).alias("d"))
    pairs = F.expr("total * (total - 1) div 2")
    mean = F.when(F.col("total") < 2, F.lit(0.0)).otherwise(rounded_ratio(F.col("d"), pairs))
    return sizes.join(sums, "g").select(
        F.col("g").alias(group), F.col("total").alias("n"), mean.alias("mean_distance")
    )
