"""Symbol dictionaries by first appearance, and traces written as symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.fixed_values import OPCODE_LETTERS, OPERAND_LETTERS
from tracewright.functions.strings import operand_code, operand_type
from tracewright.operators.traces import PART_LENGTH
from tracewright.plans.ordering import global_index, segment
from tracewright.plans.skew import lookup_join
from tracewright.session import materialised


def first_seen(rows: DataFrame, symbol: str, order: list[str]) -> DataFrame:
    """(symbol, *order): where each symbol first appears; map-side combined, one row per symbol."""
    return (
        rows.groupBy(symbol)
        .agg(F.min(F.struct(*order)).alias("_first"))
        .select(symbol, *[F.col(f"_first.{c}").alias(c) for c in order])
    )


def first_seen_index(rows: DataFrame, symbol: str, order: list[str], name: str = "idx") -> DataFrame:
    """(symbol, name): 0-based index of every symbol by first appearance."""
    return global_index(materialised(first_seen(rows, symbol, order)), order, name).select(symbol, name)


def letter_table(rows: DataFrame, symbol: str, letters: str, name: str) -> DataFrame:
    """(symbol, name): letters dealt to the first len(letters) symbols; later symbols get none."""
    order = ["sample_id", "step"]
    earliest = first_seen(rows, symbol, order).orderBy(*order).limit(len(letters))
    rank = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order))  # over len(letters) rows at most
    return earliest.withColumn("_r", rank).select(symbol, F.substring(F.lit(letters), F.col("_r"), F.lit(1)).alias(name))


def operand_signature(operands: Column) -> Column:
    return F.array_join(F.transform(operands, operand_type), ",")


def _with_empty(trace: DataFrame, samples: DataFrame | None) -> DataFrame:
    """An empty trace is read as one nameless action, which takes a letter like any other."""
    if samples is None:
        return trace
    empty = samples.select("sample_id").join(trace.select("sample_id"), "sample_id", "left_anti")
    return trace.unionByName(empty.select("sample_id", F.lit(1).cast("bigint").alias("step"), F.lit("").alias("opcode")))


def _assemble(coded: DataFrame, symbol: str, part_length: int) -> DataFrame:
    """(sample_id, part, symbols): symbols joined in step order up to the first step without one.

    A part is cut at its own first step without a symbol; the parts after that of the sample's first are left out.
    """
    parts = coded.groupBy("sample_id", segment("step", part_length).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("step", F.col(symbol).alias("s")))).alias("_s"),
        F.min(F.when(F.col(symbol).isNull(), F.col("step"))).alias("_null"),
    )
    kept = F.filter("_s", lambda x: F.col("_null").isNull() | (x["step"] < F.col("_null")))
    texts = parts.select("sample_id", "part", "_null", F.array_join(F.transform(kept, lambda x: x["s"]), "").alias("symbols"))
    cut = texts.withColumn("_cut", F.min("_null").over(W.partitionBy("sample_id")))
    reached = F.col("_cut").isNull() | (F.col("part") == 0) | (F.col("_cut") > F.col("part") * part_length + 1)
    return cut.filter(reached).select("sample_id", "part", "symbols")


def alpha_sequence(trace: DataFrame, samples: DataFrame | None = None, part_length: int = PART_LENGTH) -> DataFrame:
    """(sample_id, part, symbols): one letter per opcode.

    Letters go to opcodes in order of first appearance over all samples.  When they run out, a sequence ends
    before its first opcode without one.  Part p holds steps p*part_length+1 onwards.
    """
    actions = _with_empty(trace.select("sample_id", "step", "opcode"), samples)
    letters = letter_table(actions, "opcode", OPCODE_LETTERS, "_letter")
    coded = actions.join(F.broadcast(letters), "opcode", "left")  # at most 62 rows
    return _assemble(coded, "_letter", part_length)


def alpha_param_sequence(trace: DataFrame, part_length: int = PART_LENGTH) -> DataFrame:
    """(sample_id, part, symbols): a letter for the opcode and one for the types of its operands, per step.

    The last character of a sample's sequence is dropped.
    """
    steps = trace.select("sample_id", "step", "opcode", operand_signature(F.col("operands")).alias("_sig"))
    # Both tables come from one pass over the steps: where each pair of symbols first appears.
    order = ["sample_id", "step"]
    pairs = materialised(steps.groupBy("opcode", "_sig").agg(F.min(F.struct(*order)).alias("_at")).select("opcode", "_sig", "_at.*"))
    letters = letter_table(pairs, "opcode", OPCODE_LETTERS, "_letter")
    signs = letter_table(pairs, "_sig", OPERAND_LETTERS, "_sign")
    coded = (
        steps.join(F.broadcast(letters), "opcode", "left")  # at most 62 rows
        .join(F.broadcast(signs), "_sig", "left")  # at most 24 rows
        .withColumn("_pair", F.concat("_letter", "_sign"))
    )
    parts = _assemble(coded, "_pair", part_length).filter((F.col("part") == 0) | (F.col("symbols") != ""))
    last = F.max("part").over(W.partitionBy("sample_id"))
    text = F.when(
        F.col("part") == F.col("_last"),
        F.substring(F.col("symbols"), F.lit(1), F.greatest(F.length("symbols") - 1, F.lit(0))),
    ).otherwise(F.col("symbols"))
    return parts.withColumn("_last", last).select("sample_id", "part", text.alias("symbols"))


def encode_trace(trace: DataFrame) -> DataFrame:
    """(sample_id, step, code): opcode index followed by one type digit per operand."""
    digits = F.array_join(F.transform(F.col("operands"), operand_code), "")
    return _encode(trace.select("sample_id", "step", "opcode", digits.alias("_digits")))


def encode_lines(lines: DataFrame) -> DataFrame:
    """The same for instruction text (sample_id, step, line): opcode, spaces, comma-separated operands."""
    items = F.split("line", " ")
    operands = F.flatten(
        F.transform(F.filter(F.slice(items, 2, F.size(items)), lambda i: i != ""), lambda i: F.split(i, ","))
    )
    digits = F.array_join(F.transform(operands, operand_code), "")
    return _encode(
        lines.select("sample_id", "step", F.element_at(items, 1).alias("opcode"), digits.alias("_digits"))
    )


def _encode(steps: DataFrame) -> DataFrame:
    index = first_seen_index(steps, "opcode", ["sample_id", "step"])
    return lookup_join(steps, index, ["opcode"], ["sample_id", "step"]).select(
        "sample_id", "step", F.concat(F.col("idx").cast("string"), F.col("_digits")).alias("code")
    )
