"""Parsing, filtering and counting of instruction traces.

A trace is a long table (sample_id, step, opcode, operands); steps run 1..n within a sample.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.fixed_values import (
    CATEGORY_OPCODES,
    COUNTER_SUBSTRINGS,
    CRASH_MARK,
    TRANSITIONS,
)
from tracewright.functions.rows import exploded
from tracewright.functions.strings import (
    after_first_colon,
    call_target,
    last_tab_field,
    line_opcode,
    line_operands,
    run_succeeded,
)
from tracewright.plans.ordering import RUN_LENGTH, carry_forward, lag_in_order, row_numbers, segment
from tracewright.plans.skew import salted_join

PART_LENGTH = 1 << 16  # symbols per row where sequences are written as strings
START_MARK = "Breakpoint 1"


# ---- parsing -------------------------------------------------------------------------------------------


def parse_trace_text(files: DataFrame) -> DataFrame:
    """(sample_id, step, opcode, operands) from whole trace texts (sample_id, content).

    Lines with '=>' after the start mark are instructions; a text without the mark is an empty trace.
    """
    start = F.instr("content", START_MARK)
    body = F.when(start > 0, F.substring(F.col("content"), start, F.length("content")))
    lines = F.filter(F.split(body, "\n"), lambda line: line.contains("=>"))
    return exploded(files, ["sample_id"], lines, "line", "step").select(
        "sample_id", "step", line_opcode(F.col("line")).alias("opcode"), line_operands(F.col("line")).alias("operands")
    )


def parse_trace_lines(lines: DataFrame, start_mark: str | None = START_MARK) -> DataFrame:
    """The same from numbered lines (sample_id, step, line), for traces too long for one row.

    Steps keep their line numbers; renumber with consecutive_steps before counting transitions.
    start_mark=None takes every line with '=>'.
    """
    kept = lines.filter(F.col("line").contains("=>"))
    if start_mark is not None:  # the mark's own line counts from the mark on
        starts = (
            lines.filter(F.col("line").contains(start_mark)).groupBy("sample_id").agg(F.min("step").alias("_start"))
        )
        kept = salted_join(kept, starts, ["sample_id"], ["sample_id", "step"]).filter("step >= _start")
        of_mark = F.substring(F.col("line"), F.instr("line", start_mark), F.length("line"))
        kept = kept.withColumn("line", F.when(F.col("step") == F.col("_start"), of_mark).otherwise(F.col("line")))
        kept = kept.filter(F.col("line").contains("=>"))
    return kept.select(
        "sample_id", "step", line_opcode(F.col("line")).alias("opcode"), line_operands(F.col("line")).alias("operands")
    )


def consecutive_steps(trace: DataFrame) -> DataFrame:
    """Renumber steps to 1..n per sample."""
    return row_numbers(trace.withColumnRenamed("step", "_at"), ["sample_id"], ["_at"], "step").drop("_at")


def listing_slice(lines: DataFrame, function: str = "main", run_length: int = RUN_LENGTH) -> DataFrame:
    """(sample_id, line_no, line): instructions of one function of static listings.

    A line with <function> switches the slice on, any other line with '>:' switches it off; while it is on,
    lines of three or more tab fields give their last field, and calls give the called name with ().
    """
    line = F.col("line")
    state = F.when(line.contains(f"<{function}>"), F.lit(True)).when(line.contains(">:"), F.lit(False))
    sliced = carry_forward(lines, ["sample_id"], "line_no", state, "_on", run_length)
    text = F.when(line.contains("call"), call_target(line)).otherwise(last_tab_field(line))
    return sliced.filter(F.col("_on") & (F.size(F.split(line, "\t")) > 2)).select(
        "sample_id", "line_no", text.alias("line")
    )


def trace_filter(lines: DataFrame, function: str = "main") -> DataFrame:
    """Lines with '=>' that mention the function, cut after the first ':'."""
    line = F.col("line")
    return lines.filter(line.contains("=>") & line.contains(function)).withColumn("line", after_first_colon(line))


def successful_runs(outputs: DataFrame, column: str) -> DataFrame:
    """Runs whose output names no failure and whose trace did not crash."""
    text = F.col(column)
    return outputs.filter(run_succeeded(text) & ~text.contains(CRASH_MARK))


# ---- counting ------------------------------------------------------------------------------------------


def counter_of(opcode: Column) -> Column:
    """Counter an opcode belongs to: the first whose substrings it contains."""
    chain = None
    for name, parts in COUNTER_SUBSTRINGS.items():
        hit = reduce(lambda a, b: a | b, [opcode.contains(p) for p in parts])
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain


def category_of(opcode: Column) -> Column:
    """Category of a whole opcode; null for opcodes in none."""
    chain = None
    for name, members in CATEGORY_OPCODES.items():
        hit = opcode.isin(members)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain


def _count_if(condition: Column, name: str) -> Column:
    return F.count_if(condition).cast("bigint").alias(name)


def _counter_aggregates() -> list[Column]:
    kind = F.col("_kind")
    return [
        _count_if(kind == "arith", "n_arith"),
        _count_if(kind == "jump", "n_jump"),
        _count_if(kind == "mov", "n_mov"),
        _count_if(kind == "call", "n_call"),
        F.count(F.lit(1)).cast("bigint").alias("n_total"),
    ]


def _revisits() -> Column:
    """Jumps whose operand list was seen before: jumps minus distinct operand lists of jumps."""
    jump = F.col("_kind") == "jump"
    places = F.count_distinct(F.when(jump, F.array_join("operands", ",")))
    return (F.count_if(jump) - places).cast("bigint").alias("n_revisit")


def _transition_aggregates(mode: str) -> list[Column]:
    """Counts of category changes between different neighbouring opcodes.

    mode="reference" counts logic to logic in the place of logic to arithmetic, as existing feature files
    do; mode="fixed" counts logic to arithmetic.
    """
    if mode not in ("reference", "fixed"):
        raise ValueError(f"unknown transition mode {mode!r}; use reference or fixed")
    counted = {t: t for t in TRANSITIONS}
    if mode == "reference":
        counted["LA"] = "LL"
    return [_count_if(F.col("_change") == pair, f"n_{name.lower()}") for name, pair in counted.items()]


def _with_previous(trace: DataFrame, run_length: int) -> DataFrame:
    """Adds _changed (opcode differs from the previous one; true at step 1) and _change (category pair)."""
    lagged = lag_in_order(trace, ["sample_id"], "step", "opcode", "_prev", run_length)
    changed = F.coalesce(F.col("_prev"), F.lit("")) != F.col("opcode")
    return lagged.withColumn("_changed", changed).withColumn(
        "_change", F.when(changed, F.concat(category_of(F.col("_prev")), category_of(F.col("opcode"))))
    )


def trace_counters(trace: DataFrame) -> DataFrame:
    """(sample_id, n_arith, n_jump, n_mov, n_call, n_total)"""
    return (
        trace.withColumn("_kind", counter_of(F.col("opcode"))).groupBy("sample_id").agg(*_counter_aggregates())
    )


def jump_revisits(trace: DataFrame) -> DataFrame:
    """(sample_id, n_revisit)"""
    return trace.withColumn("_kind", counter_of(F.col("opcode"))).groupBy("sample_id").agg(_revisits())


def opcode_changes(trace: DataFrame, run_length: int = RUN_LENGTH) -> DataFrame:
    """(sample_id, n_change): steps whose opcode differs from the one before; the first step counts."""
    return (
        _with_previous(trace.select("sample_id", "step", "opcode"), run_length)
        .groupBy("sample_id")
        .agg(_count_if(F.col("_changed"), "n_change"))
    )


def trace_transitions(trace: DataFrame, mode: str = "reference", run_length: int = RUN_LENGTH) -> DataFrame:
    """(sample_id, n_ac, n_al, ... ): the twelve category transitions."""
    return (
        _with_previous(trace.select("sample_id", "step", "opcode"), run_length)
        .groupBy("sample_id")
        .agg(*_transition_aggregates(mode))
    )


VECTOR_SLOTS = ["n_arith", "n_jump", "n_mov", "n_call", "n_total", "n_change", "n_revisit"] + [
    f"n_{t.lower()}" for t in TRANSITIONS
]


def trace_vector(trace: DataFrame, mode: str = "reference", run_length: int = RUN_LENGTH) -> DataFrame:
    """(sample_id, features): counters, changes, revisits and transitions in the order of VECTOR_SLOTS."""
    counted = (
        _with_previous(trace.select("sample_id", "step", "opcode", "operands"), run_length)
        .withColumn("_kind", counter_of(F.col("opcode")))
        .groupBy("sample_id")
        .agg(
            *_counter_aggregates(),
            _count_if(F.col("_changed"), "n_change"),
            _revisits(),
            *_transition_aggregates(mode),
        )
    )
    return counted.select("sample_id", F.array(*VECTOR_SLOTS).alias("features"))


def opcode_string(trace: DataFrame, part_length: int = PART_LENGTH) -> DataFrame:
    """(sample_id, part, opcodes): comma-joined opcodes in step order, one row per part_length steps."""
    return (
        trace.groupBy("sample_id", segment("step", part_length).alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("step", "opcode"))).alias("_s"))
        .select("sample_id", "part", F.array_join(F.col("_s.opcode"), ",").alias("opcodes"))
    )
