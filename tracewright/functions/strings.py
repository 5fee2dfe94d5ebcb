"""Column expressions on trace lines, operands, file names and class names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.fixed_values import FAILURE_WORDS, OPERAND_TYPES


def _last_index(text: Column, char: str) -> Column:
    """1-based index of the last occurrence of one character, 0 if there is none."""
    back = F.instr(F.reverse(text), char)
    return F.when(back == 0, F.lit(0)).otherwise(F.length(text) - back + 1)


def _once(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value), where value is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def _sub(text: Column, start: Column, length: Column) -> Column:
    return F.substring(text, start, F.greatest(length, F.lit(0)))


def operand_type(operand: Column) -> Column:
    """imm, mem, reg or lbl."""
    return (
        F.when(operand.contains("$"), "imm")
        .when(operand.contains("(") | operand.contains("0x"), "mem")
        .when(operand.contains("%"), "reg")
        .otherwise("lbl")
    )


def operand_code(operand: Column) -> Column:
    """Position of the operand type among the four types, as a digit."""
    kind = operand_type(operand)
    code = F.lit(None).cast("string")
    for digit, name in enumerate(OPERAND_TYPES):
        code = F.when(kind == name, F.lit(str(digit))).otherwise(code)
    return code


def last_tab_field(line: Column) -> Column:
    return F.substring_index(line, "\t", -1)


def line_opcode(line: Column) -> Column:
    """First space-separated token of the last tab field."""
    return F.substring_index(last_tab_field(line), " ", 1)


def line_operands(line: Column) -> Column:
    """Last space-separated token of the last tab field, split on commas."""
    return F.split(F.substring_index(last_tab_field(line), " ", -1), ",")


def after_first_colon(line: Column) -> Column:
    """Text after the first ':', or the whole line if there is none."""
    return F.substring(line, F.instr(line, ":") + 1, F.length(line))


def call_target(line: Column) -> Column:
    """name() of a call line in a listing; without <name> the line minus its last character, plus ()."""
    first = _last_index(line, "<")
    last = _last_index(line, ">")
    # A missing '>' counts from the end of the line: it drops one character.
    stop = F.when(last == 0, F.length(line) - 1).otherwise(last - 1)
    return F.concat(_sub(line, first + 1, stop - first), F.lit("()"))


def mask_operands(line: Column, mode: str) -> Column:
    """Mask immediates and addresses, then turn commas into spaces.

    raw: nothing is masked; mem: addresses, in lines without an immediate; both: immediates, then addresses.
    """
    immediate, address = r"\$0x\w+", r"0x\w+"
    mode = mode.lower()
    if mode == "raw":
        masked = line
    elif mode == "mem":
        masked = F.when(line.rlike(immediate), line).otherwise(F.regexp_replace(line, address, "mem"))
    elif mode == "both":
        masked = F.regexp_replace(F.regexp_replace(line, immediate, "imm"), address, "mem")
    else:
        raise ValueError(f"unknown mask mode {mode!r}; use raw, mem or both")
    return F.replace(masked, F.lit(","), F.lit(" "))


def disassembly_instruction(line: Column) -> Column:
    """Instruction text of a listing line that contains '<'.

    It starts two characters from the first '>' and ends one before the last '#', else one before the
    last '<', else at the end of the line.  Null for a line without '>'.
    """
    def instruction(tail: Column) -> Column:
        cut_at = F.when(tail.contains("#"), _last_index(tail, "#")).when(tail.contains("<"), _last_index(tail, "<"))
        # cut_at is 1-based; the text ends one character before it.  A cut at the very start counts from the end.
        kept = cut_at - 2
        return F.when(cut_at.isNull(), tail).otherwise(
            _sub(tail, F.lit(1), F.when(kept < 0, F.length(tail) + kept).otherwise(kept)))

    return _once(line, lambda whole: F.when(
        whole.contains(">"), _once(F.substring(whole, F.instr(whole, ">") + 2, F.length(whole)), instruction)))


def run_succeeded(output: Column) -> Column:
    """False for output that names a failure, in any case."""
    return ~F.lower(output).rlike("|".join(FAILURE_WORDS))


def base_name(file_name: Column, extension: str = ".c") -> Column:
    """File name without folders, underscores, the extension and digits."""
    bare = F.replace(F.replace(file_name, F.lit("_"), F.lit("")), F.lit(extension), F.lit(""))
    return F.substring_index(F.regexp_replace(bare, "[0-9]", ""), "/", -1)


def stem(path: Column) -> Column:
    """File name without folders and without the last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def label_stem(path: Column) -> Column:
    """Path up to the last '_test' of a test-case path; null for paths without 'test'.

    A path that contains 'test' but no '_test' loses its last character, as a label path does.
    """
    cut = F.length(path) - F.instr(F.reverse(path), "tset_") - 4
    with_test = F.when(path.contains("_test"), F.substring(path, F.lit(1), cut)).otherwise(
        F.substring(path, F.lit(1), F.length(path) - 1)
    )
    return F.when(path.contains("test"), with_test)


def last_label(class_name: Column) -> Column:
    """Component after the last comma."""
    return F.substring_index(class_name, ",", -1)


def flip_sign(values: Column, sign: str = "+") -> Column:
    """All values of an array made >= 0 ('+') or <= 0 ('-')."""
    if sign == "+":
        return F.transform(values, lambda v: F.when(v < 0, -v).otherwise(v))
    if sign == "-":
        return F.transform(values, lambda v: F.when(v > 0, -v).otherwise(v))
    raise ValueError(f"sign must be + or -, not {sign!r}")


def letter_mismatch(first: Column, second: Column) -> Column:
    """Over the distinct letters of second: how far the letter counts of the two names are apart, summed."""

    def count(text: Column, letter: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, letter, F.lit("")))

    letters = F.filter(F.array_distinct(F.split(second, "")), lambda c: c != "")
    return F.aggregate(
        letters,
        F.lit(0).cast("bigint"),
        lambda total, c: total + F.abs(count(first, c) - count(second, c)).cast("bigint"),
    )


def class_letter(rank: Column) -> Column:
    """Code letter of a 1-based alphabetical class rank: the upper case of character rank + 96."""
    return F.upper(F.chr(rank + 96))
