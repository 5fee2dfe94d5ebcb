"""Readers for line-oriented logs whose lines depend on earlier lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.plans.ordering import RUN_LENGTH, carry_forward, segment

# A header says which tree depth or target dimensionality the following predictions belong to.
HEADER = r"(?i)(?:tree )?(?:depth|dimensionality): *([0-9]+)"


def unescaped(text: Column) -> Column:
    """Backslash escapes decoded as in string literals: letters, octal and \\xNN; an unknown escape stays as it is."""
    plain = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\\": "\\", "'": "'", '"': '"'}
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)\\x[0-9a-fA-F]{2}|\\[0-7]{1,3}|\\.|[^\\]+|\\"), F.lit(0))

    def decoded(piece: Column) -> Column:
        code = F.when(piece.rlike(r"^\\x"), F.conv(F.substring(piece, 3, 2), 16, 10)).when(
            piece.rlike(r"^\\[0-7]"), F.conv(F.substring(piece, 2, 3), 8, 10))
        out = F.when(code.isNotNull(), F.char(code.cast("int")))
        for letter, character in plain.items():
            out = out.when(piece == "\\" + letter, character)
        return out.otherwise(piece)

    return F.when(text.contains("\\"), F.array_join(F.transform(pieces, decoded), "")).otherwise(text)


def testcase_args(lines: DataFrame, run_length: int = RUN_LENGTH) -> DataFrame:
    """(file_id, line_no, arg) from the lines (file_id, line_no, line) of test-case logs.

    A line with 'arg' (but neither n_args nor --sym-args) arms; the next 'data: ' line gives the argument,
    without quotes and with its escapes decoded, and disarms.
    """
    line = F.col("line")
    arms = line.contains("arg") & ~line.contains("n_args") & ~line.contains("--sym-args")
    data = ~arms & line.contains("data: ")
    # Only these lines change the state, so the carry looks at them alone.
    state = F.when(arms, F.lit(1)).when(data, F.lit(0))
    states = carry_forward(lines, ["file_id"], "line_no", state, "_armed", run_length, include_current=False)
    value = F.replace(
        F.substring(line, F.instr(line, "data: ") + 6, F.length(line)), F.lit("'"), F.lit("")
    )
    return states.filter(data & (F.col("_armed") == 1)).select("file_id", "line_no", unescaped(value).alias("arg"))


def argument_text(args: DataFrame, run_length: int = RUN_LENGTH) -> DataFrame:
    """(file_id, part, args): arguments in line order, each followed by a space.

    Part p holds the arguments of one run of line numbers, so that no row grows with the length of a log.
    """
    return (
        args.groupBy("file_id", segment("line_no", run_length).alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "arg"))).alias("_a"))
        .select("file_id", "part", F.array_join(F.transform("_a", lambda a: F.concat(a["arg"], F.lit(" "))), "")
                .alias("args"))
    )


def parse_predictions(lines: DataFrame, experiment: str = "exp1", run_length: int = RUN_LENGTH) -> DataFrame:
    """(file_id, line_no, param, class_name, predicted) from the lines of prediction logs.

    exp1 lines read Class:A,Predicted:B; exp2 lines read <file>: Class: A, Predicted: B and also give
    sample_id.  A header line holds for the lines after it; lines before the first header are dropped.
    """
    line = F.col("line")
    if experiment == "exp1":
        is_header = line.rlike(r"(?i)(tree depth|target dimensionality):")
        fields = [
            F.regexp_extract(line, r"^[^,:]*:([^,:]*)", 1).alias("class_name"),
            F.regexp_extract(line, r"^[^,]*,[^,:]*:([^,:]*)", 1).alias("predicted"),
        ]
    elif experiment == "exp2":
        is_header = line.rlike(r"(?i)^(tree )?depth:|^(target )?dimensionality:")
        fields = [
            F.regexp_extract(line, r"^(.*?): Class:", 1).alias("sample_id"),
            F.regexp_extract(line, r"Class: (\S+?),? Predicted:", 1).alias("class_name"),
            F.regexp_extract(line, r"(\S+)\s*$", 1).alias("predicted"),
        ]
    else:
        raise ValueError(f"unknown experiment {experiment!r}; use exp1 or exp2")
    param = F.when(is_header, F.regexp_extract(line, HEADER, 1).try_cast("int"))
    headed = carry_forward(lines, ["file_id"], "line_no", param, "param", run_length)
    return headed.filter(line.contains("Class") & ~is_header & F.col("param").isNotNull()).select(
        "file_id", "line_no", "param", *fields
    )
