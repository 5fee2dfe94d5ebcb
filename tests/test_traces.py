"""Hand-worked traces."""

import pytest
from pyspark.sql import functions as F

from tracewright.functions import strings
from tracewright.operators import encode, traces


def values(spark, fn, items):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def trace_of(spark, rows):
    """rows: (sample, 'op a,b ...')"""
    out, at = [], {}
    for sample, text in rows:
        at[sample] = at.get(sample, 0) + 1
        op, _, rest = text.partition(" ")
        out.append((sample, at[sample], op, rest.split(",") if rest else [op]))
    return spark.createDataFrame(out, "sample_id string, step bigint, opcode string, operands array<string>")


def test_operand_types(spark):
    got = values(spark, strings.operand_type, ["$0x4", "8(%rax", "0x10", "%rbx", "main", "ret"])
    assert got == ["imm", "mem", "mem", "reg", "lbl", "lbl"]


def test_parse_text(spark):
    text = (
        "before => 0x1\tpush   %rax\nBreakpoint 1, main ()\nx\n=> 0x2 <main+4>:\tmov    $0x0,%eax\n"
        "int i;\n=> 0x3 <main+9>:\tret\n=> 0x4 <main>:\tmov    8(%rax,%rbx),%rcx"
    )
    files = spark.createDataFrame([("a", text), ("b", "=> 0x2\tret"), ("c", "")], "sample_id string, content string")
    got = [tuple(r) for r in traces.parse_trace_text(files).orderBy("sample_id", "step").collect()]
    assert got == [
        ("a", 1, "mov", ["$0x0", "%eax"]),
        ("a", 2, "ret", ["ret"]),
        ("a", 3, "mov", ["8(%rax", "%rbx)", "%rcx"]),
    ]
    lines = files.select("sample_id", F.posexplode(F.split("content", "\n")).alias("p", "line")).select(
        "sample_id", (F.col("p") + 1).cast("bigint").alias("step"), "line"
    )
    by_line = traces.consecutive_steps(traces.parse_trace_lines(lines))
    assert sorted(tuple(r) for r in by_line.select("sample_id", "step", "opcode", "operands").collect()) == got


def test_listing_slice(spark):
    text = [
        "0000 <main>:", "  1:\t55\tpush   %rbp", "  2:\te8\tcallq  400 <puts@plt>", "short\tline",
        "  3:\tff d0\tcallq  *%rax", "0010 <helper>:", "  4:\t90\tnop", "  5:\te8\tcall 0 <main>", "  6:\tc3\tret",
        "0020 <x>:", "  7:\tc3\tret",
    ]
    lines = spark.createDataFrame([("a", i + 1, t) for i, t in enumerate(text)], "sample_id string, line_no bigint, line string")
    for run_length in (1, 4, 1000):
        got = [r.line for r in traces.listing_slice(lines, "main", run_length).orderBy("line_no").collect()]
        # a call without <name> gives the line without its last character; a call of main switches on as well
        assert got == ["push   %rbp", "puts@plt()", "  3:\tff d0\tcallq  *%ra()", "main()", "ret"]


def test_masks(spark):
    line = " mov    $0x1f,0x8(%rbp)"
    assert values(spark, lambda c: strings.mask_operands(c, "raw"), [line]) == [" mov    $0x1f 0x8(%rbp)"]
    assert values(spark, lambda c: strings.mask_operands(c, "mem"), [line, "lea 0x8(%rbp),%rax"]) == [
        " mov    $0x1f 0x8(%rbp)", "lea mem(%rbp) %rax"]
    assert values(spark, lambda c: strings.mask_operands(c, "both"), [line]) == [" mov    imm mem(%rbp)"]
    with pytest.raises(ValueError):
        strings.mask_operands(F.col("x"), "none")


def test_names(spark):
    assert values(spark, strings.after_first_colon, ["a:b:c", "abc"]) == ["b:c", "abc"]
    assert values(spark, strings.base_name, ["/d/e/foo_12.c", "bar3.c"]) == ["foo", "bar"]
    assert values(spark, strings.label_stem, ["a_test_b_test1.x", "test.x", "a.x"]) == ["a_test_b", "test.", None]
    assert values(spark, strings.last_label, ["a,b,c", "d"]) == ["c", "d"]
    assert values(spark, strings.disassembly_instruction, [
        "  400 <main+1>:\tmov %eax,%ebx", "4 <f>: lea 0x2(%rip),%rdi        # 0x601040", "4 <f>: jmp 9 <g>", "<x"
    ]) == ["\tmov %eax,%ebx", " lea 0x2(%rip),%rdi       ", " jmp 9", None]
    assert values(spark, strings.run_succeeded, ["fine", "An ERROR", "cannot do"]) == [True, False, False]


def test_letter_mismatch_is_not_symmetric(spark):
    df = spark.createDataFrame([("ab", "abc"), ("abc", "ab"), ("JiVi", "ViJi"), ("aab", "ab"), ("a", "")], "a string, b string")
    got = [r.m for r in df.select(strings.letter_mismatch(F.col("a"), F.col("b")).alias("m")).collect()]
    assert got == [1, 0, 0, 1, 0]


ROWS = [("s", t) for t in [
    "push %rax", "xor %eax,%eax", "and %eax,%ebx", "add $1,%eax", "add $2,%eax", "jmp <a>", "je <a>", "jne <b>", "jmp <a>",
    "movzbl %al,%eax", "call <f>", "ret", "test %eax,%eax", "inc %eax"]] + [("t", "nop")]


def test_counters(spark):
    trace = trace_of(spark, ROWS)
    got = {r.sample_id: r.asDict() for r in traces.trace_counters(trace).collect()}
    # push contains sh and so counts as arithmetic; inc is in no counter
    assert got["s"] == {"sample_id": "s", "n_arith": 3, "n_jump": 4, "n_mov": 1, "n_call": 1, "n_total": 14}
    assert {r.sample_id: r.n_revisit for r in traces.jump_revisits(trace).collect()} == {"s": 2, "t": 0}
    assert {r.sample_id: r.n_change for r in traces.opcode_changes(trace).collect()} == {"s": 13, "t": 1}


@pytest.mark.parametrize("run_length", [1, 2, 5, 1000])
def test_transitions(spark, run_length):
    trace = trace_of(spark, ROWS)
    found = {m: traces.trace_transitions(trace, m, run_length).filter("sample_id = 's'").first().asDict() for m in ("reference", "fixed")}
    # D->L push/xor, L->L xor/and, L->A and/add, A->C add/jmp, C->D jmp/movzbl, D->C movzbl/call, L->A test/inc
    common = {"n_dl": 1, "n_ac": 1, "n_cd": 1, "n_dc": 1}
    for mode, la in (("reference", 1), ("fixed", 2)):
        row = found[mode]
        assert {k: v for k, v in row.items() if k != "sample_id" and v} == {**common, "n_la": la}
    with pytest.raises(ValueError):
        traces.trace_transitions(trace, "other")


def test_vector_properties(spark):
    trace = trace_of(spark, ROWS)
    f = dict(zip(traces.VECTOR_SLOTS, traces.trace_vector(trace).filter("sample_id = 's'").first().features))
    assert len(f) == 19
    assert sum(f[f"n_{t.lower()}"] for t in traces.TRANSITIONS) <= f["n_change"] <= f["n_total"]


def test_opcode_string_in_parts(spark):
    trace = trace_of(spark, [("a", o) for o in ["mov", "add", "ret", "nop", "jmp"]])
    got = [(r.part, r.opcodes) for r in traces.opcode_string(trace, 2).orderBy("part").collect()]
    assert got == [(0, "mov,add"), (1, "ret,nop"), (2, "jmp")]


def joined(df):
    out = {}
    for r in df.orderBy("sample_id", "part").collect():
        out[r.sample_id] = out.get(r.sample_id, "") + r.symbols
    return out


@pytest.mark.parametrize("part_length", [1, 2, 3, 1000])
def test_sequences(spark, part_length):
    trace = trace_of(spark, [("a", "mov %rax,%rbx"), ("a", "add $1,%rax"), ("a", "mov %rax,%rbx"), ("b", "ret"), ("b", "mov 0x8(%rax),%rbx")])
    assert joined(encode.alpha_sequence(trace, part_length=part_length)) == {"a": "aba", "b": "ca"}
    # signatures reg,reg ! / imm,reg # / lbl $ / mem,reg ^, last character dropped
    assert joined(encode.alpha_param_sequence(trace, part_length)) == {"a": "a!b#a", "b": "c$a"}
    codes = [r.code for r in encode.encode_trace(trace).orderBy("sample_id", "step").collect()]
    assert codes == ["000", "110", "000", "23", "020"]
    samples = spark.createDataFrame([("a",), ("aa",), ("b",)], "sample_id string")
    # an empty trace is one nameless action and takes a letter
    assert joined(encode.alpha_sequence(trace, samples, part_length)) == {"a": "aba", "aa": "c", "b": "da"}


@pytest.mark.parametrize("part_length", [10, 70, 1000])
def test_letters_run_out(spark, part_length):
    rows = [("a", f"op{i:02d}") for i in range(62)] + [("b", "op00"), ("b", "late"), ("b", "op01"), ("c", "late")]
    rows += [("d", "op01")] * 75
    got = joined(encode.alpha_sequence(trace_of(spark, rows), part_length=part_length))
    assert len(got["a"]) == 62 and got["b"] == "a" and got["c"] == "" and got["d"] == "b" * 75


def test_encode_lines(spark):
    lines = spark.createDataFrame([("a", 1, "mov   $0x1,%rax"), ("a", 2, "ret"), ("a", 3, "mov")], "sample_id string, step bigint, line string")
    got = [r.code for r in encode.encode_lines(lines).orderBy("step").collect()]
    assert got == ["010", "1", "0"]


def test_sequences_take_two_passes_over_the_steps(spark, capsys):
    """The steps are read for the letters and for the sequences; cuts and last parts come from the parts."""
    rows = [("a", i, "mov", ["%rax"]) for i in range(1, 8)] + [("b", 1, "add", ["$1"])]
    steps = spark.createDataFrame(rows, "sample_id string, step long, opcode string, operands array<string>").repartition(3, "sample_id")
    got = encode.alpha_param_sequence(steps, 3)
    got.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(sample_id") == 1 and "SortMergeJoin" not in plan
    assert [tuple(r) for r in got.orderBy("sample_id", "part").collect()] == [
        ("a", 0, "a!a!a!"), ("a", 1, "a!a!a!"), ("a", 2, "a"), ("b", 0, "b")]


def test_line_is_worked_out_once(spark, capsys):
    """A line made by an expression is not made anew for each place where its instruction is looked for."""
    rows = spark.createDataFrame([("mov %eax # a",)], "s string")
    got = rows.select(strings.disassembly_instruction(F.concat(F.lit("<a>:\t"), F.upper("s"))).alias("i"))
    got.explain()
    assert capsys.readouterr().out.count("upper(") == 1
    assert got.first().i == "\tMOV %EAX"
