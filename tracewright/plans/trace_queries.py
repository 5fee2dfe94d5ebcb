"""Queries on traces: parsing, filtering, masking, counting, encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import strings
from tracewright.operators import encode, traces
from tracewright.plans import views
from tracewright.plans.catalog import query


def trace(spark, sf):
    """The asm view as a trace table."""
    return views.asm(spark, sf).select("sample_id", "step", "opcode", F.split("operand", ",").alias("operands"))


@query("trace_parse", views="asm gdb", sql="""
select sample_id, cast(step as bigint) as step,
  split_part(string_split(line, chr(9))[-1], ' ', 1) as opcode,
  string_split(string_split(line, chr(9))[-1], ' ')[-1] as operands
from gdb where contains(line, '=>')""")
def trace_parse(spark, sf):
    parsed = traces.parse_trace_lines(views.gdb(spark, sf), start_mark=None)
    return parsed.withColumn("operands", F.array_join("operands", ","))


@query("trace_parse_marked", views="asm gdb", sql="""
select sample_id, cast(step as bigint) as step,
  split_part(string_split(line, chr(9))[-1], ' ', 1) as opcode,
  string_split(string_split(line, chr(9))[-1], ' ')[-1] as operands
from gdb where contains(line, '=>') and sample_id % 7 <> 0""")
def trace_parse_marked(spark, sf):
    """Traces with a start mark, an instruction above it and one in front of it; every seventh trace has no mark."""
    gdb = views.gdb(spark, sf)
    heads = gdb.select("sample_id").distinct().select("sample_id", F.explode(F.array(
        F.struct(F.lit(-1).alias("step"), F.lit("=> 0x1 <pre+1>:\tnop    x").alias("line")),
        F.struct(F.lit(0).alias("step"), F.when(F.col("sample_id") % 7 != 0, "=> 0x1 <pre+2>:\tnop    y Breakpoint 1, main ()")
                 .otherwise("=> 0x1 <pre+2>:\tnop    y").alias("line")))).alias("h")).select("sample_id", "h.*")
    lines = gdb.select("sample_id", F.col("step").cast("bigint").alias("step"), "line").unionByName(
        heads.withColumn("step", F.col("step").cast("bigint")))
    parsed = traces.parse_trace_lines(lines)
    return parsed.withColumn("operands", F.array_join("operands", ","))


@query("listing_slice", views="asm listing", sql="""--ctes
s as (select sample_id, line_no, line, last_value(case when contains(line, '<main>') then true
        when contains(line, '>:') then false end ignore nulls)
        over (partition by sample_id order by line_no rows between unbounded preceding and current row) as st
      from listing),
c as (select *, string_split(line, chr(9)) as f, length(line) as n,
        strpos(reverse(line), '<') as ra, strpos(reverse(line), '>') as rb from s where st)
select sample_id, cast(line_no as bigint) as line_no,
  case when contains(line, 'call') then
    substr(line, case when ra=0 then 1 else n-ra+2 end,
      greatest((case when rb=0 then n-1 else n-rb end) - (case when ra=0 then 0 else n-ra+1 end), 0)) || '()'
  else f[-1] end as line
from c where len(f) > 2""")
def listing_slice(spark, sf):
    return traces.listing_slice(views.listing(spark, sf), "main")


_FILTERED = """--ctes
f as (select sample_id, step, substr(line, strpos(line, ':') + 1) as line from gdb
      where contains(line, '=>') and contains(line, 'main'))
"""
_MASKED = {
    "raw": "line",
    "mem": r"case when regexp_matches(line, '\$0x\w+') then line else regexp_replace(line, '0x\w+', 'mem', 'g') end",
    "both": r"regexp_replace(regexp_replace(line, '\$0x\w+', 'imm', 'g'), '0x\w+', 'mem', 'g')",
}


@query("trace_filter", views="asm gdb", sql=_FILTERED + "select sample_id, cast(step as bigint) as step, line from f")
def trace_filter(spark, sf):
    return traces.trace_filter(views.gdb(spark, sf), "main")


def _mask_query(mode):
    @query(f"trace_mask_{mode}", views="asm gdb", sql=_FILTERED +
           f"select sample_id, cast(step as bigint) as step, replace({_MASKED[mode]}, ',', ' ') as line from f")
    def masked(spark, sf):
        kept = traces.trace_filter(views.gdb(spark, sf), "main")
        return kept.withColumn("line", strings.mask_operands(F.col("line"), mode))


for _mode in _MASKED:
    _mask_query(_mode)


@query("disasm_parse", views="asm listing", sql="""--ctes
t as (select sample_id, line_no, substr(line, strpos(line, '>') + 2) as tail from listing
      where contains(line, '<') and contains(line, '>')),
c as (select *, length(tail) as n, case when contains(tail, '#') then n - strpos(reverse(tail), '#') + 1
        when contains(tail, '<') then n - strpos(reverse(tail), '<') + 1 end as cut from t)
select sample_id, cast(line_no as bigint) as line_no,
  case when cut is null then tail when cut < 2 then substr(tail, 1, greatest(n + cut - 2, 0))
    else substr(tail, 1, cut - 2) end as instruction
from c""")
def disasm_parse(spark, sf):
    line = F.col("line")
    rows = views.listing(spark, sf).filter(line.contains("<") & line.contains(">"))
    return rows.select("sample_id", "line_no", strings.disassembly_instruction(line).alias("instruction"))


@query("disasm_parse_debugger", views="asm gdb", sql="""--ctes
t as (select sample_id, step, substr(line, strpos(line, '>') + 2) as tail
      from (select sample_id, step, line || case when l_suppkey % 3 = 0 then '        # 0x601040 <x>' else '' end as line
            from gdb join asm using (sample_id, step)) q),
c as (select *, length(tail) as n, case when contains(tail, '#') then n - strpos(reverse(tail), '#') + 1
        when contains(tail, '<') then n - strpos(reverse(tail), '<') + 1 end as cut from t)
select sample_id, cast(step as bigint) as step,
  case when cut is null then tail when cut < 2 then substr(tail, 1, greatest(n + cut - 2, 0))
    else substr(tail, 1, cut - 2) end as instruction
from c""")
def disasm_parse_debugger(spark, sf):
    """Debugger lines, some of which end in a comment."""
    rows = views.asm(spark, sf).selectExpr(
        "sample_id",
        "step",
        r"'=> 0x' || lower(hex(l_partkey)) || ' <' || fn || '+' || step || '>:\t' || opcode || '    ' || operand "
        "|| case when l_suppkey % 3 = 0 then '        # 0x601040 <x>' else '' end as line",
    )
    return rows.select("sample_id", "step", strings.disassembly_instruction(F.col("line")).alias("instruction"))


_TYPE = """case when contains(op, '$') then 'imm' when contains(op, '(') or contains(op, '0x') then 'mem'
  when contains(op, '%') then 'reg' else 'lbl' end"""


@query("operand_type", views="asm", sql=f"""--ctes
o as (select sample_id, step, opcode, string_split(operand, ',') as ops from asm),
e as (select sample_id, step, unnest(ops) as op, generate_subscripts(ops, 1) as pos from o)
select sample_id, cast(step as bigint) as step, cast(pos as bigint) as pos, op as operand, {_TYPE} as operand_type
from e""")
def operand_type(spark, sf):
    ops = trace(spark, sf).select("sample_id", "step", F.posexplode("operands").alias("p", "operand"))
    return ops.select(
        "sample_id", "step", (F.col("p") + 1).cast("bigint").alias("pos"), "operand",
        strings.operand_type(F.col("operand")).alias("operand_type"),
    )


@query("opcode_string", views="asm", sql="""
select sample_id, cast((step - 1) // 65536 as bigint) as part, string_agg(opcode, ',' order by step) as opcodes
from asm group by 1, 2""")
def opcode_string(spark, sf):
    return traces.opcode_string(trace(spark, sf))


_COUNTER = """case when contains(opcode,'add') or contains(opcode,'sub') or contains(opcode,'sh') or contains(opcode,'rot') then 'arith'
  when contains(opcode,'and') or contains(opcode,'or') or contains(opcode,'xor') or contains(opcode,'neg') then 'logic'
  when contains(opcode,'j') then 'jump' when contains(opcode,'mov') then 'mov' when contains(opcode,'call') then 'call' end"""
_CATEGORY = """case when {0} in ('add','sub','mul','sh','rot','inc','dec','shr','shl','addq') then 'A'
  when {0} in ('and','or','xor','neg','test','cmp','testb','cmpq','testl') then 'L'
  when {0} in ('jmp','jne','je','jz','jnz','jg','jge','jl','jle','ja','jae','jb','jbe','jo','jno','jc','jnc','js','jns','loop','call','rep') then 'C'
  when {0} in ('mov','loads','stos','pop','push','movzbl','cmove','movl','movq') then 'D' end"""
_STEPS = f"""--ctes
p as (select *, coalesce(lag(opcode) over (partition by sample_id order by step), '') as prev, {_COUNTER} as kind from asm),
k as (select *, case when prev <> opcode then ({_CATEGORY.format('prev')}) || ({_CATEGORY.format('opcode')}) end as pair from p)
"""
_COUNTS = ", ".join(
    [f"cast(count(*) filter (where kind = '{k}') as bigint) as n_{k}" for k in ("arith", "jump", "mov", "call")]
    + ["cast(count(*) as bigint) as n_total"]
)
_REVISIT = """cast(count(*) filter (where kind = 'jump') - count(distinct case when kind = 'jump' then operand end) as bigint)
  as n_revisit"""


def _pairs(mode):
    names = ["AC", "AL", "AD", "CA", "CL", "CD", "DA", "DL", "DC", "LA", "LC", "LD"]
    return ", ".join(
        f"cast(count(*) filter (where pair = '{'LL' if mode == 'reference' and p == 'LA' else p}') as bigint) "
        f"as n_{p.lower()}" for p in names
    )


@query("trace_counters", views="asm", sql=_STEPS + f"select sample_id, {_COUNTS} from k group by sample_id")
def trace_counters(spark, sf):
    return traces.trace_counters(trace(spark, sf))


@query("jump_revisits", views="asm", sql=_STEPS + f"select sample_id, {_REVISIT} from k group by sample_id")
def jump_revisits(spark, sf):
    return traces.jump_revisits(trace(spark, sf))


@query("opcode_changes", views="asm", sql=_STEPS + """
select sample_id, cast(count(*) filter (where prev <> opcode) as bigint) as n_change from k group by sample_id""")
def opcode_changes(spark, sf):
    return traces.opcode_changes(trace(spark, sf))


@query("trace_transitions", views="asm",
       sql=_STEPS + f"select sample_id, {_pairs('reference')} from k group by sample_id")
def trace_transitions(spark, sf):
    return traces.trace_transitions(trace(spark, sf), "reference")


@query("trace_transitions_fixed", views="asm",
       sql=_STEPS + f"select sample_id, {_pairs('fixed')} from k group by sample_id")
def trace_transitions_fixed(spark, sf):
    return traces.trace_transitions(trace(spark, sf), "fixed")


@query("trace_vector", views="asm", sql=_STEPS + f""",
v as (select sample_id, {_COUNTS}, cast(count(*) filter (where prev <> opcode) as bigint) as n_change, {_REVISIT},
  {_pairs('reference')} from k group by sample_id)
select sample_id, '[' || concat_ws(', ', {', '.join(traces.VECTOR_SLOTS)}) || ']' as features from v""")
def trace_vector(spark, sf):
    vectors = traces.trace_vector(trace(spark, sf))
    text = F.concat(F.lit("["), F.array_join(F.col("features").cast("array<string>"), ", "), F.lit("]"))
    return vectors.select("sample_id", text.alias("features"))


# ---- encoding ------------------------------------------------------------------------------------------

_FIRST = """d as (select opcode, row_number() over (order by f.sample_id, f.step) as r
      from (select opcode, min({'sample_id': sample_id, 'step': step}) as f from asm group by opcode) q)"""
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


@query("first_seen_dict", views="asm", sql=f"--ctes\n{_FIRST}\nselect opcode, cast(r - 1 as bigint) as idx from d")
def first_seen_dict(spark, sf):
    return encode.first_seen_index(trace(spark, sf), "opcode", ["sample_id", "step"])


@query("alpha_sequence", views="asm", sql=f"""--ctes
{_FIRST},
l as (select a.sample_id, a.step, case when r <= 62 then substr('{_LETTERS}', r, 1) end as letter
      from asm a join d using (opcode)),
c as (select sample_id, min(step) as cut from l where letter is null group by sample_id)
select l.sample_id, cast((step - 1) // 65536 as bigint) as part,
  coalesce(string_agg(letter, '' order by step) filter (where cut is null or step < cut), '') as symbols
from l left join c using (sample_id) group by 1, 2""")
def alpha_sequence(spark, sf):
    return encode.alpha_sequence(trace(spark, sf))


_SIG = """s as (select sample_id, step, opcode, array_to_string([""" + _TYPE + """ for op in string_split(operand, ',')], ',') as sig
      from asm)"""


@query("alpha_param_sequence", views="asm", sql=f"""--ctes
{_FIRST},
{_SIG},
g as (select sig, row_number() over (order by f.sample_id, f.step) as r
      from (select sig, min({{'sample_id': sample_id, 'step': step}}) as f from s group by sig) q),
l as (select s.sample_id, s.step, substr('{_LETTERS}', d.r, 1) || substr('!#$^&*()-+=~?:;{{}}[]|<>,.', g.r, 1) as pair
      from s join d using (opcode) join g using (sig)),
t as (select sample_id, string_agg(pair, '' order by step) as symbols from l group by sample_id)
select sample_id, cast(0 as bigint) as part, substr(symbols, 1, length(symbols) - 1) as symbols from t""")
def alpha_param_sequence(spark, sf):
    return encode.alpha_param_sequence(trace(spark, sf))


_DIGITS = f"""replace(replace(replace(replace(array_to_string([{_TYPE} for op in string_split(operand, ',')], ''),
  'reg', '0'), 'imm', '1'), 'mem', '2'), 'lbl', '3')"""


@query("encode_sequence", views="asm", sql=f"""--ctes
{_FIRST}
select a.sample_id, cast(a.step as bigint) as step, cast(d.r - 1 as varchar) || {_DIGITS} as code
from asm a join d using (opcode)""")
def encode_sequence(spark, sf):
    return encode.encode_trace(trace(spark, sf))


@query("encode_lines", views="asm", sql=f"""--ctes
{_FIRST}
select a.sample_id, cast(a.step as bigint) as step, cast(d.r - 1 as varchar) || {_DIGITS} as code
from asm a join d using (opcode)""")
def encode_lines(spark, sf):
    """The same from instruction text such as 'mov    %rax,%rbx'."""
    lines = views.asm(spark, sf).selectExpr("sample_id", "step", "opcode || '    ' || operand as line")
    return encode.encode_lines(lines)
