"""Named queries on the given tables, each with an equivalent SQL text where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# The views of plans/views.py, as SQL.
VIEWS = {
    "asm": """select l_orderkey as sample_id,
  row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey) as step,
  split_part('mov,push,pop,add,sub,xor,and,or,cmp,test,jmp,jne,je,call,lea,ret,nop,shl,inc,movzbl,testb,movl,addq,loop',
             ',', cast(l_partkey % 24 + 1 as int)) as opcode,
  case l_suppkey % 4 when 0 then '%rax,%rbx' when 1 then '$0x'||lower(hex(l_partkey))||',%eax'
       when 2 then '0x'||lower(hex(l_suppkey))||'(%rbp),%rax' else '<loop>' end as operand,
  case when l_linenumber<=4 then 'main' else 'helper' end as fn, l_partkey, l_suppkey
from lineitem""",
    "gdb": """select sample_id, step, '=> 0x'||lower(hex(l_partkey))||' <'||fn||'+'||cast(step as varchar(10))||'>:'
  ||chr(9)||opcode||'    '||operand as line from asm""",
    "listing": """select sample_id, 2*step as line_no, '  '||lower(hex(l_partkey))||':'||chr(9)||'48 89'||chr(9)||
  case when opcode='call' then 'callq  400 <'||case when l_suppkey%5=0 then 'main' else 'puts' end||'>'
       else opcode||'    '||operand end as line from asm
union all
select sample_id, 2*step-1, '0000000000400000 <'||fn||'>:'
from (select *, lag(fn) over (partition by sample_id order by step) as pfn from asm) q
where pfn is null or pfn<>fn""",
    "pred": """select o_orderkey as sample_id, case o_orderkey%4 when 0 then 2 when 1 then 4 when 2 then 8 else 16 end as param,
  cast(floor(o_orderkey/1500) as int) as fold,
  split_part('JiVi,ViJi,Fl,FlAr,ArFl', ',', cast(o_custkey%5+1 as int)) as class_name,
  split_part('JiVi,ViJi,Fl,FlAr,ArFl', ',', cast((case when o_orderkey%7<5 then o_custkey else o_custkey+o_orderkey end)%5+1 as int)) as predicted
from orders""",
    "predlog": """select user_id as file_id, row_number() over (partition by user_id order by ts) as line_no,
  case event_type when 'signup' then 'Tree Depth: '||cast(event_id%4*4 as varchar(10)) when 'error' then 'noise'
       else 'Class:'||event_type||',Predicted:'||split_part('click,view,purchase',',',cast(event_id%3+1 as int)) end as line
from events""",
    "testcase": """select user_id as file_id, row_number() over (partition by user_id order by ts) as line_no,
  case event_type when 'purchase' then 'object 0: name: '||chr(39)||'arg0'||chr(39)
       when 'view' then 'object 0: data: '||chr(39)||'v'||cast(event_id as varchar(10))||chr(39)
       when 'signup' then 'object 0: name: n_args' else 'object 0: size: 4' end as line
from events""",
    "metadata": """select p_partkey as sample_id, case when p_size%10=0 then 'Ident' else '['||chr(39)||'--Transform='||p_type||chr(39)||', '||
  chr(39)||'--Functions=main'||chr(39)||', '||chr(39)||'--'||replace(p_brand,'#','')||'Kinds='||cast(p_size as varchar(10))||chr(39)||', '||
  chr(39)||'--out=x.c'||chr(39)||']' end as content
from part""",
}


def with_views(names: str, body: str) -> str:
    """SQL with the named views in front; body is a query, or begins with a `--ctes` line and further 'name as (...)' parts.

    These may call on themselves.
    """
    parts = [f"{n} as (\n{VIEWS[n]})" for n in names.split()]
    return "with recursive " + ",\n".join(parts) + (",\n" if body.lstrip().startswith("--ctes") else "\n") + body


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query; sql is its equivalent, on top of the given views."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_views(views, sql) if views else sql
        return fn

    return add
