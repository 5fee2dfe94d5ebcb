"""Tables of the given data set, and views on them that have the shapes of a trace corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.plans.ordering import lag_in_order, row_numbers

OPCODES = ("mov,push,pop,add,sub,xor,and,or,cmp,test,jmp,jne,je,call,lea,ret,nop,shl,inc,movzbl,testb,movl,"
           "addq,loop")
CLASSES = "JiVi,ViJi,Fl,FlAr,ArFl"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def asm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instruction per order line: sample_id, step, opcode, operand, fn, l_partkey, l_suppkey."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    numbered = row_numbers(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "step")
    return numbered.selectExpr(
        "l_orderkey as sample_id",
        "step",
        f"split_part('{OPCODES}', ',', cast(l_partkey % 24 + 1 as int)) as opcode",
        "case l_suppkey % 4 when 0 then '%rax,%rbx' when 1 then '$0x' || lower(hex(l_partkey)) || ',%eax' "
        "when 2 then '0x' || lower(hex(l_suppkey)) || '(%rbp),%rax' else '<loop>' end as operand",
        "case when l_linenumber <= 4 then 'main' else 'helper' end as fn",
        "l_partkey",
        "l_suppkey",
    )


def gdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Debugger trace lines: sample_id, step, line."""
    return asm(spark, sf_dir).selectExpr(
        "sample_id",
        "step",
        r"'=> 0x' || lower(hex(l_partkey)) || ' <' || fn || '+' || step || '>:\t' || opcode || '    ' || operand "
        "as line",
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static listing lines: function headers on odd line numbers, instructions on even ones."""
    rows = lag_in_order(asm(spark, sf_dir), ["sample_id"], "step", "fn", "pfn")
    body = F.expr(
        r"struct(2 * step as line_no, '  ' || lower(hex(l_partkey)) || ':\t48 89\t' || case when opcode = 'call' "
        "then 'callq  400 <' || case when l_suppkey % 5 = 0 then 'main' else 'puts' end || '>' "
        "else opcode || '    ' || operand end as line)"
    )
    header = F.expr("struct(2 * step - 1 as line_no, '0000000000400000 <' || fn || '>:' as line)")
    starts = F.col("pfn").isNull() | (F.col("pfn") != F.col("fn"))
    return rows.select(
        "sample_id", F.explode(F.when(starts, F.array(header, body)).otherwise(F.array(body))).alias("r")
    ).select("sample_id", "r.line_no", "r.line")


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions: sample_id, param, fold, class_name, predicted."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as sample_id",
        "case o_orderkey % 4 when 0 then 2 when 1 then 4 when 2 then 8 else 16 end as param",
        "cast(floor(o_orderkey / 1500) as int) as fold",
        f"split_part('{CLASSES}', ',', cast(o_custkey % 5 + 1 as int)) as class_name",
        f"split_part('{CLASSES}', ',', cast((case when o_orderkey % 7 < 5 then o_custkey "
        "else o_custkey + o_orderkey end) % 5 + 1 as int)) as predicted",
    )


def _numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_numbers(table(spark, sf_dir, "events"), ["user_id"], ["ts"], "line_no")


def predlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction log lines: file_id, line_no, line."""
    return _numbered_events(spark, sf_dir).selectExpr(
        "user_id as file_id",
        "line_no",
        "case event_type when 'signup' then 'Tree Depth: ' || (event_id % 4 * 4) when 'error' then 'noise' "
        "else 'Class:' || event_type || ',Predicted:' || "
        "split_part('click,view,purchase', ',', cast(event_id % 3 + 1 as int)) end as line",
    )


def testcase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test-case log lines: file_id, line_no, line."""
    return _numbered_events(spark, sf_dir).selectExpr(
        "user_id as file_id",
        "line_no",
        "case event_type when 'purchase' then 'object 0: name: \\'arg0\\'' "
        "when 'view' then 'object 0: data: \\'v' || event_id || '\\'' "
        "when 'signup' then 'object 0: name: n_args' else 'object 0: size: 4' end as line",
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files in metadata form: sample_id, content."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as sample_id",
        "case when p_size % 10 = 0 then 'Ident' else '[\\'--Transform=' || p_type || '\\', \\'--Functions=main\\', "
        "\\'--' || replace(p_brand, '#', '') || 'Kinds=' || p_size || '\\', \\'--out=x.c\\']' end as content",
    )
