"""Queries on file contents: scans, vectors, labels, logs, and the joins of samples with labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import strings
from tracewright.operators import traces
from tracewright.plans import views
from tracewright.plans.catalog import query
from tracewright.plans.views import table
from tracewright.sources import files, logs


@query("corpus_scan", sql="""
select source || '/' || cast(doc_id as varchar) || '.' || lang as path, cast(doc_id as varchar) as sample_id,
  lang as kind, text as content from documents""")
def corpus_scan(spark, sf):
    path = F.concat_ws("", "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    return table(spark, sf, "documents").select(
        path.alias("path"), strings.stem(path).alias("sample_id"),
        F.substring_index(path, ".", -1).alias("kind"), F.col("text").alias("content"),
    )


@query("line_scan", sql="""
select doc_id, cast(generate_subscripts(l, 1) as bigint) as line_no, unnest(l) as line
from (select doc_id, string_split(text, chr(10)) as l from documents) q""")
def line_scan(spark, sf):
    return files.line_scan(table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")))


@query("vector_parse", sql="""
select vec_id, cast(generate_subscripts(embedding, 1) as bigint) as pos, cast(unnest(embedding) as double) as value
from embeddings""")
def vector_parse(spark, sf):
    as_text = F.concat(
        F.lit("["), F.array_join(F.col("embedding").cast("array<double>").cast("array<string>"), ", "), F.lit("]")
    )
    read = table(spark, sf, "embeddings").select("vec_id", files.vector_from_text(as_text).alias("features"))
    good, _ = files.quarantine(read)
    return good.select("vec_id", F.posexplode("features").alias("p", "value")).select(
        "vec_id", (F.col("p") + 1).cast("bigint").alias("pos"), "value"
    )


@query("scalar_lines", sql="""
select l_orderkey, l_linenumber, cast(1 as bigint) as line_no, l_extendedprice as value from lineitem union all
select l_orderkey, l_linenumber, 3, l_quantity from lineitem union all
select l_orderkey, l_linenumber, 4, l_discount from lineitem""")
def scalar_lines(spark, sf):
    content = F.concat_ws("\n", "l_extendedprice", F.lit(""), "l_quantity", "l_discount", F.lit(""))
    return files.scalar_lines(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", content.alias("content")))


_NOMINAL = r"concat('[', user_id, ', ', value, ', \'', if(event_type = 'click', 'Yes', 'No'), '\', \'', event_type, '\']\n')"


def _nominal(spark, sf):
    return table(spark, sf, "events").select("event_id", F.expr(_NOMINAL).alias("content"))


@query("nominal_vector", sql="""
select event_id, cast(1 as bigint) as pos, cast(user_id as double) as value from events union all
select event_id, 2, value from events union all
select event_id, 3, case when event_type = 'click' then 1.0::double else 0.0::double end from events union all
select event_id, 4, 0.0::double from events""")
def nominal_vector(spark, sf):
    read = _nominal(spark, sf).select("event_id", F.posexplode(files.nominal_vector(F.col("content"))).alias("p", "value"))
    return read.select("event_id", (F.col("p") + 1).cast("bigint").alias("pos"), "value")


@query("nominal_vector_plots", sql="""
select event_id, cast(1 as bigint) as pos, cast(user_id as varchar) as value from events union all
select event_id, 2, printf('%.6f', value) from events union all
select event_id, 3, case when event_type = 'click' then '1' else '0' end from events union all
select event_id, 4, '''' || event_type || '''' from events""")
def nominal_vector_plots(spark, sf):
    """The looser reading; the number in place 2 is printed with six decimals, as engines print doubles differently."""
    items = files.nominal_vector_for_plots(F.col("content"))
    read = _nominal(spark, sf).select("event_id", F.posexplode(items).alias("p", "value"))
    printed = F.when(F.col("p") == 1, F.format_string("%.6f", F.col("value").try_cast("double"))).otherwise(F.col("value"))
    return read.select("event_id", (F.col("p") + 1).cast("bigint").alias("pos"), printed.alias("value"))


@query("sequence_prefix", sql="""
select doc_id, replace(text, chr(10), '') as symbols,
  substr(replace(text, chr(10), ''), 1, 64) as prefix, cast(length(replace(text, chr(10), '')) as bigint) as n
from documents""")
def sequence_prefix(spark, sf):
    whole = files.symbol_prefix(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(whole, "").alias("symbols"),
        F.array_join(files.symbol_prefix(F.col("text"), 64), "").alias("prefix"),
        F.size(whole).cast("bigint").alias("n"),
    )


@query("label_parse", sql="""
select doc_id, source || '_' || lang || '_' as label, source || '_' || lang as clipped from documents""")
def label_parse(spark, sf):
    content = F.concat_ws("\n", F.concat("source", F.lit("_"), "lang", F.lit("_")), F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", files.label_from_text(content).alias("label"), files.label_from_text(content, clip=True).alias("clipped")
    )


@query("metadata_parse", views="metadata", sql="""--ctes
t as (select sample_id, content, contains(content, 'Ident') as ident,
        string_split(substr(content, 2, length(content) - 2), ',') as toks from metadata),
c as (select sample_id, ident,
        array_to_string([replace(split_part(x, '=', 2), chr(39), '') for x in toks if contains(x, 'Transform')], '_') as cls,
        [replace(replace(split_part(x, '=', 1), '-', ''), chr(39), '') || '_' || replace(split_part(x, '=', 2), chr(39), '')
         for x in toks if contains(x, '=') and not contains(x, 'Transform') and not contains(x, 'Functions')
           and not contains(x, 'out')] as params from t)
select sample_id, case when ident then 'Ident' else cls end as class_name,
  replace(case when ident then 'Ident' else cls || case when len(params) > 0 then '_' else '' end
    || array_to_string(list_sort(params), '_') end, ' ', '') as full_class,
  cast(case when ident then 0 else len(params) end as bigint) as n_params
from c""")
def metadata_parse(spark, sf):
    content = F.col("content")
    read = views.metadata(spark, sf).select(
        "sample_id", files.metadata_class(content).alias("class_name"), files.metadata_params(content).alias("params")
    )
    return read.select(
        "sample_id", "class_name", files.full_class_name(F.col("class_name"), F.col("params")).alias("full_class"),
        F.size("params").cast("bigint").alias("n_params"),
    )


_ARGS = """--ctes
s as (select *, case when contains(line, 'arg') and not contains(line, 'n_args') and not contains(line, '--sym-args') then 1
        when contains(line, 'data: ') then 0 end as st from testcase),
a as (select *, last_value(st ignore nulls) over (partition by file_id order by line_no
        rows between unbounded preceding and 1 preceding) as armed from s),
r as (select file_id, cast(line_no as bigint) as line_no,
        replace(substr(line, strpos(line, 'data: ') + 6), chr(39), '') as arg from a where st = 0 and armed = 1)
"""


@query("testcase_args", views="testcase", sql=_ARGS + "select * from r")
def testcase_args(spark, sf):
    return logs.testcase_args(views.testcase(spark, sf))


@query("testcase_escapes", views="testcase", sql=_ARGS + r"""
select file_id, line_no, 'A' || chr(10) || '\' || 'B' || chr(233) || arg || '\q' as arg from r""")
def testcase_escapes(spark, sf):
    """Arguments with hexadecimal, octal and letter escapes, and one that is none."""
    lines = views.testcase(spark, sf)
    escaped = F.regexp_replace("line", "data: '(.*)'$", r"data: '\\x41\\n\\\\\\102\\351$1\\q'")
    return logs.testcase_args(lines.withColumn("line", escaped))


@query("testcase_argument_text", views="testcase", sql=_ARGS + """
select file_id, cast((line_no - 1) // 1048576 as bigint) as part, string_agg(arg || ' ', '' order by line_no) as args
from r group by 1, 2""")
def testcase_argument_text(spark, sf):
    return logs.argument_text(logs.testcase_args(views.testcase(spark, sf)))


@query("predlog_parse", views="predlog", sql="""--ctes
h as (select *, last_value(case when contains(line, 'Tree Depth:') then
          try_cast(regexp_extract(line, 'Tree Depth: ([0-9]+)', 1) as int) end ignore nulls)
        over (partition by file_id order by line_no rows between unbounded preceding and current row) as param from predlog)
select file_id, cast(line_no as bigint) as line_no, param, split_part(split_part(line, ',', 1), ':', 2) as class_name,
  split_part(split_part(line, ',', 2), ':', 2) as predicted
from h where contains(line, 'Class') and param is not null""")
def predlog_parse(spark, sf):
    return logs.parse_predictions(views.predlog(spark, sf), "exp1")


@query("predlog_parse_exp2", views="predlog", sql="""--ctes
h as (select *, last_value(case when contains(line, 'Depth:') then
          try_cast(regexp_extract(line, 'Depth: ([0-9]+)', 1) as int) end ignore nulls)
        over (partition by file_id order by line_no rows between unbounded preceding and current row) as param from predlog)
select file_id, cast(line_no as bigint) as line_no, param, 'x/a_' || cast(line_no as varchar) || '.dyndis' as sample_id,
  split_part(split_part(line, ',', 1), ':', 2) as class_name, split_part(split_part(line, ',', 2), ':', 2) as predicted
from h where contains(line, 'Class') and param is not null""")
def predlog_parse_exp2(spark, sf):
    """The log in its other form: 'Depth: 8' headers, 'x/a_1.dyndis: Class: A, Predicted: B' lines."""
    line = F.col("line")
    other = F.when(line.contains("Class"), F.concat(
        F.lit("x/a_"), F.col("line_no").cast("string"), F.lit(".dyndis: "),
        F.replace(F.replace(line, F.lit(":"), F.lit(": ")), F.lit(","), F.lit(", ")),
    )).otherwise(F.replace(line, F.lit("Tree "), F.lit("")))
    return logs.parse_predictions(views.predlog(spark, sf).withColumn("line", other), "exp2")


@query("incremental_skip", sql="""
select doc_id, text from documents where doc_id not in (select doc_id from labels)""")
def incremental_skip(spark, sf):
    return files.unprocessed(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"), "doc_id")


@query("labelled_only", sql="""
select doc_id, lang, source, n_chars from documents where doc_id in (select doc_id from labels)""")
def labelled_only(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return files.labelled_only(docs, table(spark, sf, "labels"), "doc_id")


@query("samples_labels", sql="""
select doc_id, lang, source, n_chars, quality, toxic from documents join labels using (doc_id)""")
def samples_labels(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return files.with_labels(docs, table(spark, sf, "labels"), "doc_id")


# ---- names and values ----------------------------------------------------------------------------------


@query("run_ok_filter", sql="""
select event_id, event_type || ' ' || props as output from events
where not regexp_matches(lower(event_type || ' ' || props), 'error|fail|unexpected|cannot')
  and not contains(event_type || ' ' || props, 'Segmentation fault')""")
def run_ok_filter(spark, sf):
    runs = table(spark, sf, "events").select("event_id", F.concat_ws(" ", "event_type", "props").alias("output"))
    return traces.successful_runs(runs, "output")


@query("base_name", sql="""
select page_id, regexp_extract(regexp_replace(replace(replace(url, '_', ''), '.com', ''), '[0-9]', '', 'g'), '[^/]*$', 0)
  as base_name from pages""")
def base_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", strings.base_name(F.col("url"), ".com").alias("base_name"))


@query("flip_sign", sql="""
select vec_id, cast(generate_subscripts(embedding, 1) as bigint) as pos, abs(cast(unnest(embedding) as double)) as up,
  -abs(cast(unnest(embedding) as double)) as down from embeddings""")
def flip_sign(spark, sf):
    x = F.col("embedding").cast("array<double>")
    pairs = F.arrays_zip(strings.flip_sign(x, "+").alias("up"), strings.flip_sign(x, "-").alias("down"))
    both = table(spark, sf, "embeddings").select("vec_id", F.posexplode(pairs).alias("p", "v"))
    return both.select("vec_id", (F.col("p") + 1).cast("bigint").alias("pos"), "v.up", "v.down")


@query("label_last", sql="""
select doc_id, string_split(source || ',' || lang, ',')[-1] as label from documents""")
def label_last(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", strings.last_label(F.concat_ws(",", "source", "lang")).alias("label")
    )


_PATH = """source || case lang when 'en' then '_test_a_test' when 'fr' then '_test' when 'de' then 'test' else '_run' end
  || cast(doc_id as {t}) || '.seq'"""


@query("label_stem", sql=f"""
select doc_id, p as path, case when contains(p, '_test') then regexp_extract(p, '^(.*)_test', 1)
  when contains(p, 'test') then substr(p, 1, length(p) - 1) end as stem
from (select doc_id, {_PATH.format(t='varchar')} as p from documents) q""")
def label_stem(spark, sf):
    paths = table(spark, sf, "documents").select("doc_id", F.expr(_PATH.format(t="string")).alias("path"))
    return paths.withColumn("stem", strings.label_stem(F.col("path")))
