"""Queries on documents and on originals with their variants."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracewright.operators import diff, text
from tracewright.plans.catalog import query
from tracewright.plans.views import table
from tracewright.session import ensure_checkpoint_dir
from tracewright.sources import files



def _ws(name: str, source: str) -> str:
    return f"""{name} as (select doc_id, generate_subscripts(t, 1) as pos, unnest(t) as token
      from (select doc_id, list_filter_ws as t from
        (select doc_id, [x for x in string_split_regex(lower(text), '\\s+')
           if x <> '' and x not in (',', '%', '(', ')', ':', '$')] as list_filter_ws from {source}) q) q)"""


_WS = _ws("w", "documents")
_WORD = """w as (select doc_id, generate_subscripts(t, 1) as pos, unnest(t) as token
      from (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') as t from documents) q)"""
_TF = "tf as (select doc_id, token, cast(count(*) as bigint) as tf from w group by 1, 2)"
_DF = "df as (select token, cast(count(*) as bigint) as df, cast(sum(tf) as bigint) as tf_total from tf group by 1)"
_TOP = "v as (select token, df, row_number() over (order by df desc, token) as rank from df order by rank limit 128)"
_TOP_TF = """v as (select token, tf_total, df, row_number() over (order by token) as rank
      from (select * from df order by tf_total desc, token limit 1000) q)"""


def _weights(n_docs: str, tf: str = "tf") -> str:
    return f"""x as (select {tf}.doc_id, {tf}.token, v.rank,
        {tf}.tf * (ln(cast(1 + ({n_docs}) as double) / cast(1 + v.df as double)) + cast(1 as double)) as w
      from {tf} join v using (token)),
y as (select *, sqrt(sum(w * w) over (partition by doc_id)) as norm from x)
"""


def _tokens(spark, sf, tokeniser):
    return text.with_tokens(table(spark, sf, "documents"), "doc_id", "text", tokeniser)


@query("tokenise_ws", sql=f"with {_WS} select doc_id, cast(pos as bigint) as pos, token from w")
def tokenise_ws(spark, sf):
    return text.tokens_long(_tokens(spark, sf, text.whitespace_tokens))


@query("tokenise_word", sql=f"with {_WORD} select doc_id, cast(pos as bigint) as pos, token from w")
def tokenise_word(spark, sf):
    return text.tokens_long(_tokens(spark, sf, text.word_tokens))


@query("term_freq", sql=f"with {_WS}, {_TF} select * from tf")
def term_freq(spark, sf):
    return text.term_freq(_tokens(spark, sf, text.whitespace_tokens))


@query("doc_freq", sql=f"with {_WS}, {_TF}, {_DF} select token, df from df")
def doc_freq(spark, sf):
    return text.doc_freq(_tokens(spark, sf, text.whitespace_tokens))


@query("term_total", sql=f"with {_WORD}, {_TF}, {_DF} select token, tf_total, df from df")
def term_total(spark, sf):
    return text.term_total(_tokens(spark, sf, text.word_tokens))


@query("vocab_topk", sql=f"with {_WS}, {_TF}, {_DF}, {_TOP} select token, df, cast(rank as bigint) as rank from v")
def vocab_topk(spark, sf):
    return text.vocab_topk(text.doc_freq(_tokens(spark, sf, text.whitespace_tokens)))


@query("vocab_topk_tf",
       sql=f"with {_WORD}, {_TF}, {_DF}, {_TOP_TF} select token, tf_total, df, cast(rank as bigint) as rank from v")
def vocab_topk_tf(spark, sf):
    return text.vocab_topk_tf(text.term_total(_tokens(spark, sf, text.word_tokens)))


@query("tf_matrix", sql=f"""with {_WS}, {_TF}, {_DF}, {_TOP}
select tf.doc_id, v.token, cast(v.rank as bigint) as rank, v.df, tf.tf from tf join v using (token)""")
def tf_matrix(spark, sf):
    tokens = _tokens(spark, sf, text.whitespace_tokens)
    return text.tf_matrix(tokens, text.vocab_topk(text.doc_freq(tokens)), 128)


@query("tfidf_topk", sql=f"""with {_WS}, {_TF}, {_DF}, {_TOP}, {_weights('select count(*) from documents')}
select doc_id, token, cast(rank as bigint) as rank, round(w / norm, 6) as weight from y""")
def tfidf_topk(spark, sf):
    weights = text.tfidf_topk(table(spark, sf, "documents"), "doc_id", "text", 128)
    return weights.withColumn("weight", F.round("weight", 6))


@query("tfidf_vectors", sql=f"""with {_WS}, {_TF}, {_DF}, {_TOP}, {_weights('select count(*) from documents')},
g as (select d.doc_id, r.rank from documents d, range(1, 129) r(rank))
select g.doc_id, cast(g.rank as bigint) as rank, round(coalesce(w / norm, 0), 6) as weight
from g left join y on g.doc_id = y.doc_id and g.rank = y.rank""")
def tfidf_vectors(spark, sf):
    """Dense vectors, also of documents without any kept token."""
    docs = table(spark, sf, "documents")
    cells = text.tfidf_topk(docs, "doc_id", "text", 128)
    dense = text.densify(cells, 128, "weight", docs)
    return dense.select("doc_id", F.posexplode("features").alias("p", "x")).select(
        "doc_id", (F.col("p") + 1).cast("bigint").alias("rank"), F.round("x", 6).alias("weight")
    )


_UNSEEN = "(select cast(conv_id as varchar) || '_' || cast(turn as varchar) as doc_id, text from conversations)"


@query("dictionary_tfidf", sql=f"""with {_WS}, {_TF}, {_DF}, {_TOP}, {_ws('u', _UNSEEN)},
utf as (select doc_id, token, cast(count(*) as bigint) as tf from u group by 1, 2),
{_weights('select count(*) from documents', 'utf')}
select doc_id, token, cast(rank as bigint) as rank, round(w / norm, 6) as weight from y""")
def dictionary_tfidf(spark, sf):
    """A dictionary of all documents, stored in two batches and read again, weighs the turns of conversations."""
    path = f"{ensure_checkpoint_dir(spark)}/dictionary-{uuid.uuid4().hex}"
    docs, odd = table(spark, sf, "documents"), F.coalesce(F.pmod("doc_id", F.lit(2)), F.lit(0))
    for k in (0, 1):
        tokens = text.with_tokens(docs.filter(odd == k), "doc_id", "text", text.whitespace_tokens)
        files.write_dictionary(text.dictionary_entries(tokens), path, str(k))
    turns = table(spark, sf, "conversations").withColumn("id", F.concat_ws("_", "conv_id", "turn"))
    unseen = text.with_tokens(turns, "id", "text", text.whitespace_tokens)
    return text.tfidf_stored(unseen, files.read_dictionary(spark, path)).withColumn("weight", F.round("weight", 6))


# ---- originals and variants ----------------------------------------------------------------------------


def _samples(spark, sf):
    """Conversations as a corpus: turn 0 is the original <conv>, later turns are variants <conv>_<turn>."""
    name = F.concat(
        F.col("conv_id").cast("string"),
        F.when(F.col("turn") > 0, F.concat(F.lit("_"), F.col("turn").cast("string"))).otherwise(F.lit("")),
    )
    return diff.with_program(
        table(spark, sf, "conversations").select(name.alias("sample_id"), F.col("text").alias("content"))
    )


def _pairs(spark, sf):
    samples = _samples(spark, sf)
    return diff.variant_pairs(diff.originals(samples), diff.variants(samples), "sample_id")


_SAMPLES = """s as (select cast(conv_id as varchar) || case when turn > 0 then '_' || cast(turn as varchar) else '' end as sample_id,
        cast(conv_id as varchar) as program, turn, text as content from conversations),
p as (select v.program, v.sample_id, v.content, o.content as original
      from s v join s o on v.program = o.program and o.turn = 0 where v.turn > 0)"""
_LINES = """l as (select distinct program, sample_id, unnest(string_split(content, chr(10))) as line from p),
o as (select distinct program, unnest(string_split(content, chr(10))) as line from s where turn = 0),
d as (select * from l where not exists (select 1 from o where o.program = l.program and o.line = l.line))"""
_SYMBOLS = """c as (select program, sample_id, original, unnest(string_split(content, '')) as c,
        generate_subscripts(string_split(content, ''), 1) as pos from p),
d as (select program, sample_id, cast(pos as bigint) as pos,
        case when pos <= length(original) and substr(original, pos, 1) = c then '_' else c end as symbol
      from c where c <> '')"""


@query("originals_except", sql=f"""with {_SAMPLES}
select sample_id from s except select sample_id from s where contains(sample_id, '_')""")
def originals_except(spark, sf):
    return diff.originals(_samples(spark, sf)).select("sample_id")


@query("variant_pairs", sql=f"with {_SAMPLES} select * from p")
def variant_pairs(spark, sf):
    return _pairs(spark, sf)


@query("line_diff", sql=f"with {_SAMPLES}, {_LINES} select program, sample_id, line from d")
def line_diff(spark, sf):
    return diff.line_diff(_pairs(spark, sf))


@query("line_diff_steps", sql=f"with {_SAMPLES}, {_LINES} select program, sample_id, line from d")
def line_diff_steps(spark, sf):
    """The same from one row per line, the form of listings too long for one row."""
    lines = _samples(spark, sf).select("program", "sample_id", F.explode(F.split("content", "\n")).alias("line"))
    return diff.line_diff_steps(diff.originals(lines), diff.variants(lines), "sample_id")


@query("line_diff_counts", sql=f"""with {_SAMPLES}, {_LINES}
select program, cast(count(distinct sample_id) as bigint) as n_differences from d group by program""")
def line_diff_counts(spark, sf):
    """Variants per program whose difference is not empty."""
    with_lines = diff.line_diff_arrays(_pairs(spark, sf)).filter(F.size("lines") > 0)
    return with_lines.groupBy("program").agg(F.count_distinct("sample_id").alias("n_differences"))


@query("positional_diff", sql=f"with {_SAMPLES}, {_SYMBOLS} select program, sample_id, pos, symbol from d")
def positional_diff(spark, sf):
    return diff.positional_diff(_pairs(spark, sf))


@query("positional_diff_steps", sql=f"with {_SAMPLES}, {_SYMBOLS} select program, sample_id, pos, symbol from d")
def positional_diff_steps(spark, sf):
    """The same from one row per symbol, the form of traces too long for one row."""
    samples = _samples(spark, sf)
    chars = samples.select("program", "sample_id", F.posexplode(F.split("content", "")).alias("p", "symbol")).filter(
        "symbol <> ''"
    ).select("program", "sample_id", (F.col("p") + 1).cast("bigint").alias("pos"), "symbol")
    return diff.positional_diff_steps(diff.originals(chars), diff.variants(chars), "sample_id").select(
        "program", "sample_id", "pos", "symbol"
    )


_DIFF_DOCS = "select count(*) from p"


@query("diff_tfidf", sql=f"""with {_SAMPLES}, {_LINES},
w as (select sample_id as doc_id, unnest(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}_]{{2,}}')) as token from d),
{_TF}, {_DF}, {_TOP_TF}, {_weights(_DIFF_DOCS)}
select doc_id, token, cast(rank as bigint) as rank, round(w / norm, 6) as weight from y""")
def diff_tfidf(spark, sf):
    lines = diff.line_diff_arrays(_pairs(spark, sf))
    docs = lines.select(F.col("sample_id").alias("doc_id"), text.word_tokens(F.array_join("lines", "\n")).alias("tokens"))
    return text.tfidf_topk_tf(docs).withColumn("weight", F.round("weight", 6))


@query("positional_diff_tfidf", sql=f"""with {_SAMPLES}, {_SYMBOLS},
w as (select sample_id as doc_id, lower(symbol) as token from d where not regexp_matches(symbol, '^\\s*$')),
{_TF}, {_DF}, {_TOP_TF}, {_weights(_DIFF_DOCS)}
select doc_id, token, cast(rank as bigint) as rank, round(w / norm, 6) as weight from y""")
def positional_diff_tfidf(spark, sf):
    symbols = diff.positional_diff_arrays(_pairs(spark, sf))
    docs = symbols.select(
        F.col("sample_id").alias("doc_id"), text.symbol_tokens(F.array_join("symbols", "")).alias("tokens")
    )
    return text.tfidf_topk_tf(docs).withColumn("weight", F.round("weight", 6))


_NAMES = """n as (select replace(p_name, ' ', '-') || '-' || cast(p_partkey as varchar) as sample_id from part),
g as (select distinct replace(p_name, ' ', '-') as program from part
      union select distinct split_part(p_name, ' ', 1) from part)"""


@query("prefix_join", sql=f"""with {_NAMES}
select program, sample_id from g join n on starts_with(sample_id, program || '-')""")
def prefix_join(spark, sf):
    part = table(spark, sf, "part")
    samples = part.select(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string"))
                          .alias("sample_id"))
    programs = part.select(
        F.explode(F.array(F.replace("p_name", F.lit(" "), F.lit("-")), F.split_part("p_name", F.lit(" "), F.lit(1))))
        .alias("program")
    ).distinct()
    return diff.prefix_join(programs, samples, "-")


@query("mean_levenshtein", sql="""
with s as (select p_brand as g, p_name as s, count(*) as n from part group by 1, 2),
t as (select g, cast(sum(n) as bigint) as total from s group by 1),
d as (select a.g, cast(sum(a.n * b.n * levenshtein(a.s, b.s)) as bigint) as d from s a join s b on a.g = b.g and a.s < b.s group by 1)
select t.g as p_brand, total as n, case when total < 2 then cast(0 as double)
  else floor((coalesce(d, 0) * 200 + total * (total - 1) // 2) / (2 * (total * (total - 1) // 2))) / cast(100 as double)
  end as mean_distance from t left join d using (g)""")
def mean_levenshtein(spark, sf):
    return diff.mean_levenshtein(table(spark, sf, "part"), "p_brand", "p_name")
