"""The registered queries of the operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import (
    collocations,
    decontaminate,
    html_extract,
    language_id,
    line_dedup,
    mixing,
    ngram_join,
    periodic_runs,
    quality_classifier,
    quality_rules,
    secret_scan,
    substring_dedup,
    url_filter,
)
from tracewright.llm.common import remainder_of_id, table

QUERIES = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ---- 1: substring dedup --------------------------------------------------------------------------------


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.without_repeats(table(spark, sf_dir, "documents")))


SQL["op1_substring_dedup"] = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
places as (select doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) as g
  from (select doc_id, w, unnest(range(1, len(w) - 48)) as s from d where len(w) >= 50) q),
firsts as (select g, min(doc_id) as first from places group by g),
gone as (select doc_id, list(distinct p) as ps
  from (select doc_id, unnest(range(s, s + 50)) as p from places join firsts using (g) where first < doc_id) q
  group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(ps), 0) as bigint) as n_removed,
  sha256(array_to_string(case when ps is null then w
    else list_filter(w, lambda x, i: not list_contains(ps, i)) end, ' ')) as kept_sha256
from d left join gone on gone.doc_id = d.doc_id"""


# ---- 2: HTML extraction --------------------------------------------------------------------------------


@query
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = html_extract.extracted(pages.select("page_id", "url", "html"), html_extract.learn(pages))
    return found.select(F.col("row.page_id").alias("page_id"), F.col("row.url").alias("url"), F.col("main").alias("text"),
                        F.char_length("main").cast("long").alias("n_chars"))


# ---- 3: line dedup -------------------------------------------------------------------------------------


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_lines(table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines",
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


# For one edit: equal without the character at one place, or one text equal to the other without a character.
SQL["op3_line_dedup"] = rf"""
with d as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
lines as (select doc_id, i as no, ls[i] as line, regexp_matches(ls[i], '[^\x20\x09-\x0D]') as has_word
  from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from d) q),
texts as (select line, min(struct_pack(d := doc_id, n := no)) as first from lines where has_word group by line),
long as (select line, first, length(line) as n from texts where length(line) >= {line_dedup.LEAST}),
cut as (select line, first, n, i, left(line, i - 1) || substr(line, i + 1) as rest
  from (select line, first, n, unnest(range(1, n + 1)) as i from long) q),
near as (select a.line from cut a join cut b on a.i = b.i and a.rest = b.rest and b.line <> a.line where b.first < a.first
  union select a.line from cut a join long b on a.rest = b.line where b.first < a.first
  union select b.line from cut a join long b on a.rest = b.line where a.first < b.first),
marked as (select doc_id, no, l.line, has_word,
  has_word and (struct_pack(d := doc_id, n := no) <> t.first or x.line is not null) as gone
  from lines l left join texts t on t.line = l.line and has_word left join near x on x.line = l.line and has_word),
kept as (select doc_id, count(*) filter (has_word) as n_lines, count(*) filter (gone) as n_removed,
  coalesce(string_agg(line, chr(10) order by no) filter (not gone), '') as kept from marked group by doc_id)
select doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_removed, 0) as bigint) as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from documents left join kept using (doc_id)"""


# ---- 4: benchmark decontamination ----------------------------------------------------------------------


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digests(found)


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op4_benchmark_decontamination"] = f"""
with d as (select doc_id, {_BENCH_WORDS.format("coalesce(text, '')")} as w from documents),
items as (select coalesce(cast(item_id as varchar), 'null') as item, {_BENCH_WORDS.format('text')} as w from benchmark
  where text is not null),
grams as (select distinct item, least(10, len(w)) as m, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') as g
  from (select item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s from items where len(w) > 0) q),
lengths as (select distinct m from grams),
places as (select doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') as g
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as s from d, lengths where len(w) >= m) q),
hits as (select doc_id, m, s, item from places join grams using (m, g)),
covered as (select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(s, s + m)) as p from hits) q group by doc_id),
found as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as names
  from hits group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(names, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join found using (doc_id)"""


# ---- 5: language identification ------------------------------------------------------------------------


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(remainder_of_id("doc_id", 4) != 2))
    return language_id.predicted(docs.select("doc_id", "text"), model).select(
        F.col("row.doc_id").alias("doc_id"), (remainder_of_id("row.doc_id", 4) == 2).alias("held_out"), "lang_pred",
        "score")


# ---- 6: URL filter -------------------------------------------------------------------------------------


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = url_filter.judged(pages.select("page_id", "url"), url_filter.unigrams(pages))
    return found.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


# ---- 7: quality rules ----------------------------------------------------------------------------------


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def _rules_sql() -> str:
    terms = []
    for _, above, below, least, most in quality_rules.RULES:
        ratio = f"({above} / nullif(cast({below} as double), 0))"
        terms += [f"coalesce({ratio} >= {least}, false)"] if least is not None else []
        terms += [f"coalesce({ratio} <= {most}, false)"] if most is not None else []
    return " and ".join(terms)


_WS_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

SQL["op7_quality_rules"] = f"""
with d as (select doc_id, coalesce(text, '') as t, {_WS_WORDS.format('text')} as w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from documents),
places as (select doc_id, s, array_to_string(w[s:s + 4], ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - 3)) as s from d where len(w) >= 5) q),
twice as (select doc_id, g from places group by doc_id, g having count(*) > 1),
repeats as (select doc_id, count(distinct p) as n
  from (select doc_id, unnest(range(s, s + 5)) as p from places join twice using (doc_id, g)) q group by doc_id),
m as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
  length(t) - length(translate(t, '{quality_rules.SYMBOLS}', '')) as n_symbols, len(lines) as n_lines,
  len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words,
  len(list_filter(w, lambda x: upper(x) <> lower(x))) as n_alpha_words,
  len(list_filter(w, lambda x: upper(x) = x and lower(x) <> x and strlen(x) > 2)) as n_upper_words,
  1 + len(list_filter(w, lambda x: lower(trim(x, '{quality_rules.PUNCTUATION}')) in
    ({', '.join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))}))) as n_stop_words_and_one
  from d left join repeats using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
  cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, base_failed, not base_failed and {_rules_sql()} as kept
from b"""


# ---- 8: quality classifier -----------------------------------------------------------------------------


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(remainder_of_id("doc_id", 3) != 1)
    return quality_classifier.scored(docs.select("doc_id", "text"), quality_classifier.train(docs, labels)).select(
        F.col("row.doc_id").alias("doc_id"), (remainder_of_id("row.doc_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


# ---- 9: mixing sources to target weights ---------------------------------------------------------------


@query
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "tokens", "topic", F.round("weight", 6).alias("weight"),
        F.round("probability", 6).alias("probability"), "kept")


def _mixing_sql() -> str:
    topic = " ".join(f"when regexp_matches(coalesce(text, ''), '{p}') then '{t}'" for t, p in mixing.TOPICS)
    parts = [f"""docs as (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang,
  case {topic} else '{mixing.NO_TOPIC}' end as topic, cast(len({_WS_WORDS.format('text')}) as bigint) as tokens,
  cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 13)) as bigint) / {float(1 << 52)!r} as u
  from documents)""", """cells as (select source, lang, topic, sum(tokens) as tokens from docs group by all having sum(tokens) > 0)""",
             "w0 as (select *, cast(tokens as double) as weight from cells)"]
    for dim, power in mixing.POWERS.items():
        parts.append(f"""target_{dim} as (select {dim}, share / sum(share) over () as target from (select {dim},
  power(sum(tokens) / (select sum(tokens) from cells), {power}) as share from cells group by {dim}) q)""")
    at = 0
    for _ in range(12):  # the tables' margins are met to the last digit well before
        for dim in mixing.POWERS:
            parts.append(f"""w{at + 1} as (select w.* replace (weight * target / sum(weight) over (partition by w.{dim}) as weight)
  from w{at} w join target_{dim} t on t.{dim} = w.{dim})""")
            at += 1
    # As a document's probability grows with weight / tokens, the full cells are the first ones in that order.
    parts.append(f"""ranked as (select *, coalesce(sum(tokens) over before, 0) as full_tokens, coalesce(sum(weight) over after, 0) as open_weight
  from w{at} window before as (order by weight / tokens desc, source, lang, topic rows between unbounded preceding and 1 preceding),
  after as (order by weight / tokens desc, source, lang, topic rows between current row and unbounded following))""")
    parts.append(f"""scale as (select arg_min(({mixing.BUDGET} * (select sum(tokens) from cells) - full_tokens) / open_weight, full_tokens) as c
  from ranked
  where weight * ({mixing.BUDGET} * (select sum(tokens) from cells) - full_tokens) / open_weight < tokens)""")
    parts.append(f"fitted as (select source, lang, topic, weight, least(1.0, c * weight / tokens) as p from w{at}, scale)")
    return "with " + ",\n".join(parts) + """
select doc_id, tokens, topic, round(coalesce(weight, 0), 6) as weight, round(coalesce(p, 1), 6) as probability,
  u < coalesce(p, 1) as kept
from docs left join fitted using (source, lang, topic)"""


SQL["op9_source_mixing"] = _mixing_sql()


# ---- 10: n-gram Jaccard join ---------------------------------------------------------------------------


@query
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


SQL["op10_ngram_jaccard_join"] = rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w
  from documents),
sets as (select distinct doc_id, array_to_string(w[s:s + m - 1], ' ') as g
  from (select doc_id, w, least(5, len(w)) as m, unnest(range(1, len(w) - least(5, len(w)) + 2)) as s
    from d where len(w) > 0) q),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from sets a join sets b using (g)
  where a.doc_id <> b.doc_id group by 1, 2),
links as (select x, y from common join sizes a on a.doc_id = x join sizes b on b.doc_id = y
  where 100 * c >= 75 * (a.n + b.n - c)),
reach(doc_id, seen) as (select doc_id, doc_id from d union select r.doc_id, y from reach r join links on x = seen)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id
from (select doc_id, min(seen) as component_id from reach group by doc_id) r left join sizes using (doc_id)"""


# ---- 11: secret scans ----------------------------------------------------------------------------------


@query
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.digests(secret_scan.scanned(docs, secret_scan.model_of(docs)))


def _secrets_sql() -> str:
    s = secret_scan
    assign, size = s.ASSIGN.replace("'", "''"), len(s.ALPHABET)

    def places(name: str, source: str, pattern: str, text: str = "t", key: str = "doc_id", more: str = "") -> str:
        return f"""{name} as (select *, upto - ml as start from (
  select *, sum(gl + ml) over (partition by {key} order by i) as upto from (
    select * exclude (m, g), m[i] as found, length(m[i]) as ml, length(g[i]) as gl from (
      select *, unnest(range(1, len(m) + 1)) as i from (
        select *, regexp_extract_all({text}, '{pattern}') as m, string_split_regex({text}, '{pattern}') as g{more} from {source}) q) q) q) q)"""

    alphabet = s.ALPHABET
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
{places("a0", "d", assign, more=f", regexp_extract_all(t, '{assign}', 2) as v")},
{places("b0", "d", s.ACCESS)},
{places("c0", "d", s.HEX)},
base as (select doc_id, start, 0 as kind, upto from a0 where length(v[i]) >= {s.LEAST_VALUE}
  union all select doc_id, start, 1, upto from b0 union all select doc_id, start, 2, upto from c0),
sample as (select t from d order by md5(coalesce(cast(doc_id as varchar), 'null')), md5(t) limit {s.SAMPLE}),
vals as (select unnest(regexp_extract_all(t, '{assign}', 2)) as x from sample
  union all select unnest(regexp_extract_all(t, '{s.ACCESS}')) from sample
  union all select unnest(regexp_extract_all(t, '{s.HEX}')) from sample),
made as (select i, md5('sample ' || i) as h, to_base64(unhex(md5('sample ' || i))) as b from range({s.GENERATED}) r(i)),
rest as (select regexp_replace(regexp_replace(regexp_replace(t, '{assign}', ' ', 'g'), '{s.ACCESS}', ' ', 'g'),
  '{s.HEX}', ' ', 'g') as t from sample),
plain as (select unnest(regexp_extract_all(t, '{s.ALPHABET_CLASS}{{{s.LEAST_SAMPLE},}}')) as x from rest),
samples as (select x, true as random from vals where length(x) >= {s.LEAST_RANDOM}
  union all select case i % 4 when 0 then h when 1 then b when 2 then upper(translate(b, '+/=', '')) else translate(b, '+/', '-_') end,
    true from made
  union all select x, false from plain union all select upper(x), false from plain),
pairs as (select random, case when i = 1 then 0 else instr('{alphabet}', x[i - 1]) end as a, instr('{alphabet}', x[i]) as b
  from (select random, x, unnest(range(1, length(x) + 1)) as i from samples) q),
counts as (select a, b, count(*) filter (random) as r, count(*) filter (not random) as o from pairs where b > 0 group by a, b),
cells as (select k // {size} as a, k % {size} + 1 as b, coalesce(r, 0) as r, coalesce(o, 0) as o
  from range({(size + 1) * size}) e(k) left join counts on counts.a = k // {size} and counts.b = k % {size} + 1),
ratios as (select a, b, cast(floor(1000 * (ln((r + 0.5) / (sum(r) over w + {0.5 * size})) - ln((o + 0.5) / (sum(o) over w + {0.5 * size})))
  + 0.5) as bigint) as ratio from cells window w as (partition by a)),
cut as (select doc_id, string_split_regex(t, '{assign}') as p, regexp_extract_all(t, '{assign}') as m from d),
pieces as (select doc_id, j, piece, sum(length(piece) + ml) over (partition by doc_id order by j) - length(piece) - ml as base_at
  from (select doc_id, j, p[j] as piece, coalesce(length(m[j]), 0) as ml
    from (select *, unnest(range(1, len(p) + 1)) as j from cut) q) q),
{places("tokens", "pieces", f"{s.ALPHABET_CLASS}{{{s.LEAST},{s.LONGEST}}}", "piece", "doc_id, j")},
likely as (select doc_id, j, i, any_value(found) as found, any_value(start + base_at) as start, any_value(upto + base_at) as upto,
    sum(ratio) as total
  from (select *, unnest(range(1, ml + 1)) as c from tokens) q
  join ratios on a = (case when c = 1 then 0 else instr('{alphabet}', found[c - 1]) end) and b = instr('{alphabet}', found[c])
  group by doc_id, j, i),
spans as (select *, true as own from base
  union all select doc_id, start, 3, upto, false from likely where total >= {s.MARGIN} * length(found)
    and not regexp_matches(found, '{s.HEX}') and not regexp_matches(found, '{s.ACCESS}')),
named as (select *, case kind when 0 then 'assign' when 1 then 'access' when 2 then 'hex' else 'markov' end
  || ':' || cast(start as bigint) || ':' || cast(upto as bigint) as name from spans)
select d.doc_id, count(*) filter (own and kind = 0) as n_assign, count(*) filter (own and kind = 1) as n_access,
  count(*) filter (own and kind = 2) as n_hex,
  sha256(coalesce(string_agg(name, ',' order by start, kind) filter (own), '')) as base_sha256,
  coalesce(string_agg(name, ',' order by start, kind), '') as spans
from d left join named on named.doc_id = d.doc_id group by d.doc_id"""


SQL["op11_secret_scan"] = _secrets_sql()


# ---- 12: periodic run detection ------------------------------------------------------------------------


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = periodic_runs.stretched(F.col("text"), F.col("doc_id"))
    return periodic_runs.digests(periodic_runs.periodic_runs(docs, text))


# The CRC by half bytes; the table is that of the polynomial 0xEDB88320 (fixed values). A run is an island of equal six-word
# windows at one lag; one that lies in a run of a smaller period has that period too.
_HALF = ("[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, "
         "3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]")
SQL["op12_periodic_runs"] = rf"""
with ids as (select distinct doc_id from documents where doc_id is not null),
bytes as (select doc_id, list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''),
  lambda c: cast(ascii(c) as bigint))) as bs from ids),
crcs as (select doc_id, xor(list_reduce(bs, lambda a, b:
  xor({_HALF}[1 + (xor(xor({_HALF}[1 + (xor(a, b) & 15)], a >> 4), b >> 4) & 15)],
    xor({_HALF}[1 + (xor(a, b) & 15)], a >> 4) >> 4)), 4294967295) as h from bytes),
own as (select doc_id, {_WS_WORDS.format('text')} as w from documents),
cut as (select doc_id, w, len(w) as n, h, h // 10 as g from own left join crcs using (doc_id)),
bent as (select *, g % n as a, 1 + (n - g % n) // (3 + g % 8) as p from cut where h % 10 = 0 and n > 0),
d as (select doc_id, n, w from cut where h is null or h % 10 <> 0 or n = 0
  union all select doc_id, n, list_transform(range(0, n), lambda i: w[1 + case when i >= a then a + (i - a) % p else i end]) from bent),
grams as (select doc_id, n, i, md5(array_to_string(w[i + 1:i + 6], ' ')) as gram
  from (select doc_id, n, w, unnest(range(0, n - 5)) as i from d where n >= 12) q),
pairs as (select x.doc_id, x.i, y.i - x.i as q from grams x join grams y using (doc_id, gram)
  where y.i > x.i and 2 * (y.i - x.i) <= x.n),
islands as (select doc_id, q, min(i) as s, count(*) + 5 + q as len
  from (select *, i - row_number() over (partition by doc_id, q order by i) as island from pairs) z group by doc_id, q, island),
stretches as (select * from islands where len >= greatest(12, 2 * q)),
runs as (select x.* from stretches x where not exists (select 1 from stretches y
  where y.doc_id = x.doc_id and y.q < x.q and y.s <= x.s and y.s + y.len >= x.s + x.len)),
listed as (select doc_id, count(*) as n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) as names,
  first(struct_pack(s := s, len := len, q := q) order by len desc, s, q) as top from runs group by doc_id),
gone as (select distinct doc_id, unnest(range(s + q, s + len)) as i from runs),
kept as (select doc_id, string_agg(word, ' ' order by i) as text
  from (select doc_id, i, w[i + 1] as word from (select doc_id, w, unnest(range(0, n)) as i from d) z) z
  anti join gone using (doc_id, i) group by doc_id)
select d.doc_id, cast(coalesce(n_runs, 0) as bigint) as n_runs, cast(top.s as bigint) as start, cast(top.len as bigint) as length,
  cast(top.q as bigint) as period, cast(1000 * top.len // top.q as bigint) as exponent_milli,
  sha256(coalesce(names, '')) as runs_sha256, sha256(coalesce(text, '')) as collapsed_sha256
from d left join listed on listed.doc_id = d.doc_id left join kept on kept.doc_id = d.doc_id"""


# ---- 13: phrase collocation mining ---------------------------------------------------------------------


@query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def collocations_sql(least: int = collocations.LEAST, top: int = collocations.TOP, longest: int = collocations.LONGEST) -> str:
    return rf"""
with pieces as (select coalesce(lang, 'und') as lang,
  unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
cut as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
places as (select lang, m, w[s:s + m - 1] as w from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as s
  from (select lang, w, unnest(range(1, {longest + 1})) as m from cut) q) q),
f as (select lang, m, array_to_string(w, ' ') as phrase, count(*) as a from places group by all),
totals as (select lang, sum(a) as n from f where m = 1 group by lang),
cand as (select *, string_split(phrase, ' ') as w from f where m > 1 and a >= {least}),
parts as (select lang, array_to_string(w[s:s + k - 1], ' ') as phrase, max(a) as a from (
  select lang, w, a, k, unnest(range(1, m - k + 2)) as s from (select *, unnest(range(2, m)) as k from cand) q) q group by all),
cuts as (select c.lang, c.phrase, c.a, k, x.a as l, y.a as r, n,
    (1000::hugeint * c.a::hugeint * n::hugeint) // (x.a::hugeint * y.a::hugeint) as score
  from (select *, unnest(range(1, m)) as k from cand) c join totals using (lang)
  join f x on x.lang = c.lang and x.m = k and x.phrase = array_to_string(w[1:k], ' ')
  join f y on y.lang = c.lang and y.m = c.m - k and y.phrase = array_to_string(w[k + 1:], ' ')),
least as (select lang, phrase, a, n, arg_min(l, (score, k)) as l, arg_min(r, (score, k)) as r, min(score) as score
  from cuts group by lang, phrase, a, n),
kept as (select * from least where not exists (select 1 from parts p
  where p.lang = least.lang and p.phrase = least.phrase and p.a >= least.a))
select lang, row_number() over w as rank, phrase, a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n,
  cast(score as bigint) as score
from kept window w as (partition by lang order by score desc, a desc, phrase) qualify rank <= {top}"""


SQL["op13_phrase_collocations"] = collocations_sql()
