"""Queries on feature vectors: selection, classification, trees, projections, clusters, Markov models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions.fixed_values import TREE_DEPTHS
from tracewright.operators import bayes, cluster, evaluate, growth, hmm, holdout, plans, reduce, split, tree
from tracewright.plans import views
from tracewright.plans.catalog import query
from tracewright.plans.ordering import row_numbers
from tracewright.plans.skew import lookup_join, salted_join
from tracewright.plans.views import table

K = 10


def vectors(spark, sf):
    """Embeddings as samples (sample_id, class_name, features)."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.col("label").cast("string").alias("class_name"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


def folded(spark, sf, k=K):
    return split.kfold_assign(vectors(spark, sf), "sample_id", k)


# ---- SQL building blocks -------------------------------------------------------------------------------

_X = """x as (select vec_id as sample_id, cast(label as varchar) as c, cast(generate_subscripts(embedding, 1) as bigint) as j,
        cast(unnest(embedding) as double) as x from embeddings)"""


def _folds(rows: str, key: str, k: int) -> str:
    return f"""fo as (select {key}, cast(case when i < (n % {k}) * (n // {k} + 1) then i // (n // {k} + 1)
        else n % {k} + (i - (n % {k}) * (n // {k} + 1)) // greatest(n // {k}, 1) end as int) as fold
      from (select {key}, row_number() over (order by {key}) - 1 as i, count(*) over () as n from {rows}) q)"""


_ANOVA = """sm as (select c, j, count(*) as n, sum(x) as s, sum(x * x) as ss from x group by 1, 2),
fs as (select j, sum(s * s / n) as b, sum(s) as s, sum(ss) as ss, sum(n) as n, count(*) as k from sm group by 1),
fr as (select j, case when ss - b > 1e-12 * ss then ((b - s * s / n) / (k - 1)) / ((ss - b) / (n - k))
  when b - s * s / n > 1e-12 * ss then cast('infinity' as double) end as f_score from fs),
an as (select j, f_score, cast(row_number() over (order by round(f_score, 9) desc nulls last, j desc) as bigint) as rank
  from fr)"""


# ---- splits --------------------------------------------------------------------------------------------


@query("kfold_assign", sql=f"with {_folds('documents', 'doc_id', 7)} select * from fo")
def kfold_assign(spark, sf):
    return split.kfold_assign(table(spark, sf, "documents").select("doc_id"), "doc_id", 7)


_PROGRAMS = """pg as (select program, row_number() over (order by program) - 1 as rank, count(*) over () as n
      from (select distinct o_custkey % 40 as program from orders) q)"""


def _programs(spark, sf):
    return table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("program")).distinct()


@query("program_holdout", sql=f"""with {_PROGRAMS}
select program, cast(rank as bigint) as rank, cast(case when rank // (n // 7) < 7 then rank // (n // 7) end as int) as cycle
from pg""")
def program_holdout(spark, sf):
    """40 programs in 7 cycles of 5: the last 5 are never tested."""
    return split.program_holdout(_programs(spark, sf), 7)


@query("train_except_test", sql=f"""with {_folds('embeddings', 'vec_id', 10)}
select vec_id as sample_id from embeddings except select vec_id from fo where fold = 9""")
def train_except_test(spark, sf):
    samples = folded(spark, sf)
    return split.train_except_test(samples.select("sample_id"), samples.filter("fold = 9"), "sample_id")


@query("split_sizes", sql=f"""with {_folds('embeddings', 'vec_id', 10)}
select fold, cast(label as varchar) as class_name, cast(count(*) as bigint) as n
from embeddings join fo using (vec_id) group by 1, 2""")
def split_sizes(spark, sf):
    return split.split_sizes(folded(spark, sf), ["fold", "class_name"])


# ---- selection -----------------------------------------------------------------------------------------


@query("anova_f", sql=f"with {_X}, {_ANOVA} select j, round(f_score, 6) as f_score, rank from an")
def anova_f(spark, sf):
    return reduce.anova_f(vectors(spark, sf)).withColumn("f_score", F.round("f_score", 6))


@query("anova_separating", sql=f"""
with x0 as (select vec_id as sample_id, cast(label as varchar) as c,
  list_concat([cast(label as double), 1.0, label + (case when vec_id % 100 = 0 then 0.5 else 0 end)],
    [cast(v as double) for v in embedding]) as vs from embeddings),
x as (select sample_id, c, j, vs[j] as x from (select *, unnest(range(1, len(vs) + 1)) as j from x0) q), {_ANOVA}
select cast(j as bigint) as j, f_score = 'infinity'::double as separates, f_score is null as flat, rank from an""")
def anova_separating(spark, sf):
    """A feature that is the label, a constant and a nearly separating one, in front of the vectors."""
    label = F.col("class_name").cast("double")
    nearly = label + F.when(F.col("sample_id") % 100 == 0, 0.5).otherwise(0.0)
    more = vectors(spark, sf).withColumn("features", F.concat(F.array(label, F.lit(1.0), nearly), "features"))
    scores = reduce.anova_f(more)
    return scores.select(F.col("j").cast("bigint").alias("j"), (F.col("f_score") == float("inf")).alias("separates"),
                         F.col("f_score").isNull().alias("flat"), "rank")


@query("select_kbest", sql=f"""with {_X}, {_ANOVA}
select sample_id, cast(row_number() over (partition by sample_id order by x.j) as bigint) as pos, x.x as value
from x join an on x.j = an.j and an.rank <= 10""")
def select_kbest(spark, sf):
    kept = reduce.select_kbest(vectors(spark, sf), 10)
    return kept.select("sample_id", F.posexplode_outer("features").alias("p", "value")).select(
        "sample_id", (F.col("p") + 1).cast("bigint").alias("pos"), "value"
    )


# ---- naive Bayes ---------------------------------------------------------------------------------------


def _nb(train: str, batches: str, extra: str = "", join: str = "", param: str = "cast(0 as int)", test: str = "fo.fold = tr.f") -> str:
    """Scores sc(f, param, sample_id, c, score) of the samples of each fold f under the model of the others."""
    return f"""bt as (select f from (values {batches}) t(f)),
tr as (select f, {param} as param, x.c, x.j, sum(abs(x.x)) as s from bt, x join fo on x.sample_id = fo.vec_id {join}
       where {train} {extra} group by 1, 2, 3, 4),
tt as (select f, param, c, sum(s) as s, count(*) as k from tr group by 1, 2, 3),
cn as (select f, cast(label as varchar) as c, count(*) as n from bt, embeddings join fo using (vec_id) where {train} group by 1, 2),
pr as (select f, c, ln(cast(n as double) / cast(sum(n) over (partition by f) as double)) as lp from cn),
sc as (select tr.f, tr.param, x.sample_id, tr.c, any_value(pr.lp) + sum(abs(x.x) * ln((tr.s + 1) / (tt.s + tt.k))) as score
       from tr join tt on tr.f = tt.f and tr.param = tt.param and tr.c = tt.c join pr on pr.f = tr.f and pr.c = tr.c
       join fo on {test} join x on x.sample_id = fo.vec_id and x.j = tr.j group by 1, 2, 3, 4),
be as (select f, param, sample_id, c as predicted from sc
       qualify row_number() over (partition by f, param, sample_id order by round(score, 9) desc, c) = 1)
"""


_FOLDS10 = ", ".join(f"({f})" for f in range(K))
_BASE = f"with {_X}, {_folds('embeddings', 'vec_id', K)}, "
_ACC = "cast(floor((200 * sum(case when {a} = {b} then 1 else 0 end) + count(*)) / (2 * count(*))) as bigint)"


def _held_out(spark, sf):
    samples = folded(spark, sf)
    return samples.filter("fold <> 9").drop("fold"), samples.filter("fold = 9").drop("fold")


@query("nb_predict", sql=_BASE + _nb("fold <> f", "(9)") + """
select sample_id, cast(label as varchar) as class_name, predicted from be join embeddings on vec_id = sample_id""")
def nb_predict(spark, sf):
    train, test = _held_out(spark, sf)
    return bayes.predictions(bayes.fit_predict(train, test)).select("sample_id", "class_name", "predicted")


@query("nb_predict_reduced", sql=_BASE.replace("with ", "with ", 1) + """
rx as (select * from x join fo on sample_id = vec_id where fold <> 9),
sm as (select c, j, count(*) as n, sum(x) as s, sum(x * x) as ss from rx group by 1, 2),
fs as (select j, sum(s * s / n) as b, sum(s) as s, sum(ss) as ss, sum(n) as n, count(*) as k from sm group by 1),
fr as (select j, ((b - s * s / n) / (k - 1)) / ((ss - b) / (n - k)) as f_score from fs),
an as (select j, row_number() over (order by round(f_score, 9) desc, j desc) as rank from fr),
""" + _nb("fold <> f", "(9)", extra="and an.rank <= 16", join="join an on an.j = x.j") + """
select sample_id, cast(label as varchar) as class_name, predicted from be join embeddings on vec_id = sample_id""")
def nb_predict_reduced(spark, sf):
    """With the 16 best features of the training part."""
    train, test = _held_out(spark, sf)
    return bayes.predictions(bayes.fit_predict(train, test, reduce_to=16)).select("sample_id", "class_name", "predicted")


@query("nb_predict_separate", sql=_BASE + """
px as (select *, fold = 9 as tested from x join fo on sample_id = vec_id),
sm as (select tested, c, j, count(*) as n, sum(x) as s, sum(x * x) as ss from px group by 1, 2, 3),
fs as (select tested, j, sum(s * s / n) as b, sum(s) as s, sum(ss) as ss, sum(n) as n, count(*) as k from sm group by 1, 2),
fr as (select tested, j, ((b - s * s / n) / (k - 1)) / ((ss - b) / (n - k)) as f_score from fs),
an as (select tested, j, row_number() over (partition by tested order by round(f_score, 9) desc, j desc) as rank from fr),
ps as (select tested, j, row_number() over (partition by tested order by j) as pos from an where rank <= 16),
rx as (select px.tested, px.sample_id, px.c, ps.pos, abs(px.x) as x from px join ps on ps.tested = px.tested and ps.j = px.j),
tr as (select c, pos, sum(x) as s from rx where not tested group by 1, 2),
tt as (select c, sum(s) as s, count(*) as k from tr group by 1),
cn as (select c, count(distinct sample_id) as n from rx where not tested group by 1),
pr as (select c, ln(cast(n as double) / cast(sum(n) over () as double)) as lp from cn),
sc as (select rx.sample_id, rx.c as class_name, tr.c, any_value(lp) + sum(rx.x * ln((tr.s + 1) / (tt.s + tt.k))) as score
       from rx join tr on tr.pos = rx.pos join tt on tt.c = tr.c join pr on pr.c = tr.c where rx.tested group by 1, 2, 3)
select sample_id, class_name, c as predicted from sc
qualify row_number() over (partition by sample_id order by round(score, 9) desc, c) = 1""")
def nb_predict_separate(spark, sf):
    """Training and test samples each with their own 16 best features."""
    train, test = _held_out(spark, sf)
    found = bayes.predictions(bayes.fit_predict(train, test, 16, "separate"))
    return found.select("sample_id", "class_name", "predicted")


@query("nb_proba", sql=_BASE + _nb("fold <> f", "(9)") + """
select sample_id, c as class_name, round(exp(score - m) / sum(exp(score - m)) over (partition by sample_id), 6) as probability
from (select *, max(score) over (partition by sample_id) as m from sc) q""")
def nb_proba(spark, sf):
    train, test = _held_out(spark, sf)
    rows = bayes.fit_predict(train, test).select(
        "sample_id", F.explode_outer(bayes.probabilities(F.col("scores"))).alias("p")
    )
    return rows.select("sample_id", "p.class_name", F.round("p.probability", 6).alias("probability"))


@query("nb_kfold", sql=_BASE + _nb("fold <> f", _FOLDS10) + """
select sample_id, cast(label as varchar) as class_name, f as fold, predicted from be join embeddings on vec_id = sample_id""")
def nb_kfold(spark, sf):
    return bayes.predictions(bayes.kfold_scores(folded(spark, sf), K)).select(
        "sample_id", "class_name", "fold", "predicted"
    )


@query("nb_kfold_accuracy", sql=_BASE + _nb("fold <> f", _FOLDS10) + f"""
select f as fold, {_ACC.format(a='cast(label as varchar)', b='predicted')} / cast(100 as double) as accuracy
from be join embeddings on vec_id = sample_id group by f""")
def nb_kfold_accuracy(spark, sf):
    found = bayes.predictions(bayes.kfold_scores(folded(spark, sf), K))
    return evaluate.fold_accuracy(found, ["fold"])


_SWEEP = _BASE + _ANOVA + ",\n" + _nb(
    "fold <> f", _FOLDS10, extra="and an.rank <= p.p", param="p.p",
    join="join an on an.j = x.j, (values (8), (16), (32), (64), (128)) p(p)",
)
_CURVE = f"""a as (select {{by}}, {_ACC.format(a='cls', b='predicted')} as h from {{rows}} group by all)"""


@query("nb_sweep_predictions", sql=_SWEEP + """
select sample_id, cast(label as varchar) as class_name, f as fold, param, predicted
from be join embeddings on vec_id = sample_id""")
def nb_sweep_predictions(spark, sf):
    return bayes.sweep(folded(spark, sf), K).select("sample_id", "class_name", "fold", "param", "predicted")


@query("nb_sweep", sql=_SWEEP + f""",
a as (select param, f, {_ACC.format(a='cast(label as varchar)', b='predicted')} as h
      from be join embeddings on vec_id = sample_id group by 1, 2)
select param, floor((2 * sum(h) + count(*)) / (2 * count(*))) / cast(100 as double) as mean_accuracy from a group by 1""")
def nb_sweep(spark, sf):
    return evaluate.sweep_curve(bayes.sweep(folded(spark, sf), K))


# ---- principal components ------------------------------------------------------------------------------

SQUARINGS = 36  # a power of 2^36: what the second axis still adds is beyond the last digit


def _axes_sql(k: int) -> str:
    """ax(g, p, j, v) and ev(g, p, l): the first k axes and their variances of each matrix cv(g, i, j, v).

    A matrix that is squared again and again, and scaled to trace 1, becomes the product of its first axis with itself; the
    axis is then taken out of the matrix, and the next one follows. An axis points where its largest number is positive.
    """
    ctes = ["""ma0 as (select g, list(r order by i) as m from (select g, i, list(v order by j) as r from cv group by g, i) q group by g)"""]
    for p in range(1, k + 1):
        ctes.append(f"""sq{p}(g, it, m) as (select g, 0, m from ma{p - 1} union all
  select g, it + 1, list_transform(s, lambda r: list_transform(r, lambda v: v / t)) from (
    select g, it, s, list_sum(list_transform(range(1, len(s) + 1), lambda i: s[i][i])) as t from (
      select g, it, list_transform(m, lambda r: list_transform(m, lambda q: list_inner_product(r, q))) as s
      from sq{p} where it < {SQUARINGS}) q) q),
co{p} as (select g, m[list_position(d, list_max(d))] as c from (
  select g, m, list_transform(range(1, len(m) + 1), lambda i: m[i][i]) as d from sq{p} where it = {SQUARINGS}) q),
un{p} as (select g, list_transform(c, lambda v: v * sign(c[list_position(a, list_max(a))]) / sqrt(list_inner_product(c, c))) as u
  from (select g, c, list_transform(c, lambda v: abs(v)) as a from co{p}) q),
ax{p} as (select g, u, m, list_inner_product(u, list_transform(m, lambda r: list_inner_product(r, u))) as l
  from un{p} join ma{p - 1} using (g)),
ma{p} as (select g, list_transform(range(1, len(u) + 1), lambda i: list_transform(range(1, len(u) + 1),
  lambda j: m[i][j] - l * u[i] * u[j])) as m from ax{p})""")
    every = " union all ".join(f"select g, {p} as p, u, l from ax{p}" for p in range(1, k + 1))
    ctes.append(f"us as ({every}), ev as (select g, p, l from us), "
                "ax as (select g, p, cast(generate_subscripts(u, 1) as bigint) as j, unnest(u) as v from us)")
    return ",\n".join(ctes)


_CENTRED = """x0 as (select sample_id, c, j, x - avg(x) over (partition by j) as x, 0 as g from x),
cv as (select 0 as g, a.j as i, b.j, sum(a.x * b.x) as v from x0 a join x0 b using (sample_id) group by 1, 2, 3)"""


def _components(k: int) -> str:
    """y(sample_id, c, j, x): the samples on their first k axes."""
    return f"""with recursive {_X}, {_CENTRED}, {_axes_sql(k)},
y as (select sample_id, c, p as j, sum(x0.x * v) as x from x0 join ax on ax.j = x0.j group by 1, 2, 3)"""


def _nb_components(k: int, params: list[int]) -> str:
    listed = ", ".join(f"({p})" for p in params)
    scores = _nb("fold <> f", _FOLDS10, extra="and x.j <= p.p", param="p.p", join=f", (values {listed}) p(p)")
    return f"{_components(k)}, {_folds('embeddings', 'vec_id', K)}, {scores.replace(', x join fo', ', y as x join fo').replace('join x on', 'join y as x on')}"


@query("nb_kfold_pca", sql=_nb_components(8, [8]) + """
select sample_id, cast(label as varchar) as class_name, f as fold, predicted from be join embeddings on vec_id = sample_id""")
def nb_kfold_pca(spark, sf):
    """On the first eight principal components of all samples."""
    found = bayes.sweep(folded(spark, sf), K, [8], reduction="pca")
    return found.select("sample_id", "class_name", "fold", "predicted")


@query("nb_sweep_pca", sql=_nb_components(16, [2, 4, 8, 16]) + f""",
a as (select param, f, {_ACC.format(a='cast(label as varchar)', b='predicted')} as h
      from be join embeddings on vec_id = sample_id group by 1, 2)
select param, floor((2 * sum(h) + count(*)) / (2 * count(*))) / cast(100 as double) as mean_accuracy from a group by 1""")
def nb_sweep_pca(spark, sf):
    return evaluate.sweep_curve(bayes.sweep(folded(spark, sf), K, [2, 4, 8, 16], reduction="pca"))


# ---- held-out programs ---------------------------------------------------------------------------------

COLUMNS = 16


def _holdout_samples(spark, sf):
    """Orders as samples of 40 programs: (sample_id, own, class_name)."""
    cycles = split.program_holdout(_programs(spark, sf), K).select("program", F.col("cycle").alias("own"))
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("sample_id"), (F.col("o_custkey") % 40).alias("program"),
        F.col("o_orderpriority").alias("class_name"),
    )
    return lookup_join(orders, cycles, ["program"], ["sample_id"]).select("sample_id", "own", "class_name")


def _opcode_counts(spark, sf):
    """Opcode counts of the traces."""
    return views.asm(spark, sf).groupBy("sample_id", F.col("opcode").alias("token")).agg(F.count(F.lit(1)).alias("tf"))


def _holdout_cells(spark, sf, samples):
    """Opcode counts of the samples' traces."""
    return _opcode_counts(spark, sf).join(samples.select("sample_id", "own", "class_name"), "sample_id")


def _rounded(weights):
    return weights.select("cycle", "split", "sample_id", "rank", F.round("weight", 6).alias("weight"))


def _batch_sql(vocabulary_split: str) -> str:
    return f"""--ctes
{_PROGRAMS},
sp as (select o_orderkey as sample_id, o_orderpriority as cls, case when rank // (n // 10) < 10 then rank // (n // 10) end as own
       from orders join pg on o_custkey % 40 = program),
m as (select sample_id, cls, cycle, case when own = cycle then 'test' else 'train' end as split
      from sp, (select unnest(range(10)) as cycle) t),
ce as (select sample_id, opcode as token, count(*) as tf from asm group by 1, 2),
nn as (select cycle, split, count(*) as n from m group by 1, 2),
df as (select cycle, split, token, count(*) as df from ce join m using (sample_id) group by 1, 2, 3),
vo as (select cycle, split, token, rank, ln(cast(1 + n as double) / cast(1 + df as double)) + cast(1 as double) as idf
       from (select *, row_number() over (partition by cycle, split order by df desc, token) as rank from df) q
       join nn using (cycle, split) where rank <= {COLUMNS}),
w0 as (select m.cycle, m.split, m.sample_id, m.cls, v.rank as j, ce.tf * v.idf as w
       from ce join m using (sample_id) join vo v on v.cycle = m.cycle and v.split = {vocabulary_split} and v.token = ce.token),
w1 as (select *, sqrt(sum(w * w) over (partition by cycle, split, sample_id)) as norm from w0)
"""


@query("tfidf_batch", views="asm", sql=_batch_sql("m.split") + """
select cast(cycle as int) as cycle, split, sample_id, cast(j as bigint) as rank, round(w / norm, 6) as weight from w1""")
def tfidf_batch(spark, sf):
    samples = _holdout_samples(spark, sf)
    cells = _holdout_cells(spark, sf, samples)
    return _rounded(holdout.tfidf_batch(cells, samples, K, COLUMNS, "separate"))


@query("tfidf_batch_train", views="asm", sql=_batch_sql("'train'") + """
select cast(cycle as int) as cycle, split, sample_id, cast(j as bigint) as rank, round(w / norm, 6) as weight from w1""")
def tfidf_batch_train(spark, sf):
    samples = _holdout_samples(spark, sf)
    cells = _holdout_cells(spark, sf, samples)
    return _rounded(holdout.tfidf_batch(cells, samples, K, COLUMNS, "train"))


def _holdout_nb_sql(vocabulary_split: str, params: list[int] | None) -> str:
    swept = "" if params is None else f""",
ga as (select s.cycle, s.cls, s.j, s.s, s.ss, n.n from ag s join cn n on n.cycle = s.cycle and n.cls = s.cls),
gs as (select cycle, j, sum(s * s / n) as b, sum(s) as s, sum(ss) as ss from ga group by 1, 2),
gn as (select cycle, sum(n) as n, count(*) as k from cn group by 1),
an as (select cycle, j, row_number() over (partition by cycle order by round(
         case when ss - b > 1e-12 * ss then ((b - s * s / n) / (k - 1)) / ((ss - b) / (n - k))
           when b - s * s / n > 1e-12 * ss then cast('infinity' as double) end, 9) desc nulls last, j desc) as rank
       from gs join gn using (cycle)),
pa as (select cycle, j, p as param from an, (values {", ".join(f"({p})" for p in params)}) t(p) where rank <= p)"""
    masked = "(select cycle, j, 0 as param from (select distinct cycle, j from ag) q)" if params is None else "pa"
    return _batch_sql(vocabulary_split) + f""",
cn as (select cycle, cls, count(*) as n from m where split = 'train' group by 1, 2),
pr as (select cycle, cls, ln(cast(n as double) / cast(sum(n) over (partition by cycle) as double)) as lp from cn),
w2 as (select *, w / norm as x from w1),
a0 as (select cycle, cls, j, sum(x) as s, sum(x * x) as ss from w2 where split = 'train' group by 1, 2, 3),
ag as (select g.cycle, g.cls, g.j, coalesce(s, 0) as s, coalesce(ss, 0) as ss
       from (select d.cycle, d.j, cn.cls from (select distinct cycle, j from a0) d join cn using (cycle)) g
       left join a0 using (cycle, cls, j)){swept},
tr as (select pm.param, ag.* from ag join {masked} pm on pm.cycle = ag.cycle and pm.j = ag.j),
tt as (select cycle, param, cls, sum(s) as s, count(*) as k from tr group by 1, 2, 3),
th as (select tr.cycle, tr.param, tr.cls, tr.j, ln((tr.s + 1) / (tt.s + tt.k)) as lt from tr join tt using (cycle, param, cls)),
te as (select cycle, sample_id, cls as truth from m where split = 'test'),
ba as (select te.cycle, te.sample_id, te.truth, tt.param, tt.cls, pr.lp from te join tt using (cycle) join pr using (cycle, cls)),
dt as (select w2.cycle, w2.sample_id, th.param, th.cls, sum(w2.x * th.lt) as d
       from w2 join th on th.cycle = w2.cycle and th.j = w2.j where w2.split = 'test' group by 1, 2, 3, 4),
be as (select ba.cycle, ba.sample_id, ba.truth, ba.param, ba.cls as predicted
       from ba left join dt using (cycle, sample_id, param, cls)
       qualify row_number() over (partition by ba.cycle, ba.sample_id, ba.param
         order by round(lp + coalesce(d, 0), 9) desc, ba.cls) = 1)
"""


@query("holdout_nb", views="asm", sql=_holdout_nb_sql("'train'", None) + """
select sample_id, truth as class_name, cast(cycle as int) as cycle, cast(param as int) as param, predicted from be""")
def holdout_nb(spark, sf):
    samples = _holdout_samples(spark, sf)
    return holdout.holdout_bayes(_opcode_counts(spark, sf), samples, K, COLUMNS)


@query("holdout_nb_separate", views="asm", sql=_holdout_nb_sql("m.split", None) + """
select sample_id, truth as class_name, cast(cycle as int) as cycle, cast(param as int) as param, predicted from be""")
def holdout_nb_separate(spark, sf):
    samples = _holdout_samples(spark, sf)
    return holdout.holdout_bayes(_opcode_counts(spark, sf), samples, K, COLUMNS, fit="separate")


@query("holdout_nb_curve", views="asm", sql=_holdout_nb_sql("'train'", [4, 8, 16]) + f""",
a as (select param, cycle, {_ACC.format(a='truth', b='predicted')} as h from be group by 1, 2)
select cast(param as int) as param, floor((2 * sum(h) + count(*)) / (2 * count(*))) / cast(100 as double) as mean_accuracy
from a group by 1""")
def holdout_nb_curve(spark, sf):
    samples = _holdout_samples(spark, sf)
    found = holdout.holdout_bayes(_opcode_counts(spark, sf), samples, K, COLUMNS, params=[4, 8, 16])
    return evaluate.sweep_curve(found, ["param"], "cycle")


_HOLDOUT_COMPONENTS = [2, 4]


# As above, with the places on the axes of each cycle's training samples as cells; zeros are cells here, too.
@query("holdout_nb_pca", views="asm", sql=_batch_sql("'train'") + f""",
w2 as (select *, w / norm as x from w1),
dn as (select m.cycle as g, m.split, m.sample_id, m.cls, cast(r.j as bigint) as j, coalesce(w2.x, 0) as x
  from m cross join range(1, {COLUMNS + 1}) r(j)
  left join w2 on w2.cycle = m.cycle and w2.split = m.split and w2.sample_id = m.sample_id and w2.j = r.j),
mn as (select g, j, avg(x) as mu from dn where split = 'train' group by 1, 2),
x0 as (select dn.* replace (x - mu as x) from dn join mn using (g, j)),
cv as (select g, a.j as i, b.j, sum(a.x * b.x) as v from x0 a join x0 b using (g, split, sample_id)
  where split = 'train' group by 1, 2, 3),
{_axes_sql(max(_HOLDOUT_COMPONENTS))},
y as (select x0.g as cycle, split, sample_id, cls, p as j, abs(sum(x0.x * v)) as x from x0 join ax on ax.g = x0.g and ax.j = x0.j
  group by 1, 2, 3, 4, 5),
pp as (select p as param from (values {", ".join(f"({p})" for p in _HOLDOUT_COMPONENTS)}) t(p)),
cn as (select cycle, cls, count(*) as n from m where split = 'train' group by 1, 2),
pr as (select cycle, cls, ln(cast(n as double) / cast(sum(n) over (partition by cycle) as double)) as lp from cn),
tr as (select cycle, param, cls, j, sum(x) as s from y join pp on j <= param where split = 'train' group by 1, 2, 3, 4),
tt as (select cycle, param, cls, sum(s) as s, count(*) as k from tr group by 1, 2, 3),
sc as (select y.cycle, y.sample_id, y.cls as truth, tr.param, tr.cls, any_value(lp) + sum(y.x * ln((tr.s + 1) / (tt.s + tt.k))) as score
  from y join tr on tr.cycle = y.cycle and tr.j = y.j join tt on tt.cycle = tr.cycle and tt.param = tr.param and tt.cls = tr.cls
  join pr on pr.cycle = tr.cycle and pr.cls = tr.cls where y.split = 'test' group by 1, 2, 3, 4, 5)
select sample_id, truth as class_name, cast(cycle as int) as cycle, cast(param as int) as param, cls as predicted from sc
qualify row_number() over (partition by cycle, sample_id, param order by round(score, 9) desc, cls) = 1""")
def holdout_nb_pca(spark, sf):
    samples = _holdout_samples(spark, sf)
    return holdout.holdout_components(_opcode_counts(spark, sf), samples, K, COLUMNS, _HOLDOUT_COMPONENTS)


@query("holdout_cart")
def holdout_cart(spark, sf):
    """A tree per cycle on the dense vectors of the held-out experiment."""
    samples = _holdout_samples(spark, sf)
    return holdout.holdout_trees(_opcode_counts(spark, sf), samples, K, COLUMNS, "gini", [4], max_bins=32)


# ---- trees ---------------------------------------------------------------------------------------------


def _best_sql(impurity: str) -> str:
    return f"""with {_X},
g as (select j, x, c, count(*) as n from x group by 1, 2, 3),
vals as (select distinct j, x from x),
cl as (select distinct c from x),
gr as (select v.j, v.x, cl.c, coalesce(g.n, 0) as n from vals v cross join cl left join g on g.j = v.j and g.x = v.x and g.c = cl.c),
cu as (select j, x, c, cast(sum(n) over (partition by j, c order by x) as double) as l, cast(sum(n) over (partition by j, c) as double) as t from gr),
nx as (select j, x, lead(x) over (partition by j order by x) as nxt from vals),
si as (select j, x, sum(l) as ln, sum(t - l) as rn, sum(t) as tn from cu group by 1, 2),
im as (select cu.j, cu.x, {impurity.format(p='(t / tn)')} as ip,
         case when any_value(rn) > 0 then {impurity.format(p='(l / ln)')} end as il,
         case when any_value(rn) > 0 then {impurity.format(p='((t - l) / rn)')} end as ir
       from cu join si on cu.j = si.j and cu.x = si.x group by 1, 2),
ga as (select im.j, (im.x + nx.nxt) / 2 as threshold, round(ip - (ln / tn) * il - (rn / tn) * ir, 9) as gain
       from im join si on im.j = si.j and im.x = si.x join nx on nx.j = im.j and nx.x = im.x where nx.nxt is not null)
select j, threshold, gain from ga qualify row_number() over (partition by j order by gain desc, threshold) = 1"""


@query("best_split_gini", sql=_best_sql("1 - sum({p} * {p})"))
def best_split_gini(spark, sf):
    return tree.best_splits(vectors(spark, sf), "gini")


@query("best_split_entropy", sql=_best_sql("-sum(case when {p} > 0 then {p} * log2(case when {p} > 0 then {p} else 1 end) else 0 end)"))
def best_split_entropy(spark, sf):
    return tree.best_splits(vectors(spark, sf), "entropy")


def _growth_sql(criterion: str, depths: list[int]) -> str:
    """pr(f, sample_id, class_name, param, predicted) from rw(f, sample_id, c, j, x, train): trees grown level by level.

    n<d> has the node of each row after d splits and b<d> the best splits of the nodes of level d, each threshold midway between
    two values of the node. w is the sum over classes of n * n or n * log2(n).
    """
    def w(n: str) -> str:
        return f"({n}) * ({n})" if criterion == "gini" else f"case when {n} > 0 then ({n}) * log2({n}) else 0 end"

    def impurity(total: str, n: str) -> str:
        return f"1 - ({total}) / (({n}) * ({n}))" if criterion == "gini" else f"log2({n}) - ({total}) / ({n})"

    parts, deepest = ["n0 as materialized (select distinct f, sample_id, c, train, cast(1 as bigint) as node from rw)"], max(depths)
    for d in range(deepest):
        parts += [f"""s{d} as (select rw.f, n.node, rw.j, rw.x, rw.c, cast(count(*) as double) as n from rw
        join n{d} n on n.f = rw.f and n.sample_id = rw.sample_id where n.train and n.node >= {1 << d} group by all),
l{d} as (select *, coalesce(sum(n) over (partition by f, node, j, c order by x rows between unbounded preceding and 1 preceding), 0) as l,
        sum(n) over (partition by f, node, j, c) as t from s{d}),
v{d} as (select f, node, j, x, sum(n) as n, sum({w('l + n')} - {w('l')}) as dl, sum({w('t - l - n')} - {w('t - l')}) as dr from l{d} group by all),
r{d} as (select f, node, j, x, lead(x) over o as nxt, sum(n) over o as ln, sum(dl) over o as sl, sum(dr) over o as sr,
        sum(n) over p as tn, sum(dl) over p as st from v{d} window o as (partition by f, node, j order by x), p as (partition by f, node, j)),
b{d} as materialized (select * from (select f, node, j, (x + nxt) / 2 as threshold, round({impurity('st', 'tn')}
          - (ln / tn) * ({impurity('sl', 'ln')}) - ((tn - ln) / tn) * ({impurity('st + sr', '(tn - ln)')}), 9) as gain
        from r{d} where nxt is not null) q
        qualify row_number() over (partition by f, node order by gain desc, j, threshold) = 1),
n{d + 1} as materialized (select n.f, n.sample_id, n.c, n.train, case when b.gain > 0 then 2 * n.node
          + case when rw.x <= b.threshold then 0 else 1 end else n.node end as node
        from n{d} n left join b{d} b on b.f = n.f and b.node = n.node
        left join rw on rw.f = n.f and rw.sample_id = n.sample_id and rw.j = b.j)"""]
    leaves = " union all ".join(
        f"""select {d} as param, n.f, n.sample_id, n.c as class_name, m.c as predicted from n{d} n
        join (select f, node, c from n{d} where train group by f, node, c
              qualify row_number() over (partition by f, node order by count(*) desc, c) = 1) m
        on m.f = n.f and m.node = n.node where not n.train""" for d in depths
    )
    return ",\n".join([*parts, f"pr as ({leaves})"]) + "\n"


def _grown_sql(tested: str, criterion: str, depths: list[int]) -> str:
    return f"""with {_X}, {_folds('embeddings', 'vec_id', K)}, bt as (select f from (values {tested}) t(f)),
rw as materialized (select bt.f, x.*, fo.fold <> bt.f as train from bt, x join fo on fo.vec_id = x.sample_id),
{_growth_sql(criterion, depths)}"""


@query("cart_predict", sql=_grown_sql("(9)", "gini", [8]) + "select sample_id, class_name, predicted from pr")
def cart_predict(spark, sf):
    train, test = _held_out(spark, sf)
    return growth.fit_predict(train, test, "gini", 8).select("sample_id", "class_name", "predicted")


def _cart_predictions(spark, sf):
    return growth.kfold_predictions(folded(spark, sf), K, "entropy", TREE_DEPTHS)


@query("cart_kfold", sql=_grown_sql(_FOLDS10, "entropy", TREE_DEPTHS) + """
select sample_id, class_name, cast(f as int) as fold, cast(param as int) as param, predicted from pr""")
def cart_kfold(spark, sf):
    """Ten folds and eleven depths from ten trees that grow together."""
    return _cart_predictions(spark, sf)


@query("cart_sweep", sql=_grown_sql(_FOLDS10, "entropy", TREE_DEPTHS) + f""",
a as (select param, f, {_ACC.format(a='class_name', b='predicted')} as h from pr group by 1, 2)
select cast(param as int) as param, floor((2 * sum(h) + count(*)) / (2 * count(*))) / cast(100 as double) as mean_accuracy
from a group by 1""")
def cart_sweep(spark, sf):
    return evaluate.sweep_curve(_cart_predictions(spark, sf))


def _cart_sql(folds: int, tested: str, criterion: str, depth: int) -> str:
    """Trees grown level by level: nodes n<d> of the training rows, best splits b<d>, nodes t<d> of the test rows.

    A threshold lies midway between a value and the next one among all training rows; a node that is pure or
    gains nothing stays as it is.
    """
    impurity = {
        "gini": "1 - sum({p} * {p})",
        "entropy": "-sum(case when {p} > 0 then {p} * log2(case when {p} > 0 then {p} else 1 end) else 0 end)",
    }[criterion]
    parts = [
        f"with {_X}, {_folds('embeddings', 'vec_id', folds)}",
        f"bt as (select f from (values {tested}) t(f))",
        "rw as (select bt.f, x.*, fo.fold <> bt.f as train from bt, x join fo on fo.vec_id = x.sample_id)",
        "va as (select f, j, x, lead(x) over (partition by f, j order by x) as nxt from "
        "(select distinct f, j, x from rw where train) q)",
        "n0 as (select distinct f, sample_id, c, train, cast(1 as bigint) as node from rw)",
    ]
    for d in range(depth):
        parts += [
            f"""s{d} as (select rw.f, n.node, rw.j, rw.x, rw.c, count(*) as n from rw
        join n{d} n on n.f = rw.f and n.sample_id = rw.sample_id where rw.train group by all)""",
            f"c{d} as (select f, node, c, count(*) as t from n{d} where train group by all)",
            # running class counts of a node at every value any training row has
            f"""g{d} as (select va.f, c.node, va.j, va.x, c.c, c.t,
          sum(coalesce(s.n, 0)) over (partition by va.f, c.node, va.j, c.c order by va.x) as l
        from va join c{d} c on c.f = va.f
        left join s{d} s on s.f = va.f and s.node = c.node and s.j = va.j and s.x = va.x and s.c = c.c)""",
            f"""h{d} as (select *, cast(sum(l) over w as double) as ln, cast(sum(t - l) over w as double) as rn,
          cast(sum(t) over w as double) as tn from g{d} window w as (partition by f, node, j, x))""",
            f"""i{d} as (select f, node, j, x, any_value(ln) as ln, any_value(rn) as rn, any_value(tn) as tn,
          {impurity.format(p='(t / tn)')} as ip, {impurity.format(p='(l / ln)')} as il,
          {impurity.format(p='((t - l) / rn)')} as ir
        from h{d} where ln > 0 and rn > 0 group by f, node, j, x)""",
            f"""b{d} as (select i.f, i.node, i.j, (i.x + va.nxt) / 2 as threshold,
          round(ip - (ln / tn) * il - (rn / tn) * ir, 9) as gain
        from i{d} i join va on va.f = i.f and va.j = i.j and va.x = i.x
        qualify row_number() over (partition by i.f, i.node order by gain desc, i.j, threshold) = 1)""",
            f"""n{d + 1} as (select n.f, n.sample_id, n.c, n.train, case when b.gain > 0 then 2 * n.node
          + case when rw.x <= b.threshold then 0 else 1 end else n.node end as node
        from n{d} n left join b{d} b on b.f = n.f and b.node = n.node
        left join rw on rw.f = n.f and rw.sample_id = n.sample_id and rw.j = b.j)""",
        ]
    leaves = " union all ".join(
        f"""select {d} as param, n.f, n.sample_id, n.c as class_name, m.c as predicted from n{d} n
        join (select f, node, c from n{d} where train group by f, node, c
              qualify row_number() over (partition by f, node order by count(*) desc, c) = 1) m
        on m.f = n.f and m.node = n.node where not n.train""" for d in range(1, depth + 1)
    )
    return ",\n".join(parts + [f"pr as ({leaves})"]) + "\n"


@query("cart_shallow", sql=_cart_sql(10, "(9)", "gini", 3) + """
select sample_id, class_name, predicted from pr where param = 3""")
def cart_shallow(spark, sf):
    """A tree of depth 3 with a threshold between any two values."""
    train, test = _held_out(spark, sf)
    return growth.fit_predict(train, test, "gini", 3, between="all").select("sample_id", "class_name", "predicted")


def _shallow(spark, sf):
    return growth.kfold_predictions(folded(spark, sf, 3), 3, "entropy", [1, 2, 3], between="all")


@query("cart_shallow_kfold", sql=_cart_sql(3, "(0), (1), (2)", "entropy", 3) + """
select sample_id, class_name, cast(f as int) as fold, cast(param as int) as param, predicted from pr""")
def cart_shallow_kfold(spark, sf):
    return _shallow(spark, sf)


@query("cart_shallow_sweep", sql=_cart_sql(3, "(0), (1), (2)", "entropy", 3) + f""",
a as (select param, f, {_ACC.format(a='class_name', b='predicted')} as h from pr group by 1, 2)
select cast(param as int) as param, floor((2 * sum(h) + count(*)) / (2 * count(*))) / cast(100 as double) as mean_accuracy
from a group by 1""")
def cart_shallow_sweep(spark, sf):
    return evaluate.sweep_curve(_shallow(spark, sf))


# ---- projections ---------------------------------------------------------------------------------------


@query("pca_project", sql=_components(8) + """
select sample_id, cast(j as bigint) as component, round(x, 6) as value from y""")
def pca_project(spark, sf):
    projected = reduce.pca_project(vectors(spark, sf), 8)
    return projected.select("sample_id", F.posexplode_outer("features").alias("p", "x")).select(
        "sample_id", (F.col("p") + 1).cast("bigint").alias("component"), F.round("x", 6).alias("value")
    )


@query("pca_explained", sql=_components(8) + """
select cast(p as bigint) as component, l / (select sum(v) from cv where i = j) as ratio from ev""")
def pca_explained(spark, sf):
    return reduce.pca_explained(vectors(spark, sf), 8)


@query("projection_2d", sql=_components(2) + """
select sample_id, sum(x) filter (j = 1) as x1, sum(x) filter (j = 2) as x2, c as class_name from y group by sample_id, c""")
def projection_2d(spark, sf):
    return reduce.projection(vectors(spark, sf), 2)


# ---- clusters ------------------------------------------------------------------------------------------


@query("cluster_assign")
def cluster_assign(spark, sf):
    return cluster.cluster_assign(vectors(spark, sf)).select("sample_id", "class_name", "cluster")


def _assigned(spark, sf):
    return table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 10).cast("int").alias("cluster"), F.col("label").cast("string").alias("class_name"),
        F.col("label").alias("class_idx"),
    )


@query("cluster_contingency", sql="""
select cast(vec_id % 10 as int) as cluster, cast(label as varchar) as class_name, cast(count(*) as bigint) as n
from embeddings group by 1, 2""")
def cluster_contingency(spark, sf):
    return cluster.cluster_contingency(_assigned(spark, sf))


@query("cluster_accuracy", sql="""
with m as (select cast(vec_id % 10 as int) as k, label, count(*) as n from embeddings group by 1, 2),
c as (select k, max(n) as top, sum(n) as n, sum(case when k = label then n else 0 end) as same from m group by 1)
select floor((200 * sum(same) + sum(n)) / (2 * sum(n))) / cast(100 as double) as raw_accuracy,
  floor((200 * sum(top) + sum(n)) / (2 * sum(n))) / cast(100 as double) as majority_accuracy from c""")
def cluster_accuracy(spark, sf):
    return cluster.cluster_accuracy(_assigned(spark, sf))


# ---- Markov models and plans ---------------------------------------------------------------------------


@query("hmm_similarity")
def hmm_similarity(spark, sf):
    """Event types of each user in time order, one model per market segment of the users."""
    steps = row_numbers(table(spark, sf, "events").select("user_id", "ts", "event_type"), ["user_id"], ["ts"], "step")
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("class_name"))
    symbols = salted_join(steps, users, ["user_id"], ["user_id", "step"]).select(
        F.col("user_id").alias("sample_id"), "class_name", "step", F.col("event_type").alias("symbol")
    )
    return hmm.hmm_similarity(symbols, n_iter=3)


@query("label_plans", sql="""
with e as (select distinct event_type as x from events),
p as (select a.x || '_' || b.x || '_' || c.x as steps from e a, e b, e c where a.x <> b.x and a.x <> c.x and b.x <> c.x)
select n_name as program, steps, case when n_nationkey % 2 = 0 then steps else r_name || '_' || steps end as label
from nation join region on n_regionkey = r_regionkey, p
union all select n_name, '', 'Ident' from nation""")
def label_plans(spark, sf):
    programs = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(
        F.col("n_name").alias("program"),
        F.when(F.col("n_nationkey") % 2 == 0, F.lit("")).otherwise(F.col("r_name")).alias("label"),
    )
    return plans.label_plans(programs, table(spark, sf, "events").select("event_type"), 3)
