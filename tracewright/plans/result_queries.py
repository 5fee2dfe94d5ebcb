"""Queries on predictions: trends, confusion matrices, accuracies, classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import strings
from tracewright.operators import evaluate
from tracewright.plans import views
from tracewright.plans.catalog import query
from tracewright.plans.views import CLASSES, table

_TREND = "t as (select param, class_name, predicted, cast(count(*) as bigint) as n from pred group by 1, 2, 3)"


@query("trend_counts", views="pred", sql=f"--ctes\n{_TREND}\nselect * from t")
def trend_counts(spark, sf):
    return evaluate.trend_counts(views.pred(spark, sf))


@query("trend_merge", views="pred", sql="select class_name, predicted, cast(count(*) as bigint) as n from pred group by 1, 2")
def trend_merge(spark, sf):
    """Trends of the small and of the large parameters, added up."""
    found = views.pred(spark, sf)
    return evaluate.trend_merge(
        evaluate.trend_counts(found.filter("param <= 4"), []), evaluate.trend_counts(found.filter("param > 4"), []), []
    )


_CELLS = """k as (select distinct param, class_name as c from t union select distinct param, predicted from t),
l as (select a.param, a.c as class_name, b.c as predicted, coalesce(t.n, 0) as n
      from k a join k b on a.param = b.param left join t on t.param = a.param and t.class_name = a.c and t.predicted = b.c)"""


@query("confusion_long", views="pred", sql=f"--ctes\n{_TREND},\n{_CELLS}\nselect * from l")
def confusion_long(spark, sf):
    return evaluate.confusion_long(evaluate.trend_counts(views.pred(spark, sf)))


@query("confusion_pivot", views="pred", sql=f"--ctes\n{_TREND},\n{_CELLS}\nselect param, class_name, " + ", ".join(
    f"cast(sum(case when predicted = '{c}' then n else 0 end) as bigint) as {c}" for c in sorted(CLASSES.split(","))
) + " from l group by 1, 2")
def confusion_pivot(spark, sf):
    """A matrix for each parameter."""
    trends = evaluate.trend_counts(views.pred(spark, sf))
    return evaluate.confusion_pivot(evaluate.confusion_long(trends), sorted(CLASSES.split(",")), ["param"])


@query("trends_ordered", views="pred", sql=f"""--ctes\n{_TREND}
select *, cast(row_number() over (order by param, n desc, class_name, predicted) as bigint) as rank from t""")
def trends_ordered(spark, sf):
    """The trends in the operator's own order, numbered as they come."""
    ordered = evaluate.trends_ordered(evaluate.trend_counts(views.pred(spark, sf)))
    listed = ordered.coalesce(1).select("*", (F.monotonically_increasing_id() + 1).alias("rank"))  # 25 rows a parameter
    return listed


@query("confusion_labels", sql="""
with t as (select cast(quality as varchar) as c, cast(toxic as varchar) as p, count(*) as n from labels group by 1, 2),
k as (select c as x from t union select p from t)
select a.x as class_name, b.x as predicted, cast(coalesce(t.n, 0) as bigint) as n
from k a cross join k b left join t on t.c = a.x and t.p = b.x""")
def confusion_labels(spark, sf):
    """Quality against toxicity."""
    found = table(spark, sf, "labels").select(
        F.col("quality").cast("string").alias("class_name"), F.col("toxic").cast("string").alias("predicted")
    )
    return evaluate.confusion_long(evaluate.trend_counts(found, []), [])


_MISMATCH = """mm as (select class_name, predicted, cast(sum(abs((length(class_name) - length(replace(class_name, x, '')))
        - (length(predicted) - length(replace(predicted, x, ''))))) as bigint) as mismatch
      from (select class_name, predicted, unnest(list_distinct(string_split(predicted, ''))) as x
            from (select distinct class_name, predicted from pred) q) q group by 1, 2)"""


@query("letter_mismatch", views="pred", sql=f"--ctes\n{_MISMATCH}\nselect * from mm")
def letter_mismatch(spark, sf):
    names = views.pred(spark, sf).select("class_name", "predicted").distinct()
    return names.withColumn("mismatch", strings.letter_mismatch(F.col("class_name"), F.col("predicted")))


@query("accuracy_modes", views="pred", sql=f"""--ctes
{_TREND},
{_MISMATCH},
f as (select t.*, t.class_name = t.predicted as same, mismatch <= 1 as near,
        contains(t.class_name, 'Ji') and contains(t.predicted, 'Ji') as jit from t join mm using (class_name, predicted)),
s as (select param, 'strict' as mode, sum(case when same then n else 0 end) as correct, sum(n) as total from f group by 1
  union all select param, 'viceversa', sum(case when same or near then n else 0 end), sum(n) from f group by 1
  union all select param, 'jit', sum(case when same or jit then n else 0 end), sum(n) from f group by 1
  union all select param, 'both', sum(case when same or near or jit then n else 0 end), sum(n) from f group by 1)
select param, mode, cast(correct as bigint) as correct, cast(total as bigint) as total,
  floor((cast(correct as bigint) * 20000 + cast(total as bigint)) / (2 * cast(total as bigint))) / cast(100 as double) as accuracy
from s""")
def accuracy_modes(spark, sf):
    return evaluate.accuracy_modes(evaluate.trend_counts(views.pred(spark, sf)))


_HUNDREDTHS = "cast(floor((200 * sum(case when class_name = predicted then 1 else 0 end) + count(*)) / (2 * count(*))) as bigint)"


@query("fold_accuracy", views="pred", sql=f"""
select param, fold, {_HUNDREDTHS} / cast(100 as double) as accuracy from pred group by 1, 2""")
def fold_accuracy(spark, sf):
    return evaluate.fold_accuracy(views.pred(spark, sf))


@query("sweep_curve", views="pred", sql=f"""--ctes
a as (select param, fold, {_HUNDREDTHS} as h from pred group by 1, 2)
select param, floor((2 * sum(h) + count(*)) / (2 * count(*))) / cast(100 as double) as mean_accuracy from a group by 1""")
def sweep_curve(spark, sf):
    return evaluate.sweep_curve(views.pred(spark, sf))


# ---- classes -------------------------------------------------------------------------------------------


def _class_samples(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("class_name"), "lang")


@query("class_index", sql="""
with r as (select source as class_name, case when lang = 'en' then 0 else 1 end as phase, doc_id from documents),
f as (select class_name, phase, min(doc_id) as d from r
      group by 1, 2 qualify row_number() over (partition by class_name order by phase) = 1),
i as (select class_name, row_number() over (order by phase, d) - 1 as class_idx from f)
select doc_id as sample_id, source as class_name, cast(class_idx as bigint) as class_idx
from documents join i on i.class_name = source""")
def class_index(spark, sf):
    """Classes of the English documents first, then those only the others have."""
    samples = _class_samples(spark, sf)
    classes = evaluate.class_index(samples.filter("lang = 'en'"), samples.filter("lang <> 'en'"))
    return evaluate.with_class_index(samples, classes).select("sample_id", "class_name", "class_idx")


@query("classes_distinct", sql="select distinct source as class_name from documents")
def classes_distinct(spark, sf):
    return _class_samples(spark, sf).select("class_name").distinct()


@query("class_counts", sql="select source as class_name, cast(count(*) as bigint) as n from documents group by 1")
def class_counts(spark, sf):
    return _class_samples(spark, sf).groupBy("class_name").agg(F.count(F.lit(1)).alias("n"))


@query("class_letters", sql="""
select class_name, cast(rank as bigint) as rank, upper(chr(cast(rank + 96 as int))) as letter
from (select x as class_name, row_number() over (order by x) as rank from (select distinct source as x from documents) q) q""")
def class_letters(spark, sf):
    return evaluate.class_letters(_class_samples(spark, sf))


@query("class_alphabet", sql="""
select c_mktsegment as class_name, event_type as symbol, cast(count(*) as bigint) as n
from events join customer on c_custkey = user_id group by 1, 2""")
def class_alphabet(spark, sf):
    # Events are summed per user and symbol before the join, so that a busy user is one row per symbol.
    per_user = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("class_name"))
    return evaluate.class_alphabet(
        per_user.join(users, "user_id").withColumnRenamed("event_type", "symbol"), weight="n"
    )
