"""The pipeline on nulls, empty, long and repeated rows, clashing column names and empty tables."""

from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F

WORDS = "the sea and the old town lay quiet under a grey sky when we came down from the hills to buy bread".split()


def prose(rng: random.Random, n: int, a_line: int = 30) -> str:
    return "\n".join(" ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(a_line)) for _ in range(n // a_line))


def written(spark, folder, rows, labels, items):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ["topic", "Probability", "a.b", "row", "kept", "gone", "score", "id", "component_id", "tokens", "mixing_topic"]
    docs = docs.select("*", *(F.concat_ws("/", F.lit(c), "doc_id").alias(c) for c in names))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_rows_of_all_kinds(spark, tmp_path):
    rng = random.Random(5)
    passage = "one passage of the benchmark has at least ten words of its own"
    base = [prose(rng, 300) for _ in range(40)]
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(base)]
    rows += [(100, None, None, None, None), (101, "", "en", "web", 0), (None, base[0], "en", "web", 1), (None, None, None, None, None)]
    rows += [(102, base[1], "en", "web", 5), rows[2], rows[2]]
    rows += [(103, prose(rng, 300) + "\n" + passage, "de", "books", 9)]
    long = prose(rng, 250_000)
    rows += [(104, long, "en", "web", len(long)), (105, prose(rng, 100_000, 100_000), "en", "web", 1)]
    labels = [(i, 1, 0) for i in range(40)] + [(None, 0, 0), (3, None, 0)]
    docs = written(spark, tmp_path, rows, labels, [("x", passage), ("y", None), (None, ""), ("z", "hi")])
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        assert docs.columns == spark.read.parquet(f"{tmp_path}/documents.parquet").columns
    first, lines, one, clean = kept.values()
    assert len(first) == len(rows)  # all labels are 1
    assert len(lines) == len(rows) - 1 and 102 not in {r.doc_id for r in lines}  # an exact copy has no line left
    assert sum(r.doc_id == 2 for r in clean) == 3 and sum(r.doc_id is None for r in clean) == 2
    assert {r.doc_id for r in one} - {r.doc_id for r in clean} == {103}
    assert {r.doc_id: r.text for r in clean}[104] == long and all(r["a.b"] == f"a.b/{r.doc_id}" for r in clean if r.doc_id is not None)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[-2:] == ["mixing_topic_", "mixing_probability"] and 0 < out.count() <= len(clean)
    assert out.where("doc_id = 100").first().mixing_probability == 1.0  # no tokens, nothing to pay for


def test_without_documents_labels_or_items(spark, tmp_path):
    written(spark, f"{tmp_path}/a", [], [], [])
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 0
    written(spark, f"{tmp_path}/b", [(1, " ", "en", "web", 1), (2, None, None, None, 0)], [], [])
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/b").collect()} == {1, 2}
