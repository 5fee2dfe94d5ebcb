"""Collocations against their SQL on small corpora, where every wave matters."""

import random

import duckdb
import pytest

from tests.llm.test_operators import corpus
from tracewright.llm import collocations, queries

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def texts():
    rng = random.Random(7)
    passage = "Rare one meets rare two; again and again"
    out = [(r[1], r[2]) for r in corpus()]
    for i in range(150):
        words = [f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(40)]
        at = rng.randrange(40)
        words[at:at] = [rng.choice([passage, "PASSAGE\tnumber  three, ", "x.y!z", "été\x0bà la", "a a a a a a"])]
        out.append((" ".join(words), rng.choice(["en", "de", None, "und"])))
    return out


@pytest.mark.parametrize("least, top, waves", [(5, 30, (0.01, 0.1, 0.5)), (3, 2000, (0.3,)), (8, 3, ())])
def test_collocations_against_sql(spark, tmp_path, least, top, waves):
    rows = [(i, t, lang, f"p{i}", 1) for i, (t, lang) in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string, h int").repartition(5)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = collocations.collocations(df, least=least, top=top, waves=waves)
    assert found.columns == COLUMNS
    want = con.sql(queries.collocations_sql(least, top)).fetchall()
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and len(want) > 3


def test_collocations_without_candidates(spark):
    df = spark.createDataFrame([(None, "en"), ("", None), ("a b c", "en")], "text string, lang string")
    assert collocations.collocations(df).collect() == []
