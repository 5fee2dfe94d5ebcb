"""The pipeline's stages bring little to the driver, in few jobs, however many tasks or rounds there are."""

from __future__ import annotations

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import common, components, mixing, quality_classifier


def jobs_of(spark, work):
    """The result of work and the number of Spark jobs that it ran."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def plain_components(links):
    least = {x: x for ab in links for x in ab if ab[0] != ab[1]}
    while True:
        before = dict(least)
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
        if least == before:
            return least


def test_components_of_few_links_take_few_jobs(spark):
    rng = random.Random(11)
    codes = [rng.randrange(-2**63, 2**63) for _ in range(120)]
    links = [(rng.choice(codes), rng.choice(codes)) for _ in range(90)] + [(i, i + 1) for i in range(40)]
    df = spark.createDataFrame(links, "a long, b long")
    want = plain_components(links)
    rows, jobs = jobs_of(spark, lambda: components.components(df).collect())
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want)
    assert jobs <= 8, jobs
    # More links than one task may follow take rounds of shuffles, with the same result.
    rows = components.components(df, links_a_task=20).collect()
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want)


def test_components_without_links(spark):
    assert components.components(spark.createDataFrame([(4, 4)], "a long, b long")).count() == 0


def test_sums_of_tasks_are_added_up_in_tasks(spark):
    def count(batches):
        out = np.zeros(128, np.int64)
        for batch in batches:
            out += np.bincount(batch.column(0).to_numpy(), minlength=128)
        return out

    got = common.summed_numbers(spark.range(1000, numPartitions=7).select(F.pmod("id", F.lit(100)).alias("x")), count, 128)
    assert got.tolist() == [10] * 100 + [0] * 28
    none = spark.createDataFrame([], "x long")
    assert common.summed_numbers(none, count, 128).tolist() == [0] * 128


def test_training_brings_sums_to_the_driver_once(spark, monkeypatch):
    texts = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(30)), i % 2) for i in range(40)]
    df = spark.createDataFrame(texts, "doc_id long, text string, quality int")
    models, jobs = [], []
    for tasks in (2, 12):
        monkeypatch.setattr(quality_classifier, "FIT_TASKS", tasks)
        model, n = jobs_of(spark, lambda: quality_classifier.train(df.drop("quality"), df.drop("text")))
        models.append(model)
        jobs.append(n)
    assert jobs[0] == jobs[1], jobs
    assert (models[0]["vectors"] == models[1]["vectors"]).all()


def test_few_cells_are_raked_without_broadcasts(spark, monkeypatch):
    cells = [(s, l, 100 * i + 7 * j + 1) for i, s in enumerate("abcd") for j, l in enumerate(("en", "de", "fr"))]
    df = spark.createDataFrame(cells, "source string, lang string, tokens long").repartition(3)
    powers = {"source": 0.7, "lang": 0.8}

    def probabilities():
        rows = mixing.calibrated(mixing.raked(df, powers, {"lang": {"de": 0.3}})).collect()
        return {(r.source, r.lang): (r.weight, r.probability) for r in rows}

    monkeypatch.setattr(mixing, "CELLS_A_TASK", 2)
    shuffled = probabilities()
    monkeypatch.undo()
    monkeypatch.setattr(mixing, "few_or_joined", lambda df: pytest.fail("broadcast"))
    got = probabilities()
    assert set(got) == set(shuffled) and len(got) == len(cells)
    assert all(got[k] == pytest.approx(v, rel=1e-7) for k, v in shuffled.items())
