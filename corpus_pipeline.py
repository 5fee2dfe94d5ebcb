"""Stages that turn the documents into training data: each works on all that the one before has kept.

quality classifier -> line dedup -> n-gram Jaccard join -> benchmark decontamination -> mixing to target weights.

Defined results: a row without text is scored like an empty one, has no lines, links with nothing, holds no benchmark
passage and costs no tokens, so only the first stage can reject it. A row without an id is never a copy of another.
Rows that repeat id and text are one document: all of them stay or go together. Texts are worked on whole, at any length.
Further columns are carried along whatever their names; without documents all stages give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontaminate, line_dedup, mixing, ngram_join, quality_classifier
from tracewright.llm.common import table
from tracewright.session import ensure_checkpoint_dir

ORACLE_SQL = None  # the first stage is a trained network


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of these documents, does not reject."""
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.scored(docs, model).where("score >= 0.5").select("row.*")


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier in the corpus; one that has no line left goes.

    n_chars is the length of the text that is left, unless no line was removed.
    """
    found = line_dedup.without_lines(docs).where("gone is null or size(gone) < n_lines")
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(
        F.char_length("kept").cast("long"))}
    return found.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that shares three quarters of its five-word shingles."""
    return ngram_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of the benchmark occurs."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with raked shares of sources, languages and topics, with the topic and probability of each document.

    Where the documents already have a column of such a name, in any case, it stays, and the new one is called
    mixing_topic or mixing_probability, with further underscores until no column has that name.
    """
    taken = {c.lower() for c in docs.columns}
    named = []
    for name in ("topic", "probability"):
        new = name if name not in taken else f"mixing_{name}"
        while new in taken:
            new += "_"
        named.append(F.col(name).alias(new))
    return mixing.mixed_documents(docs).where("kept").select("row.*", *named)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", new_lines),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing to target weights", to_target_weights),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on the documents; what stages pass on lies in the checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
