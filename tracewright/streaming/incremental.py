"""New trace files, taken up as they arrive: files already processed are skipped by the stream's own log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.strings import stem
from tracewright.operators.traces import parse_trace_text


def follow_traces(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """(sample_id, content) of trace files under path, as a stream."""
    return (
        spark.readStream.format("text")
        .schema("value string")
        .option("wholetext", "true")
        .option("pathGlobFilter", f"*.{extension}")
        .load(path)
        .select(stem(F.col("_metadata.file_path")).alias("sample_id"), F.col("value").alias("content"))
    )


def process_new_traces(spark: SparkSession, path: str, extension: str, out: str, progress: str):
    """Parse the traces that came since the last call, append them to out, and stop.

    progress is a folder on shared storage that records which files are done.
    """
    parsed = parse_trace_text(follow_traces(spark, path, extension))
    query = (
        parsed.writeStream.format("parquet")
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return query
