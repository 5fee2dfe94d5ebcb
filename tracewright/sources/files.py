"""Readers and writers for corpora kept as one file per sample and kind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions.rows import exploded
from tracewright.functions.strings import stem
from tracewright.plans.skew import lookup_join, salted_join
from tracewright.session import materialised


# ---- reading files -------------------------------------------------------------------------------------


def read_corpus(spark: SparkSession, path: str | list[str], extension: str) -> DataFrame:
    """(path, sample_id, content): every file of one extension, one row each."""
    return (
        spark.read.option("pathGlobFilter", f"*.{extension}")
        .text(path, wholetext=True)
        .select(
            F.col("_metadata.file_path").alias("path"),
            stem(F.col("_metadata.file_path")).alias("sample_id"),
            F.col("value").alias("content"),
        )
    )


def read_lines(spark: SparkSession, path: str | list[str], extension: str) -> DataFrame:
    """(path, sample_id, line_no, line) without ever holding a whole file in one row.

    For traces of any length: a file is read in blocks, whose lines follow each other in one task.  A line's
    number is its distance from the first line of its block plus the lines of the blocks before (one row per
    block), so lines are neither sorted nor shuffled.  They are written once, because blocks are cut anew when
    files are read again with other settings or executors.  Unlike line_scan it has no row for the empty text
    after a final newline, and it ends lines at \\n only.
    """
    raw = materialised(
        spark.read.option("pathGlobFilter", f"*.{extension}")
        .text(path, lineSep="\n")
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_at"),
            F.col("value").alias("line"),
        )
    )
    lines_before = F.sum("_n").over(W.partitionBy("path").orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    blocks = (
        raw.groupBy("path", "_block")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
        .select("path", "_block", (F.coalesce(lines_before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    )
    return lookup_join(raw, blocks, ["path", "_block"], ["path", "_at"]).select(
        "path",
        stem(F.col("path")).alias("sample_id"),
        (F.col("_at") + F.col("_shift")).cast("bigint").alias("line_no"),
        "line",
    )


def line_scan(files: DataFrame, content: str = "content") -> DataFrame:
    """Split content on newlines, empty lines kept, numbered from 1; other columns stay."""
    others = [c for c in files.columns if c != content]
    return exploded(files, others, F.split(content, "\n"), "line", "line_no")


# ---- content of feature files --------------------------------------------------------------------------


def vector_from_text(content: Column) -> Column:
    """'[a, b, ...]' to array<double>; null if any item is not a number."""
    items = F.split(F.substring(content, F.lit(2), F.greatest(F.length(content) - 2, F.lit(0))), ",")
    values = F.transform(items, lambda x: F.trim(x).try_cast("double"))
    return F.when(F.forall(values, lambda v: v.isNotNull()), values)


def quarantine(vectors: DataFrame, features: str = "features") -> tuple[DataFrame, DataFrame]:
    """Rows whose vector parsed, and rows whose vector did not."""
    return vectors.filter(F.col(features).isNotNull()), vectors.filter(F.col(features).isNull())


def scalar_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """One number per line, blank lines skipped; malformed lines give null."""
    lines = line_scan(files, content).filter(F.col("line") != "")
    return lines.withColumn("value", F.col("line").try_cast("double")).drop("line")


def nominal_vector(content: Column) -> Column:
    """Mixed list text to array<double>: digits and decimals as numbers, yes as 1, anything else as 0."""
    bare = F.regexp_replace(content, "[\n ]", "")
    items = F.split(F.substring(bare, F.lit(2), F.greatest(F.length(bare) - 2, F.lit(0))), ",")

    def value(item: Column) -> Column:
        text = F.replace(item, F.lit("'"), F.lit(""))
        return (
            F.when(text.rlike("^[0-9]+$"), text.try_cast("double"))
            .when(text.contains("."), text.try_cast("double"))
            .when(F.lower(text) == "yes", F.lit(1.0))
            .otherwise(F.lit(0.0))
        )

    return F.transform(items, value)


def nominal_vector_for_plots(content: Column) -> Column:
    """The looser reading used for projections: items containing yes are 1, containing no are 0, others stay."""
    bare = F.regexp_replace(content, "[\n ]", "")
    items = F.split(F.substring(bare, F.lit(2), F.greatest(F.length(bare) - 2, F.lit(0))), ",")
    return F.transform(
        items,
        lambda i: F.when(F.lower(i).contains("yes"), "1").when(F.lower(i).contains("no"), "0").otherwise(i),
    )


def symbol_prefix(content: Column, n: int = 0) -> Column:
    """Symbols of a sequence file as an array; the first n of them if 0 < n <= length."""
    bare = F.replace(content, F.lit("\n"), F.lit(""))
    if n:
        bare = F.substring(bare, 1, n)
    return F.filter(F.split(bare, ""), lambda c: c != "")


# ---- labels --------------------------------------------------------------------------------------------


def label_from_text(content: Column, clip: bool = False) -> Column:
    """First line of a label file; clip drops one trailing underscore."""
    first = F.split_part(content, F.lit("\n"), F.lit(1))
    return F.regexp_replace(first, "_$", "") if clip else first


def metadata_class(content: Column) -> Column:
    """Class name of a metadata file: the transforms joined by '_'; Ident if it says so anywhere."""
    tokens = _metadata_tokens(content)
    transforms = F.transform(
        F.filter(tokens, lambda t: t.contains("Transform")),
        lambda t: F.replace(F.split_part(t, F.lit("="), F.lit(2)), F.lit("'"), F.lit("")),
    )
    return F.when(content.contains("Ident"), "Ident").otherwise(F.array_join(transforms, "_"))


def metadata_params(content: Column) -> Column:
    """Options of a metadata file as map<string,string>; empty for Ident.  The last value of a key wins."""
    entries = F.transform(
        F.filter(
            _metadata_tokens(content),
            lambda t: t.contains("=") & ~t.contains("Transform") & ~t.contains("Functions") & ~t.contains("out"),
        ),
        lambda t: F.struct(
            F.regexp_replace(F.split_part(t, F.lit("="), F.lit(1)), "[-']", "").alias("key"),
            F.replace(F.split_part(t, F.lit("="), F.lit(2)), F.lit("'"), F.lit("")).alias("value"),
        ),
    )
    # Keep the last entry of each key, so that the map never sees a key twice.
    kept = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]),
    )
    none = F.array().cast("array<struct<key:string,value:string>>")
    return F.map_from_entries(F.when(content.contains("Ident"), none).otherwise(kept))


def _metadata_tokens(content: Column) -> Column:
    return F.split(F.substring(content, F.lit(2), F.greatest(F.length(content) - 2, F.lit(0))), ",")


def full_class_name(class_name: Column, params: Column) -> Column:
    """Class name followed by _key_value for every option in key order, without spaces."""
    parts = F.transform(
        F.array_sort(F.map_entries(params)), lambda e: F.concat(F.lit("_"), e["key"], F.lit("_"), e["value"])
    )
    return F.replace(F.concat(class_name, F.array_join(parts, "")), F.lit(" "), F.lit(""))


def labelled_only(samples: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Samples that have a label (semi join)."""
    return samples.join(labels.select(key), key, "left_semi")


def with_labels(
    samples: DataFrame, labels: DataFrame, key: str, row_id: Sequence[str] | None = None
) -> DataFrame:
    """Samples with the columns of their label; labels has one row per key.

    Give row_id (columns that tell apart the rows of a key) if samples has many rows per key.
    """
    return salted_join(samples, labels, [key], row_id) if row_id else samples.join(labels, key)


def unprocessed(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs that have no output yet (anti join)."""
    return inputs.join(done.select(key), key, "left_anti")


# ---- writing -------------------------------------------------------------------------------------------


def write_vectors(vectors: DataFrame, path: str) -> None:
    """One row per (sample, kind); reading one kind prunes the folders of the others."""
    vectors.write.mode("append").partitionBy("kind").parquet(path)


def read_vectors(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("kind") == kind)


def write_vector_text(vectors: DataFrame, path: str) -> None:
    """Vectors as list text, in folders by sample kind, for tools that read that form."""
    text = F.concat(F.lit("["), F.array_join(F.col("features").cast("array<string>"), ", "), F.lit("]"))
    vectors.select("sample_id", "kind", text.alias("content")).write.mode("append").partitionBy("kind").json(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Append predictions of an experiment."""
    predictions.write.mode("append").partitionBy("experiment").parquet(path)


def write_dictionary(entries: DataFrame, path: str, batch: str) -> None:
    """Store what a batch of documents adds to a dictionary (text.dictionary_entries); a repeated batch replaces its own."""
    entries.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(token, df, n): all batches of a stored dictionary added up; n is the number of all their documents."""
    stored = spark.read.parquet(path)
    n = stored.filter("token is null").agg(F.sum("df").alias("n")).scalar()
    tokens = stored.filter("token is not null").groupBy("token").agg(F.sum("df").alias("df"))
    return tokens.withColumn("n", n)


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """Token table (token, df), to be read back for later batches."""
    vocabulary.write.mode("overwrite").parquet(path)


def write_differences(differences: DataFrame, path: str) -> DataFrame:
    """Write difference lines and return how many non-empty differences each program has."""
    differences.write.mode("overwrite").parquet(path)
    return (
        differences.sparkSession.read.parquet(path)
        .groupBy("program")
        .agg(F.count_distinct("sample_id").alias("n_differences"))
    )


def write_confusion_csv(matrix: DataFrame, path: str) -> None:
    """Integer cells, comma-delimited, no header, in class order."""
    classes = [c for c in matrix.columns if c != "class_name"]
    (
        matrix.orderBy("class_name")
        .select(*[F.col(f"`{c}`").cast("int") for c in classes])
        .coalesce(1)  # a matrix of classes by classes
        .write.mode("overwrite")
        .csv(path)
    )
