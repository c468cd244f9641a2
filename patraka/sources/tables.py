"""Manifests, transcript files, word lists, model outputs and listings as DataFrames; CSV sinks."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patraka.functions import text as T

MANIFEST = "recording_id string, user_id string, duration double, rec_url_gcp string, transcription_url_gcp string, metadata_url_gcp string"
#: Words that a word list's reader takes for missing values and then for the word ``nan``.
MISSING = ("", "NaN", "nan", "NA", "N/A", "n/a", "null", "NULL", "None", "<NA>", "#N/A", "-nan", "-NaN")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False, text: bool = False) -> DataFrame:
    """CSV with a header and RFC 4180 quotes; kinds are inferred only without a ``schema``, and not if all is ``text``."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", not text).csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Recordings; columns are matched by name, and what the file lacks is null."""
    found = spark.read.option("header", True).option("escape", '"').csv(path)
    fields = [f.split() for f in MANIFEST.split(", ")]
    return found.select(*((F.col(k).cast(kind) if k in found.columns else F.lit(None).cast(kind)).alias(k) for k, kind in fields), *(c for c in found.columns if c not in dict(fields)))


def transcript_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, recording_id, raw)``: one row for each JSON file, its text as a whole.

    The recording is the file's name without ``_transcription.json`` or ``.json``.
    """
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("__n"), F.col("value").alias("raw"))
    return rows.select("path", F.regexp_replace("__n", r"(_transcription)?\.json$", "").alias("recording_id"), "raw")


def ranked_words(spark: SparkSession, path: str) -> DataFrame:
    """``(rank, word)`` of a word list's first column, ranks from 1 by position.

    Positions are exact without one task for all: rows are counted by block of the file, blocks added up.
    """
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    word = F.col(f"`{rows.columns[0]}`")
    rows = rows.select(word.alias("word"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    blocks = rows.groupBy("f", "b").count()
    before = blocks.select("f", "b", (F.sum("count").over(Window.orderBy("f", "b")) - F.col("count")).alias("before"))  # one row a block
    inside = F.row_number().over(Window.partitionBy("f", "b").orderBy("i"))
    return rows.withColumn("n", inside).join(before, ["f", "b"]).select((F.col("before") + F.col("n")).alias("rank"), as_word(F.col("word")).alias("word"))


def as_word(word: Column) -> Column:
    return F.when(word.isNull() | word.isin(*MISSING), "nan").otherwise(word)


def model_outputs(spark: SparkSession, path: str, key: str = "segment_url_link", human: str = "Human") -> DataFrame:
    """A wide table of model outputs with trimmed column names and ``segment_idx`` by position."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    named = rows.toDF(*(c.strip() or f"_c{i}" for i, c in enumerate(rows.columns)))
    # multi-line files are read by one task each, in order
    return named.withColumn("segment_idx", F.monotonically_increasing_id()).select("segment_idx", *(c for c in (key, human) if c in named.columns), *(c for c in named.columns if c not in (key, human)))


def recordings(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """``(path, recording_id, length)`` of the files below ``path``, by path; contents are not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length")
    return rows.select("path", F.element_at(F.split("path", "/"), -2).alias("recording_id"), "length").orderBy("path")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with headers, written by the executors; arrays and structs as JSON."""
    flat = df.select(*(F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(f"`{c}`") for c, kind in df.dtypes))
    flat.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def export_csv(df: DataFrame, file: str, bom: bool = False) -> int:
    """One local file for spreadsheets, with a byte-order mark if wanted; rows pass the driver one partition at a time."""
    n = 0
    with Path(file).open("w", encoding="utf-8-sig" if bom else "utf-8", newline="") as out:
        writer = csv.writer(out)
        writer.writerow(df.columns)
        for row in df.toLocalIterator():
            writer.writerow(["" if x is None else x for x in row])
            n += 1
    return n


def non_empty(df: DataFrame, column: str = "text") -> DataFrame:
    """Rows whose normalized text is not empty."""
    return df.where(F.length(T.for_error_rate(F.col(column))) > 0)


def cached(df: DataFrame, path: str) -> DataFrame:
    """``df`` from the Parquet cache at ``path``, which is filled at the first call; a cache that was left half-written is made anew.

    The folder should be one that all executors share; delete it to compute ``df`` again.
    """
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
