"""Ingestion: links, transcript files of four shapes, segments, splits, filters and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from patraka.functions.numbers import bind
from patraka.functions.text import squeeze_ends
from patraka.functions.wer import half_even

LINKS = ("rec_url_gcp", "transcription_url_gcp", "metadata_url_gcp")
SEGMENT = "struct<start_time:double,end_time:double,text:string>"
TEXT_KEYS, START_KEYS, END_KEYS = ("text", "transcript", "sentence"), ("start", "start_time", "begin"), ("end", "end_time", "finish")


def rewrite_links(df: DataFrame, old: str, new: str, columns: tuple[str, ...] = LINKS) -> DataFrame:
    """Replace every occurrence of a prefix in those of ``columns`` that there are."""
    return df.withColumns({c: F.replace(F.col(c), F.lit(old), F.lit(new)) for c in columns if c in df.columns})


def local_paths(manifest: DataFrame, folder: str, audio: bool = True, transcripts: bool = True, metadata: bool = True) -> DataFrame:
    """Where a download of each recording's files goes; null for kinds that are not wanted."""

    def path(on: bool, kind: str, pattern: str) -> Column:
        return F.format_string(f"{folder}/{kind}/{pattern}", F.col("recording_id").cast("string")) if on else F.lit(None).cast("string")

    return manifest.withColumns(
        {
            "local_audio_path": path(audio, "audio", "%s_audio.wav"),
            "local_transcription_path": path(transcripts, "transcriptions", "%s_transcription.json"),
            "local_metadata_path": path(metadata, "metadata", "%s_metadata.json"),
        }
    )


def existing(df: DataFrame, files: DataFrame, column: str) -> DataFrame:
    """Rows whose file is in the listing ``files(path)``."""
    return df.join(files.select(F.col("path").alias(column)), column, "left_semi")


def segments(raw: Column) -> Column:
    """Segments of a transcript's JSON text; empty if it is malformed or any segment is.

    A list, an object with ``segments``, an object with ``text`` (taken as it is), or an object that is
    one segment itself. Of alternative keys the first that is present counts, even if its value is null.
    """
    none = F.array().cast(f"array<{SEGMENT}>")
    many = "array<variant>"

    def value(m: Column, keys: tuple[str, ...]) -> Column:
        out = F.lit(None)
        for k in reversed(keys):
            out = F.when(F.map_contains_key(m, k), F.element_at(m, k)).otherwise(out)
        return out

    def has(m: Column, keys: tuple[str, ...]) -> Column:
        return F.arrays_overlap(F.map_keys(m), F.array(*map(F.lit, keys)))

    def number(m: Column, keys: tuple[str, ...]) -> Column:
        v = value(m, keys)
        plain = F.try_variant_get(v, "$", "double")
        return F.when(has(m, keys), F.coalesce(plain, F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")))).otherwise(F.lit(0.0))

    def falsy(v: Column) -> Column:
        kind, said = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
        return F.coalesce(v.isNull() | F.is_variant_null(v) | (said == "") | ((kind != "STRING") & (said.isin("false", "[]", "{}") | (F.try_variant_get(v, "$", "double") == 0))), F.lit(True))

    def one(item: Column) -> Column:
        m = F.try_variant_get(item, "$", "map<string,variant>")
        return bind(
            m,
            lambda m: F.struct(
                F.coalesce(falsy(value(m, TEXT_KEYS)), F.lit(True)).alias("drop"),
                (m.isNull() | (~falsy(value(m, TEXT_KEYS)) & (number(m, START_KEYS).isNull() | number(m, END_KEYS).isNull()))).alias("bad"),
                F.struct(number(m, START_KEYS).alias("start_time"), number(m, END_KEYS).alias("end_time"), squeeze_ends(F.try_variant_get(value(m, TEXT_KEYS), "$", "string")).alias("text")).alias("segment"),
            ),
        )

    def listed(items: Column) -> Column:
        return bind(
            F.transform(items, one),
            lambda xs: F.when(F.exists(xs, lambda x: x["bad"]), none).otherwise(F.transform(F.filter(xs, lambda x: ~x["drop"]), lambda x: x["segment"]).cast(f"array<{SEGMENT}>")),
        )

    def whole(m: Column) -> Column:
        at = lambda keys: F.when(has(m, keys), F.try_variant_get(value(m, keys), "$", "double")).otherwise(F.lit(0.0))
        return F.array(F.struct(at(START_KEYS[:2]).alias("start_time"), at(END_KEYS[:2]).alias("end_time"), F.try_variant_get(F.element_at(m, "text"), "$", "string").alias("text"))).cast(f"array<{SEGMENT}>")

    def shaped(v: Column) -> Column:
        def of(m: Column) -> Column:
            return (
                F.when(F.map_contains_key(m, "segments"), listed(F.try_variant_get(F.element_at(m, "segments"), "$", many)))
                .when(F.map_contains_key(m, "text"), whole(m))
                .otherwise(listed(F.array(v)))
            )

        items = F.try_variant_get(v, "$", many)
        return F.when(items.isNotNull(), listed(items)).otherwise(bind(F.try_variant_get(v, "$", "map<string,variant>"), of))

    return F.coalesce(bind(F.try_parse_json(raw), shaped), none)


def valid_segments(df: DataFrame, column: str = "segments", low: float = 1.0, high: float = 30.0, rate: int = 16_000, total: str | None = None) -> DataFrame:
    """One row for each segment of ``low`` to ``high`` seconds with text, with its id (its place before filtering),
    file name and bounds in samples, clamped to ``total`` samples."""
    rows = df.select(*[c for c in df.columns if c != column], F.posexplode(column).alias("segment_id", "__s"))
    start, end = F.col("__s.start_time"), F.col("__s.end_time")
    first = F.greatest((start * rate).cast("long"), F.lit(0).cast("long"))
    last = (end * rate).cast("long")
    rows = rows.withColumns(
        {"text": squeeze_ends(F.col("__s.text")), "start_time": start, "end_time": end, "duration": end - start, "start_sample": first, "end_sample": F.least(last, F.col(total)) if total else last}
    ).drop("__s")
    kept = rows.where(F.col("duration").between(low, high) & (F.length("text") > 0) & (F.col("start_sample") < F.col("end_sample")))
    return kept.withColumn("audio_path", F.format_string("%s_seg%04d.wav", F.col("recording_id").cast("string"), F.col("segment_id")))


def without_outliers(df: DataFrame, low: float = 1.0, high: float = 25.0, least_text: int = 2, sigma: float | None = 3.0) -> DataFrame:
    """Rows within the bounds and, after those, within ``sigma`` population deviations of the mean duration."""
    kept = df.where(F.col("duration").between(low, high) & (F.length(squeeze_ends(F.col("text"))) >= least_text))
    if sigma is None:
        return kept
    stats = kept.agg(F.avg("duration").alias("__mean"), F.stddev_pop("duration").alias("__dev"))  # one row
    near = F.col("duration").between(F.greatest(F.lit(low), F.col("__mean") - sigma * F.col("__dev")), F.least(F.lit(high), F.col("__mean") + sigma * F.col("__dev")))
    return kept.join(F.broadcast(stats)).where(near).drop("__mean", "__dev")


def outlier_report(df: DataFrame, **bounds) -> DataFrame:
    """One row: ``n_before``, ``n_after``, ``n_removed`` and ``removed_pct`` (one digit) of ``without_outliers``."""
    after = without_outliers(df, **bounds).agg(F.count("*").alias("n_after"))
    row = df.agg(F.count("*").alias("n_before")).join(F.broadcast(after))  # one row each
    removed = F.col("n_before") - F.col("n_after")
    return row.select("n_before", "n_after", removed.alias("n_removed"), half_even(removed * 100.0 / F.greatest("n_before", F.lit(1)), 1).alias("removed_pct"))


def input_lengths(df: DataFrame, column: str = "input_features") -> DataFrame:
    """Add ``input_length``: entries of an array, or of the first one of an array of arrays; for batches of about the same length."""
    kind = df.schema[column].dataType
    inner = F.get(F.col(column), F.lit(0)) if isinstance(kind.elementType, ArrayType) else F.col(column)
    return df.withColumn("input_length", F.size(inner).cast("long"))


def dataset_statistics(df: DataFrame) -> DataFrame:
    """One row about ``df(user_id, duration)``: counts, total seconds and hours, mean, least and most."""
    total = F.sum("duration")
    return df.agg(
        F.count("*").alias("num_recordings"),
        F.countDistinct("user_id").alias("num_unique_users"),
        total.alias("total_duration_seconds"),
        half_even(total / 3600, 2).alias("total_duration_hours"),
        half_even(F.avg("duration"), 1).alias("avg_duration_seconds"),
        F.min("duration").alias("min_duration_seconds"),
        F.max("duration").alias("max_duration_seconds"),
    )
