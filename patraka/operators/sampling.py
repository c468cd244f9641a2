"""Reproducible samples and splits: order is that of an md5 of seed and key, alike on any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD = 4  # characters by which words of one count are grouped for their ranks
BANDS = (("Very Low", 0.0, 0.1), ("Low", 0.1, 0.3), ("Medium", 0.3, 0.5), ("High", 0.5, 0.8), ("Very High", 0.8, float("inf")))


def turn(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def sample(df: DataFrame, key: str, n: int = 50, seed: int = 42) -> DataFrame:
    """``n`` rows (all, if fewer) by the order of their keys' digests."""
    return df.orderBy(turn(F.col(key), seed), key).limit(n)


def band(wer: Column) -> Column:
    """Name of the half-open error-rate band; null for zero."""
    out = F.lit(None).cast("string")
    for name, low, high in BANDS:
        out = F.when((wer > low) & (wer <= high), name).otherwise(out)
    return out


def stratified(df: DataFrame, wer: str, key: str, n: int = 5, seed: int = 42) -> DataFrame:
    """At most ``n`` rows of each error-rate band, with the band as ``stratum``; rows without errors are left out."""
    # not as a condition, which would be carried below ``wer`` and compute it once more (with each use of its value, before)
    rows = df.withColumn("stratum", F.explode(F.filter(F.array(band(F.col(wer))), lambda b: b.isNotNull())))
    order = Window.partitionBy("stratum").orderBy(turn(F.col(key), seed), key)
    return rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def grouped_split(df: DataFrame, group: str, ratio: float = 0.9, seed: int = 42) -> DataFrame:
    """Add ``split``: 'train' for the first ``int(groups * ratio)`` groups by digest, 'val' for the rest.

    Ranks are exact without one task for all groups: counts of 4,096 digest ranges are added up first.
    """
    groups = df.select(F.col(group).alias("__g")).distinct().withColumn("__t", turn(F.col("__g"), seed))
    groups = groups.withColumn("__r", F.conv(F.substring("__t", 1, 3), 16, 10).cast("int"))
    ranges = groups.groupBy("__r").count()
    before = ranges.select(F.col("__r"), (F.sum("count").over(Window.orderBy("__r")) - F.col("count")).alias("__b"))
    total = ranges.agg(F.sum("count").alias("__n"))
    inside = Window.partitionBy("__r").orderBy("__t", "__g")
    ranked = groups.withColumn("__i", F.row_number().over(inside)).join(F.broadcast(before), "__r").join(F.broadcast(total))
    split = F.when(F.col("__b") + F.col("__i") <= F.floor(F.col("__n") * ratio), "train").otherwise("val")
    named = ranked.select("__g", split.alias("split"))
    return df.join(named, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def frequency_ranks(counted: DataFrame) -> DataFrame:
    """``(rank, word, n)`` of ``counted(word, n)``: ranks from 1, the most frequent first, ties by code point.

    Ranks are exact without one task for all words: words of one count that begin alike are counted first.
    """
    head = F.substring("word", 1, HEAD)
    groups = counted.groupBy("n", head.alias("__h")).agg(F.count("*").alias("__c"))
    before = groups.select(F.col("n").alias("__n"), "__h", (F.sum("__c").over(Window.orderBy(F.desc("n"), "__h")) - F.col("__c")).alias("__b"))
    inside = F.row_number().over(Window.partitionBy("n", "__h").orderBy("word"))
    own = counted.withColumn("__h", head).withColumn("__i", inside)
    met = own.join(before.withColumnRenamed("__h", "__g"), F.col("__h").eqNullSafe(F.col("__g")) & (F.col("n") == F.col("__n")))
    return met.select((F.col("__b") + F.col("__i")).alias("rank"), "word", "n")
