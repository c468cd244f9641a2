"""Transforms of streams of transcripts.

Number and English-word cleanup and spelling are projections, so that they run on ``readStream`` frames as
they are; error rates by time are windowed aggregations with a watermark.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patraka.functions import codeswitch, wer
from patraka.functions.text import tokens
from patraka.operators import spelling


def cleaned(stream: DataFrame, text: str, keep_idioms: bool = True) -> DataFrame:
    """Numbers to digits, then English tagging; stateless."""
    return codeswitch.cleanup(stream, text, keep_idioms)


def classified(stream: DataFrame, word: str = "word", dictionary: Iterable[str] | None = None) -> DataFrame:
    """Spelling verdicts; the frequency dictionary, which needs ranks of the whole list, comes from a batch."""
    return spelling.classify(stream, word, dictionary)


def error_rates(stream: DataFrame, time: str, ref: str, hyp: str, window: str = "10 minutes", late: str = "30 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """``(window, *by, n, wer_micro, wer_macro)`` by tumbling windows; rows later than ``late`` are left out."""
    rows = stream.withColumns({"__r": tokens(F.col(ref)), "__h": tokens(F.col(hyp))})
    rows = rows.withColumn("__e", wer.word_distance(F.col("__r"), F.col("__h"))).withWatermark(time, late)
    rate = wer.standard_wer(F.col("__r"), F.col("__e"))
    return rows.groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"), F.try_divide(F.sum("__e"), F.sum(F.size("__r"))).alias("wer_micro"), F.avg(rate).alias("wer_macro"))
