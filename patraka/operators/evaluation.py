"""Evaluation of several models' outputs: long rows, lattices, error rates, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patraka.functions import wer
from patraka.functions.text import tokens
from patraka.operators import align


def worded(wide: DataFrame, human: str, models: Sequence[str]) -> DataFrame:
    """The reference and the outputs as word arrays; a null reference is the word ``nan``, a null output is empty."""
    return wide.withColumns({human: tokens(F.coalesce(F.col(f"`{human}`"), F.lit("nan")))} | {m: tokens(F.coalesce(F.col(f"`{m}`"), F.lit(""))) for m in models})


def long(rows: DataFrame, models: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """One row for each model: ``carry``, ``model`` and ``hyp``."""
    each = F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"`{m}`").alias("hyp")) for m in models))
    return rows.select(*carry, F.explode(each).alias("__x")).select(*carry, "__x.model", "__x.hyp")


def rates(rows: DataFrame, human: str, lattice: str, errors: Column, lattice_errors: Column) -> DataFrame:
    """Add ``standard_wer``, ``lattice_wer``, ``wer_reduction`` and ``ref_length``."""
    rows = rows.withColumns({"standard_wer": wer.standard_wer(F.col(human), errors), "lattice_wer": wer.lattice_wer(F.col(lattice), lattice_errors)})
    return rows.withColumns({"wer_reduction": F.col("standard_wer") - F.col("lattice_wer"), "ref_length": F.size(human).cast("long")})


def rated(rows: DataFrame, human: str = "human", lattice: str = "lattice", epsilon_bins: bool = False) -> DataFrame:
    """``rates`` of rows with a lattice of their own and ``hyp``.

    ``epsilon_bins`` (an extension): bins without a word of the reference may be skipped at no cost.
    """
    free = F.transform(lattice, lambda b: ~F.arrays_overlap(b, F.col(human))) if epsilon_bins else None
    return rates(rows, human, lattice, wer.word_distance(F.col(human), F.col("hyp")), wer.lattice_errors(F.col(lattice), F.col("hyp"), free))


def aligned_rates(rows: DataFrame, human: str, models: Sequence[str], carry: Sequence[str], anchored: bool = False, min_support: int = 1, epsilon_bins: bool = False) -> DataFrame:
    """One row for each row and model: ``carry``, ``model``, ``hyp`` and the ``rates`` against the lattice of the reference and all models.

    Lattices and edits come from one Arrow pass over the rows, before the models become rows. The rows should be
    spread over tasks by then, as alignment is the costly part.
    """
    sequences = F.array(F.col(f"`{human}`"), *(F.col(f"`{m}`") for m in models))
    rows = rows.withColumn("__r", align.rated(sequences, anchored, min_support, epsilon_bins))
    each = F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"`{m}`").alias("hyp"), F.col("__r.errors")[i].alias("e"), F.col("__r.lattice_errors")[i].alias("l")) for i, m in enumerate(models)))
    rows = rows.select(*carry, F.col(f"`{human}`").alias("__human"), F.col("__r.lattice").alias("__lattice"), F.explode(each).alias("__x")).select(*carry, "__human", "__lattice", "__x.*")
    return rates(rows, "__human", "__lattice", F.col("e"), F.col("l")).drop("__human", "__lattice", "e", "l")


def evaluate(
    wide: DataFrame, models: Sequence[str] | None = None, human: str = "Human", key: str = "segment_url_link", drop_empty: bool = False, anchored: bool = False, min_support: int = 1, epsilon_bins: bool = False
) -> DataFrame:
    """``(segment_idx, model, standard_wer, lattice_wer, wer_reduction, ref_length)`` from a wide table of outputs.

    ``models``: by default every column but the key, the reference and the index. ``drop_empty`` leaves out
    outputs that are null (such as a trailing column without a name). Segments are dealt to tasks by their
    index first: a file of outputs is read by one task.
    """
    models = list(models or [c for c in wide.columns if c not in (human, key, "segment_idx")])
    rows = aligned_rates(worded(wide.repartition("segment_idx"), human, models), human, models, ["segment_idx"], anchored, min_support, epsilon_bins)
    rows = rows.where(F.size("hyp") > 0) if drop_empty else rows
    return rows.select("segment_idx", "model", "standard_wer", "lattice_wer", "wer_reduction", "ref_length")


def summary(detail: DataFrame) -> DataFrame:
    """Mean rates by model to four digits, and the improvement in percent of those rounded means."""
    means = detail.groupBy("model").agg(*(wer.half_even(F.avg(c), 4).alias(c) for c in ("standard_wer", "lattice_wer", "wer_reduction")))
    change = F.try_divide(F.col("standard_wer") - F.col("lattice_wer"), F.col("standard_wer")) * 100
    return means.withColumn("improvement_pct", wer.half_even(change, 2))


def corpus_wer(rows: DataFrame, ref: str, hyp: str, by: Sequence[str] = ()) -> DataFrame:
    """Micro rate (all edits by all reference words) and macro rate (mean of rates), by the columns ``by``."""
    each = rows.withColumn("__e", wer.word_distance(F.col(ref), F.col(hyp)))
    rate = wer.standard_wer(F.col(ref), F.col("__e"))
    return each.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(F.sum("__e"), F.sum(F.size(ref))).alias("wer_micro"), F.avg(rate).alias("wer_macro"))
