"""The layered spelling classifier: first rule that fits decides, with confidence and provenance."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patraka.functions import lexicons as lex
from patraka.functions import text as T
from patraka.functions.numbers import bind
from patraka.functions.wer import half_even
from patraka.sources import tables

LAYERS = (
    ("punctuation", "correct", "high"),
    ("dictionary", "correct", "high"),
    ("english_transliteration", "correct", "high"),
    ("structure_invalid", "incorrect", "high"),
    ("mixed_content", "incorrect", "high"),
    ("mixed_script", "incorrect", "high"),
    ("morphology_suffix", "correct", "medium"),
    ("morphology_prefix", "correct", "medium"),
    ("morphology_combined", "correct", "medium"),
    ("english_pattern", "correct", "medium"),
    ("number", "correct", "high"),
    ("nukta_variant", "correct", "medium"),
    ("compound", "correct", "medium"),
    ("single_char", "correct", "medium"),
    ("short_word", "correct", "low"),
    ("unknown_devanagari", "incorrect", "low"),
    ("unknown_nonstandard", "incorrect", "medium"),
)
MORPHOLOGY = ("morphology_suffix", "morphology_prefix", "morphology_combined")
REASONS = {
    "punctuation": "Nothing but punctuation",
    "dictionary": "In the dictionary",
    "english_transliteration": "Known English word in Devanagari",
    "structure_invalid": "Impossible sequence of Devanagari signs",
    "mixed_content": "Digits or punctuation within the word",
    "mixed_script": "Latin letters within the word",
    "english_pattern": "Ends like an English word",
    "number": "Number word",
    "single_char": "One Devanagari character",
    "short_word": "Short Devanagari word",
    "unknown_devanagari": "Not in the dictionary",
    "unknown_nonstandard": "Characters of no known kind",
}
SIGNS = "[ऄ-्ँंः़]"
VERDICT = ("classification", "confidence", "reason", "layer")


def frequency_dictionary(words: DataFrame, top_n: int = 5000) -> DataFrame:
    """``(word)``: distinct clean words of two or more characters among the ranks up to ``top_n`` of ``words(rank, word)``."""
    clean = T.strip_marks(F.coalesce(F.col("word"), F.lit("nan")))
    kept = words.where(F.col("rank") <= top_n).select(clean.alias("word"))
    return kept.where((F.length("word") >= 2) & T.only_devanagari(F.col("word"))).distinct()


def morphs(clean: Column, layers: Iterable[str] = MORPHOLOGY) -> Column:
    """Splits of a word, in the order in which they are tried: ``array<struct<layer, root, reason>>``; ``layers``: only those of some layers."""
    suffixes, prefixes = lex.affixes("suffix"), lex.affixes("prefix")
    # stable by length, longest first
    by_length = lambda xs: F.array(*map(F.lit, sorted(xs, key=len, reverse=True)))
    literal = lambda xs: F.array(*map(F.lit, xs))

    def ending(word: Column, options: Column) -> Column:
        return F.filter(options, lambda s: F.endswith(word, s) & (F.length(word) > F.length(s) + 1))

    def beginning(word: Column, options: Column) -> Column:
        return F.filter(options, lambda p: F.startswith(word, p))

    def without_end(word: Column, s: Column) -> Column:
        return F.substring(word, F.lit(1), F.length(word) - F.length(s))

    def without_start(word: Column, p: Column) -> Column:
        return F.substring(word, F.length(p) + 1, F.length(word))

    def split(layer: str, root: Column, *reason: Column | str) -> Column:
        return F.struct(F.lit(layer).alias("layer"), root.alias("root"), F.concat(*(F.lit(r) if isinstance(r, str) else r for r in reason)).alias("reason"))

    one = F.transform(ending(clean, by_length(suffixes)), lambda s: split("morphology_suffix", without_end(clean, s), 'Root "', without_end(clean, s), '" and suffix "', s, '"'))
    long_enough = F.filter(beginning(clean, by_length(prefixes)), lambda p: F.length(clean) > F.length(p) + 1)
    two = F.transform(long_enough, lambda p: split("morphology_prefix", without_start(clean, p), 'Prefix "', p, '" and stem "', without_start(clean, p), '"'))

    def both(p: Column) -> Column:
        return bind(
            without_start(clean, p),
            lambda rest: F.transform(
                ending(rest, literal(suffixes)), lambda s: split("morphology_combined", without_end(rest, s), 'Prefix "', p, '", core "', without_end(rest, s), '" and suffix "', s, '"')
            ),
        )

    three = F.flatten(F.transform(beginning(clean, literal(prefixes)), both))
    return F.concat(*(splits for layer, splits in zip(MORPHOLOGY, (one, two, three)) if layer in layers))


def nukta_variants(clean: Column) -> Column:
    """The word without nuktas, or with one added to each kind of letter in turn."""
    bases = F.filter(F.array(*map(F.lit, lex.NUKTA_BASES)), lambda b: F.contains(clean, b))
    return F.when(T.has_nukta(clean), F.array(F.replace(clean, F.lit(lex.NUKTA), F.lit("")))).otherwise(F.transform(bases, lambda b: F.replace(clean, b, F.concat(b, F.lit(lex.NUKTA)))))


def classify(words: DataFrame, column: str = "word", dictionary: Iterable[str] | None = None, core: Iterable[str] | None = None) -> DataFrame:
    """Add ``classification``, ``confidence``, ``reason`` and ``layer`` to each row; a narrow projection.

    ``core``: the core vocabulary (by default that of ``lexicons.vocabulary``, which also reads one from a
    file); ``dictionary``: words beside it, such as those of ``frequency_dictionary`` (its size
    is bounded by the ranks it takes). A null word counts as the word ``nan``.
    """
    vocabulary = {*(lex.vocabulary() if core is None else core), *(dictionary or ())}
    word = F.coalesce(F.col(column), F.lit("nan"))
    clean = T.strip_marks(word)
    known = lambda c: lex.among(c, vocabulary)

    def decide(w: Column, c: Column) -> Column:
        def verdict(layer: str, reason: Column | None = None) -> Column:
            _, classification, confidence = next(x for x in LAYERS if x[0] == layer)
            said = F.lit(REASONS.get(layer)) if reason is None else reason
            return F.struct(F.lit(classification).alias("classification"), F.lit(confidence).alias("confidence"), said.alias("reason"), F.lit(layer).alias("layer"))

        pure = T.only_devanagari(c)
        cheap = (
            F.when(c == "", verdict("punctuation"))
            .when(known(c), verdict("dictionary"))
            .when(lex.among(c, lex.loanwords()), verdict("english_transliteration"))
            .when(~T.sound_structure(c), verdict("structure_invalid"))
            .when(T.has_marks(c), verdict("mixed_content"))
            .when(T.has_latin(c), verdict("mixed_script"))
        )

        def morphological(m: Column) -> Column:
            grade = F.struct(F.lit("correct").alias("classification"), F.lit("medium").alias("confidence"), m["reason"].alias("reason"), m["layer"].alias("layer"))
            return F.when(m.isNotNull(), grade)

        def late(nukta: Column, parts: Column) -> Column:
            valid = F.size(F.filter(parts, lambda p: known(p) | known(T.strip_marks(p))))
            return (
                F.when(T.english_ending(c) & pure, verdict("english_pattern"))
                .when(lex.among(c, lex.numerals()), verdict("number"))
                .when(nukta.isNotNull(), verdict("nukta_variant", F.concat(F.lit('Variant of "'), nukta, F.lit('"'))))
                .when(T.joined(w) & (valid >= F.size(parts) * 0.5), verdict("compound", F.concat(valid.cast("string"), F.lit(" of "), F.size(parts).cast("string"), F.lit(" parts known"))))
                .when((F.length(c) == 1) & c.rlike(SIGNS), verdict("single_char"))
                .when(pure & (F.length(c) <= 3), verdict("short_word"))
                .when(pure, verdict("unknown_devanagari"))
                .otherwise(verdict("unknown_nonstandard"))
            )

        # Splits are only made for words that the cheap layers leave open, and variants after those.
        split = F.get(F.filter(morphs(c), lambda m: known(m["root"])), F.lit(0))
        variant = F.get(F.filter(nukta_variants(c), known), F.lit(0))
        return F.coalesce(cheap, bind(split, morphological), bind(F.struct(variant.alias("v"), F.split(c, "[-_]").alias("p")), lambda x: late(x["v"], x["p"])))

    got = words.withColumn("__v", bind(F.struct(word.alias("w"), clean.alias("c")), lambda x: decide(x["w"], x["c"])))
    return got.withColumns({k: F.col(f"__v.{k}") for k in VERDICT}).drop("__v")


def summary(verdicts: DataFrame) -> DataFrame:
    """``(kind, value, n)``: totals, by classification, by confidence and by layer, in one pass."""
    sets = verdicts.groupingSets([[], [F.col("classification")], [F.col("confidence")], [F.col("layer")]], "classification", "confidence", "layer").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "classification").when(F.col("g") == 5, "confidence").otherwise("layer")
    return sets.select(kind.alias("kind"), F.coalesce("classification", "confidence", "layer", F.lit("all")).alias("value"), "n")


def totals(verdicts: DataFrame) -> DataFrame:
    """One row: ``total_words``, ``correct_spelling``, ``incorrect_spelling``, ``correct_pct`` (two digits, 0 without words) and the counts by ``confidence_breakdown`` and ``layer_breakdown`` as maps."""
    each = summary(verdicts)
    n = lambda kind, value: F.coalesce(F.max(F.when((F.col("kind") == kind) & (F.col("value") == value), F.col("n"))), F.lit(0).cast("long"))
    counts = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("value", "n")))))
    row = each.agg(
        n("total", "all").alias("total_words"),
        n("classification", "correct").alias("correct_spelling"),
        n("classification", "incorrect").alias("incorrect_spelling"),
        counts("confidence").alias("confidence_breakdown"),
        counts("layer").alias("layer_breakdown"),
    )
    share = half_even(F.coalesce(F.try_divide(F.col("correct_spelling") * 100.0, F.col("total_words")), F.lit(0.0)), 2)
    return row.select("total_words", "correct_spelling", "incorrect_spelling", share.alias("correct_pct"), "confidence_breakdown", "layer_breakdown")


def check_csv(spark: SparkSession, source: str, sink: str, column: str = "word", dictionary: Iterable[str] | None = None, core: Iterable[str] | None = None) -> DataFrame:
    """Classify a CSV file's words and write ``(word, classification, confidence, reason, layer)`` as CSV below ``sink``; returns ``totals``.

    Executors write the files, with a header each; ``tables.export_csv`` makes one local file with a byte-order mark.
    """
    words = tables.read_csv(spark, source, text=True).select(tables.as_word(F.col(f"`{column}`")).alias("word"))
    tables.write_csv(classify(words, "word", dictionary, core).select("word", *VERDICT), sink)
    return totals(tables.read_csv(spark, sink, text=True))
