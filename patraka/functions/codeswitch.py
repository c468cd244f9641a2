"""English words in Devanagari text: detection, tagging, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patraka.functions import lexicons as lex
from patraka.functions.numbers import converted
from patraka.functions.text import detector_clean, has_latin, split

MOST_EXTRA = 3
DETECTION = "struct<word:string,clean_word:string,english:string,detection_method:string,confidence:string,position:int>"


def merged(custom: dict[str, str] | None) -> dict[str, str]:
    """Overrides keep a word's place, new words come last."""
    return lex.loanwords() | (custom or {})


def looked_up(words: Column, custom: dict[str, str] | None = None) -> Column:
    """By word its ``hit``, null unless it is English; first rule that fits: Latin letters, a known word, a known word with up to three characters more.

    The last looks up the word's own prefixes in the (hashed) set of known words, and takes of those found
    the first in the lexicon's order.
    """
    known = merged(custom)
    exact = lex.mapping(known)
    long_ = {k: i for i, k in enumerate(known) if len(k) > MOST_EXTRA}
    place = lex.mapping(long_ or {"": 0})

    def partial(clean: Column) -> Column:
        heads = F.transform(F.array(*map(F.lit, range(MOST_EXTRA + 1))), lambda k: F.substring(clean, F.lit(1), F.length(clean) - k))
        found = F.filter(heads, lambda h: lex.among(h, long_))
        return F.array_min(F.transform(found, lambda h: F.struct(F.element_at(place, h).alias("ord"), h.alias("head"))))["head"]

    def found(english: Column, method: str, confidence: str) -> Column:
        return F.struct(english.alias("english"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))

    def look(clean: Column) -> Column:
        variant = F.concat(F.element_at(exact, partial(clean)), F.lit(" (variant)"))
        return (
            F.when(clean == "", None)
            .when(has_latin(clean), found(F.lower(clean), "latin_script", "high"))
            .when(lex.among(clean, known), found(F.element_at(exact, clean), "lookup_table", "high"))
            .when(F.length(clean) > MOST_EXTRA, found(variant, "partial_match", "medium"))
        )

    def one(w: Column, i: Column) -> Column:
        hit = look(detector_clean(w))
        return F.struct(w.alias("word"), detector_clean(w).alias("clean_word"), hit.alias("hit"), i.cast("int").alias("position"))

    return F.transform(words, one)


def detections(looked: Column) -> Column:
    """One struct for each English word among those that ``looked_up`` tells of."""
    return F.transform(
        F.filter(looked, lambda x: x["hit"]["english"].isNotNull()),
        lambda x: F.struct(
            x["word"].alias("word"), x["clean_word"].alias("clean_word"), x["hit"]["english"].alias("english"), x["hit"]["method"].alias("detection_method"), x["hit"]["confidence"].alias("confidence"), x["position"].alias("position")
        ),
    )


def tagged(text: Column, looked: Column) -> Column:
    """The text with ``[EN]`` and ``[/EN]`` around English words; unchanged, white space too, if there are none."""
    english = lambda x: x["hit"]["english"].isNotNull()
    marked = F.transform(looked, lambda x: F.when(english(x), F.concat(F.lit("[EN]"), x["word"], F.lit("[/EN]"))).otherwise(x["word"]))
    return F.when(F.exists(looked, english), F.array_join(marked, " ")).otherwise(text)


def analyze(df: DataFrame, text: str, custom: dict[str, str] | None = None) -> DataFrame:
    """Add ``words``, ``english_words``, ``tagged``, ``total_words``, ``english_word_count`` and ``english_ratio``."""
    df = df.withColumn("words", split(F.col(text))).withColumn("__looked", looked_up(F.col("words"), custom)).withColumn("english_words", detections(F.col("__looked")))
    n, m = F.size("words"), F.size("english_words")
    return df.withColumns(
        {"tagged": tagged(F.col(text), F.col("__looked")), "total_words": n, "english_word_count": m, "english_ratio": F.coalesce(F.try_divide(m, n), F.lit(0.0))}
    ).drop("__looked")


def cleanup(df: DataFrame, text: str, keep_idioms: bool = True) -> DataFrame:
    """Numbers to digits, then English tagging of the result; no shuffle, works on streams too.

    Adds ``numbers_normalized``, ``number_notes`` and the columns of ``analyze``.
    """
    df = df.withColumn("__converted", converted(split(F.col(text)), keep_idioms))
    df = df.withColumns({"numbers_normalized": F.array_join("__converted.words", " "), "number_notes": F.col("__converted.notes")}).drop("__converted")
    return analyze(df, "numbers_normalized")


def with_english(df: DataFrame) -> DataFrame:
    """Rows of ``analyze`` in which English words were found."""
    return df.where(F.col("english_word_count") > 0)
