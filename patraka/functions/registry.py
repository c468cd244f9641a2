"""The scalar functions as temporary SQL functions, for queries in text; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

from patraka.functions import lexicons as lex
from patraka.functions.text import BLANK, DOUBLE_DANDA, MARKS


def _spaced(text: str, marks: str) -> str:
    return f"trim(regexp_replace(lower(translate({text}, {lex.quoted(marks)}, {lex.quoted(' ' * len(marks))})), {lex.quoted(BLANK)}, ' '))"


def _matches(text: str, pattern: str) -> str:
    return f"{text} rlike {lex.quoted(pattern)}"


def _any_end(endings: tuple[str, ...]) -> str:
    return "(" + "|".join(endings) + ")$"


def definitions() -> dict[str, tuple[str, str, str]]:
    """By name the parameters, the kind of the result and the expression."""
    values = ", ".join(f"{lex.quoted(w)}, {v}" for w, v in lex.numerals().items())
    ends = f"^{BLANK}|{BLANK}$"
    return {
        "align_text": ("text string", "string", f"coalesce({_spaced('text', MARKS + '.')}, '')"),
        "composed_wer_text": ("text string", "string", _spaced("text", MARKS + DOUBLE_DANDA)),
        "strip_marks": ("word string", "string", f"regexp_replace(translate(word, {lex.quoted(MARKS + '.')}, ''), {lex.quoted(ends)}, '')"),
        "detector_clean": ("word string", "string", f"translate(word, {lex.quoted('।,?!;:.-')}, '')"),
        "number_value": ("word string", "bigint", f"cast(try_element_at(map({values}), trim(word)) as bigint)"),
        "has_latin": ("text string", "boolean", _matches("text", "[a-zA-Z]")),
        "only_devanagari": ("word string", "boolean", _matches("word", "^[ऀ-ॿ꣠-ꣿ]*$")),
        "sound_structure": ("word string", "boolean", "not (" + _matches("word", "|".join(lex.BROKEN)) + ")"),
        "english_ending": ("word string", "boolean", _matches("word", _any_end(lex.ENGLISH_ENDINGS))),
        "has_nukta": ("word string", "boolean", f"contains(word, {lex.quoted(lex.NUKTA)})"),
        "normalized_distance": ("a string, b string", "double", "case when a = b then 0.0D when a = '' or b = '' then 1.0D else levenshtein(a, b) / greatest(length(a), length(b)) end"),
        "half_even": ("x double, digits int", "double", "rint(x * pow(10, digits)) / pow(10, digits)"),
    }


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create the functions for this session, under their names with ``prefix``; returns the names."""
    for name, (parameters, kind, body) in definitions().items():
        spark.sql(f"create or replace temporary function {prefix}{name}({parameters}) returns {kind} return {body}")
    return [prefix + name for name in definitions()]
