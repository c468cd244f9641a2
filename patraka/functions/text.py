"""Text normalizers, tokenizers and script tests as column expressions.

The four normalizers differ on purpose: the one for error rates spaces punctuation but keeps full stops,
the one for alignment spaces full stops too but keeps the double danda, the stripper deletes, and the
detector's cleaner deletes a small set.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patraka.functions import lexicons as lex

MARKS = "।,?!;:\"'…-–—()[]{}"
DOUBLE_DANDA = "॥"
#: What ``str.split()`` takes for white space.
BLANK = r"(?U)[\s\x1c-\x1f]+"


def nfc(text: Column) -> Column:
    """Canonical composition by the Unicode library that Spark brings along, without Python's batches of whole texts."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    # most texts need none: letters up to U+02FF alone are composed
    return F.when(text.rlike(r"[^\x00-\x{2FF}]"), composed).otherwise(text)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANK, " "))


def spaced(text: Column, marks: str) -> Column:
    return F.translate(text, marks, " " * len(marks))


def for_error_rate(text: Column, compose: bool = True) -> Column:
    """NFC, punctuation to blanks (full stops stay), lower case, single blanks.

    ``compose=False`` skips the first step, for text known to be composed.
    """
    return squeeze(F.lower(spaced(nfc(text) if compose else text, MARKS + DOUBLE_DANDA)))


def for_alignment(text: Column) -> Column:
    """As above without NFC, with full stops blanked and the double danda kept; null gives the empty text."""
    return F.coalesce(squeeze(F.lower(spaced(text, MARKS + "."))), F.lit(""))


def strip_marks(word: Column) -> Column:
    return squeeze_ends(F.translate(word, MARKS + ".", ""))


def squeeze_ends(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}|{BLANK}$", "")


def detector_clean(word: Column) -> Column:
    return F.translate(word, "।,?!;:.-", "")


def split(text: Column) -> Column:
    """Words between white space, none for an empty text."""
    return F.filter(F.split(squeeze(text), " "), lambda w: w != "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(for_alignment(text), " "), lambda w: w != "")


def mostly_devanagari(text: Column) -> Column:
    own, latin = F.regexp_count(text, F.lit("[ऀ-ॿ]")), F.regexp_count(text, F.lit("[a-zA-Z]"))
    return F.coalesce(F.try_divide(own, own + latin) > 0.5, F.lit(False))


def has_latin(text: Column) -> Column:
    return text.rlike("[a-zA-Z]")


def only_devanagari(word: Column) -> Column:
    return word.rlike("^[ऀ-ॿ꣠-ꣿ]*$")


def sound_structure(word: Column) -> Column:
    return ~word.rlike("|".join(lex.BROKEN))


def english_ending(word: Column) -> Column:
    return word.rlike("(" + "|".join(lex.ENGLISH_ENDINGS) + ")$")


def joined(word: Column) -> Column:
    return word.rlike("[-_।.]")


def has_marks(word: Column) -> Column:
    return word.rlike("[0-9।,.!?;:]")


def has_nukta(word: Column) -> Column:
    return F.contains(word, F.lit(lex.NUKTA))


def collapse_repeats(words: Column, least: int = 3) -> Column:
    """Extension: a run of ``least`` or more equal words becomes one word."""
    n = F.size(words)
    same = F.transform(words, lambda w, i: F.coalesce((i > 0) & (F.get(words, i - 1) == w), F.lit(False)))

    def in_run(i: Column) -> Column:
        spans = [[i - back + k for k in range(least)] for back in range(1, least)]
        each = [F.coalesce(F.reduce(F.array(*(F.coalesce((p >= 0) & (p < n) & (F.get(words, p) == F.get(words, i)), F.lit(False)) for p in span)), F.lit(True), lambda a, b: a & b), F.lit(False)) for span in spans]
        out = each[0]
        for e in each[1:]:
            out = out | e
        return out

    kept = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), (F.get(same, i) & in_run(i)).alias("drop"))), lambda x: ~x["drop"])
    return F.transform(kept, lambda x: x["w"])
