"""Golden cases of the transcript operators."""

from __future__ import annotations

import json
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from patraka.functions import codeswitch, numbers, registry, wer
from patraka.functions import edits as edits_
from patraka.functions import lexicons as lex
from patraka.functions import text as T
from patraka.operators import align, ingest, sampling, spelling
from patraka.plans.queries import QUERIES


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, x {kind}")


def mapped(spark, values, f, kind="string"):
    return [r[0] for r in column(spark, values, kind).select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def passes(df) -> int:
    """How often the plan hands rows to Python."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


# --- text ------------------------------------------------------------------------------------------


def test_normalizers_treat_full_stops_apart(spark):
    assert mapped(spark, ["a.b", "A,  b।"], T.for_error_rate) == ["a.b", "a b"]
    assert mapped(spark, ["a.b", None, "x॥y"], T.for_alignment) == ["a b", "", "x॥y"]
    assert mapped(spark, ["a.b", " (a) ", "…"], T.strip_marks) == ["ab", "a", ""]
    assert mapped(spark, ["a.b-c_d"], T.detector_clean) == ["abc_d"]


def test_composition_and_white_space(spark):
    assert mapped(spark, ["ज़"], T.for_error_rate) == ["ज़"]
    assert mapped(spark, ["a b\x1cc", "", "  "], T.split) == [["a", "b", "c"], [], []]


def test_composition_needs_no_python(spark, sf):
    texts = ["e\u0301", "\u0928\u093c", "\u1100\u1161\u11a8", "\u0958", "a\u0323\u0307", "\u212b\u2126", "caf\u00e9", "", None]
    assert mapped(spark, texts, T.nfc) == [x if x is None else unicodedata.normalize("NFC", x) for x in texts]
    for name in ("non_empty", "norm_wer_text"):  # batches of whole texts took memory with the texts' length
        assert passes(QUERIES[name](spark, sf)) == 0


def test_script_tests(spark):
    assert mapped(spark, ["", "घर", "घरx", "1"], T.only_devanagari) == [True, True, False, False]
    assert mapped(spark, ["", "घर", "xघ", "1"], T.mostly_devanagari) == [False, True, False, False]
    assert mapped(spark, ["कािी", "क््", "काा", "किताब"], T.sound_structure) == [False, False, False, True]
    assert mapped(spark, ["स्टेशन", "घर"], T.english_ending) == [True, False]


def test_runs_of_words_collapse(spark):
    got = mapped(spark, ["a a a b b c c c c", "a a", ""], lambda x: F.array_join(T.collapse_repeats(T.split(x)), " "))
    assert got == ["a b b c", "a a", ""]


def test_words_are_judged_once_each(spark, sf):
    for name in ("suffix_morph", "prefix_morph", "combined_morph", "nukta_variant", "failure_categories", "low_confidence_sample", "structure_invalid"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "Filter" in plan and "Filter" not in plan[plan.rindex("Aggregate [") :], name  # conditions were carried below the count, to each row


# --- numbers ---------------------------------------------------------------------------------------

# The first eight sentences are inputs whose results are given; the others are written for this test.
NUMBERS = [
    ("मेरे पास दो किताबें हैं", "मेरे पास 2 किताबें हैं", 1, 0),
    ("तीन सौ चौवन रुपए", "354 रुपए", 1, 0),
    ("एक हज़ार पांच सौ", "1500", 1, 0),
    ("पच्चीस लोग आए", "25 लोग आए", 1, 0),
    ("दो-चार बातें करनी हैं", "दो-चार बातें करनी हैं", 0, 0),
    ("नौ दो ग्यारह हो गए", "नौ दो ग्यारह हो गए", 0, 3),
    ("उसने दस किताबें पढ़ीं", "उसने 10 किताबें पढ़ीं", 1, 0),
    ("सौ प्रतिशत सही", "100 प्रतिशत सही", 1, 0),
    ("दो लाख तीन हज़ार चार सौ पचास", "203450", 1, 0),
    ("तीन दो", "5", 1, 0),
    ("दो तीन", "2 3", 2, 0),
    ("सौ सौ", "10000", 1, 0),
    ("पच्चीस हज़ार", "25000", 1, 0),
    ("एक तरफ", "एक तरफ", 0, 1),
]


def test_numbers(spark):
    df = column(spark, [x[0] for x in NUMBERS]).withColumn("c", numbers.converted(T.split(F.col("x"))))
    for r, (_, out, n, kept) in zip(df.orderBy("i").collect(), NUMBERS):
        assert " ".join(r.c.words) == out
        kinds = [x.type for x in r.c.notes]
        assert (kinds.count("number_conversion"), kinds.count("preserved_idiom")) == (n, kept)


def test_numbers_without_protection_and_without_bound(spark):
    assert mapped(spark, ["एक तरफ"], lambda x: numbers.to_digits(x, keep_idioms=False)) == ["1 तरफ"]
    assert mapped(spark, ["अरब अरब अरब", "अरब " * 6], numbers.to_digits)[0] == "1" + "0" * 27


def test_numbers_are_walked_outside_of_the_row_expressions(spark, sf):
    for name in ("number_normalize", "number_annotations", "converted_transcripts", "cleanup_pipeline"):
        df = QUERIES[name](spark, sf)  # as column expressions each word's state was copied
        assert passes(df) == 1 and "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString(), name
    words = [["सौ", None, "दो", " तीन "], None, [], ["अरब"] * 5]
    got = [r.c for r in column(spark, words, "array<string>").select("i", numbers.converted(F.col("x")).alias("c")).orderBy("i").collect()]
    assert [r.words for r in got] == [["100", None, "2", "3"], None, [], ["1" + "0" * 36]]
    assert got[1].notes is None and [n.original for n in got[3].notes] == ["अरब अरब अरब अरब अरब"]


# --- English words ---------------------------------------------------------------------------------

# Sentences whose English words are given.
ENGLISH = [
    ("मेरा इंटरव्यू बहुत अच्छा गया और मुझे जॉब मिल गई", ["इंटरव्यू", "जॉब"], 10),
    ("ये प्रॉब्लम सॉल्व नहीं हो रहा", ["प्रॉब्लम"], 6),
    ("एक सिंपल और सादा वे में", ["सिंपल"], 6),
    ("पहले डेस्कटॉप था ना बाद में लैपटॉप आया", ["डेस्कटॉप", "लैपटॉप"], 8),
    ("मुझे म्यूजिक सुनना पसंद है गाना भी पसंद है एक्चुअली", ["म्यूजिक", "एक्चुअली"], 10),
    ("जी फीडबैक मिलने पर सुधार करना", ["फीडबैक"], 6),
    ("तो भारत तो एक खुद से ही गिफ्टेड लैंड है तो हमें इसको एक्सप्लोर करना चाहिए", ["गिफ्टेड", "लैंड", "एक्सप्लोर"], 16),
]


def test_english_words(spark):
    got = codeswitch.analyze(column(spark, [x[0] for x in ENGLISH]), "x").orderBy("i").collect()
    for r, (text, words, total) in zip(got, ENGLISH):
        assert [e.word for e in r.english_words] == words
        assert (r.total_words, r.english_word_count) == (total, len(words))
        assert r.tagged == " ".join(f"[EN]{w}[/EN]" if w in words else w for w in text.split())


def test_variants_custom_words_and_white_space(spark):
    df = column(spark, ["मोबाइलों में", "दो  शब्द", "OK, अबकड"])
    got = codeswitch.analyze(df, "x", custom={"अबकड": "abcd"}).orderBy("i").collect()
    assert [(e.english, e.detection_method, e.confidence) for e in got[0].english_words] == [("mobile (variant)", "partial_match", "medium")]
    assert got[1].tagged == "दो  शब्द"
    assert [(e.english, e.detection_method) for e in got[2].english_words] == [("ok", "latin_script"), ("abcd", "lookup_table")]


# --- spelling --------------------------------------------------------------------------------------

# Words whose verdicts are given, here and in the loop below; the others are written for this test.
WORDS = {w: ("correct", "high", "dictionary") for w in "बहुत कंप्यूटर अच्छा हम्म स्कूल पढ़ाई बिजनेस बच्चों स्कॉलरशिप".split()}
WORDS |= {
    "xyzहां": ("incorrect", "high", "mixed_script"),
    "499में": ("incorrect", "high", "mixed_content"),
    "एग्जाक्ट्ली": ("correct", "medium", "english_pattern"),
    "आ-अब": ("correct", "low", "short_word"),
    "…": ("correct", "high", "punctuation"),
    "मोबाइल": ("correct", "high", "english_transliteration"),
    "कााा": ("incorrect", "high", "structure_invalid"),
    "पच्चीस": ("correct", "high", "number"),
    "किताबवाला": ("correct", "medium", "morphology_suffix"),
    "अनदेखा": ("correct", "medium", "morphology_prefix"),
    "ज़रूरत?é": ("incorrect", "medium", "unknown_nonstandard"),
    "घर_काम": ("correct", "medium", "compound"),
    "ञ": ("correct", "medium", "single_char"),
}
WORDS |= {w: ("incorrect", "low", "unknown_devanagari") for w in "इंरव्यू गोशालाएं अपङी हांपकवान".split()}


def test_spelling_layers(spark):
    got = {r.x: (r.classification, r.confidence, r.layer) for r in spelling.classify(column(spark, list(WORDS)), "x").collect()}
    assert got == WORDS


def test_spelling_vocabularies(spark):
    df = column(spark, ["qवव", "वववव", "ज़ोर"])
    core = {r.x: r.layer for r in spelling.classify(df, "x", core=["वव", "जोर"]).collect()}
    assert core["ज़ोर"] == "nukta_variant"
    both = {r.x: r.layer for r in spelling.classify(df, "x", dictionary=["वववव"]).collect()}
    assert both["वववव"] == "dictionary"


def test_frequency_dictionary_and_summary(spark):
    ranked = spark.createDataFrame([(1, "घर,"), (2, "घर"), (3, "x"), (4, "देश"), (5, None)], "rank long, word string")
    assert {r.word for r in spelling.frequency_dictionary(ranked, 3).collect()} == {"घर"}
    got = {(r.kind, r.value): r.n for r in spelling.summary(spelling.classify(ranked)).collect()}
    assert got[("total", "all")] == 5
    assert got[("layer", "mixed_script")] == 2


def test_vocabulary_from_a_file(tmp_path):
    (tmp_path / "words").write_text("घर\n\nदेश \n", encoding="utf-8")
    assert lex.vocabulary(str(tmp_path / "words")) == ("घर", "देश") or set(lex.vocabulary(str(tmp_path / "words"))) == {"घर", "देश"}


# --- error rates and lattices ----------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


def through(lattice, words):
    row = list(range(len(lattice) + 1))
    for j, w in enumerate(words, 1):
        prev, row = row, [j]
        for i, options in enumerate(lattice, 1):
            row.append(min(prev[i] + 1, row[-1] + 1, prev[i - 1] + (w not in options)))
    return row[-1]


def test_word_distance_like_a_table(spark):
    rng = random.Random(3)
    pairs = [([rng.choice("abcde") for _ in range(rng.randrange(9))], [rng.choice("abcde") for _ in range(rng.randrange(9))]) for _ in range(200)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a array<string>, b array<string>")
    got = df.select("i", wer.word_distance(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == [edits(a, b) for a, b in pairs]


def test_empty_references(spark):
    df = spark.createDataFrame([([], ["a"])], "a array<string>, b array<string>")
    d = wer.word_distance(F.col("a"), F.col("b"))
    assert tuple(df.select(d, wer.standard_wer(F.col("a"), d), wer.sentence_wer(F.col("a"), d)).first()) == (1, 0.0, 1.0)


def test_lattice_distance_like_a_table(spark):
    rng = random.Random(4)
    cases = [([[rng.choice("abc") for _ in range(rng.randrange(1, 3))] for _ in range(rng.randrange(6))], [rng.choice("abcd") for _ in range(rng.randrange(7))]) for _ in range(100)]
    df = spark.createDataFrame([(i, x, h) for i, (x, h) in enumerate(cases)], "i long, l array<array<string>>, h array<string>")
    got = df.select("i", wer.lattice_errors(F.col("l"), F.col("h")).alias("e")).orderBy("i").collect()
    assert [r.e for r in got] == [through(x, h) for x, h in cases]


def test_free_bins(spark):
    df = spark.createDataFrame([([["a"], ["q"], ["b"]], ["a", "b"], [False, True, False])], "l array<array<string>>, h array<string>, f array<boolean>")
    assert tuple(df.select(wer.lattice_errors(F.col("l"), F.col("h")), wer.lattice_errors(F.col("l"), F.col("h"), F.col("f"))).first()) == (1, 0)


CASES = [
    ("A x y|A x q y|A x y", False, "A x q y"),
    ("A x y|B x y|B x y|B x z", False, "[A|B] x y"),
    ("A x y|B x y|B x y|B x z", True, "[A|B] x [y|z]"),
    ("A x|B x|B x|B x tail", False, "[A|B] x tail"),
    ("|p q", False, "p q"),
    ("उसने चौदह किताबें खरीदीं|उसने 14 किताबें खरीदीं|उसने चौदह किताबे खरीदी|उसने चौदह पुस्तकें खरीदीं", False, "उसने [14|चौदह] [किताबे|किताबें|पुस्तकें] [खरीदी|खरीदीं]"),
]


@pytest.mark.parametrize("text,anchored,expected", CASES)
def test_lattices(spark, text, anchored, expected):
    sequences = [s.split() for s in text.split("|")]
    df = spark.createDataFrame([(sequences,)], "s array<array<string>>")
    assert df.select(wer.lattice_text(align.lattice(F.col("s"), anchored))).first()[0] == expected


def test_alignment_keeps_all_words():
    rng = random.Random(5)
    for _ in range(50):
        a, b = ([rng.choice(["ab", "abc", "x", "yy"]) for _ in range(rng.randrange(7))] for _ in range(2))
        got = align.align_pair(a, b)
        assert [x for x, _ in got if x is not None] == a
        assert [y for _, y in got if y is not None] == b


def test_distances_together_like_one_by_one():
    rng = random.Random(6)
    words = {"".join(rng.choice("abcé漢\U0001f600") for _ in range(rng.randrange(1, 9))) for _ in range(60)} | {"", "x" * 50}
    known = align.Distances([words])
    assert len(known) > 1000
    for a in words:
        for b in words - {a}:
            assert known[a, b] == known[b, a] == (edits(a, b) / max(len(a), len(b)) if a and b else 1.0)


def test_rounding_to_even(spark):
    df = spark.createDataFrame([(0.5,), (2.5,), (0.12345,)], "x double")
    assert [r[0] for r in df.select(wer.half_even(F.col("x"), 0)).collect()] == [0.0, 2.0, 0.0]


def test_more_distinct_words_than_two_byte_symbols(spark):
    words = [f"w{i}" for i in range(42_500)]
    df = spark.createDataFrame([(words, ["w5", "other"]), (None, ["a"])], "a array<string>, b array<string>")
    d = wer.word_distance(F.col("a"), F.col("b"))
    got = df.select(d.alias("d"), wer.standard_wer(F.col("a"), d).alias("w")).collect()
    assert tuple(got[0]) == (42_499, 42_499 / 42_500)
    assert tuple(got[1]) == (None, None)  # what isn't known is no perfect score


def test_a_thousand_distinct_words_like_a_table(spark):
    rng = random.Random(9)
    a = [f"w{rng.randrange(900)}" for _ in range(1000)]
    b = [w for w in a if rng.random() < 0.9] + ["x", "y"]
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(wer.word_distance(F.col("a"), F.col("b"))).first()[0] == edits(a, b)


LETTERS = ["ab", "abc", "x", "yy", "abd", "", "é", "zzzz" * 10]


@pytest.mark.parametrize("anchored", [False, True])
@pytest.mark.parametrize("support", [1, 2])
def test_batches_of_lattices_like_one_by_one(spark, anchored, support):
    rng = random.Random(7)
    rows = [[[rng.choice(LETTERS) for _ in range(rng.randrange(9))] for _ in range(rng.randrange(1, 6))] for _ in range(300)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, s array<array<string>>")
    got = {r.i: (r.x, r.rated) for r in df.select("i", align.lattice(F.col("s"), anchored, support).alias("x"), align.rated(F.col("s"), anchored, support).alias("rated")).collect()}
    for i, sequences in enumerate(rows):
        plain = align.bins([[w or None for w in row] for row in align.align_all(sequences, anchored)], support)
        assert got[i][0] == got[i][1].lattice == plain
        assert got[i][1].errors == [edits(sequences[0], h) for h in sequences[1:]]
        assert got[i][1].lattice_errors == [through(plain, h) for h in sequences[1:]]


def test_batches_of_pairs_like_one_by_one(spark):
    rng = random.Random(8)
    rows = [tuple([rng.choice(LETTERS) for _ in range(rng.randrange(9))] for _ in range(2)) for _ in range(300)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, a array<string>, b array<string>")
    got = {r.i: [tuple(x) for x in r.p] for r in df.select("i", align.pairs(F.col("a"), F.col("b")).alias("p")).collect()}
    assert got == {i: align.align_pair(a, b) for i, (a, b) in enumerate(rows)}
    assert df.limit(0).select(align.pairs(F.col("a"), F.col("b"))).count() == 0


def test_alignment_compares_few_words():
    # before, the distances of all pairs of different words of a row: 435 here
    words = [chr(97 + i % 26) * (1 + i // 26) + chr(98 + i % 7) for i in range(30)]
    held = edits_.Words([*words, *(w + "x" for w in words)])
    asked, own = [], held.distances
    held.distances = lambda i, j: asked.append(len(i)) or own(i, j)
    full = np.arange(30)[None]
    dropped, changed = np.array([[i for i in range(30) if i % 5]]), np.where(full % 4, full, full + 30)
    for other, most in ((dropped, 0), (changed, 60)):
        asked.clear()
        path, ends = edits_.aligned(full, np.array([30]), other, np.array([other.shape[1]]), held, 1.0)
        assert sum(asked) <= most
        said = align.align_pair([held.words[i] for i in full[0]], [held.words[i] for i in other[0]])
        assert [edits_.UP if b is None else edits_.LEFT if a is None else edits_.PAIR for a, b in said] == path[0, : ends[0]].tolist()


def test_long_rows_by_bands_and_by_tables():
    rng = random.Random(11)
    known = edits_.Words(["ab", "abc", "x", "yy", "abd", "", "\u00e9"])
    near = [rng.randrange(7) for _ in range(120)]
    rows = [(near, [w for w in near if rng.random() < 0.95]), ([rng.randrange(7) for _ in range(150)], [rng.randrange(7) for _ in range(40)]), ([], [1, 2])]
    (x, m), (y, n) = (edits_.padded([np.array(r[k], dtype=np.int64) for r in rows], 0) for k in range(2))
    low, high, _ = edits_.bands(x, m, y, n, known, 1.0)
    assert high[0] - low[0] < edits_.BITS <= high[1] - low[1]  # one of each kind
    path, ends = edits_.aligned(x, m, y, n, known, 1.0)
    for r, (a, b) in enumerate(rows):
        said = align.align_pair([known.words[i] for i in a], [known.words[i] for i in b])
        assert [edits_.UP if q is None else edits_.LEFT if p is None else edits_.PAIR for p, q in said] == path[r, : ends[r]].tolist()


def test_odd_lattices(spark):
    df = spark.createDataFrame([(None, ["a"]), ([["a"]], None), ([], ["a", "b"]), ([["a"], ["b"]], [])], "l array<array<string>>, h array<string>")
    e = wer.lattice_errors(F.col("l"), F.col("h"))
    assert [tuple(r) for r in df.select(e, wer.lattice_wer(F.col("l"), e)).collect()] == [(None, None), (None, None), (2, 0.0), (2, 1.0)]


@pytest.mark.parametrize("size", [0, 3, 64, 65, 90])
def test_edits_by_bits_like_a_table(spark, size):
    rng = random.Random(size)
    rows = [tuple([rng.choice("abcde") for _ in range(rng.randrange(size + 1))] for _ in range(2)) for _ in range(40)] + [(["a"] * size, ["b"] * size)]
    bins = [[[rng.choice("abcde") for _ in range(rng.choice([0, 1, 2, 9]))] for _ in a] for a, _ in rows]
    df = spark.createDataFrame([(i, a, b, x) for i, ((a, b), x) in enumerate(zip(rows, bins))], "i long, a array<string>, b array<string>, l array<array<string>>")
    got = df.select("i", wer.word_distance(F.col("a"), F.col("b")).alias("d"), wer.lattice_errors(F.col("l"), F.col("b")).alias("e")).orderBy("i").collect()
    assert [r.d for r in got] == [edits(a, b) for a, b in rows]
    assert [r.e for r in got] == [through(x, b) for (_, b), x in zip(rows, bins)]


def test_edits_stay_out_of_the_row_expressions(spark, sf):
    # as column expressions they were interpreted word by word, and a condition repeated them
    for name in ("standard_wer", "sentence_wer", "wer_micro", "wer_macro_by_group", "best_worst_model", "lattice_wer", "lattice_summary", "stratified_sample"):
        df = QUERIES[name](spark, sf)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert passes(df) == 1 and "levenshtein" not in plan, name


# --- ingestion -------------------------------------------------------------------------------------

FILES = {
    "list": ([{"text": " a ", "start": 1, "end": "2.5"}, {"transcript": "b", "start_time": 3, "finish": 4}], [(1.0, 2.5, "a"), (3.0, 4.0, "b")]),
    "present key": ([{"text": None, "transcript": "x"}, {"sentence": "y"}], [(0.0, 0.0, "y")]),
    "segments": ({"segments": [{"text": "a", "begin": 1, "end_time": 2}]}, [(1.0, 2.0, "a")]),
    "whole": ({"text": " a ", "start": 1, "end": 2}, [(1.0, 2.0, " a ")]),
    "bare": ({"transcript": "q", "begin": 2, "end": 3}, [(2.0, 3.0, "q")]),
    "one bad time": ([{"text": "a", "start": None}, {"text": "b"}], []),
    "nothing": ({}, []),
}


@pytest.mark.parametrize("name", FILES)
def test_transcript_shapes(spark, name):
    content, expected = FILES[name]
    got = mapped(spark, [json.dumps(content)], ingest.segments)[0]
    assert [tuple(s) for s in got] == expected


def test_malformed_transcripts(spark):
    assert mapped(spark, ["[{", None, "3"], ingest.segments) == [[], [], []]


def test_valid_segments(spark):
    df = spark.createDataFrame([("r", [(0.0, 0.5, "short"), (1.0, 2.0, " ok "), (3.0, 5.0, " "), (9.0, 20.0, "cut")], 160_000)], "recording_id string, segments array<struct<start_time:double,end_time:double,text:string>>, total long")
    got = ingest.valid_segments(df, total="total").collect()
    assert [(r.segment_id, r.audio_path, r.text, r.start_sample, r.end_sample) for r in got] == [(1, "r_seg0001.wav", "ok", 16_000, 32_000), (3, "r_seg0003.wav", "cut", 144_000, 160_000)]


def test_links_paths_and_listing(spark):
    df = spark.createDataFrame([("1", "old/a/old/b")], "recording_id string, rec_url_gcp string")
    assert ingest.rewrite_links(df, "old", "new").first().rec_url_gcp == "new/a/new/b"
    row = ingest.local_paths(df, "d", metadata=False).first()
    assert (row.local_audio_path, row.local_transcription_path, row.local_metadata_path) == ("d/audio/1_audio.wav", "d/transcriptions/1_transcription.json", None)
    files = spark.createDataFrame([("d/audio/1_audio.wav",)], "path string")
    assert ingest.existing(ingest.local_paths(df, "d"), files, "local_audio_path").count() == 1


def test_outliers_and_statistics(spark):
    df = spark.createDataFrame([(1, float(d), "text") for d in [5] * 20 + [24]] + [(2, 5.0, "x"), (3, 0.5, "text")], "user_id long, duration double, text string")
    assert ingest.without_outliers(df, sigma=3.0).count() == 20
    assert ingest.without_outliers(df, sigma=None).count() == 21
    row = ingest.dataset_statistics(df).first()
    assert (row.num_recordings, row.num_unique_users, row.min_duration_seconds) == (23, 3, 0.5)


def test_outlier_report_and_lengths(spark):
    df = spark.createDataFrame([(float(d), "text") for d in [5] * 20 + [24]] + [(5.0, "x"), (0.5, "text")], "duration double, text string")
    assert tuple(ingest.outlier_report(df).first()) == (23, 20, 3, 13.0)
    assert tuple(ingest.outlier_report(df.limit(0)).first()) == (0, 0, 0, 0.0)
    rows = spark.createDataFrame([([1.0, 2.0], [[1.0], [2.0, 3.0]])], "a array<double>, b array<array<double>>")
    assert [ingest.input_lengths(rows, c).first().input_length for c in ("a", "b")] == [2, 1]


# --- sampling --------------------------------------------------------------------------------------


def test_split_keeps_groups_whole(spark):
    df = spark.range(1000).select((F.col("id") % 53).alias("g"), "id")
    got = sampling.grouped_split(df, "g").groupBy("g").agg(F.collect_set("split").alias("s")).collect()
    assert all(len(r.s) == 1 for r in got)
    assert sum(r.s == ["train"] for r in got) == int(53 * 0.9)


def test_samples_are_reproducible(spark):
    df = spark.range(500).select("id", (F.col("id") % 10 / 10).alias("wer"))
    first = [r.id for r in sampling.sample(df, "id", 7).collect()]
    assert len(first) == 7 and first == [r.id for r in sampling.sample(df.repartition(5), "id", 7).collect()]
    got = sampling.stratified(df, "wer", "id").groupBy("stratum").count().collect()
    assert {r.stratum: r["count"] for r in got} == {k: 5 for k in ("Very Low", "Low", "Medium", "High", "Very High")}


def test_frequency_ranks_are_those_of_a_sort(spark):
    rng = random.Random(4)
    counts = {"".join(rng.choice("aébक") for _ in range(rng.randrange(1, 8))): rng.randrange(1, 4) for _ in range(500)}
    got = sampling.frequency_ranks(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    expected = sorted(counts, key=lambda w: (-counts[w], w.encode()))
    assert [r.word for r in sorted(got, key=lambda r: r["rank"])] == expected and sorted(r["rank"] for r in got) == list(range(1, len(counts) + 1))


def test_row_filters_and_totals(spark):
    df = column(spark, ["दो किताबें", "एक तरफ", "मोबाइल"]).withColumn("number_notes", numbers.converted(T.split(F.col("x")))["notes"])
    assert [r.i for r in numbers.with_notes(df, "number_conversion").collect()] == [0]
    assert [r.i for r in numbers.with_notes(df, "preserved_idiom").collect()] == [1]
    assert [r.i for r in codeswitch.with_english(codeswitch.analyze(df, "x")).collect()] == [2]
    row = spelling.totals(spelling.classify(column(spark, ["घर", "देश", "xyzहां"]), "x")).first()
    assert (row.total_words, row.correct_spelling, row.incorrect_spelling, row.correct_pct) == (3, 2, 1, 66.67)
    assert row.layer_breakdown == {"dictionary": 2, "mixed_script": 1}
    assert spelling.totals(spelling.classify(column(spark, []), "x")).first().correct_pct == 0.0


def test_ordered_resources(tmp_path):
    (tmp_path / "r").write_text("2\tb\tbee\n1\ta\tay\n3\ta\tlater\n4\tc\n", encoding="utf-8")
    assert lex.resource(str(tmp_path / "r")) == (("a", "ay"), ("b", "bee"), ("c", None))


def test_words_with_quotes_in_literal_sets(spark):
    words = {"it's", "a\\b", 'q"q', ""}
    assert mapped(spark, [*sorted(words), "its", None], lambda x: lex.among(x, words)) == [True] * 4 + [False, None]
    assert mapped(spark, ["it's"], lambda x: F.element_at(lex.mapping({"it's": "a'b"}), x)) == ["a'b"]
    assert mapped(spark, ["a"], lambda x: lex.among(x, [])) == [False]


def test_sql_functions_like_the_expressions(spark):
    texts = ["A.b, c। d॥", " (x) ", "", None, "घरx", "काा", "ज़", "सौ", "स्टेशन", "it's \"…\" — ok"]
    names = registry.register(spark, "t_")
    assert len(names) == len(registry.definitions())
    column(spark, texts).createOrReplaceTempView("t_texts")
    said = {
        "align_text": T.for_alignment, "composed_wer_text": lambda x: T.for_error_rate(x, compose=False), "strip_marks": T.strip_marks, "detector_clean": T.detector_clean, "number_value": numbers.number_value,
        "has_latin": T.has_latin, "only_devanagari": T.only_devanagari, "sound_structure": T.sound_structure, "english_ending": T.english_ending, "has_nukta": T.has_nukta,
    }
    for name, f in said.items():
        assert [r[0] for r in spark.sql(f"select t_{name}(x) from t_texts order by i").collect()] == mapped(spark, texts, f), name
    row = spark.sql("select t_normalized_distance('ab', 'abc') as d, t_normalized_distance('', 'a') as e, t_half_even(2.5, 0) as h").first()
    assert (row.d, row.e, row.h) == (pytest.approx(1 / 3), 1.0, 2.0)
