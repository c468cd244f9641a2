"""Language identification: held-out accuracy and odd texts."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from patraka.llm import langid
from patraka.llm.queries import op4_language_id

SENTENCES = {
    "en": "the house by the river was built when people still thought that winter would never come to this valley",
    "de": "das haus am fluss wurde gebaut als die leute noch dachten dass der winter niemals in dieses tal kommen würde",
    "fr": "la maison au bord de la rivière fut construite quand les gens pensaient que l'hiver ne viendrait jamais",
}


def labelled(spark, extra=(), kind="doc_id long, text string, lang string"):
    rows = []
    for lang, text in SENTENCES.items():
        words = text.split()
        for i in range(40):
            rows.append((len(rows) + 10, " ".join(words[i % 7 :] + words[: i % 7]), lang))
    return spark.createDataFrame(rows + list(extra), kind)


def test_query_on_held_out_rows(spark, sf):
    got = {r.doc_id: r for r in op4_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    tested = right = 0
    for d in docs:
        r = got[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if r.held_out and d.lang and d.text and len(d.text) > 100:
            tested += 1
            right += r.lang_pred == d.lang
    assert tested > 20 and right / tested >= 0.95


def test_labels_of_held_out_rows_do_not_matter(spark):
    from pyspark.sql import functions as F

    df = labelled(spark)
    wrong = df.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    key = lambda d: sorted(map(tuple, langid.identify(d).collect()))
    assert key(df) == key(wrong)


def test_odd_texts(spark):
    long_ = " ".join([SENTENCES["de"]] * 30_000)
    extra = [(1, None, "en"), (2, "", "en"), (3, "123 ... !", None), (4, long_, None), (5, "ß", None), (None, SENTENCES["fr"], "en"), (6, SENTENCES["en"], None), (6, SENTENCES["en"], None)]
    got = langid.identify(labelled(spark, extra)).where("doc_id < 10 or doc_id is null").collect()
    said = sorted((r.doc_id or 0, r.lang_pred, r.held_out) for r in got if r.doc_id != 5)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    assert said == [(0, "fr", False), (1, "und", held(1)), (2, "und", held(2)), (3, "und", held(3)), (4, "de", held(4)), (6, "en", held(6)), (6, "en", held(6))]
    assert all(r.score == 0 for r in got if r.lang_pred == "und")


def test_pieces_of_a_long_text_add_up():
    model = langid.Model(["a", "b"], np.random.default_rng(0).normal(size=(langid.BUCKETS, 2)).astype(np.float32), np.zeros(2))
    texts = ["abc def", "xyz" * 1000, "q"]
    together = langid._sums(*langid.grams(texts), model)
    alone = np.concatenate([langid._sums(*langid.grams([t]), model) for t in texts])
    assert np.allclose(together, alone)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.identify(df).collect()} == {("und", 0.0)}
    assert langid.identify(df.limit(0)).count() == 0


def test_keep_leaves_rows_as_they_are(spark):
    df = labelled(spark, [(1, "123", "en"), (2, None, "fr")]).selectExpr("*", "'x' as score", "7 as lang_pred")
    kept = langid.keep(df, langid.train(df), 0.5)
    assert kept.columns == df.columns
    assert kept.count() == df.count() - 2
    assert kept.where("doc_id in (1, 2)").count() == 0


@pytest.mark.parametrize("text", ["a", "ab", "éa", "日本語", "\U0001f600 x"])
def test_grams_are_those_of_the_text_alone(text):
    ids, offsets = langid.grams(["zz", text, "yy"])
    alone, _ = langid.grams([text])
    assert ids[offsets[1] : offsets[2]].tolist() == alone.tolist()


def test_parts_of_a_long_text_have_the_grams_of_the_whole():
    text = "Die ÖDE Straße ΟΔΟΣ ΣΑΣ liegt fern, İzmir! " * 40
    whole = np.bincount(langid.grams([text])[0], minlength=langid.BUCKETS)
    for most in (1, 2, 7, 100, 5000):
        parts = sum(np.bincount(ids, minlength=langid.BUCKETS) for ids in langid.counted_grams(text, most))
        assert (parts == whole).all()


def test_more_labels_than_the_matrix_holds(spark):
    rows = [(i, f"text {i}", f"l{i:03d}") for i in range(langid.MOST_LANGUAGES + 1)]
    with pytest.raises(ValueError, match="languages"):
        langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    model = langid.train(spark.createDataFrame(rows[:-1], "doc_id long, text string, lang string"))
    assert len(model.languages) == langid.MOST_LANGUAGES


def plain_buckets(text: str) -> list[int]:
    """Hashed n-grams one by one, in unbounded integers."""
    low, out, wrap = f"  {text.lower()} ", [], 2**64 - 1

    def mixed(x: int) -> int:
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & wrap
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & wrap
        return x ^ x >> 31

    turned = lambda x: (x << 1 & wrap) | x >> 63
    for i in range(2, len(low)):
        a, b, c = (mixed(ord(ch) + 1) for ch in low[i - 2 : i + 1])
        for k, h in enumerate((c, c ^ turned(b), c ^ turned(b ^ turned(a)))):
            out.append((h * (0x9E3779B97F4A7C15 + 2 * k) & wrap) >> 48)
    return out


def test_query_like_a_plain_naive_bayes(spark, sf):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learned = [(t, lang) for i, t, lang in docs if not held(i) and t is not None and lang is not None]
    langs = sorted({lang for _, lang in learned})
    counts = {lang: np.full(1 << 16, langid.SMOOTHING) for lang in langs}
    for t, lang in learned:
        np.add.at(counts[lang], plain_buckets(t), 1)
    logs = {lang: np.log(c / c.sum()) for lang, c in counts.items()}
    prior = {lang: np.log(sum(x == lang for _, x in learned) / len(learned)) for lang in langs}
    got = {r.doc_id: r for r in op4_language_id(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, t, _ in docs:
        if t is None or not any(ch.isalpha() for ch in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        own = plain_buckets(t)
        score = {lang: prior[lang] + logs[lang][own].sum() for lang in langs}
        best = max(score, key=score.get)
        assert got[i].lang_pred == best
        assert got[i].score == pytest.approx(1 / sum(np.exp(s - score[best]) for s in score.values()), abs=2e-3)
