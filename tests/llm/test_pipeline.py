"""The corpus pipeline: each stage on its predecessor's rows, against plain versions."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
import sentencepiece

from patraka.llm import mix, pieces
from tests.llm.test_shingles import plain_first
from tests.llm.test_suffix import N


@pytest.fixture(scope="module")
def stages(spark, sf):
    from patraka.llm.common import materialize

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(materialize(f(spark, out[-1], sf)))
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[0])


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeats", "mixture", "tokens"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_language_keeps_clean_documents(stages):
    before, after = rows(stages[0]), set(rows(stages[1]))
    assert after <= set(before)
    clean = [r for r in before if r[1] and r[2] and sum(c.isalpha() for c in r[1]) > 200]
    assert sum(r in after for r in clean) >= 0.99 * len(clean)


def test_one_of_each_group_stays(stages):
    before, after = rows(stages[1]), rows(stages[2])
    first = set(plain_first([(r[0], r[1]) for r in before]))
    assert after == [r for r in before if r[0] in first]


def test_repeats_are_cut(stages):
    before, after = rows(stages[2]), {r[0]: r for r in rows(stages[3])}
    seen: set[bytes] = set()
    for r in before:
        text = (r[1] or "").encode()
        own = [text[k : k + N] for k in range(len(text) - N + 1)]
        gone = bytearray(len(text))
        for k, w in enumerate(own):
            if w in seen:
                gone[k : k + N] = b"\x01" * N
        kept = bytes(b for b, g in zip(text, gone) if not g).decode("utf-8", "ignore")
        assert (after[r[0]][1] if r[0] in after else "") == kept
        seen.update(own)


def test_mixture_takes_whole_copies(stages):
    before, after = rows(stages[3]), rows(stages[4])
    counted = Counter(r[0] for r in after)
    assert max(counted.values()) <= 3
    assert {r for r in after} <= set(before)
    report = {r.doc_id: r.copies for r in mix.mix_report(stages[3]).collect()}
    assert counted == Counter({i: n for i, n in report.items() if n})


def test_tokens_like_the_library(stages, spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {r[0]: r[1] for r in rows(stages[4])}
    got = stages[5].collect()
    assert len(got) == stages[4].count()
    assert all(list(r.token_ids) == library.encode(texts[r.doc_id]) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, corpus_pipeline.run(spark, sf).collect()))


ODD = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, fp string, lang_pred int"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows_and_an_empty_table(spark, name, stage):
    long_ = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "The same words stand here twice, in this table of odd rows.", "en", "a", 59)]
    rows += [(3, rows[2][1], "en", "a", 59), (None, "No id at all, but words in plenty to be found here.", "en", None, 51), (4, long_, "en", "b", len(long_))]
    df = spark.createDataFrame([(*r, "k", 1, "f", 2) for r in rows], ODD)
    got, empty = stage(spark, df, ""), stage(spark, df.limit(0), "")
    assert empty.count() == 0 and empty.columns == got.columns
    if name != "tokens":
        assert got.columns == df.columns
        assert {r.doc_id for r in got.collect()} <= {None, 1, 2, 3, 4}
    else:
        assert got.count() == len(rows)
    if name == "language":
        assert not {1, 2} & {r.doc_id for r in got.collect()}
