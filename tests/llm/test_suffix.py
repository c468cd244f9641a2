"""Suffix-array dedup against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest

from patraka.llm import suffix
from patraka.llm.queries import op2_suffix_dedup

N = suffix.LENGTH


def plain(rows: list[tuple[int, str | None]]) -> list[tuple]:
    first: dict[bytes, int] = {}
    texts = sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: r[0])
    for i, text in texts:
        for k in range(len(text) - N + 1):
            first.setdefault(text[k : k + N], i)
    out = []
    for i, text in texts:
        gone = bytearray(len(text))
        for k in range(len(text) - N + 1):
            if first[text[k : k + N]] < i:
                gone[k : k + N] = b"\x01" * N
        spans = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        kept = bytes(b for b, g in zip(text, gone) if not g)
        out.append((i, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, suffix.deduplicate(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))


def test_query_like_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected = plain(rows)
    assert sorted(map(tuple, op2_suffix_dedup(spark, sf).collect())) == expected
    assert any(r[2] for r in expected)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aé漢"])
def test_shared_passages(spark, letters):
    rng = random.Random(letters)
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [word(rng.randrange(45, 160)) for _ in range(12)]
    rows = [(i * 3, word(rng.randrange(60)) + "".join(rng.choice(passages) + word(rng.randrange(40)) for _ in range(rng.randrange(5)))) for i in range(40)]
    assert run(spark, rows) == plain(rows)


def test_a_cell_twice_in_its_first_document(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    a, b = word(90), word(90)
    end = a[20:] + "?" + word(30)
    rows = [(1, a + b), (2, "x" + end + "yy" + end + "z" + a[:60] + "!" + a[:60]), (2, "q" + end), (3, end)]
    assert run(spark, rows[:2] + rows[3:]) == plain(rows[:2] + rows[3:])
    got = {(r[0], r[1]): r[2] for r in run(spark, rows)}
    assert got[2, len(rows[2][1])] == 70


def test_runs_of_one_byte_and_cut_passages(spark):
    whole = "".join(random.Random(4).choice("abcdefghij ") for _ in range(400))
    rows = [(1, "x" * 300), (2, "x" * 49), (3, "x" * 50), (4, "y" * 10 + "x" * 70), (5, whole), (6, whole[100:149]), (7, whole[100:150]), (8, whole[1:120] + "?" + whole[120:]), (9, whole)]
    assert run(spark, rows) == plain(rows)


def test_long_texts_cross_pieces(spark):
    rng = random.Random(6)
    long_ = "".join(rng.choice("abcdefghijklmnop ") for _ in range(suffix.PIECE + 70_000))
    rows = [(1, long_), (2, "zz" + long_[5000:40_000]), (3, long_[suffix.PIECE - 500 : suffix.PIECE + 900]), (4, "q" + long_)]
    assert run(spark, rows) == plain(rows)


def test_edge_rows(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away from it"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (3, "")], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix.deduplicate(df).collect()}
    assert got == {(1, len(text)): 0, (None, len(text)): len(text), (2, 0): 0, (3, 0): 0}
    assert suffix.deduplicate(df).count() == 5
    assert suffix.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cut_keeps_columns_and_drops_what_is_empty(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away from it"
    df = spark.createDataFrame([(1, text, "a", 69, 7), (2, text, "b", 69, 8), (3, "tail " + text, "c", 74, 9), (4, None, "d", 0, None)], "doc_id long, text string, id string, n_chars long, bucket int")
    got = suffix.cut_repeats(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.select("doc_id", "text", "id", "n_chars", "bucket").collect()), key=lambda r: r[0]) == [(1, text, "a", 69, 7), (3, "tail ", "c", 5, 9), (4, None, "d", 0, None)]


def test_index_levels_grow_geometrically():
    import numpy as np

    rng = np.random.default_rng(0)
    anchors = rng.integers(0, 2**64, 300, dtype=np.uint64)
    index = suffix.LogIndex()
    seen: dict[tuple[int, int], int] = {}
    for batch in range(40):
        h, c = anchors[rng.integers(0, 300, 50)], rng.integers(0, 3, 50).astype(np.uint64)
        doc = np.sort(rng.integers(batch * 10, batch * 10 + 10, 50))
        found = index.add(h, c, doc)
        for a, b, d in zip(h.tolist(), c.tolist(), doc.tolist()):
            seen[a, b] = min(seen.get((a, b), d), d)
        assert found.tolist() == [seen[a, b] < d for a, b, d in zip(h.tolist(), c.tolist(), doc.tolist())]
        sizes = [len(x[0]) for x in index.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))


def test_entries_that_share_their_short_key():
    import numpy as np

    rng = np.random.default_rng(2)
    h = rng.integers(0, 3, 400).astype(np.uint64)  # differ in the low bits only, which the short key leaves out
    c = rng.integers(0, 3, 400).astype(np.uint64)
    doc = np.arange(400)
    index, seen = suffix.LogIndex(), {}
    for at in range(0, 400, 25):
        found = index.add(h[at : at + 25], c[at : at + 25], doc[at : at + 25])
        for a, b, d, f in zip(h[at : at + 25].tolist(), c[at : at + 25].tolist(), doc[at : at + 25].tolist(), found.tolist()):
            assert f == (seen.setdefault((a, b), d) < d)
    a, b = np.array([1], np.uint64), np.array([2], np.uint64)
    index = suffix.LogIndex()
    assert [bool(index.add(x, a, np.array([d]))[0]) for x, d in ((a, 1), (b, 2), (a, 3))] == [False, False, True]


def test_many_continuations_of_one_passage(spark):
    rng = random.Random(21)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = word(120)
    rows = [(i, word(rng.randrange(30)) + shared[rng.randrange(40) :] + word(80)) for i in range(150)]
    assert run(spark, rows) == plain(rows)
