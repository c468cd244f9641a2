"""Language-model scores: exact counts and base, and a plain sampler for the model's own scores."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from patraka.llm import lm
from patraka.llm.queries import op6_lm_score

END = "\x00end"


def words(text: str | None) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w] + [END]


def held(i: int) -> bool:
    return zlib.crc32(str(i).encode()) % 7 == 2


def check_counts(rows, got) -> None:
    count = Counter(w for i, t in rows if i is not None and not held(i) for w in words(t))
    n, v = sum(count.values()), len(count)
    expected = []
    for i, t in rows:
        own = words(t)
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own)
        expected.append((i or -1, i is not None and held(i), len(own), sum(count[w] > 0 for w in own), n, base))
    found = [(r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got]
    for a, b in zip(sorted(found), sorted(expected), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])


def test_query_counts_like_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op6_lm_score(spark, sf).collect()
    check_counts(rows, got)
    assert all(r.score <= 0 for r in got)
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_odd_texts(spark):
    long_ = " ".join(random.Random(2).choice("abcdefgh") for _ in range(700_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One one"), (4, "One one"), (None, "secret words"), (5, long_), (6, "é É\x0bz"), (7, "tab\tnew\nline")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "'x' as bucket")
    check_counts(rows, lm.score(df).collect())
    assert lm.score(df.limit(0)).count() == 0
    alone = lm.score(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert (alone.train_tokens, alone.n_known, alone.base_score, alone.held_out) == (0, 0, 0.0, False)


def plain_model(texts: list[list[str]], sweeps: int = 60, burn: int = 20, seed: int = 0, others: list[list[str]] = ()):
    """Seating customer by customer; averaged probabilities of all pairs of the texts, and of ``others`` that aren't learned from."""
    rng = random.Random(seed)
    d, a, d0, a0 = lm.DISCOUNT, lm.STRENGTH, lm.ROOT_DISCOUNT, lm.ROOT_STRENGTH
    v = len({w for t in texts for w in t})
    tables: dict = defaultdict(lambda: defaultdict(list))  # context -> word -> sizes
    root: dict = defaultdict(list)

    def totals(r):
        return sum(sum(x) for x in r.values()), sum(len(x) for x in r.values())

    def p_root(w):
        c, t = totals(root)
        return (sum(root[w]) - d0 * len(root[w]) + (a0 + d0 * t) / (v + 1)) / (a0 + c)

    def p(u, w):
        c, t = totals(tables[u])
        return (sum(tables[u][w]) - d * len(tables[u][w]) + (a + d * t) * p_root(w)) / (a + c)

    def sit(sizes, discount, open_weight):
        weights = [x - discount for x in sizes] + [open_weight]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(sizes):
            sizes.append(1)
            return True
        sizes[k] += 1
        return False

    def add(u, w):
        _, t = totals(tables[u])
        if sit(tables[u][w], d, (a + d * t) * p_root(w)):
            _, t0 = totals(root)
            sit(root[w], d0, (a0 + d0 * t0) / (v + 1))

    def leave(sizes):
        k = rng.choices(range(len(sizes)), sizes)[0]
        sizes[k] -= 1
        if not sizes[k]:
            sizes.pop(k)
            return True
        return False

    pairs = [(u, w) for t in texts for u, w in zip([None, *t], t)]
    for u, w in pairs:
        add(u, w)
    kept: dict = defaultdict(float)
    asked = sorted({(u, w) for t in [*texts, *others] for u, w in zip([None, *t], t)}, key=str)
    for s in range(sweeps):
        for u, w in pairs:
            if leave(tables[u][w]):
                leave(root[w])
            add(u, w)
        if s >= burn:
            for pair in asked:
                kept[pair] += p(*pair) / (sweeps - burn)
    return kept


def test_scores_like_a_plain_sampler(spark):
    rng = random.Random(3)
    letters = [chr(97 + k) for k in range(12)]
    rows = [(i, " ".join(rng.choices(letters, [1 / (k + 1) for k in range(12)], k=14))) for i in range(60)]
    kept = plain_model([words(t) for i, t in rows if not held(i)])
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        if not held(i):
            own = words(t)
            expected = sum(math.log10(kept[u, w]) for u, w in zip([None, *own], own))
            assert got[i] == pytest.approx(expected, rel=0.04)


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=20))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first, again = ({r.doc_id: r.score for r in lm.score(x).collect()} for x in (df, df.repartition(5)))
    assert first == pytest.approx(again)


def test_stirling_numbers_are_those_of_the_recursion():
    got = np.exp(lm.stirling(0.5, 6))
    plain = np.zeros((7, 7))
    plain[1, 1] = 1
    for c in range(1, 6):
        for t in range(1, 7):
            plain[c + 1, t] = plain[c, t - 1] + max(c - 0.5 * t, 0) * plain[c, t]
    assert np.allclose(got, plain)


def test_large_groups_of_customers_open_as_many_tables_as_one_by_one():
    rng = np.random.default_rng(5)
    table = lm.stirling(lm.DISCOUNT)
    fast = lm.seat(np.full(400, 500), np.full(400, 1.0), lm.Parent(np.full(400, 0.05), np.ones(400)), lm.DISCOUNT, table, rng).mean()
    slow = []
    for _ in range(400):
        t = 1
        for c in range(1, 500):
            new = (1.0 + lm.DISCOUNT * t) * 0.05
            t += rng.random() < new / (new + c - lm.DISCOUNT * t)
        slow.append(t)
    assert fast == pytest.approx(np.mean(slow), rel=0.1)


def test_many_null_ids_with_different_texts(spark):
    rng = random.Random(8)
    texts = ["one"] + [" ".join(rng.choice("abcdefghij") for _ in range(1 + i % 40)) + f" t{i}" for i in range(1500)]
    df = spark.createDataFrame([(None, t) for t in texts] + [(1, "a b c d")], "doc_id long, text string")
    got = sorted(r.n_tokens for r in lm.score(df).collect() if r.doc_id is None)
    assert got == sorted(len(t.split()) + 1 for t in texts)


@pytest.mark.parametrize("shard,most", [(1 << 24, 0.04), (1500, 0.06), (400, 0.09)])
def test_scores_over_shards_like_a_plain_sampler(spark, monkeypatch, shard, most):
    """One shard, four and about fourteen; held-out rows too. What shards exchange once is an estimate, so that many tiny ones differ more."""
    monkeypatch.setattr(lm, "SHARD", shard)
    rng = random.Random(3)
    letters = [chr(97 + k) for k in range(12)]
    rows = [(i, " ".join(rng.choices(letters, [1 / (k + 1) for k in range(12)], k=14))) for i in range(60)]
    kept = plain_model([words(t) for i, t in rows if not held(i)], others=[words(t) for i, t in rows if held(i)])
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    off = {}
    for i, t in rows:
        own = words(t)
        off[i] = got[i] / sum(math.log10(kept[u, w]) for u, w in zip([None, *own], own)) - 1
    assert any(held(i) for i in off)
    assert max(map(abs, off.values())) < most


def test_exchange_by_groups_gives_each_shard_its_totals(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice("abcdefghijklmnopq") + str(rng.randrange(20)) for _ in range(30))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for shard in (1 << 24, 3000, 300):
        monkeypatch.setattr(lm, "SHARD", shard)
        check_counts(rows, lm.score(df).collect())
