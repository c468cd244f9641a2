"""Mixing sources: sizes, targets, bounds, curriculum."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from patraka.llm import mix
from patraka.llm.queries import ORACLES, op8_source_mix
from tests.compare import duck, same

KIND = "doc_id long, text string, source string"


def corpus(n: int = 400, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["web"] * 6 + ["books", "books", "code", None])
        rows.append((i, " ".join("w" for _ in range(rng.randrange(60))), source))
    return rows


def plain_targets(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        rate = left / sum(weight[s] for s in free) if free else 0.0
        over = {s for s in free if weight[s] * rate > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * rate for s in names}
        capped |= over


def verify(rows, got) -> None:
    size = {i: len((t or "").split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    by_source: dict = defaultdict(int)
    for i, n in size.items():
        by_source[source[i]] += n
    targets = plain_targets(by_source)
    taken: dict = defaultdict(int)
    assert sorted(r.doc_id for r in got) == sorted(size)
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], by_source[source[r.doc_id]])
        assert r.target == pytest.approx(targets[source[r.doc_id]])
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[source[r.doc_id]] += r.taken
    for s, t in targets.items():
        smallest = min([size[i] for i in size if source[i] == s and size[i]] or [0])
        assert abs(taken[s] - t) <= max(smallest, 0.04 * t)  # a source may have a dozen documents here


def test_query(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    verify(rows, op8_source_mix(spark, sf).collect())


def test_query_like_sql(spark, sf):
    same(op8_source_mix(spark, sf), duck(sf), ORACLES["op8_source_mix"])


def test_small_sources_stop_at_three_times(spark):
    rows = [*corpus(), (1000, "a b c", "aaa"), (1001, None, "zzz"), (1002, "", "zzz")]
    df = spark.createDataFrame(rows, KIND)
    got = mix.mix_report(df).collect()
    verify(rows, got)
    assert [r.taken for r in got if r.doc_id == 1000] == [9]
    assert [r.taken for r in got if r.doc_id in (1001, 1002)] == [0, 0]


def test_reruns_agree_whatever_the_partitions(spark):
    df = spark.createDataFrame(corpus(), KIND)
    key = lambda d: sorted(map(tuple, mix.mix_report(d).collect()))
    assert key(df) == key(df.repartition(7))


def test_repeated_rows_count_one_by_one(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (None, "q", "x"), (2, "e", None)]
    got = mix.mix_report(spark.createDataFrame(rows, KIND)).collect()
    assert len(got) == 4 and {r.source_size for r in got if r.size == 4} == {9}
    assert mix.mix_report(spark.createDataFrame([], KIND)).count() == 0


def test_mixed_rows_follow_the_plan(spark):
    rows = corpus(200, 3)
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], KIND + ", positions int, turn string")
    copies = {r.doc_id: r.copies for r in mix.mix_report(df).collect()}
    got = mix.mixed(df)
    assert got.columns == df.columns
    counted = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert counted == {i: n for i, n in copies.items() if n}
    order = [r.doc_id for r in got.collect()]
    assert order == [r.doc_id for r in mix.mixed(df.repartition(5)).collect()]


@pytest.mark.parametrize("schedule", mix.SCHEDULES)
def test_positions_invert_the_cumulative_demand(spark, schedule):
    def demand(t: float) -> float:
        out = 0.0
        for (t0, a), (t1, b) in zip(schedule, schedule[1:]):
            x = min(max(t, t0), t1)
            out += (x - t0) * (a + a + (b - a) * (x - t0) / (t1 - t0)) / 2
        return out

    shares = [k / 100 for k in range(101)]
    df = spark.createDataFrame([(s,) for s in shares], "s double")
    got = [r[0] for r in df.select(mix.position(F.col("s"), schedule)).collect()]
    assert got == sorted(got)
    for s, t in zip(shares, got):
        assert demand(t) == pytest.approx(s * demand(1.0), abs=1e-9)


def test_heavy_sources_come_early(spark):
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(900)]
    got = mix.plan(spark.createDataFrame(rows, KIND)).select("source", F.explode("positions").alias("at")).groupBy("source").agg(F.avg("at").alias("mean"), F.max("at").alias("last")).collect()
    mean = {r.source: r["mean"] for r in got}
    assert mean["a"] < mean["b"] < mean["c"]
    assert all(r["last"] <= 1 for r in got)


@pytest.mark.parametrize("text", ["", " ", "a", " a b ", "a\x0bb\x0cc\rd\te\nf", "é à"])
def test_word_counts(spark, text):
    own = len([w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w])
    df = spark.createDataFrame([(1, text), (2, (text + " ") * (1 << 18)), (3, None)], "i long, text string")
    got = {r.i: r.n for r in df.select("i", mix.n_words(F.col("text")).alias("n")).collect()}
    assert got == {1: own, 2: (1 << 18) * own, 3: 0}


def filled(rows, got) -> dict:
    """By source: what was taken, of the target, in words."""
    source, out = {i: s for i, _, s in rows}, defaultdict(lambda: [0, 0.0])
    for r in got:
        out[source[r.doc_id]][0] += r.taken
        out[source[r.doc_id]][1] = r.target
    return out


def test_one_long_document_keeps_no_others_out(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(20, 400), "b") for i in range(200)]
    rows += [(1000, "w " * 100_000, "b"), (1001, "w " * 60_000, "a"), (1002, "w " * 1000, "c")]
    df = spark.createDataFrame(rows, KIND)
    got = mix.mix_report(df).collect()
    taken, target = filled(rows, got)["b"]
    assert abs(taken - target) <= 20
    assert all(0 <= r.first_position <= 1 for r in got if r.copies)
    counted = {r.doc_id: r["count"] for r in mix.mixed(df).groupBy("doc_id").count().collect()}
    assert counted == {r.doc_id: r.copies for r in got if r.copies}


def test_repeated_rows_are_taken_one_by_one(spark):
    rows = [(7, "a b c d e", "x")] * 1000 + [(8, "w " * 3000, "y"), (9, "w " * 9000, "z")]
    df = spark.createDataFrame(rows, KIND)
    got = mix.mix_report(df).collect()
    taken, target = filled(rows, got)["x"]
    assert abs(taken - target) <= 5 and max(r.copies for r in got) <= 3
    assert len({r.copies for r in got if r.doc_id == 7}) <= 2
    assert mix.mixed(df).where("doc_id = 7").count() == sum(r.copies for r in got if r.doc_id == 7)


def test_positions_and_odd_rows_of_the_mixture(spark):
    rows = [(i, "w " * (1 + i % 7), "ab"[i % 2]) for i in range(40)] + [(None, "q r", "a"), (90, None, "a"), (91, "", "b"), (92, "x", None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], KIND + ", size int, target int")
    got = mix.mixed(df, position="at").collect()
    assert all(0 <= r["at"] <= 1 for r in got) and [r["at"] for r in got] == sorted(r["at"] for r in got)
    assert not {90, 91} & {r.doc_id for r in got} and any(r.doc_id is None for r in got)
    assert mix.mixed(df.limit(0)).columns == df.columns and mix.mixed(df.limit(0)).count() == 0
