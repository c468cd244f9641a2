"""Embedding operators against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from patraka.llm import vectors
from patraka.llm.queries import ORACLES, op7_embedding_dedup, op9_nearest
from tests.compare import duck, same

KIND = "vec_id long, embedding array<float>, label int"


def table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    return [(r.vec_id, r.embedding) for r in rows]


def good(v) -> bool:
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = np.asarray(a, float), np.asarray(b, float)
    return (a / np.linalg.norm(a, axis=-1, keepdims=True)) @ (b / np.linalg.norm(b, axis=-1, keepdims=True)).T


def plain_links(rows) -> dict[int, tuple[int, int]]:
    """By vec_id: number of links, smallest reachable."""
    own = sorted((i, v) for i, v in rows if good(v))
    out = {i: (0, i) for i, _ in rows}
    if not own:
        return out
    near = cosines([v for _, v in own], [v for _, v in own]) >= 0.95
    np.fill_diagonal(near, False)
    root = list(range(len(own)))
    changed = True
    while changed:
        changed = False
        for i in range(len(own)):
            low = min([root[i], *(root[j] for j in np.flatnonzero(near[i]))])
            if low < root[i]:
                root[i], changed = low, True
    return out | {own[i][0]: (int(near[i].sum()), own[root[i]][0]) for i in range(len(own))}


def test_dedup_query(spark, sf):
    expected = plain_links(table(spark, sf))
    got = {r.vec_id: (r.n_links, r.component_id) for r in op7_embedding_dedup(spark, sf).collect()}
    assert got == expected


def test_dedup_query_like_sql(spark, sf):
    same(op7_embedding_dedup(spark, sf), duck(sf), ORACLES["op7_embedding_dedup"])


@pytest.mark.parametrize("block", [40, 4096])
def test_planted_groups(spark, block):
    rng = np.random.default_rng(5)
    rows, centres = [], rng.normal(size=(30, 24))
    for i in range(400):
        v = centres[i % 30] * rng.uniform(0.1, 9) + rng.normal(size=24) * rng.choice([0, 0.05, 0.2, 2.0])
        rows.append((i, [float(x) for x in np.float32(v)]))
    expected = plain_links(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df, block=block).collect()}
    assert got == expected


ODD = [(0, None, 1), (1, [], 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 2), (5, [float("inf"), 1.0], 2)]
PLAIN = [(10, [1.0, 0.0], 1), (11, [3.0, 0.0], 2), (12, [1.0, 0.0], 3), (13, [-1.0, 0.0], 1), (14, [1.0, 0.0, 0.0], 1), (15, [1e-30, 0.0], 1), (50, [0.0, 2.0], 1)]


def test_dedup_of_odd_rows(spark):
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(spark.createDataFrame(ODD + PLAIN, KIND)).collect()}
    assert got == {i: (0, i, True) for i, _, _ in ODD} | {10: (3, 10, True), 11: (3, 10, False), 12: (3, 10, False), 15: (3, 10, False), 13: (0, 13, True), 14: (0, 14, True), 50: (0, 50, True)}
    assert vectors.near_duplicates(spark.createDataFrame(ODD, KIND)).count() == len(ODD)
    assert vectors.near_duplicates(spark.createDataFrame([], KIND)).count() == 0
    twice = spark.createDataFrame([(7, [1.0, 2.0], 0), (7, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)], KIND).selectExpr("*", "1 as links", "2 as rep")
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in vectors.near_duplicates(twice).collect()) == [(0, 2, 7), (7, 2, 7), (7, 2, 7)]


def plain_nearest(rows, every: int, k: int) -> dict[int, list[tuple[float, int]]]:
    own = sorted((i, v) for i, v in rows if good(v))
    out = {}
    for i, v in own:
        if i % every == 0:
            others = [(j, w) for j, w in own if j != i and len(w) == len(v)]
            c = cosines([v], [w for _, w in others])[0] if others else []
            out[i] = sorted(((-x, j) for x, (j, _) in zip(c, others)))[:k]
    return out


def test_nearest_query_recall(spark, sf):
    rows = table(spark, sf)
    expected = plain_nearest(rows, 50, 5)
    vector = {i: v for i, v in rows}
    got: dict[int, list] = {}
    for r in op9_nearest(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(expected)
    hits = 0
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, len(expected[q]) + 1))
        for _, j, s in found:
            assert j != q and s == pytest.approx(float(cosines([vector[q]], [vector[j]])[0, 0]), abs=1e-12)
        assert [(-s, j) for _, j, s in found] == sorted((-s, j) for _, j, s in found)
        hits += len({j for _, j, _ in found} & {j for _, j in expected[q]})
    assert hits >= 0.9 * sum(map(len, expected.values()))


def test_recall_over_shards(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(6000, 32)))]
    expected = plain_nearest([r for r in rows], 50, 5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found: dict[int, set[int]] = {}
    for r in vectors.nearest(df, shard=1500).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(found[q] & {j for _, j in best}) for q, best in expected.items())
    assert hits >= 0.9 * sum(map(len, expected.values()))


def test_nearest_of_odd_rows(spark):
    df = spark.createDataFrame(ODD + PLAIN + [(None, [1.0, 0.0], 1), (100, [1.0, 0.0, 0.0], 1)], KIND).selectExpr("*", "1 as rank", "2 as score")
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in vectors.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(50, 1, 10, 0.0), (50, 2, 11, 0.0), (50, 3, 12, 0.0), (50, 4, 13, 0.0), (50, 5, 15, 0.0), (100, 1, 14, 1.0)]
    assert vectors.nearest(df.limit(0)).count() == 0


def test_null_id_between_two_others(spark):
    at = lambda d: [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))]
    rows = [(5, at(0.0)), (None, at(15.0)), (9, at(30.0)), (4, at(120.0)), (None, at(200.0))]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=lambda r: (r[0] or 0, r[2] or 0)) == [(None, 0, None, False), (None, 2, 5, False), (4, 0, 4, True), (5, 1, 5, True), (9, 1, 5, False)]


def test_repeated_query_rows_keep_their_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(60)]
    kind = "vec_id long, embedding array<double>"
    once = sorted(map(tuple, vectors.nearest(spark.createDataFrame(rows, kind)).collect()))
    again = sorted(map(tuple, vectors.nearest(spark.createDataFrame(rows * 3, kind)).collect()))
    assert once and again == once


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_recall_of_a_whole_shard(spread):
    """A full shard of vectors without structure, and of vectors in groups, where the ascent stops early."""
    rng = np.random.default_rng(7)
    n = vectors.SHARD
    x = rng.normal(size=(n, 64)) + spread * rng.normal(size=(400, 64))[rng.integers(0, 400, n)]
    ids = np.arange(n)
    asked = ids[::80]
    got = vectors.search(x, ids, x[asked], asked, 5).to_pydict()
    found: dict[int, set[int]] = {}
    for q, v in zip(got["query_id"], got["vec_id"]):
        found.setdefault(q, set()).add(v)
    near = cosines(x[asked], x)
    near[np.arange(len(asked)), asked] = -2
    best = np.argsort(-near, axis=1)[:, :5]
    hits = sum(len(found[q] & set(b.tolist())) for q, b in zip(asked.tolist(), best))
    assert hits >= 0.95 * best.size


def test_ascent_scores_few_rows_where_neighbours_are_near():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 64))[rng.integers(0, 200, 8000)] + 0.05 * rng.normal(size=(8000, 64))
    xn = vectors.unit(x)
    forest = vectors.Forest(xn, xn[:100], vectors.TREES)
    depth = forest.descend(100, vectors.FIRST)
    found = vectors.candidates(forest, xn, xn[:100], np.arange(8000), np.arange(100), np.arange(100), depth)
    kth = np.array([np.sort(s)[-5] for _, s in found])
    assert (depth <= vectors.enough(kth, vectors.TREES, vectors.MISS)).mean() > 0.9
    assert np.mean([len(r) for r, _ in found]) < 800


def test_recall_over_many_shards(spark):
    """A hundred thousand vectors, in seven shards."""
    from pyspark.sql import functions as F

    df = spark.range(100_000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.sqrt(-2 * F.log((F.pmod(F.xxhash64("id", k), F.lit(1 << 30)) + 1) / float(1 << 30))) * F.cos(2 * np.pi * F.pmod(F.xxhash64("id", k, F.lit(1)), F.lit(1 << 30)) / float(1 << 30))).cast("array<float>").alias("embedding"))
    rows = df.toArrow()
    x, ids = vectors.unit(vectors.matrix(rows["embedding"])), rows["vec_id"].to_numpy()
    found: dict[int, set[int]] = {}
    for r in vectors.nearest(df, every=500).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    asked = np.flatnonzero(ids % 500 == 0)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -2
    best = np.argpartition(-near, 5, axis=1)[:, :5]
    hits = sum(len(found[int(ids[q])] & set(ids[b].tolist())) for q, b in zip(asked, best))
    assert hits >= 0.9 * best.size
