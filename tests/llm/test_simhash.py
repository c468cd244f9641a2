"""SimHash near-dedup against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from patraka.llm import simhash
from patraka.llm.queries import op1_simhash_dedup

BLANKS = " \t\n\x0b\x0c\r"


def plain_fingerprint(text: str | None) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for b in BLANKS:
        low = low.replace(b, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps: list[int]) -> list[int]:
    parent = list(range(len(fps)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def check(spark, rows: list[tuple[int, str | None]]) -> None:
    rows = sorted(rows, key=lambda r: r[0])
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(fps)
    expected = sorted((i, f"{fp:016x}", rows[r][0]) for (i, _), fp, r in zip(rows, fps, roots))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == expected


def test_query_like_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = sorted((r.doc_id, r.text) for r in docs)
    fps = [plain_fingerprint(t) for _, t in rows]
    expected = sorted((i, f"{fp:016x}", rows[r][0]) for (i, _), fp, r in zip(rows, fps, plain_components(fps)))
    assert sorted(map(tuple, op1_simhash_dedup(spark, sf).collect())) == expected


def test_odd_texts(spark):
    rng = random.Random(1)
    long_ = " ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(80_000))
    texts = [None, "", " \n ", "One", "one", "one two", "One\ttwo", "a b c", "A  B\x0bC", "é É", long_, long_ + " x", "a\x00b c"]
    check(spark, list(enumerate(texts, 5)))


def test_near_copies_at_every_distance(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(400)}" for _ in range(300)]
    rows = [(0, " ".join(words))]
    for i in range(1, 60):
        own = list(words)
        for _ in range(rng.randrange(12)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(400)}"
        rows.append((i * 7, " ".join(own)))
    check(spark, rows)


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(3, "a b"), (3, "a b"), (None, "a b"), (None, "x y z"), (1, "q r s t")], "doc_id long, text string")
    got = simhash.near_duplicates(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in got if r.fingerprint == f"{plain_fingerprint('a b'):016x}") == [(False, 3, 3), (False, 3, 3), (True, 0, 3)]
    assert [r.component_id for r in got if r.fingerprint == f"{plain_fingerprint('x y z'):016x}"] == [None]


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, fp string, component_id string")
    assert simhash.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", 6, "y")], "doc_id long, text string, fp int, component_id string")
    assert sorted(r.component_id for r in simhash.near_duplicates(df).collect()) == [1, 1]
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, "a", 5, "x")]


@pytest.mark.parametrize("n,spread", [(50, 1), (300, 1), (300, 4), (40, 64)])
def test_links_like_brute_force(spark, n, spread):
    rng = random.Random(n * spread)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = set()
    for _ in range(n):
        fp = rng.choice(centres)
        for _ in range(rng.randrange(4 * spread) if spread < 64 else 64):
            fp ^= 1 << rng.randrange(64)
        fps.add(fp)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.connected_components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")))
    found = {r.node: r.component for r in got.collect()}
    groups: dict[int, set[int]] = {}
    for f, s in zip(fps, signed):
        groups.setdefault(found.get(s, s), set()).add(f)
    expected: dict[int, set[int]] = {}
    for f, r in zip(fps, plain_components(fps)):
        expected.setdefault(r, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


@pytest.mark.parametrize("huge", [20_000, 10])
def test_large_groups(monkeypatch, huge):
    monkeypatch.setattr(simhash, "HUGE", huge)
    rng = random.Random(9)
    fps = sorted({0xABCDEF ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for _ in range(400)})
    got = simhash.large_group(np.array(fps, dtype=np.uint64))
    root = dict(zip(got[:, 0].tolist(), got[:, 1].tolist()))
    expected = plain_components(fps)
    assert [root.get(f, f) for f in fps] == [fps[r] for r in expected]


def test_keep_first_is_deterministic(spark):
    rows = [(4, "a b c d e f g", "p"), (2, "a b c d e f g", "q"), (2, "zz yy", "r"), (2, "zz yy", "s"), (None, "null", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = sorted(map(str, simhash.keep_first(df).collect()))
    assert first == sorted(map(str, simhash.keep_first(df.repartition(4)).collect()))
    assert sorted(r.text for r in simhash.keep_first(df).collect()) == ["a b c d e f g", "null", "zz yy"]
    assert simhash.keep_first(df).where(F.col("text").startswith("a b")).first().source == "q"


def test_runs_of_one_key_over_many_batches():
    import pyarrow as pa

    rng = random.Random(3)
    rows = sorted((rng.choice([1, 2, 2, 2, 2, 5, 9]), rng.getrandbits(40)) for _ in range(500))
    batch = lambda part: pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in part], pa.int64()), "fp": pa.array([f for _, f in part], pa.int64())})
    parts = [rows[i : i + 7] for i in range(0, 500, 7)]
    got = [(k, f) for keys, fps in simhash.groups(map(batch, [[], *parts, []])) for k, f in zip(keys.tolist(), fps.tolist())]
    several = {k for k in {k for k, _ in rows} if sum(x == k for x, _ in rows) > 1}
    assert got == [(k, f) for k, f in rows if k in several]
    assert list(simhash.groups(iter([]))) == []
