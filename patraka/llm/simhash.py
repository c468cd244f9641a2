"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints link at ``RADIUS`` = 3 differing bits or fewer. Half of that is one bit and a half: the
64 bits are cut into three blocks and one block at a time is left out. Of three differing bits, leaving
out a block that holds one of them leaves at most two, so that the two fingerprints' balls of radius one
over the remaining bits meet in a variant. Each fingerprint thus emits 1 + (64 - block) variants for each
block left out (131 in all, where a ball of radius two on one side would take 2,081); rows meet on the
variant, and colliding pairs are verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patraka.llm.common import connected_components, materialize, shards_for, star, text_bytes

RADIUS = 3
BLOCKS = ((0, 21), (21, 42), (42, 64))
SHINGLE = 3
SEED = 42
BALLS = 64 << 20  # bytes of variants that a task emits, about


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the lower-cased words' shingles, repeats included; 0 without a word."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0] + [e + 1 for e in ends[: -shingle]]
    ones = np.zeros(64, dtype=np.int64)
    n = len(starts)
    for i in range(0, n, 65536):  # bounded memory for very long texts
        h = np.fromiter(
            (digest(joined[s:e], seed) for s, e in zip(starts[i : i + 65536], ends[shingle - 1 + i : shingle - 1 + i + 65536])),
            dtype="<u8",
            count=min(65536, n - i),
        )
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, fp)`` for every row; fp: the 64 bits as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fp = np.array([fingerprint(t) for t in text_bytes(batch.column(2))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], schema=schema)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _text_hash(text: Column) -> Column:
    return F.coalesce(F.xxhash64(text.cast("string")), F.lit(0))


def links(fps: DataFrame) -> DataFrame:
    """``(u, v)``: links among the distinct fingerprints ``fps(fp)`` at RADIUS bits or fewer.

    Links are given as stars within each task: each fingerprint with the smallest that it reaches there.
    """
    masks = np.array([~(((1 << (to - at)) - 1) << at) & (2**64 - 1) for at, to in BLOCKS], dtype=np.uint64)
    flips = [np.array([0] + [1 << b for b in range(64) if not at <= b < to], dtype=np.uint64) for at, to in BLOCKS]
    sent = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def balls(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(0, batch.num_rows, 2048):
                own = batch.column(0).slice(i, 2048).to_numpy().view(np.uint64)
                for k, (mask, flip) in enumerate(zip(masks, flips)):
                    # the block left out holds its number, so that hardly any variants of different blocks meet
                    key = ((own & mask)[:, None] ^ flip[None, :]) | np.uint64(k + 1 << BLOCKS[k][0])
                    fp = np.repeat(own, len(flip))
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(fp.view(np.int64))], schema=sent)

    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for key, fp in groups(it):
            pairs = pairs_within(key, fp)
            found.append(pairs)
            size += len(pairs)
            if size > 1_000_000:
                found, size = [_star(np.concatenate(found))], 0
        pairs = _star(np.concatenate(found)) if found else np.empty((0, 2), dtype=np.uint64)
        for i in range(0, len(pairs), 50_000):
            part = pairs[i : i + 50_000].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], schema=out)

    # The sort spills; what a task holds in Python is one batch and the links found so far.
    met = fps.mapInArrow(balls, "key long, fp long").repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(verify, "u long, v long").distinct()


def groups(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of whole keys from batches sorted by key, only keys with two rows or more."""
    keys, fps = [], []
    for batch in it:
        if not batch.num_rows:
            continue
        keys.append(batch.column(0).to_numpy())
        fps.append(batch.column(1).to_numpy())
        if keys[-1][-1] == keys[0][0]:
            continue  # one key so far: no row is copied until it ends
        key, fp = np.concatenate(keys), np.concatenate(fps)
        whole = int(np.searchsorted(key, key[-1], side="left"))
        yield _shared(key[:whole], fp[:whole])
        keys, fps = [key[whole:]], [fp[whole:]]
    if keys:
        yield _shared(np.concatenate(keys), np.concatenate(fps))


def _shared(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    same = key[1:] == key[:-1]
    keep = np.zeros(len(key), dtype=bool)
    keep[1:] |= same
    keep[:-1] |= same
    return key[keep], fp[keep].view(np.uint64)


def pairs_within(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Verified pairs among rows of equal key: neighbours at growing offsets, then whole large groups."""
    if not len(key):
        return np.empty((0, 2), dtype=np.uint64)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    found = []
    small = np.repeat(sizes <= SMALL, sizes)
    k, f = key[small], fp[small]
    for offset in range(1, SMALL):
        if offset >= len(k):
            break
        at = np.flatnonzero(k[offset:] == k[:-offset])
        if not len(at):
            break
        a, b = f[at], f[at + offset]
        ok = np.bitwise_count(a ^ b) <= RADIUS
        found.append(np.stack([a[ok], b[ok]], axis=1))
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        found.append(large_group(fp[start : start + size]))
    return _star(np.concatenate(found)) if found else np.empty((0, 2), dtype=np.uint64)


SMALL = 64


def large_group(fp: np.ndarray) -> np.ndarray:
    """Links of one large group as stars: tiles of comparisons up to HUGE members, beyond it every member's own ball.

    The ball has 43,744 lookups a member, so that its work grows with the group's size and not its square.
    """
    own = np.sort(fp)
    found = np.empty((0, 2), dtype=np.uint64)
    if len(own) <= HUGE:
        for i in range(0, len(own), 256):
            a, b = np.nonzero(np.bitwise_count(own[i : i + 256, None] ^ own[None, i:]) <= RADIUS)
            ok = a < b
            found = _star(np.concatenate([found, np.stack([own[i + a[ok]], own[i + b[ok]]], axis=1)]))
        return found
    for flip in _ball():
        want = own ^ flip
        at = np.minimum(np.searchsorted(own, want), len(own) - 1)
        ok = (own[at] == want) & (own < want)
        if ok.any():
            found = _star(np.concatenate([found, np.stack([own[ok], want[ok]], axis=1)]))
    return found


HUGE = 20_000


def _ball() -> Iterator[np.uint64]:
    for a in range(64):
        yield np.uint64(1 << a)
        for b in range(a):
            yield np.uint64(1 << a | 1 << b)
            for c in range(b):
                yield np.uint64(1 << a | 1 << b | 1 << c)


def _star(pairs: np.ndarray) -> np.ndarray:
    if not len(pairs):
        return pairs.reshape(0, 2)
    return np.stack(star(pairs[:, 0], pairs[:, 1]), axis=1)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    Null, empty and all-blank texts have fingerprint zero and link like any other. Rows that repeat a
    doc_id each get a row. A null doc_id gets a row too but never names a component while another member
    has an id. An empty table gives an empty result; columns besides id and text are not read.
    """
    own, roots = _grouped(docs, id_col, text_col)
    lowest = own.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    reps = materialize(roots.join(lowest, "root").select("fp", "component_id"))
    return own.join(reps, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows' fingerprints, and ``(fp, root)``: components over distinct fingerprints, so that a group of copies is one node."""
    own = materialize(fingerprints(docs, id_col, text_col))
    distinct = materialize(own.select("fp").distinct())
    parts = shards_for(distinct.count() * sum(65 - (to - at) for at, to in BLOCKS) * 16, BALLS)
    comp = connected_components(links(distinct.repartition(parts, "fp")))
    return own, materialize(distinct.join(comp, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("root")))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id (null last), with all its columns.

    Among rows alike in doc_id the one with the smallest text hash stays; of rows alike in both, one.
    """
    return first_of(docs, *_grouped(docs, id_col, text_col), id_col, text_col)


def first_of(docs: DataFrame, own: DataFrame, roots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The first row of each root, from ``own(doc_id, text_hash, fp)`` and ``roots(fp, root)``."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    best = own.groupBy("fp").agg(F.min(key).alias("key")).join(roots, "fp").groupBy("root").agg(F.min("key").alias("key"))
    best = materialize(best.select(F.col("key.doc_id").alias("__id"), F.col("key.text_hash").alias("__hash")).distinct())
    held = docs.select(F.struct("*").alias("__row"), F.col(id_col).cast("long").alias("__own"), _text_hash(F.col(text_col)).alias("__text"))
    met = held.join(best, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__hash")))
    turn = Window.partitionBy("__id", "__hash").orderBy(F.xxhash64("__row"))
    return met.withColumn("__turn", F.row_number().over(turn)).where("__turn = 1").select("__row.*")
