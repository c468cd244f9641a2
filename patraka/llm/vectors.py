"""Embedding operators: exact near-dedup by cosine, and approximate nearest neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patraka.llm.common import connected_components, materialize, star

# ---------------------------------------------------------------------------------------------------
# Shared


def usable(v: Column) -> Column:
    """Whether a vector has a direction: no null or non-finite component, and one that is not zero."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


# ---------------------------------------------------------------------------------------------------
# Near-dedup: PCA-ordered tiled comparison

THRESHOLD = 0.95
BLOCK = 12_288  # vectors of a block, about; a task compares two blocks, and a vector is sent once for each block within reach
TILE = 512
PCA_SAMPLE = 20_000  # vectors that the rotation is fitted on; it only orders the work
LEAD = 16  # leading dimensions that are accumulated first, then twice as many for what is left
MANY = 20_000  # pairs of a tile beyond which the whole tile is multiplied
SLACK = 1e-4  # for single precision in the bounds; links are decided in double precision


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each row of ``vectors(vec_id, embedding)``.

    Exact: every pair with cosine of ``threshold`` or more links, whatever its label. A vector that is
    null, empty, zero or has a null or non-finite component links with nothing, and vectors of different
    length do not link. Equal vectors are compared once and counted one by one. ``kept`` is false for a
    null vec_id. An empty table gives an empty result. Other columns, of whatever name, are not read.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = own.where(usable(F.col("embedding")))
    reps = materialize(
        good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.min("vec_id").alias("real"), F.count("*").alias("copies")).withColumn("rep", F.coalesce("rep", F.lit(-1) - F.pmod(F.xxhash64("embedding"), F.lit(1 << 62))))
    )
    found = None
    for dim in [r[0] for r in reps.select(F.size("embedding")).distinct().collect()]:
        part = compared(reps.drop("real").where(F.size("embedding") == dim), dim, threshold, block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = materialize(found)
    comp = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    about = (
        reps.join(links, "rep", "left")
        .join(comp.withColumnRenamed("node", "rep"), "rep", "left")
        .select("embedding", "real", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    # A node made up for a vector without an id never names a component.
    about = materialize(about)
    lowest = about.groupBy("component").agg(F.min("real").alias("least"))
    rows = own.join(about.join(lowest, "component").select("embedding", "links", "least"), "embedding", "left")
    component = F.coalesce("least", "vec_id")
    return rows.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def compared(reps: DataFrame, dim: int, threshold: float, block: int) -> DataFrame:
    """``(rep, root, links)``: by task, each linked vector with the smallest it reaches and its links' copies."""
    n = reps.count()
    near = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, PCA_SAMPLE / n))
    sample = unit(matrix(reps.where(near).select("embedding").limit(2 * PCA_SAMPLE).toArrow()["embedding"])) if n > 1 else np.eye(1, dim)
    basis = np.linalg.eigh(np.cov(sample.T, bias=True).reshape(dim, dim))[1][:, ::-1].copy()
    first = F.aggregate(
        F.zip_with("embedding", F.array(*(F.lit(float(x)) for x in basis[:, 0])), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x
    ) / F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # A trace of the id spreads vectors that share a leading coordinate over blocks.
    lead = reps.withColumn("lead", first + F.pmod(F.xxhash64("rep", F.lit(7)), F.lit(1 << 20)) * 1e-15)
    n_blocks = max(1, math.ceil(n / block))
    cuts = sorted(set(lead.approxQuantile("lead", [i / n_blocks for i in range(1, n_blocks)], 0.1 / n_blocks))) if n_blocks > 1 else []
    reach = math.sqrt(2 - 2 * threshold) + SLACK if threshold < 1 else SLACK
    # Blocks lie in the order of the leading coordinate, so that those within reach of a block are neighbours.
    edges = np.array([-2.0, *cuts, 2.0])
    low, high = np.searchsorted(edges[1:], edges[:-1] - reach), np.searchsorted(edges[:-1], edges[1:] + reach, side="right") - 1
    blocks = reps.sparkSession.sparkContext.broadcast((edges[1:-1], low, high))  # 24 bytes for each BLOCK vectors

    @F.pandas_udf(T.StructType([T.StructField(k, T.IntegerType()) for k in ("own", "low", "high")]))
    def block_of(lead: pd.Series) -> pd.DataFrame:
        cuts, low, high = blocks.value
        own = np.searchsorted(cuts, lead.to_numpy(), side="right")
        return pd.DataFrame({"own": own, "low": low[own], "high": high[own]})

    dealt = (
        lead.withColumn("at", block_of("lead"))
        .select(F.col("at.own").alias("own"), F.explode(F.sequence("at.low", "at.high")).alias("other"), "rep", "copies", "embedding")
        .select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "copies", "embedding")
    )
    shared = reps.sparkSession.sparkContext.broadcast(basis)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        x = unit(matrix(t["embedding"]))
        return links_between(x, shared.value, t["rep"].to_numpy(), t["copies"].to_numpy(), t["own"].to_numpy() == key[0].as_py(), key[0] == key[1], threshold)

    return dealt.groupBy("i", "j").applyInArrow(run, "rep long, root long, links long")


def links_between(x: np.ndarray, basis: np.ndarray, rep: np.ndarray, copies: np.ndarray, low: np.ndarray, same: bool, threshold: float) -> pa.Table:
    turned = (x @ basis).astype(np.float32)
    order = np.lexsort((turned[:, 0], ~low)) if not same else np.argsort(turned[:, 0], kind="stable")
    x, turned, rep, copies = x[order], turned[order], rep[order], copies[order]
    n_low = len(x) if same else int(low.sum())
    stages = [min(LEAD << i, x.shape[1]) for i in range(x.shape[1].bit_length()) if i == 0 or LEAD << (i - 1) < x.shape[1]]
    squares = np.cumsum(turned.astype(np.float64) ** 2, axis=1)
    rests = [np.sqrt(np.maximum(1 - squares[:, n - 1], 0)).astype(np.float32) for n in stages]  # norms of the dimensions left
    lead, rest = stages[0], rests[0]
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    links = np.zeros(len(x), dtype=np.int64)
    us, vs = np.empty(0, np.int64), np.empty(0, np.int64)
    b0 = 0 if same else n_low
    other = turned[b0:, 0]
    for i in range(0, n_low, TILE):
        to = min(i + TILE, n_low)
        lo = b0 + int(np.searchsorted(other, turned[i, 0] - reach))
        hi = b0 + int(np.searchsorted(other, turned[to - 1, 0] + reach, side="right"))
        lo = max(lo, i) if same else lo
        for k in range(lo, hi, 4 * TILE):
            end = min(k + 4 * TILE, hi)
            head = turned[i:to, :lead] @ turned[k:end, :lead].T
            head += rest[i:to, None] * rest[None, k:end]  # Cauchy-Schwarz on the dimensions left
            a, b = np.nonzero(head >= threshold - SLACK)
            if same and len(a):
                ok = i + a < k + b
                a, b = a[ok], b[ok]
            if not len(a):
                continue
            if len(a) > MANY:
                ok = (x[i:to] @ x[k:end].T)[a, b] >= threshold
                a, b = i + a[ok], k + b[ok]
            else:
                a, b = i + a, k + b
                sums = np.einsum("ij,ij->i", turned[a, :lead], turned[b, :lead])
                for at, n, left in zip(stages, stages[1:], rests[1:]):
                    sums += np.einsum("ij,ij->i", turned[a, at:n], turned[b, at:n])
                    ok = sums + left[a] * left[b] >= threshold - SLACK
                    a, b, sums = a[ok], b[ok], sums[ok]
                ok = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                a, b = a[ok], b[ok]
            links += np.bincount(a, copies[b], len(x)).astype(np.int64) + np.bincount(b, copies[a], len(x)).astype(np.int64)
            us, vs = star(np.r_[us, rep[a]], np.r_[vs, rep[b]])
    root = dict(zip(us.tolist(), vs.tolist()))
    at = np.flatnonzero(links)
    return pa.table({"rep": rep[at], "root": pa.array([root.get(r, r) for r in rep[at].tolist()], pa.int64()), "links": links[at]})


# ---------------------------------------------------------------------------------------------------
# Nearest neighbours: hash-prefix forest

TREES = 32
BITS = 24  # of a tree's hash strings
FIRST = 256  # rows, with repeats over trees, that the descent ends with
MISS = 0.05  # probability that the ascent may leave of missing a row as near as the k-th found
DENSE = 8  # beyond this part of a shard's rows, one product with all of them is cheaper than gathering candidates
SHARD = 16_384
QUERIES = 16_384  # of a block
SEED = 11


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, miss: float = MISS, trees: int = TREES, shard: int = SHARD) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found to each row whose vec_id ``every`` divides.

    Every usable vector is indexed in one shard; queries visit all shards in blocks. A shard has one
    sorted array of hash strings for each tree. A query descends to its longest matching prefixes and
    ascends in all trees at once. Rows that share a prefix with it are scored by cosine in double precision;
    it stops where a row as near as the k-th best so far would share a prefix of that length in none of the
    trees with a probability of ``miss`` at most. Where neighbours are near, that takes few rows of a shard,
    among vectors without structure most of them, and recall does not depend on the size of the table.

    Vectors that are null, empty, zero or have null or
    non-finite components take no part, as rows with a null vec_id; vectors of another length than the
    query's are no candidates. Ties go to the smaller vec_id. Rows alike count once; rows that share a vec_id but not
    the embedding are each asked, and each a candidate, on their own. Other columns, of whatever name, are not
    read; an empty table gives an empty result.
    """
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).distinct()
    asked = own.where(F.col("vec_id") % every == 0)
    n, n_asked = own.count(), asked.count()
    shards, blocks = max(1, math.ceil(n / shard)), max(1, math.ceil(n_asked / QUERIES))
    turn, row = F.xxhash64("vec_id", F.lit("shard")), F.xxhash64("embedding").alias("row")
    rows = own.select(F.size("embedding").alias("dim"), F.pmod(turn, F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(False).alias("asks"), "vec_id", row, "embedding")
    asks = asked.select(F.size("embedding").alias("dim"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(turn, F.lit(blocks)).alias("block"), F.lit(True).alias("asks"), "vec_id", row, "embedding")

    def run(t: pa.Table) -> pa.Table:
        is_query = t["asks"].to_numpy()
        x, ids = matrix(t["embedding"]), t["vec_id"].to_numpy()
        found = search(x[~is_query], ids[~is_query], x[is_query], ids[is_query], k, miss, trees)
        rows = t["row"].to_numpy()[is_query]
        return found.append_column("row", pa.array(rows[found["asked"].to_numpy()], pa.int64())).drop_columns(["asked"])

    found = rows.unionByName(asks).groupBy("dim", "shard", "block").applyInArrow(run, "query_id long, vec_id long, score double, row long")
    best = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Forest:
    """Sorted arrays of the hash strings of one shard's rows, one for each tree, and the strings of the queries."""

    def __init__(self, rows: np.ndarray, queries: np.ndarray, trees: int):
        weight = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)
        self.order, self.keys, self.asked = (np.empty((trees, n), dtype=np.int64) for n in (len(rows), len(rows), len(queries)))
        for t in range(trees):
            planes = np.random.default_rng([SEED, t]).standard_normal((rows.shape[1], BITS))
            key = (rows @ planes > 0) @ weight
            self.order[t] = np.argsort(key, kind="stable")
            self.keys[t] = key[self.order[t]]
            self.asked[t] = (queries @ planes > 0) @ weight

    def ranges(self, queries: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By tree and query the range of the rows that share its prefix of ``depth`` bits."""
        up = BITS - depth
        head = self.asked[:, queries] >> up << up
        each = [(np.searchsorted(keys, h), np.searchsorted(keys, h + (1 << up))) for keys, h in zip(self.keys, head)]
        return np.stack([x[0] for x in each]), np.stack([x[1] for x in each])

    def descend(self, n: int, least: int) -> np.ndarray:
        """By query the longest prefix that ``least`` rows share, with repeats over trees; 0 if there are fewer."""
        depth, open_ = np.full(n, BITS), np.arange(n)
        while len(open_):
            low, high = self.ranges(open_, depth[open_])
            open_ = open_[((high - low).sum(axis=0) < least) & (depth[open_] > 0)]
            depth[open_] -= 1
        return depth


def enough(kth: np.ndarray, trees: int, miss: float) -> np.ndarray:
    """Longest prefix by which a row with that cosine shares one in some tree with a probability of 1 - ``miss``."""
    alike = 1 - np.arccos(np.clip(kth, -1, 1)) / np.pi  # probability that one bit is the same
    with np.errstate(divide="ignore"):
        bits = np.log(1 - miss ** (1 / trees)) / np.log(np.clip(alike, 1e-9, 1 - 1e-12))
    return np.minimum(bits, BITS)


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, miss: float = MISS, trees: int = TREES, first: int = FIRST) -> pa.Table:
    """The ``k`` best candidates of each query among the rows of one shard."""
    out: list[tuple[np.ndarray, ...]] = []
    if len(x) and len(q):
        xn, qn = unit(x), unit(q)
        forest = Forest(xn, qn, trees)
        depth, open_ = forest.descend(len(q), first), np.arange(len(q))
        while len(open_):
            kth = np.empty(len(open_))
            found = []
            for i in range(0, len(open_), 128):
                found += candidates(forest, xn, qn, ids, q_ids, open_[i : i + 128], depth[open_[i : i + 128]])
                for j in range(i, len(found)):
                    scores = found[j][1]
                    kth[j] = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else -1.0
                    if depth[open_[j]] <= max(enough(kth[j], trees, miss), 0):
                        out.append(ranked(x, ids, q[open_[j]], q_ids[open_[j]], open_[j], *found[j], k, kth[j]))
                    found[j] = (None, None)
            ends = np.maximum(np.floor(enough(kth, trees, miss)).astype(np.int64), 0)
            go = depth[open_] > ends
            open_, ends = open_[go], ends[go]
            depth[open_] = np.minimum(depth[open_] - 1, ends)
    cat = lambda i, kind: np.concatenate([o[i] for o in out]).astype(kind) if out else np.empty(0, kind)
    return pa.table({"query_id": cat(0, np.int64), "vec_id": cat(1, np.int64), "score": cat(2, np.float64), "asked": cat(3, np.int64)})


def candidates(forest: Forest, xn: np.ndarray, qn: np.ndarray, ids: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, depth: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By query the rows that share its prefixes, and their cosines."""
    low, high = forest.ranges(queries, depth)
    dense = (high - low).sum(axis=0) * DENSE > len(xn)
    product = iter(qn[queries[dense]] @ xn.T)
    out = []
    for j, i in enumerate(queries):
        parts = [o[a:b] for o, a, b in zip(forest.order, low[:, j], high[:, j])]
        if dense[j]:
            mask = np.zeros(len(xn), dtype=bool)
            for p in parts:
                mask[p] = True
            mask &= ids != q_ids[i]
            rows = np.flatnonzero(mask)
            out.append((rows, next(product)[rows]))
        else:
            rows = np.unique(np.concatenate(parts))
            rows = rows[ids[rows] != q_ids[i]]
            out.append((rows, xn[rows] @ qn[i]))
    return out


def ranked(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_id: int, asked: int, rows: np.ndarray, scores: np.ndarray, k: int, kth: float) -> tuple[np.ndarray, ...]:
    """The ``k`` best of a query's candidates by the cosine of the original vectors, ties to the smaller id."""
    near = scores >= kth - 1e-12
    at, scores = rows[near], scores[near]
    exact = np.clip((x[at] @ q) / (np.linalg.norm(x[at], axis=1) * np.linalg.norm(q)), -1, 1)
    exact = np.where(np.isfinite(exact), exact, scores)
    best = np.lexsort((ids[at], -exact))[:k]
    return np.full(len(best), q_id), ids[at][best], exact[best], np.full(len(best), asked)
