"""What the training-data operators share: table access, shared-folder tables, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _own_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/checkpoints"
    return f"{base.rstrip('/')}/patraka-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which all executors share.

    Only where that setting is absent (local tests) is a temporary folder used. All folders of an application
    lie in one, which ``clean`` deletes.
    """
    return f"{_own_dir(spark)}/{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder, once no result is read from it any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver drop what finished queries left, so that Spark removes their shuffle files."""
    for _ in range(2):  # what the first round frees may hold more; the cleaner works beside it
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def trim() -> None:
    """Give back what earlier tasks of this Python worker have freed; allocators would keep it until the worker ends."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def rows_of(batch: pa.RecordBatch, most_bytes: int, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``column`` holds about ``most_bytes``; a longer row stands alone."""
    offsets = np.frombuffer(batch.column(column).buffers()[1], dtype=_offset_type(batch.column(column)))[
        batch.column(column).offset :
    ]
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(offsets[: n + 1], offsets[at] + most_bytes, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield batch.slice(at, to - at)
        at = to


def _offset_type(column: pa.Array):
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    return np.int64 if large else np.int32


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def total_bytes(df: DataFrame, column: str) -> int:
    """Bytes of ``column`` over the whole table (octet lengths; reads that one column)."""
    got = df.agg(F.sum(F.octet_length(column))).first()[0]
    return int(got or 0)


def shards_for(n_bytes: int, each: int) -> int:
    return max(1, -(-n_bytes // each))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``edges(u, v)``; component: the smallest node reachable.

    Rounds of contraction: each node points to its smallest neighbour (or itself), pointers are
    followed to the roots by doubling, edges are carried over to the roots. A root has at least one
    other node in its tree, so each round at least halves the nodes. All aggregates are minima with
    map-side combination and every round is written to the shared folder.
    """
    spark = edges.sparkSession
    live = materialize(_between(edges))
    labels: DataFrame | None = None
    while not live.isEmpty():
        both = live.union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        up = materialize(up)
        while True:
            over = up.select(F.col("u").alias("q"), F.col("p").alias("pp"))
            step = up.join(over, up.p == over.q).select("u", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved"))
            step = materialize(step)
            up = step.select("u", "p")
            if step.where("moved").isEmpty():
                break
        left = up.select(F.col("u"), F.col("p").alias("a"))
        right = up.select(F.col("u").alias("v"), F.col("p").alias("b"))
        labels = (
            up
            if labels is None
            else materialize(labels.join(up.select(F.col("u").alias("p"), F.col("p").alias("root")), "p", "left").select("u", F.coalesce("root", "p").alias("p")))
        )
        live = materialize(_between(live.join(left, "u").join(right, "v").select(F.col("a").alias("u"), F.col("b").alias("v"))))
    if labels is None:
        return spark.createDataFrame([], "node long, component long")
    return labels.select(F.col("u").alias("node"), F.col("p").alias("component"))


def _between(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a, b) of one task as links from each node to the smallest node it reaches."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while True:
            again = new[new]
            if (again == new).all():
                break
            new = again
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def batches(of: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for x in of:
        yield pa.RecordBatch.from_pydict(x, schema=schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
