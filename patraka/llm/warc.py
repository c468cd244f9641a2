"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by page id and payload digest into shards. Keys picked by their hash cut the table
into cells, whatever the spread of the ids; exact byte counts of the cells make the shards, so that they do not
depend on the cluster, and each shard is a partition of its own. Within a shard, records are gzip members of their own
and files roll by compressed size. A file is written under a temporary name and renamed to its
deterministic name; a manifest table, committed by Spark after all tasks, names the files that count.
A task that runs again writes the same bytes under the same names.
"""

from __future__ import annotations

import gzip
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patraka.llm.common import shared_dir, text_bytes

ROLL = 64 << 20  # compressed bytes of a file
SHARD, SMALL_SHARD, TASKS = 128 << 20, 16 << 20, 64  # payload bytes of a shard, about: at most, at least, and shards of a table in between
LEAST = 100  # payloads below this many bytes are never revisits
DATE = "1970-01-01T00:00:00Z"
CELLS, MOST_CELLS = 1 << 12, 1 << 16  # whose bytes the driver adds up into shards
MOST_TASKS = 20_000  # that read archives
MANIFEST = "file string, shard int, seq int, records long, bytes long, sha256 string"


class Folder:
    """A folder of the shared store: a local or mounted path, or whatever pyarrow reaches by the URI."""

    def __init__(self, uri: str):
        at = urlparse(uri)
        self.local = at.scheme in ("", "file")
        if self.local:
            self.path = at.path
        else:
            from pyarrow import fs

            self.fs, self.path = fs.FileSystem.from_uri(uri)

    def make(self) -> None:
        os.makedirs(self.path, exist_ok=True) if self.local else self.fs.create_dir(self.path, recursive=True)

    def create(self, name: str):
        path = f"{self.path}/{name}"
        return open(path, "wb") if self.local else self.fs.open_output_stream(path)

    def open(self, name: str):
        path = f"{self.path}/{name}"
        return open(path, "rb") if self.local else self.fs.open_input_stream(path)

    def rename(self, old: str, new: str) -> None:
        old, new = f"{self.path}/{old}", f"{self.path}/{new}"
        os.replace(old, new) if self.local else self.fs.move(old, new)

    def remove(self, name: str) -> None:
        path = f"{self.path}/{name}"
        os.remove(path) if self.local else self.fs.delete_file(path)


class Rolling:
    """The files of one shard, one after the other."""

    def __init__(self, folder: Folder, prefix: str, shard: int, roll: int):
        self.folder, self.prefix, self.shard, self.roll = folder, prefix, shard, roll
        self.seq, self.out, self.done = 0, None, []

    def add(self, record: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = packer.compress(record) + packer.flush()
        if self.out is not None and self.size + len(data) > self.roll:
            self.close()
        if self.out is None:
            self.temp = f".tmp-{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.digest = self.folder.create(self.temp), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.digest.update(data)
        self.size += len(data)
        self.records += 1

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        name = f"{self.prefix}-{self.shard:05d}-{self.seq:05d}.warc.gz"
        self.folder.rename(self.temp, name)
        self.done.append((name, self.shard, self.seq, self.records, self.size, self.digest.hexdigest()))
        self.seq += 1

    def abort(self) -> None:
        if self.out is not None:
            self.out.close()
            self.folder.remove(self.temp)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; ``refers_to``: the page whose response this revisits."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    key = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}:{digest}:{refers_to}')}>",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {' '.join(url.split())}")
    if page_id is not None:
        head.append(f"WARC-X-Page-Id: {page_id}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    head.append(f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}")
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{digest}:None')}>")
        head.append(f"WARC-X-Refers-To-Page-Id: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def order_keys(ids: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Pairs of an id and the start of a digest as strings of bytes in the same order."""
    out = np.empty((len(ids), 2), dtype=">u8")
    out[:, 0], out[:, 1] = ids.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63), digests.astype(np.int64).view(np.uint64)
    return np.ascontiguousarray(out).view("S16").ravel()


def numbered(page_id: Column, digest: Column, bounds: np.ndarray, number: np.ndarray) -> Column:
    """By row the number of the cell between ``bounds`` (sorted keys) that it falls into."""

    @F.arrow_udf("int")
    def find(ids: pa.Array, digests: pa.Array) -> pa.Array:
        key = order_keys(ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False), digests.to_numpy(zero_copy_only=False))
        return pa.array(number[np.searchsorted(bounds, key, side="right")], pa.int32())

    return find(page_id, digest)


def shards(own: DataFrame, shard_bytes: int | None) -> tuple[Column, int]:
    """Shard of each row of ``own(page_id, digest, html)``, and how many there are."""
    bytes_, head = F.octet_length("html") + 512, F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    rows, size = own.agg(F.count("*"), F.sum(bytes_)).first()
    size = size or 0
    shard_bytes = shard_bytes or min(SHARD, max(SMALL_SHARD, size // TASKS))
    n_cells = min(MOST_CELLS, max(CELLS, 16 * size // shard_bytes))
    shard_bytes = max(shard_bytes, 4 * size // n_cells)
    picked = F.pmod(F.xxhash64("page_id", "digest", F.lit("cell")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, n_cells / max(rows, 1)))
    got = own.where(picked).select(F.coalesce("page_id", F.lit(-(2**63))).alias("i"), head.alias("d")).distinct().toArrow()  # about MOST_CELLS at most
    bounds = np.unique(order_keys(got["i"].to_numpy(), got["d"].to_numpy()))
    cell = numbered(F.col("page_id"), head, bounds, np.arange(len(bounds) + 1, dtype=np.int32))
    held = own.select(cell.alias("cell"), bytes_.alias("bytes")).groupBy("cell").agg(F.sum("bytes").alias("bytes")).orderBy("cell").collect()
    of, shard, filled = np.zeros(len(bounds) + 1, dtype=np.int32), 0, 0
    for r in held:
        if filled and filled + r["bytes"] > shard_bytes:
            shard, filled = shard + 1, 0
        filled += r["bytes"]
        of[r["cell"]] = shard
    return numbered(F.col("page_id"), head, bounds, of), shard + 1


def write(pages: DataFrame, uri: str, prefix: str = "pages", roll: int = ROLL, shard_bytes: int | None = None) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives into the folder ``uri``; returns the manifest table.

    A null html is an empty payload, a null url leaves out the target, a null page_id its header; rows
    with a null id come first. Of rows alike in id and payload (of LEAST bytes or more) the second and later ones revisit the
    first; rows alike in both stand in one shard. A payload of any length is one record. Ids may lie anywhere. Other
    columns, of whatever name, are not read. An empty table gives an empty manifest and no file.
    """
    spark = pages.sparkSession
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    seen = own.where(F.octet_length("html") >= LEAST).select("page_id", "digest")
    first = seen.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).where("rows > 1 and first is not null")
    refs = seen.join(first, "digest").where("not (page_id <=> first)").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    # A page's reference comes before the page itself, in the same shard.
    both = refs.select("page_id", "digest", F.lit(0).alias("kind"), "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html")).unionByName(
        own.select("page_id", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"), "url", "html")
    )
    shard, n = shards(own, shard_bytes)
    dealt = both.withColumn("shard", shard).repartitionById(n, F.col("shard")).sortWithinPartitions("page_id", "digest", "kind", "url")
    Folder(uri).make()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, now, done = Folder(uri), None, []
        last = ref = (object(), None, None)
        try:
            for batch in it:
                ids, digests, kinds, refers, urls, _, shards = (c.to_pylist() if i != 5 else None for i, c in enumerate(batch.columns))
                for i, payload in enumerate(text_bytes(batch.column(5))):
                    if kinds[i] == 0:
                        ref = (ids[i], digests[i], refers[i])
                        continue
                    if now is None or now.shard != shards[i]:
                        if now is not None:
                            now.close()
                            done += now.done
                        now = Rolling(folder, prefix, shards[i], roll)
                    key = (ids[i], digests[i])
                    to = ref[2] if key == ref[:2] else ids[i] if key == last[:2] and len(payload) >= LEAST else None
                    now.add(record(ids[i], urls[i], payload, digests[i], to))
                    last = (*key, None)
            if now is not None:
                now.close()
                done += now.done
        except BaseException:
            if now is not None:
                now.abort()
            raise
        cols = list(zip(*done)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=["file", "shard", "seq", "records", "bytes", "sha256"])

    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{uri}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{uri}/_manifest")


def read(spark: SparkSession, uri: str) -> DataFrame:
    """One row for each record of the archives that the manifest in ``uri`` names.

    ``(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload)``; a revisit has no
    payload. Digests of blocks and payloads are checked; a mismatch raises.
    """
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    )

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder(uri)
        rows, size = [], 0
        for batch in it:
            for name in batch.column(0).to_pylist():
                for row in parse(folder, name):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if size > 4 << 20 or len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.schema(MANIFEST).parquet(f"{uri}/_manifest").select("file")
    n = max(1, min(files.count(), MOST_TASKS))  # a number of its own, else the small table is read by one task
    return files.repartition(n, "file").mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def parse(folder: Folder, name: str) -> Iterator[dict]:
    """The records of one archive file, in order."""
    with folder.open(name) as raw, gzip.GzipFile(fileobj=raw) as f:
        while line := f.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"{name}: not a record: {line[:80]!r}")
            head = {}
            while (line := f.readline()) != b"\r\n":
                key, _, value = line.decode().rstrip("\r\n").partition(": ")
                head[key] = value
            block = f.read(int(head["Content-Length"]))
            if f.read(4) != b"\r\n\r\n":
                raise ValueError(f"{name}: a record has the wrong length")
            if head["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
                raise ValueError(f"{name}: a block differs from its digest")
            http, _, payload = block.partition(b"\r\n\r\n")
            n = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
            digest, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]
            if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                raise ValueError(f"{name}: a payload differs from its digest")
            whole = lambda k: int(head[k]) if k in head else None
            yield {
                "page_id": whole("WARC-X-Page-Id"),
                "url": head.get("WARC-Target-URI"),
                "record_type": kind,
                "payload_bytes": n,
                "payload_digest": digest,
                "refers_to": whole("WARC-X-Refers-To-Page-Id"),
                "payload": payload if kind == "response" else None,
            }


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives into the shared folder, read them back, and describe each record.

    ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``, one row for each row of ``pages``; null
    payloads, null ids, repeated rows, other columns and empty tables as in ``write``.
    """
    uri = shared_dir(pages.sparkSession)
    write(pages, uri)
    return read(pages.sparkSession, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
