"""Suffix-array dedup: remove bytes that a long match with an earlier document covers.

A string of LENGTH bytes is removed from a document if it also starts in a document with a smaller id.

Sparse suffixes. Each window of LENGTH bytes is anchored at the K-gram of the smallest hash in it, so that
equal windows have equal anchors. A cell is a longest run of windows with one anchor value; it has the
anchor's hash and the sum of its windows' mixed hashes, a fingerprint of 128 bits. Cells stand for their
suffixes: about one for sixteen bytes, whose order is that of anchor and fingerprint instead of the bytes
(carrying 50 bytes a suffix through a shuffle would exceed the disk by far).

Logarithmic index family. Cells are dealt to shards by anchor. A shard takes them in batches of rising
document id; a batch's sorted array is merge-scanned against the levels for equal cells, what is new
becomes a level, and levels of about equal size merge.

A cell that occurs in an earlier document is a match of all its windows. Where an anchor has different
cells in different documents (the ends of matches), the windows of each distinct cell are compared one
by one by the same rule. Windows and cells are equal if their fingerprints are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patraka.llm.common import materialize, mix64, release, shards_for, text_bytes, total_bytes, trim
from patraka.llm.packing import pack, unpack

LENGTH = 50
K = 20
PIECE = 1 << 18  # windows hashed at once
BLOCK = 8 << 20  # text bytes whose cells are sent together
SHARD = 12 << 20  # text bytes whose cells a shard holds, about
BUCKET = 8 << 20  # text bytes of a bucket of documents, about
BATCH = 1 << 17  # cells of an index batch
LAST = np.int64(2**63 - 1)  # stands for a null doc_id: after all others

_TABLE = np.random.default_rng(50).integers(0, 2**64, 256, dtype=np.uint64)
_M = np.random.default_rng(51).integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _join(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    out = a >> np.uint64(29)
    out ^= a
    out *= _M[step]
    out += b
    return out


def hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of LENGTH bytes: its anchor's hash, and its own."""
    h1 = _TABLE[data]
    h2 = _join(h1[:-1], h1[1:], 0)
    h4 = _join(h2[:-2], h2[2:], 1)
    h8 = _join(h4[:-4], h4[4:], 2)
    h16 = _join(h8[:-8], h8[8:], 3)
    n = len(data) - LENGTH + 1
    h32 = _join(h16[: n + 2], h16[16 : n + 18], 4)
    whole = mix64(_join(_join(h32[:n], h16[32 : 32 + n], 5), h2[48 : 48 + n], 6))
    anchor = mix64(_join(h16[: n + 30], h4[16 : n + 46], 7))
    for step in (1, 2, 4, 8):
        anchor = np.minimum(anchor[:-step], anchor[step:])
    return np.minimum(anchor[:n], anchor[15 : 15 + n]), whole  # 31 K-grams


class Cells:
    """Cells of some texts: ``h``, ``c``, ``doc`` (the text's place), ``start`` (first window), ``size`` (windows)."""

    def __init__(self, texts: list[bytes], windows: bool = False):
        parts = list(self._parts(texts, windows))
        self.h, self.c, self.doc, self.start, self.size = (np.concatenate(x) if x else np.empty(0, t) for x, t in zip(list(zip(*[p[:5] for p in parts])) or [()] * 5, (np.uint64, np.uint64, np.int64, np.int64, np.int64)))
        self.windows = [p[5] for p in parts]
        first = np.searchsorted(self.doc, np.arange(len(texts)))
        self.ord = np.arange(len(self.doc)) - first[self.doc] if len(self.doc) else self.doc

    @staticmethod
    def _parts(texts: list[bytes], windows: bool) -> Iterator[tuple]:
        held, size = [], 0

        def flush() -> tuple:
            data = np.frombuffer(b"".join(texts[d][a:b] for d, a, b in held), np.uint8)
            lens = np.array([b - a for _, a, b in held])
            at = np.r_[0, np.cumsum(lens)[:-1]]
            anchor, whole = hashes(data)
            n = lens - LENGTH + 1
            part = np.repeat(np.arange(len(held)), n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            index = at[part] + offset
            anchor, whole = anchor[index], whole[index]
            begins = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])])
            docs, shift = np.array([d for d, _, _ in held]), np.array([a for _, a, _ in held])
            return (
                anchor[begins],
                np.add.reduceat(mix64(whole), begins),
                docs[part[begins]],
                shift[part[begins]] + offset[begins],
                np.diff(np.r_[begins, len(anchor)]),
                whole if windows else None,
            )

        for d, text in enumerate(texts):
            # a longer text is cut at fixed windows of its own, whatever stands beside it
            for a in range(0, len(text) - LENGTH + 1, PIECE):
                held.append((d, a, min(a + PIECE, len(text) - LENGTH + 1) + LENGTH - 1))
                size += held[-1][2] - a
                if size >= PIECE:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()


class LogIndex:
    """A family of sorted arrays of entries (h, c), each with the first document that has it.

    Batches come in rising order of documents. ``add`` tells which entries of a batch occur in an
    earlier document; what is new becomes a level, and a level that is no larger than twice the next merges.
    """

    def __init__(self):
        self.levels: list[tuple[np.ndarray, ...]] = []  # sort key, h, c, doc

    def add(self, h: np.ndarray, c: np.ndarray, doc: np.ndarray) -> np.ndarray:
        # Entries of one anchor are neighbours; full equality is checked.
        key = (h & ~np.uint64(0xFFFFFF)) | (mix64(c) >> np.uint64(40))
        order = np.lexsort((doc, key))
        if ((key[order][1:] == key[order][:-1]) & ((h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1]))).any():
            order = np.lexsort((doc, c, h, key))  # different entries under one short key
        key, h, c, doc = (x[order] for x in (key, h, c, doc))
        new = np.r_[True, (key[1:] != key[:-1]) | (h[1:] != h[:-1]) | (c[1:] != c[:-1])] if len(key) else np.empty(0, bool)
        heads = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        first = doc[heads]
        fresh = np.ones(len(heads), dtype=bool)
        for level in self.levels:
            both = np.concatenate([level[0], key[heads]])
            at = np.argsort(both, kind="stable")  # two sorted runs: one linear merge
            is_new = at >= len(level[0])
            hit = np.flatnonzero(is_new[1:] & ~is_new[:-1])
            old, mine = at[hit], at[hit + 1] - len(level[0])
            same = (level[1][old] == h[heads[mine]]) & (level[2][old] == c[heads[mine]])
            old, mine = old[same], mine[same]
            first[mine] = np.minimum(first[mine], level[3][old])
            fresh[mine] = False
            self._shared_keys(level, key[heads], h[heads], c[heads], first, fresh)
        found = np.zeros(len(doc), dtype=bool)
        found[order] = first[run] < doc
        heads = heads[fresh]
        self._push((key[heads], h[heads], c[heads], doc[heads]))
        return found

    @staticmethod
    def _shared_keys(level: tuple[np.ndarray, ...], key: np.ndarray, h: np.ndarray, c: np.ndarray, first: np.ndarray, fresh: np.ndarray) -> None:
        """Entries that share their short key with different ones, on either side, are compared with all of that key."""
        twice = lambda x: x[1:][x[1:] == x[:-1]]
        several = np.concatenate([twice(level[0]), twice(key)])
        if not len(several):
            return
        for i in np.flatnonzero(np.isin(key, several)).tolist():
            a, b = np.searchsorted(level[0], key[i], "left"), np.searchsorted(level[0], key[i], "right")
            same = a + np.flatnonzero((level[1][a:b] == h[i]) & (level[2][a:b] == c[i]))
            if len(same):
                first[i] = min(first[i], level[3][same].min())
                fresh[i] = False

    def _push(self, level: tuple[np.ndarray, ...]) -> None:
        while self.levels and len(self.levels[-1][0]) <= 2 * len(level[0]):
            level = self._merge(self.levels.pop(), level)
        self.levels.append(level)

    @staticmethod
    def _merge(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        at = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return tuple(np.concatenate([x, y])[at] for x, y in zip(a, b))

    def whole(self) -> tuple[np.ndarray, ...]:
        while len(self.levels) > 1:
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self._merge(a, b))
        return self.levels[0]


# ---------------------------------------------------------------------------------------------------
# Rows of packed arrays between the stages


def rising(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0).astype(np.int32)


#: For one receiver: entries (h, c as raw bytes), each entry's document (place in docs) and place there.
SENT = "to long, h binary, c binary, doc binary, place binary, docs binary"
#: For one bucket: places in documents, as 2 * place + flag.
SAID = "bucket long, doc binary, place binary, docs binary"
_DOC = np.dtype([("id", "<i8"), ("uid", "<i8"), ("bucket", "<i8")])


def dealt(to: np.ndarray, arrays: dict[str, np.ndarray], doc: np.ndarray, place: np.ndarray, docs: np.ndarray, name: str = "to") -> Iterator[pa.RecordBatch]:
    """One row for each receiver, entries in the order of documents and places; only its documents go along."""
    order = np.lexsort((place, doc, to))
    to, doc, place = to[order], doc[order], place[order]
    cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.empty(0, int)
    rows = []
    for a, b in zip(cuts, np.r_[cuts[1:], len(to)]):
        own, at = np.unique(doc[a:b], return_inverse=True)
        rows.append(
            {name: int(to[a])}
            | {k: v[order[a:b]].tobytes() for k, v in arrays.items()}
            | {"doc": pack(rising(at)), "place": pack(np.diff(place[a:b].astype(np.int64), prepend=0)), "docs": pack(docs[own])}
        )
        if len(rows) == 64:
            yield _rows(rows)
            rows = []
    if rows:
        yield _rows(rows)


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if isinstance(rows[0][k], int) else pa.binary()) for k in rows[0]], names=list(rows[0]))


def gathered(t: pa.Table, names: tuple[str, ...], kinds: dict | None = None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """What ``dealt`` sent: the arrays, each entry's document, its place, and the documents."""
    out: dict[str, list] = {k: [] for k in names}
    doc, place, docs, n = [], [], [], 0
    for r in t.select([*names, "doc", "place", "docs"]).to_pylist():
        for k in names:
            out[k].append(np.frombuffer(r[k], (kinds or {}).get(k, np.uint64)))
        own = unpack(r["docs"], _DOC)
        doc.append(np.cumsum(unpack(r["doc"], np.int32), dtype=np.int64) + n)
        place.append(np.cumsum(unpack(r["place"], np.int64)))
        docs.append(own)
        n += len(own)
    cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    return {k: cat(v, np.uint64) for k, v in out.items()}, cat(doc, np.int64), cat(place, np.int64), cat(docs, _DOC)


class Said:
    """By document of a bucket, the places that were said of it."""

    def __init__(self, t: pa.Table):
        _, doc, place, docs = gathered(t, ())
        key = mix64(docs["id"].view(np.uint64)) ^ docs["uid"].view(np.uint64)
        self.key, at = np.unique(key, return_inverse=True)
        doc = at[doc] if len(doc) else doc
        order = np.argsort(doc, kind="stable")
        self.place, self.cuts = place[order], np.searchsorted(doc[order], np.arange(len(self.key) + 1))

    def of(self, doc_id: int, uid: int) -> np.ndarray:
        key = mix64(np.array([doc_id], np.int64).view(np.uint64)) ^ np.array([uid], np.int64).view(np.uint64)
        i = int(np.searchsorted(self.key, key[0]))
        if i == len(self.key) or self.key[i] != key[0]:
            return np.empty(0, np.int64)
        return self.place[self.cuts[i] : self.cuts[i + 1]]


# ---------------------------------------------------------------------------------------------------
# Stages


def _held(docs: DataFrame, n_buckets: int, columns: list[str]) -> DataFrame:
    """The documents with their internal id, text hash and bucket; ``row`` has the ``columns`` to carry along."""
    uid = F.coalesce(F.xxhash64("text"), F.lit(0))
    own = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("id"), uid.alias("uid"), F.col("text").cast("string").alias("text"), F.struct(*(docs[c] for c in columns)).alias("row")
    )
    return own.select("id", "uid", F.pmod(F.xxhash64("id", "uid"), F.lit(n_buckets)).alias("bucket"), "text", "row")


def repeated(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether an entry (a, b) occurs under a smaller id."""
    if not len(a):
        return np.empty(0, dtype=bool)
    order = np.lexsort((ids, b, a))
    new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
    first = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.empty(len(a), dtype=bool)
    out[order] = first < ids[order]
    return out


def _cells(held: DataFrame, n_shards: int) -> DataFrame:
    """By block of texts: cells (``to`` from 0 on), and those that the block itself decides (``to`` = -1 - bucket).

    A cell goes on with its first document in the block only, so that what many documents share comes to
    its shard once a block and not once a document.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send() -> Iterator[pa.RecordBatch]:
            cells = Cells(texts)
            docs = np.array(about, dtype=_DOC)
            ids = docs["id"][cells.doc]
            later = repeated(cells.h, cells.c, ids)
            go = ~later
            yield from dealt((cells.h[go] % np.uint64(n_shards)).astype(np.int64), {"h": cells.h[go], "c": cells.c[go]}, cells.doc[go], cells.ord[go], docs)
            if later.any():
                nothing = np.empty((int(later.sum()), 0), np.uint8)
                yield from dealt(-1 - docs["bucket"][cells.doc[later]], {"h": nothing, "c": nothing}, cells.doc[later], 2 * cells.ord[later], docs)

        trim()
        texts, about, size = [], [], 0
        for batch in it:
            for text, *row in zip(text_bytes(batch.column(3)), *(batch.column(i).to_pylist() for i in range(3))):
                if len(text) < LENGTH:
                    continue
                texts.append(text)
                about.append(tuple(row))
                size += len(text)
                if size >= BLOCK:
                    yield from send()
                    texts, about, size = [], [], 0
        if texts:
            yield from send()

    return held.select("id", "uid", "bucket", "text").mapInArrow(run, SENT)


def _matched(cells: DataFrame) -> DataFrame:
    """By shard: places of cells that match (flag 0) and of distinct cells whose windows are to be compared (flag 1); what blocks have decided passes."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return _passed(key, t)
        trim()
        arrays, doc, place, docs = gathered(t, ("h", "c"))
        h, c, ids = arrays["h"], arrays["c"], docs["id"][doc]
        order = np.argsort(ids, kind="stable")
        index, found = LogIndex(), np.zeros(len(ids), dtype=bool)
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            found[own] = index.add(h[own], c[own], ids[own])
        out = []
        if len(order):
            _, heads, _, first = index.whole()
            heads = heads >> np.uint64(24)
            cuts = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]])
            many = heads[cuts[np.minimum.reduceat(first, cuts) != np.maximum.reduceat(first, cuts)]]
            # what isn't found stands in its cell's first document, at each of its places there
            del index
            h = arrays["h"] >> np.uint64(24)
            near = np.minimum(np.searchsorted(many, h), max(len(many) - 1, 0))
            row = np.flatnonzero(~found & (many[near] == h)) if len(many) else np.empty(0, int)
            at = np.r_[np.flatnonzero(found), row]
            flag = np.r_[np.zeros(int(found.sum()), np.int64), np.ones(len(row), np.int64)]
            out = list(dealt(docs["bucket"][doc[at]], {}, doc[at], 2 * place[at] + flag, docs, "bucket"))
        return pa.Table.from_batches(out) if out else _none(SAID)

    return cells.groupBy("to").applyInArrow(run, SAID)


def _passed(key: tuple, t: pa.Table) -> pa.Table:
    return pa.table({"bucket": pa.array(np.full(len(t), -1 - key[0].as_py())), **{k: t[k] for k in ("doc", "place", "docs")}})


def _none(schema: str) -> pa.Table:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.table({k: pa.array([], pa.int64() if f"{k} long" in schema else pa.binary()) for k in names})


def _windows(held: DataFrame, said: DataFrame, n_shards: int) -> DataFrame:
    """By bucket: windows to be compared (``to`` from 0 on), and those decided within the bucket (``to`` = -1 - bucket)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        told = Said(right)
        rows = left.select(["id", "uid", "bucket", "text"]).to_pydict()
        w, h, doc, place, docs = [], [], [], [], []
        for i, u, b, text in zip(rows["id"], rows["uid"], rows["bucket"], rows["text"]):
            got = told.of(i, u)
            ords = np.unique(got[got & 1 == 1] >> 1)
            if not len(ords):
                continue
            cells = Cells([text.encode()], windows=True)
            whole = np.concatenate(cells.windows)
            n = cells.size[ords]
            at = np.repeat(cells.start[ords], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w.append(whole[at])
            h.append(np.repeat(cells.h[ords], n))
            doc.append(np.full(len(at), len(docs)))
            place.append(at)
            docs.append((i, u, b))
        if not docs:
            return _none(SENT)
        w, h, doc, place, docs = np.concatenate(w), np.concatenate(h), np.concatenate(doc), np.concatenate(place), np.array(docs, dtype=_DOC)
        later = repeated(w, h, docs["id"][doc])
        # Only a window's first document in the bucket goes on, all its places with it.
        go = ~later
        short = (h[go] >> np.uint64(48)).astype(np.uint16)  # beside the window's own 64 bits
        out = list(dealt((w[go] % np.uint64(n_shards)).astype(np.int64), {"h": short, "c": w[go]}, doc[go], place[go], docs))
        if later.any():
            nothing = np.empty((int(later.sum()), 0), np.uint8)
            out += dealt(-1 - docs["bucket"][doc[later]], {"h": nothing, "c": nothing}, doc[later], place[later], docs)
        return pa.Table.from_batches(out)

    return held.groupBy("bucket").cogroup(said.groupBy("bucket")).applyInArrow(run, SENT)


def _compared(windows: DataFrame) -> DataFrame:
    """By shard of windows: places of windows that an earlier document has; what buckets have decided passes."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return _passed(key, t)
        trim()
        arrays, doc, place, docs = gathered(t, ("h", "c"), {"h": np.uint16})
        ids = docs["id"][doc]
        order = np.argsort(ids, kind="stable")
        index, found = LogIndex(), np.zeros(len(ids), dtype=bool)
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            # anything may stand first in the sort, as here only equality counts: the window's hash
            found[own] = index.add(arrays["c"][own], arrays["h"][own].astype(np.uint64), ids[own])
        at = np.flatnonzero(found)
        out = list(dealt(docs["bucket"][doc[at]], {}, doc[at], place[at], docs, "bucket"))
        return pa.Table.from_batches(out) if out else _none(SAID)

    return windows.groupBy("to").applyInArrow(run, SAID)


def removed(text: bytes, cells: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the removed runs, from matched cells (by place) and windows."""
    edge = np.zeros(len(text) + 1, dtype=np.int32)
    if len(cells):
        own = Cells([text])
        np.add.at(edge, own.start[cells], 1)
        np.add.at(edge, own.start[cells] + own.size[cells] - 1 + LENGTH, -1)
    np.add.at(edge, windows, 1)
    np.add.at(edge, windows + LENGTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    turn = np.flatnonzero(np.diff(np.r_[False, gone, False]))
    return turn[::2], turn[1::2]


def _final(held: DataFrame, said: DataFrame, late: DataFrame, schema: T.StructType, cut: bool) -> DataFrame:
    """By bucket: the report, or with ``cut`` the rows with what is left of their texts."""
    told = said.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        is_late = right["late"]
        early, after = Said(right.filter(pa.compute.invert(is_late))), Said(right.filter(is_late))
        ids, uids = left["id"].to_pylist(), left["uid"].to_pylist()
        texts = text_bytes(left["text"].combine_chunks())
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for i, u, text in zip(ids, uids, texts):
            got = early.of(i, u)
            a, b = removed(text, got[got & 1 == 0] >> 1, after.of(i, u)) if len(text) >= LENGTH else (np.empty(0, int), np.empty(0, int))
            kept = b"".join(text[x:y] for x, y in zip(np.r_[0, b].tolist(), np.r_[a, len(text)].tolist()))
            out["n_bytes"].append(len(text))
            out["n_removed"].append(len(text) - len(kept))
            out["n_spans"].append(len(a))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept.decode("utf-8", "ignore") if cut and len(a) else None)
        rows = left["row"].combine_chunks()
        if not cut:
            return pa.table({"doc_id": rows.field("doc_id").cast(pa.int64()), **{k: pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")}, "kept_sha256": pa.array(out["kept_sha256"], pa.string())})
        stay = np.array([x != "" for x in out["kept"]])
        cols = {f.name: rows.field(k) for k, f in enumerate(rows.type)}
        texts = left["text"].to_pylist()
        cols["text"] = pa.array([t if k is None else k for t, k in zip(texts, out["kept"])], pa.string())
        if "n_chars" in cols:
            cols["n_chars"] = pa.array([n if k is None else len(k) for n, k in zip(cols["n_chars"].to_pylist(), out["kept"])], cols["n_chars"].type)
        return pa.table({k: cols[k] for k in schema.names}).filter(pa.array(stay))

    return held.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(run, schema)


REPORT = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(k, T.LongType()) for k in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())])


def _run(docs: DataFrame, cut: bool) -> DataFrame:
    n = total_bytes(docs, "text")
    n_shards, n_buckets = shards_for(n, SHARD), shards_for(n, BUCKET)
    held = _held(docs, n_buckets, [c for c in docs.columns if c != "text"] if cut else ["doc_id"])
    said = materialize(_matched(_cells(held, n_shards)))
    release(docs.sparkSession)
    # Both cogroups read the one exchange of the texts.
    return _final(held, said, _compared(_windows(held, said, n_shards)), docs.schema if cut else REPORT, cut)


def deduplicate(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` by row of ``docs(doc_id, text)``.

    Texts are UTF-8 bytes, null counts as empty, matches never cross documents and are judged on the
    input. Rows alike in doc_id do not remove each other's bytes. A null doc_id comes after all others.
    Texts below LENGTH bytes stay. An empty table gives an empty result.
    """
    return _run(docs, cut=False)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the removed bytes cut from ``text``; rows of which nothing is left go.

    All other columns stay (``n_chars``, where there is one, is counted anew where a text changes); a character cut in part goes whole.
    """
    return _run(docs, cut=True)
