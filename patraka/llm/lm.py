"""Scoring by a hierarchical Pitman-Yor bigram model.

Each context word has a restaurant, all contexts share their parent, the unigram restaurant, whose base
is uniform over the training tokens and one unknown token. Customers of a dish in a restaurant sit at
tables; each table sends one customer to the parent. Seatings are sampled by Gibbs: a dish's number of
tables is drawn from its conditional given all others, by generalized Stirling numbers for up to FEW
customers and by seating in growing groups beyond. Predictive probabilities are averaged over samples.

Distribution. Pairs (context, word) are dealt to shards by a hash of both, so that a frequent context or
word is spread over all shards. A shard holds its pairs' counts and where they occur. Shards first seat
by their own estimates of what the others hold; one exchange by word then sums each word's customers and
tables as a context and as a dish, and samples the parent's tables; with these totals each shard samples
on, predicts its pairs, and adds up the scores of its share of each document. The exchange goes by way of
groups, about the root of the shards in number: a group adds up its shards' words, receivers of ranges of words
add up the groups, and totals come back the same way, so that rows grow with the shards and not with their
square. Words are 64-bit hashes;
those of a table of frequent words travel as places in it, which changes no result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patraka.llm.common import materialize, mix64, shards_for, text_bytes, total_bytes
from patraka.llm.packing import pack, unpack

DISCOUNT, STRENGTH = 0.8, 1.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.6, 1.0
FIRST, BURN, SAMPLES = 3, 2, 4  # sweeps by a shard's own estimates, by the totals before sampling, and sampled
FEW = 64
BLOCK = 6 << 20  # text bytes whose pairs are sent together
SHARD = 16 << 20  # text bytes whose pairs a shard holds, about
BUCKET = 32 << 20  # text bytes of the documents whose scores are added up together, about
WORDS = 400_000  # word hashes that a task remembers
TABLE_SAMPLE = 32 << 20  # text bytes, about, from which the table of frequent words is taken
TABLE = 1 << 19  # words of the table at most: 4 MB to broadcast
FINE = 2.0**24  # base scores travel as multiples of its inverse
START, END = np.uint64(1), np.uint64(2)
LAST = 2**63 - 1  # stands for a null doc_id
_DOC = np.dtype([("id", "<i8"), ("uid", "<i8"), ("train", "u1"), ("bucket", "<i4")])


class Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word, 6) | 4
        return got


def tokens(text: bytes, hashes: Hashes) -> np.ndarray:
    """Hashes of the lower-cased words, then the end; long texts are cut at blanks."""
    parts, at = [], 0
    while at < len(text):
        to = min(at + (1 << 20), len(text))
        while to < len(text) and text[to] not in b" \t\n\r\x0b\x0c":
            to += 1
        words = text[at:to].lower().split()
        parts.append(np.fromiter((hashes[w] for w in words), np.uint64, len(words)))
        at = to
    return np.concatenate([*parts, np.array([END])])


def frequent(docs: DataFrame, n_bytes: int) -> np.ndarray:
    """Sorted hashes of the words that occur more than once in a sample of whole documents, TABLE at most."""
    share = min(1.0, TABLE_SAMPLE / max(n_bytes, 1))
    unit = F.pmod(F.xxhash64("id", F.lit("table")), F.lit(1 << 30)) / float(1 << 30)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, words, n = Hashes(), np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in it:
            own = np.concatenate([tokens(t, hashes) for t in text_bytes(batch.column(0))])
            words, at = np.unique(np.r_[words, own], return_inverse=True)
            n = np.bincount(at, np.r_[n, np.ones(len(own), np.int64)]).astype(np.int64)
        for i in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 50_000].view(np.int64)), pa.array(n[i : i + 50_000])], names=["word", "n"])

    counted = docs.where(unit < share).select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = counted.where("n > 1").orderBy(F.desc("n"), "word").limit(TABLE).select("word").toArrow()["word"]
    return np.sort(got.to_numpy().view(np.uint64)) if len(got) else np.empty(0, np.uint64)


def coded(words: np.ndarray, table: np.ndarray) -> dict[str, bytes]:
    """Sorted distinct words: places in the table of those that it has, hashes of the others."""
    at = np.minimum(np.searchsorted(table, words), max(len(table) - 1, 0))
    known = table[at] == words if len(table) else np.zeros(len(words), dtype=bool)
    return {"words": words[~known].tobytes(), "known": pack(np.diff(at[known], prepend=0).astype(np.uint32))}


def decoded(row: dict, table: np.ndarray) -> np.ndarray:
    return np.sort(np.r_[table[np.cumsum(unpack(row["known"], np.uint32))], np.frombuffer(row["words"], np.uint64)])


# ---------------------------------------------------------------------------------------------------
# Seating


def stirling(discount: float, most: int = FEW) -> np.ndarray:
    """Logs of generalized Stirling numbers: of seatings of c customers at t tables, by weight."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(most + 1)
    for c in range(1, most):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = out[c] + np.log(np.maximum(c - discount * t, 0))
        out[c + 1] = np.logaddexp(np.r_[-np.inf, out[c, :-1]], np.where(np.isfinite(out[c]), stay, -np.inf))
    return out


@dataclass
class Parent:
    """By dish: what the parent restaurant gives a customer, as ``mass / size``; ``fresh``: the parent lacks the dish so far."""

    mass: np.ndarray
    size: np.ndarray
    fresh: np.ndarray | None = None  # None: a fixed base, which customers don't change

    def of(self, dish: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probability of the dishes once ``tables`` customers more have gone there."""
        if self.fresh is None:
            return self.mass[dish] / self.size[dish]
        more = tables - ROOT_DISCOUNT * (self.fresh[dish] & (tables > 0))
        return (self.mass[dish] + more) / (self.size[dish] + tables)


def seat(c: np.ndarray, weight: np.ndarray, parent: Parent, discount: float, table: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of c customers each, drawn given all other dishes of their restaurants.

    A further table opens with the weight ``weight + discount * own tables`` (strength and discounted
    tables of the other dishes, and the own so far) times the dish's probability in the parent.
    """
    t = np.minimum(c, 1).astype(np.int64)
    few = np.flatnonzero((c > 1) & (c <= FEW))
    few = few[np.argsort(c[few], kind="stable")]
    cuts = np.searchsorted(c[few], np.arange(2, FEW + 2))
    for n, (a, b) in enumerate(zip(cuts, cuts[1:]), 2):
        own_tables = np.arange(n)
        for i in range(a, b, 65536):
            own = few[i : min(i + 65536, b), None]
            log_p = np.cumsum(np.log((weight[own] + discount * own_tables) * parent.of(own, own_tables)), axis=1) + table[n, 1 : n + 1]
            t[own[:, 0]] = 1 + np.argmax(log_p + rng.gumbel(size=log_p.shape), axis=1)
    many = np.flatnonzero(c > FEW)
    left, at = c[many] - 1, np.ones(len(many), dtype=np.int64)
    while len(many):
        group = np.minimum(left, np.maximum(1, at // 16))
        new = (weight[many] + discount * t[many]) * parent.of(many, t[many])
        p = new / (new + np.maximum(at - discount * t[many], 1e-9))
        t[many] += rng.binomial(group, p)
        at, left = at + group, left - group
        go = left > 0
        many, left, at = many[go], left[go], at[go]
    return t


class Shard:
    """Pairs of one shard and where they occur, from the rows that blocks have sent."""

    def __init__(self, t: pa.Table, number: int, shards: int, frequent: np.ndarray):
        words, u, w, pair, doc, times, docs = [], [], [], [], [], [], []
        n_words = n_pairs = n_docs = 0
        for r in t.select(["words", "known", "u", "w", "pair", "doc", "times", "docs"]).to_pylist():
            words.append(decoded(r, frequent))
            u.append(np.cumsum(unpack(r["u"], np.int32)) + n_words)
            w.append(unpack(r["w"], np.int32) + np.int32(n_words))
            pair.append(np.cumsum(unpack(r["pair"], np.int32)) + n_pairs)
            doc.append(unpack(r["doc"], np.int32) + np.int32(n_docs))
            times.append(unpack(r["times"], np.int32))
            docs.append(unpack(r["docs"], _DOC))
            n_words, n_pairs, n_docs = n_words + len(words[-1]), n_pairs + len(u[-1]), n_docs + len(docs[-1])
        self.number, self.shards, self.frequent = number, shards, frequent
        self.docs = np.concatenate(docs)
        self.words, at = np.unique(np.concatenate(words), return_inverse=True)
        key = at[np.concatenate(u)] * np.int64(len(self.words)) + at[np.concatenate(w)]
        key, inverse = np.unique(key, return_inverse=True)
        self.u, self.w = (key // len(self.words)).astype(np.int32), (key % len(self.words)).astype(np.int32)
        self.pair = inverse.astype(np.int32)[np.concatenate(pair)]
        self.doc, self.times = np.concatenate(doc), np.concatenate(times)
        learned = self.times * self.docs["train"][self.doc]
        self.c = np.bincount(self.pair, learned, len(self.u)).astype(np.int64)
        self.rng = np.random.default_rng([6, number])
        self.table = stirling(DISCOUNT)

    def by_word(self, index: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(index, values, len(self.words)).astype(np.int64)

    def first_seating(self) -> np.ndarray:
        """Seats by the shard's own estimates: it holds one in ``shards`` of each word's pairs."""
        grown = lambda k: np.where(k > 0, 1.0 + (k - 1) * self.shards, 0.0)
        t = np.ceil(self.c**DISCOUNT).astype(np.int64)  # about as many tables as there will be
        for _ in range(FIRST):
            contexts, dishes = grown(self.by_word(self.u, t)), grown(self.by_word(self.w, t))
            others = np.maximum(dishes[self.w] - t, 0)
            # about every word has one table in the parent
            parent = Parent(others - ROOT_DISCOUNT * np.minimum(others, 1) + ROOT_DISCOUNT, ROOT_STRENGTH + dishes.sum() - t, others == 0)
            t = seat(self.c, STRENGTH + DISCOUNT * np.maximum(contexts[self.u] - t, 0), parent, DISCOUNT, self.table, self.rng)
        return t

    def statistics(self, groups: int) -> Iterator[dict]:
        """One row for the shard's group, by word: customers and tables as a context, customers and tables as a dish."""
        t = self.first_seating()
        values = [self.by_word(self.u, self.c), self.by_word(self.u, t), self.by_word(self.w, self.c), self.by_word(self.w, t)]
        yield {"to": self.number % groups, "source": self.number, **coded(self.words, self.frequent), "counts": pack(np.stack(values).astype(np.int32))}

    def scores(self, t: pa.Table) -> Iterator[dict]:
        """One row for each bucket of documents: sums over this shard's share of their tokens."""
        (told,) = t.select(["counts", "totals"]).to_pylist()
        got, totals = unpack(told["counts"], np.int64).reshape(5, -1), np.frombuffer(told["totals"])
        n, v, customers, tables = totals
        context_c, context_t, dish_c, dish_n, dish_t = got
        now = self.first_seating()
        base_t, base_n = context_t - self.by_word(self.u, now), dish_n - self.by_word(self.w, now)
        mean = np.zeros(len(self.u))
        spare, first = (ROOT_STRENGTH + ROOT_DISCOUNT * tables) / (v + 1), now.sum()

        def mass(n: np.ndarray, t: np.ndarray) -> np.ndarray:
            return np.maximum(n - ROOT_DISCOUNT * np.minimum(t, n), 0) + spare

        for sweep in range(BURN + SAMPLES):
            # Half of the pairs at a time, so that those of a context don't all answer to the same state.
            turn = self.rng.random(len(now)) < 0.5
            for half in (turn, ~turn):
                # What this shard's pairs send to the parent follows their tables, what others send is as exchanged.
                total, sent, size = base_t + self.by_word(self.u, now), base_n + self.by_word(self.w, now), ROOT_STRENGTH + customers - first + now.sum()
                u, w, own = self.u[half], self.w[half], now[half]
                others = sent[w] - own
                parent = Parent(mass(others, dish_t[w]), size - own, others == 0)
                now[half] = seat(self.c[half], STRENGTH + DISCOUNT * np.maximum(total[u] - own, 0), parent, DISCOUNT, self.table, self.rng)
            if sweep >= BURN:
                total, sent, size = base_t + self.by_word(self.u, now), base_n + self.by_word(self.w, now), ROOT_STRENGTH + customers - first + now.sum()
                mean += (np.maximum(self.c - DISCOUNT * now, 0) + (STRENGTH + DISCOUNT * total[self.u]) * (mass(sent, dish_t) / size)[self.w]) / (STRENGTH + context_c[self.u])
        unseen = context_c[self.u] == 0
        mean = np.where(unseen, (mass(dish_n, dish_t) / (ROOT_STRENGTH + customers))[self.w], mean / SAMPLES)
        log_p = np.log10(mean)
        base = np.log10((dish_c + 1.0) / (n + v + 1.0))[self.w]
        known, ends = dish_c[self.w] > 0, self.words[self.w] == END
        sums = [np.bincount(self.doc, self.times * x[self.pair], len(self.docs)) for x in (np.ones(len(self.u)), known, ends, base, log_p)]
        bucket = self.docs["bucket"]
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0])
        for a, b in zip(cuts, np.r_[cuts[1:], len(order)]):
            own = order[a:b]
            docs = self.docs[own]
            yield {
                "bucket": int(bucket[own[0]]),
                "ids": pack(np.diff(docs["id"], prepend=0)),
                "uids": pack(docs["uid"]),
                "counts": pack(np.stack([s[own] for s in sums[:3]]).astype(np.int32)),
                "bases": pack(np.rint(sums[3][own] * FINE).astype(np.int64)),
                "scores": pack(sums[4][own].astype(np.float32)),
                "train_tokens": int(n),
            }


def added(rows: list[dict], frequent: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray]:
    """The words of rows with ``counts`` by word, sorted, and their sums."""
    words, sums = np.empty(0, np.uint64), np.zeros((4, 0), dtype=np.int64)
    for r in rows:
        own = decoded(r, frequent)
        both, at = np.unique(np.concatenate([words, own]), return_inverse=True)
        more = np.zeros((4, len(both)), dtype=np.int64)
        more[:, at[: len(words)]] = sums
        more[:, at[len(words) :]] += unpack(r["counts"], kind).reshape(4, -1)
        words, sums = both, more
    return words, sums


def by_receiver(words: np.ndarray, receivers: int) -> list[np.ndarray]:
    """Places of the words that each receiver is dealt."""
    to = (mix64(words) % np.uint64(receivers)).astype(np.int64)
    return np.split(np.argsort(to, kind="stable"), np.cumsum(np.bincount(to, minlength=receivers))[:-1])


def _batches(rows: Iterator[dict], fields: dict[str, pa.DataType]) -> pa.Table:
    return pa.Table.from_pylist(list(rows), schema=pa.schema(list(fields.items())))


_B, _L = pa.binary(), pa.int64()
SENT = "to long, words binary, known binary, u binary, w binary, pair binary, doc binary, times binary, docs binary"
STATS = {"to": _L, "source": _L, "words": _B, "known": _B, "counts": _B}
BACK = {"to": _L, "source": _L, "counts": _B, "totals": _B}
PART = {"bucket": _L, "ids": _B, "uids": _B, "counts": _B, "bases": _B, "scores": _B, "train_tokens": _L}


def ddl(fields: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{k} {'long' if v == _L else 'binary'}" for k, v in fields.items())


def _pairs(own: DataFrame, table: Broadcast, n_shards: int, n_buckets: int, modulus: int, remainder: int) -> DataFrame:
    fields = [f.split() for f in SENT.split(", ")]
    schema = pa.schema([(k, _L if t == "long" else _B) for k, t in fields])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()

        def send() -> Iterator[pa.RecordBatch]:
            n = np.array([len(x) for x in held])
            w = np.concatenate(held)
            u = np.r_[START, w[:-1]]
            u[np.r_[0, np.cumsum(n)[:-1]]] = START
            doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
            to = (mix64(u * np.uint64(0x9E3779B97F4A7C15) ^ w) % np.uint64(n_shards)).astype(np.int32)
            words, at = np.unique(np.r_[u, w], return_inverse=True)
            u, w = at[: len(u)].astype(np.int32), at[len(u) :].astype(np.int32)
            about = np.array(told, dtype=_DOC)
            order = np.lexsort((doc, w, u, to))
            u, w, doc, to = u[order], w[order], doc[order], to[order]
            cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            for a, b in zip(cuts, np.r_[cuts[1:], len(to)]):
                x, y, d = u[a:b], w[a:b], doc[a:b]
                new_pair = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
                new = new_pair | np.r_[True, d[1:] != d[:-1]]
                at = np.flatnonzero(new)
                heads = np.flatnonzero(new_pair)
                own, index = np.unique(np.r_[x[heads], y[heads]], return_inverse=True)
                docs_of, place = np.unique(d[at], return_inverse=True)
                i = index.astype(np.int32)
                row = {
                    "to": int(to[a]),
                    **coded(words[own], table.value),
                    "u": pack(np.diff(i[: len(heads)], prepend=np.int32(0))),
                    "w": pack(i[len(heads) :]),
                    "pair": pack(np.diff((np.cumsum(new_pair) - 1)[at], prepend=0).astype(np.int32)),
                    "doc": pack(place.astype(np.int32)),
                    "times": pack(np.diff(np.r_[at, b - a]).astype(np.int32)),
                    "docs": pack(about[docs_of]),
                }
                yield pa.RecordBatch.from_pylist([row], schema=schema)

        held, told, size = [], [], 0
        for batch in it:
            ids, uids, buckets = (batch.column(i).to_pylist() for i in range(3))
            for i, x, b, text in zip(ids, uids, buckets, text_bytes(batch.column(3))):
                train = i != LAST and zlib.crc32(str(i).encode()) % modulus != remainder
                held.append(tokens(text, hashes))
                told.append((i, x, train, b))
                size += len(text) + 64
                if size >= BLOCK:
                    yield from send()
                    held, told, size = [], [], 0
        if held:
            yield from send()

    return own.select("id", "uid", F.pmod(F.xxhash64("id", "uid"), F.lit(n_buckets)).alias("bucket"), "text").mapInArrow(run, SENT)


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` by row of ``docs(doc_id, text)``.

    Learns from the rows whose crc32(doc_id as text) modulo ``modulus`` is not ``remainder``; scores all,
    as log10 probabilities of whole texts. A null text has the end as its one token. A row with a null
    doc_id is scored, not learned from, and counts as not held out. Rows alike get a row each. An empty
    table gives an empty result; with no row to learn from, every token has the base's probability 1. Other
    columns, of whatever name, are not read.
    """
    n = total_bytes(docs, "text") + 64 * docs.count()
    n_shards, n_buckets = shards_for(n, SHARD), shards_for(n, BUCKET)
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.col("text").cast("string").alias("text"))
    # Only rows that share an id need their texts' hash; zeros cost nothing where they travel.
    shared = materialize(own.groupBy("id").count().where(F.col("count") > 1).select(F.col("id").alias("shared")))
    uid = F.when(F.col("shared").isNull(), F.lit(0)).otherwise(F.coalesce(F.xxhash64("text"), F.lit(0))).cast("long")
    own = own.join(shared, F.col("id") == F.col("shared"), "left").select("id", uid.alias("uid"), "text")
    table = docs.sparkSession.sparkContext.broadcast(frequent(own, n))
    sent = _pairs(own, table, n_shards, n_buckets, modulus, remainder)

    groups = math.isqrt(n_shards - 1) + 1  # and as many receivers

    def first(key: tuple, t: pa.Table) -> pa.Table:
        return _batches(Shard(t, key[0].as_py(), n_shards, table.value).statistics(groups), STATS)

    def gather(key: tuple, t: pa.Table) -> pa.Table:
        words, sums = added(t.select(["words", "known", "counts"]).to_pylist(), table.value, np.int32)
        dealt = ((r, np.sort(own)) for r, own in enumerate(by_receiver(words, groups)))
        return _batches(({"to": r, "source": key[0].as_py(), **coded(words[own], table.value), "counts": pack(sums[:, own])} for r, own in dealt), STATS)

    def exchange(key: tuple, t: pa.Table) -> pa.Table:
        rows = t.select(["source", "words", "known", "counts"]).to_pylist()
        unique, sums = added(rows, table.value, np.int64)
        v, customers = int((sums[2] > 0).sum()), int(sums[3].sum())
        tables = np.minimum(sums[3], 1)
        rng, numbers = np.random.default_rng([60, key[0].as_py()]), stirling(ROOT_DISCOUNT)
        for _ in range(BURN + 1):
            others = ROOT_STRENGTH + ROOT_DISCOUNT * np.maximum(groups * tables.sum() - tables, 0)
            tables = seat(sums[3], others, Parent(np.ones(len(unique)), np.full(len(unique), groups * v + 1.0)), ROOT_DISCOUNT, numbers, rng)
        totals = np.array([sums[2].sum(), v, customers, tables.sum()], dtype=np.float64).tobytes()
        out = np.vstack([sums, tables])
        back = ({"to": r["source"], "source": key[0].as_py(), "counts": pack(out[:, np.searchsorted(unique, decoded(r, table.value))]), "totals": totals} for r in rows)
        return _batches(back, BACK)

    def share(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.select(["source", "words", "known", "counts"]).to_pylist()
        words, _ = added(rows, table.value, np.int32)
        got, totals, dealt = np.zeros((5, len(words)), dtype=np.int64), np.zeros(4), by_receiver(words, groups)
        for r in right.select(["source", "counts", "totals"]).to_pylist():
            got[:, np.sort(dealt[r["source"]])] = unpack(r["counts"], np.int64).reshape(5, -1)
            totals += np.frombuffer(r["totals"])
        back = ({"to": r["source"], "source": key[0].as_py(), "counts": pack(got[:, np.searchsorted(words, decoded(r, table.value))]), "totals": totals.tobytes()} for r in rows)
        return _batches(back, BACK)

    def second(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _batches(Shard(left, key[0].as_py(), n_shards, table.value).scores(right), PART)

    def add(key: tuple, t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        ids = np.concatenate([np.cumsum(unpack(r["ids"], np.int64)) for r in rows])
        uids = np.concatenate([unpack(r["uids"], np.int64) for r in rows])
        order = np.lexsort((uids, ids))
        heads = np.flatnonzero(np.r_[True, (np.diff(ids[order]) != 0) | (uids[order][1:] != uids[order][:-1])])
        counts = np.add.reduceat(np.concatenate([unpack(r["counts"], np.int32).reshape(3, -1) for r in rows], axis=1)[:, order].astype(np.int64), heads, axis=1)
        bases = np.add.reduceat(np.concatenate([unpack(r["bases"], np.int64) for r in rows])[order], heads) / FINE
        scores = np.add.reduceat(np.concatenate([unpack(r["scores"], np.float32) for r in rows]).astype(np.float64)[order], heads)
        alike = counts[2]  # rows of this id and text: each has one end
        own = np.repeat(np.arange(len(heads)), alike)
        doc = ids[order][heads][own]
        return pa.table(
            {
                "doc_id": pa.array(doc, mask=doc == LAST),
                "held_out": pa.array([d != LAST and zlib.crc32(str(d).encode()) % modulus == remainder for d in doc.tolist()], pa.bool_()),
                "n_tokens": (counts[0] // alike)[own],
                "n_known": (counts[1] // alike)[own],
                "train_tokens": pa.array(np.full(len(own), rows[0]["train_tokens"]), _L),
                "base_score": (bases / alike)[own],
                "score": (scores / alike)[own],
            }
        )

    stats = sent.groupBy("to").applyInArrow(first, ddl(STATS))  # Spark reuses the exchanges of both
    totals = stats.groupBy("to").applyInArrow(gather, ddl(STATS)).groupBy("to").applyInArrow(exchange, ddl(BACK))
    told = stats.groupBy("to").cogroup(totals.groupBy("to")).applyInArrow(share, ddl(BACK))
    parts = sent.groupBy("to").cogroup(told.groupBy("to")).applyInArrow(second, ddl(PART))
    return parts.groupBy("bucket").applyInArrow(add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
