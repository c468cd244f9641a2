"""Alignment of word sequences into lattices of alternatives.

The traceback and the progressive merge are sequential, so that they run in Arrow batches: tables of many
rows are filled together (``patraka.functions.edits``), and error rates are measured in the same pass.
``align_pair`` and ``align_all`` state the rules for one row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from patraka.functions import edits
from patraka.functions.edits import LEFT, UP, Words, distance

GAP = 1.0
RATED = "struct<lattice:array<array<string>>,errors:array<long>,lattice_errors:array<long>>"


class Distances(dict):
    """Distances of pairs of words; those within groups are computed together, others when asked for."""

    def __init__(self, groups: Iterable[Iterable[str]] = ()):
        groups = [sorted(set(g)) for g in groups]
        words = sorted({w for g in groups for w in g})
        number = {w: i for i, w in enumerate(words)}
        pairs = sorted({p for g in groups for p in combinations(g, 2)})
        got = Words(words).distances(np.array([number[a] for a, _ in pairs], dtype=np.int64), np.array([number[b] for _, b in pairs], dtype=np.int64))
        for (a, b), d in zip(pairs, got.tolist()):
            self[a, b] = self[b, a] = d

    def __missing__(self, pair: tuple[str, str]) -> float:
        got = self[pair] = distance(*pair)
        return got


def align_pair(first: Sequence[str], second: Sequence[str], gap: float = GAP, known: Distances | None = None) -> list[tuple[str | None, str | None]]:
    """Least-cost global alignment; among equals a pair, then a gap in the second, then one in the first."""
    m, n = len(first), len(second)
    known = Distances() if known is None else known
    costs = [[0.0 if x == y else known[x, y] for y in second] for x in first]
    best = [[j * gap for j in range(n + 1)]]
    for i in range(1, m + 1):
        above, row = best[-1], [i * gap]
        for j in range(1, n + 1):
            row.append(min(above[j - 1] + costs[i - 1][j - 1], above[j] + gap, row[j - 1] + gap))
        best.append(row)
    out, i, j = [], m, n
    while i or j:
        if i and j and best[i][j] == best[i - 1][j - 1] + costs[i - 1][j - 1]:
            i, j = i - 1, j - 1
            out.append((first[i], second[j]))
        elif i and (not j or best[i][j] == best[i - 1][j] + gap):
            i -= 1
            out.append((first[i], None))
        else:
            j -= 1
            out.append((None, second[j]))
    return out[::-1]


def majority(row: Sequence) -> object:
    """The most frequent entry that is no gap (None), the earliest among equals."""
    own = first(row)
    if 2 * row.count(own) >= len(row):
        return own
    return Counter(w for w in row if w is not None).most_common(1)[0][0]


def merge(rows: list[list], steps: Iterable[tuple], k: int, anchored: bool) -> list[list]:
    """Positions of ``k`` sequences with one sequence more, aligned to their majorities by ``steps``; ``rows`` are grown in place."""
    merged, at, n = [], 0, len(rows)
    for old, new in steps:
        if old is None:
            merged.append([None] * k + [new])
            continue
        while at < n:
            row, at = rows[at], at + 1
            merged.append(row)
            if anchored or first(row) == old:
                row.append(new)
                break
            row.append(None)
    for row in rows[at:]:
        row.append(None)
    return merged + rows[at:]


def first(row: Sequence) -> object:
    """The first entry that is no gap."""
    return row[0] if row[0] is not None else next(w for w in row if w is not None)


def align_all(sequences: Sequence[Sequence[str]], anchored: bool = False, known: Distances | None = None) -> list[list[str | None]]:
    """Progressive alignment to the first sequence; one row for each position, one entry for each sequence.

    By default a later word finds its position by the position's first word, so that words are lost where
    the majority at a position differs from it; ``anchored`` keeps them, merging by position.
    """
    if not sequences:
        return []
    rows: list[list[str | None]] = [[w] for w in sequences[0]]
    for k, sequence in enumerate(sequences[1:], 1):
        rows = merge(rows, align_pair([majority(row) for row in rows], sequence, known=known), k, anchored)
    return rows


def bins(rows: Iterable[Sequence], min_support: int = 1, order: Callable | None = None) -> list[list]:
    """Alternatives of each position, sorted; ``min_support`` (an extension) asks for so many sequences, the first excepted."""
    out = []
    for row in rows:
        kept = {w for w in row if w is not None and w != ""}
        if min_support > 1:
            kept = {w for w in kept if w == row[0] or row.count(w) >= min_support}
        if kept:
            out.append(sorted(kept, key=order) if len(kept) > 1 else [*kept])
    return out


class Batch:
    """Rows of sequences of words by number, from ``list<list<string>>``; null counts as empty."""

    def __init__(self, column: pa.Array):
        self.rows = edits.Runs(column)
        self.sequences = edits.Runs(self.rows.inner)
        coded = self.sequences.inner.cast(pa.string()).fill_null("").dictionary_encode()
        self.texts, self.ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        self.words = Words(self.texts.to_pylist())
        ends = np.r_[0, np.cumsum(self.sequences.sizes)]
        self.total = ends[self.rows.starts + self.rows.sizes] - ends[self.rows.starts]  # words by row

    def nth(self, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k``-th sequences of rows that have as many, and their lengths."""
        own = self.rows.starts[rows] + k
        n = self.sequences.sizes[own]
        return edits.grid(self.ids, self.sequences.starts[own], n, -1), n


def _majorities(held: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row and position the first entry and the majority."""
    k = held.shape[2]
    own = held[:, :, 0].copy()
    for t in range(1, k):
        own = np.where(own < 0, held[:, :, t], own)
    said = own.copy()
    few = np.nonzero((2 * (held == own[:, :, None]).sum(axis=2) < k) & (np.arange(held.shape[1]) < size[:, None]))
    some = held[few]
    often = np.where(some < 0, 0, (some[:, :, None] == some[:, None, :]).sum(axis=2))
    said[few] = some[np.arange(len(some)), often.argmax(axis=1)]  # the earliest of the most frequent
    return own, said


def _merged(held: np.ndarray, size: np.ndarray, batch: Batch, rows: np.ndarray, k: int, anchored: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``k`` sequences of rows with one sequence more, and their number."""
    own, said = _majorities(held, size)
    new, n = batch.nth(rows, k)
    path, ends = edits.aligned(said, size, new, n, batch.words, GAP)
    done = path == edits.DONE
    old, word = ~done & (path != LEFT), ~done & (path != UP)
    odd = np.flatnonzero(((own != said) & (np.arange(own.shape[1]) < size[:, None])).any(axis=1)) if not anchored else ()
    lists = {}
    for r in odd:  # words may be lost
        steps = zip(np.where(old[r], said[r, np.maximum(np.cumsum(old[r]) - 1, 0)], -1)[: ends[r]].tolist(), np.where(word[r], new[r, np.maximum(np.cumsum(word[r]) - 1, 0)], -1)[: ends[r]].tolist()) if len(new[r]) and len(said[r]) else None
        if steps is not None:
            now = [[None if w < 0 else w for w in row] for row in held[r, : size[r]].tolist()]
            lists[r] = merge(now, [(None if a < 0 else a, None if b < 0 else b) for a, b in steps], k, anchored)
    wide = max([path.shape[1], *map(len, lists.values())])
    out = np.full((len(rows), wide, k + 1), -1, dtype=np.int32)
    r, at = np.nonzero(old)
    out[r, at, :k] = held[r, (np.cumsum(old, axis=1) - 1)[r, at]]
    r, at = np.nonzero(word)
    out[r, at, k] = new[r, (np.cumsum(word, axis=1) - 1)[r, at]]
    for r, got in lists.items():
        out[r], ends[r] = -1, len(got)
        out[r, : len(got)] = [[-1 if w is None else w for w in row] for row in got]
    return out, ends


class Lattices:
    """Lattices of a batch: by row the first bin and their number, by bin the first alternative and their number, and the words."""

    def __init__(self, batch: Batch, anchored: bool, min_support: int):
        order = sorted(range(len(batch.words.words)), key=batch.words.words.__getitem__)
        by_rank, rank = np.array([*order, -1]), np.full(len(order) + 1, len(order))  # the last stands for a gap
        rank[order] = np.arange(len(order))
        empty = batch.words.words.index("") if "" in batch.words.words else -1
        count, most = batch.rows.sizes, len(order)
        got, place, bins, sizes, words = [], np.zeros(len(count), dtype=np.int64), [], [], []
        for k in np.unique(count).tolist():
            same = np.flatnonzero(count == k)
            for part in edits.parts((batch.total[same] + 1) * (k + 1) * 4, edits.CELLS):
                rows = same[part]
                held, n = (np.empty((len(rows), 0, 1), np.int32), np.zeros(len(rows), np.int64)) if not k else batch.nth(rows, 0)
                held = held.reshape(len(rows), -1, 1)
                for t in range(1, k):
                    held, n = _merged(held, n, batch, rows, t, anchored)
                if empty >= 0:
                    held = np.where(held == empty, -1, held)
                if min_support > 1:
                    often = np.stack([(held == held[:, :, t, None]).sum(axis=2) for t in range(held.shape[2])], axis=2)
                    held = np.where((held == held[:, :, :1]) | (often >= min_support), held, -1)
                ranks = np.sort(rank[held], axis=2)
                kept = ranks < most
                kept[:, :, 1:] &= ranks[:, :, 1:] != ranks[:, :, :-1]
                each = kept.sum(axis=2)
                got.append(rows)
                bins.append((each > 0).sum(axis=1))
                sizes.append(each[each > 0])
                words.append(by_rank[ranks[kept]])
        joined = lambda xs: np.concatenate(xs).astype(np.int64) if xs else np.empty(0, np.int64)
        self.bins, self.sizes, self.words = joined(bins), joined(sizes), joined(words)
        place[joined(got)] = np.arange(len(count))
        self.place, self.texts = place, batch.texts
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.first, self.count = (np.cumsum(self.bins) - self.bins)[place], self.bins[place]

    def arrow(self) -> pa.Array:
        ends = lambda n: pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
        inner = pa.ListArray.from_arrays(ends(self.sizes), self.texts.take(pa.array(self.words)))
        return pa.ListArray.from_arrays(ends(self.bins), inner).take(pa.array(self.place))


def lattice(sequences: Column, anchored: bool = False, min_support: int = 1) -> Column:
    """``array<array<string>>`` of bins from an array of word arrays, the reference first."""

    @F.arrow_udf("array<array<string>>")
    def build(column: pa.Array) -> pa.Array:
        return Lattices(Batch(column), anchored, min_support).arrow()

    return build(sequences)


def rated(sequences: Column, anchored: bool = False, min_support: int = 1, epsilon_bins: bool = False) -> Column:
    """``struct<lattice, errors, lattice_errors>`` from an array of word arrays, the reference first, in one pass.

    The latter two have an entry for each sequence but the reference: its word edits against the reference and
    against the lattice. ``epsilon_bins`` (an extension): bins without a word of the reference may be left out
    at no cost.
    """

    @F.arrow_udf(RATED)
    def build(column: pa.Array) -> pa.Array:
        batch = Batch(column)
        made = Lattices(batch, anchored, min_support)
        each = np.maximum(batch.rows.sizes - 1, 0)
        owner = np.repeat(np.arange(len(each)), each)
        ends = np.r_[0, np.cumsum(each)]
        reference, hyp = batch.rows.starts[owner], batch.rows.starts[owner] + 1 + np.arange(len(owner)) - ends[owner]
        starts, sizes, ids = batch.sequences.starts, batch.sequences.sizes, batch.ids
        one = np.ones(len(ids), dtype=np.int64)
        plain = edits.counts(starts[reference], sizes[reference], np.ones(len(owner), dtype=np.int64), np.arange(len(ids)), one, ids, starts[hyp], sizes[hyp], ids)
        said, lattices = [ids[a : a + n] for a, n in zip(starts[hyp], sizes[hyp])] if epsilon_bins else [], made.arrow()
        if epsilon_bins:
            number = {w: i for i, w in enumerate(batch.words.words)}
            bins = [[[number[w] for w in b] for b in x] for x in lattices.to_pylist()]
            known = [set(ids[starts[r] : starts[r] + sizes[r]].tolist()) if n else set() for r, n in zip(batch.rows.starts, batch.rows.sizes)]
            free = [[int(not own.isdisjoint(b)) for b in x] for own, x in zip(known, bins)]
            folded = np.zeros(len(said), dtype=np.int64)
            for own in edits.parts(np.array([(len(s) + 1) * (len(bins[i]) + 1) for s, i in zip(said, owner)], dtype=np.int64)):
                of = owner[own].tolist()
                folded[own] = edits.through([bins[i] for i in of], [said[k] for k in own], [free[i] for i in of])
        else:
            most = np.zeros(len(each), dtype=np.int64)
            for i in np.flatnonzero(made.count).tolist():
                most[i] = made.sizes[made.first[i] : made.first[i] + made.count[i]].max()
            folded = edits.counts(made.first[owner], made.count[owner], most[owner], made.starts, made.sizes, made.words, starts[hyp], sizes[hyp], ids)
        lists = (pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x)) for x in (plain, folded))
        return pa.StructArray.from_arrays([lattices, *lists], ["lattice", "errors", "lattice_errors"])

    return build(sequences)


def pairs(first: Column, second: Column, gap: float = GAP) -> Column:
    """``array<struct<a, b>>``: the pairwise alignment, gaps as nulls."""

    @F.arrow_udf("array<struct<a:string,b:string>>")
    def build(column: pa.Array) -> pa.Array:
        batch = Batch(column)
        texts = batch.texts
        lengths, order, paths, sides = np.zeros(len(column), dtype=np.int64), [], [], ([], [])
        for rows in edits.parts((batch.total + 1) * 4):
            (x, m), (y, n) = batch.nth(rows, 0), batch.nth(rows, 1)
            path, lengths[rows] = edits.aligned(x, m, y, n, batch.words, gap)
            order.append(rows)
            paths.append(path[path != edits.DONE])
            for side, words, size in ((sides[0], x, m), (sides[1], y, n)):
                side.append(words[np.arange(words.shape[1]) < size[:, None]])
        joined = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
        steps, order = joined(paths, np.uint8), joined(order, np.int64)

        def said(k: int, skipped: int) -> pa.Array:
            index, stands = np.zeros(len(steps), dtype=np.int64), steps != skipped
            index[stands] = joined(sides[k], np.int32)
            return texts.take(pa.array(index, mask=~stands))

        place = np.empty(len(column), dtype=np.int64)
        place[order] = np.arange(len(order))
        ends = pa.array(np.r_[0, np.cumsum(lengths[order])].astype(np.int32))
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([said(0, LEFT), said(1, UP)], ["a", "b"])).take(pa.array(place))

    return build(F.array(first, second))
