"""Alignment and edit tables of many rows at once, filled and read back by numpy.

Rows are given as sequences of word numbers. Tables of a part of the rows are filled together, a diagonal
or a row of all of them at a time, so that the work in Python grows with the longest row of a part and not
with its cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

LONG = 32  # letters beyond which a word's distances are computed one by one
PAIRS = 1 << 14  # pairs of words whose distances are computed together
BITS = 64  # places of the rows whose edits are counted together
CELLS = 1 << 21  # cells of the tables that are filled together; a larger table stands alone
PAIR, UP, LEFT, DONE = range(4)
_DOWN, _RIGHT = np.array([1, 1, 0, 0]), np.array([1, 0, 1, 0])


def distance(a: str, b: str) -> float:
    """Levenshtein distance by the longer length."""
    if a == b:
        return 0.0
    if not a or not b:
        return 1.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1] / max(len(a), len(b))


class Words:
    """The distinct words of a batch, by number."""

    def __init__(self, words: Sequence[str]):
        self.words = list(words)
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        width = int(min(self.sizes.max(initial=1), LONG)) or 1
        letters = np.array([w[:LONG] for w in self.words], dtype=f"U{width}").view(np.uint32).reshape(len(self.words), width)
        self.letters = np.ascontiguousarray(letters.T.astype(np.uint16 if letters.max(initial=0) < 1 << 16 else np.uint32))  # by place and word
        self.kinds: np.ndarray | None = None

    def distances(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Normalized distances of pairs of different words."""
        out = np.empty(len(i))
        i, j = np.where(self.sizes[i] <= self.sizes[j], i, j), np.where(self.sizes[i] <= self.sizes[j], j, i)
        m, n = self.sizes[i], self.sizes[j]
        for k in np.flatnonzero(n > LONG):
            out[k] = distance(self.words[i[k]], self.words[j[k]])
        order = np.flatnonzero(n <= LONG)
        order = order[np.argsort((n[order] * (LONG + 1) + m[order]).astype(np.uint16), kind="stable")]
        for at in range(0, len(order), PAIRS):  # pairs of about the same lengths side by side
            own = order[at : at + PAIRS]
            high, wide = int(m[own].max()), int(n[own].max())
            out[own] = self._table(self.letters[:high].take(i[own], axis=1), self.letters[:wide].take(j[own], axis=1), m[own], n[own]) / n[own]
        return out

    @staticmethod
    def _table(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(b) + 1, dtype=np.int16)[:, None], len(m), axis=1)
        before, last = np.empty_like(row), n.copy()  # right for words without a letter
        for i, x in enumerate(a, 1):
            before, row = row, before
            row[0] = i
            other = np.add(before[:-1], x != b)  # of all columns at once
            np.minimum(before[1:] + np.int16(1), other, out=row[1:])
            for j in range(1, len(b) + 1):
                np.minimum(row[j], row[j - 1] + np.int16(1), out=row[j])
            done = np.flatnonzero(m == i)
            last[done] = row[n[done], done]
        return last

    def costs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Normalized distances of pairs of words, equal ones too."""
        out, other = np.zeros(len(i)), np.flatnonzero(i != j)
        out[other] = self.distances(i[other], j[other])
        return out

    def least(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """What the distances are at least, by the words' lengths and the letters that only one of them has."""
        if self.kinds is None:
            self.kinds = np.zeros(len(self.words), dtype=np.uint64)
            for place, letters in enumerate(self.letters):
                self.kinds |= np.where(place < self.sizes, np.left_shift(np.uint64(1), (letters & 63).astype(np.uint64)), np.uint64(0))
        a, b, m, n = self.kinds[i], self.kinds[j], self.sizes[i], self.sizes[j]
        most = np.maximum(m, n)
        edits = np.maximum(abs(m - n), 1)
        shown = np.flatnonzero(most <= LONG)
        for one, other in ((a, b), (b, a)):
            edits[shown] = np.maximum(edits[shown], np.bitwise_count(one[shown] & ~other[shown]))
        return np.where(i == j, 0.0, edits / np.maximum(most, 1))


    def within(self, rows: Sequence[np.ndarray]) -> tuple[np.ndarray, list[list[int]], list[np.ndarray]]:
        """Distances between the distinct words of each row as tables, those words, and the rows in places of their table."""
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        row = np.repeat(np.arange(len(rows)), sizes)
        flat = np.concatenate(rows) if len(rows) else np.empty(0, np.int64)
        pairs, inverse = np.unique(row * len(self.words) + flat, return_inverse=True)
        owner, word = pairs // len(self.words), pairs % len(self.words)
        starts = np.searchsorted(owner, np.arange(len(rows) + 1))
        side = int(np.diff(starts).max(initial=0))
        place = inverse - starts[row]
        own = np.zeros((len(rows), side), dtype=np.int64)
        own[owner, np.arange(len(word)) - starts[owner]] = word
        real = np.arange(side) < np.diff(starts)[:, None]
        code = own[:, :, None] * len(self.words) + own[:, None, :]
        wanted = (own[:, :, None] < own[:, None, :]) & real[:, :, None] & real[:, None, :]
        unique, at = np.unique(code[wanted], return_inverse=True)
        table = np.zeros(code.shape)
        table[wanted] = self.distances(unique // len(self.words), unique % len(self.words))[at]
        table += table.transpose(0, 2, 1)
        return table, own.tolist(), np.split(place, np.cumsum(sizes)[:-1]) if len(rows) else []


def padded(rows: Sequence[np.ndarray], fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows as a matrix, and their lengths."""
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    out = np.full((len(rows), int(sizes.max(initial=0))), fill, dtype=np.int64)
    if len(rows):
        out[np.arange(out.shape[1]) < sizes[:, None]] = np.concatenate(rows)
    return out, sizes


def bands(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray, words: Words, gap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By row the least and the most that the place in the first is ahead of the place in the second on any least-cost
    path, and what that path can spend on pairs at most.

    The path costs no more than the edits of words at ``max(gap, 1)`` each, nor than pairs all along; each place
    ahead has its gaps.
    """
    if gap <= 0:
        return -n, m, np.full(len(m), np.inf)
    if 0 < x.shape[1] <= BITS:
        few = counted([x], m, y, n)
    else:
        few = np.array([counted_long([(w,) for w in a[:p].tolist()], b[:q].tolist()) for a, p, b, q in zip(x, m, y, n)], dtype=np.int64)
    most = few * max(gap, 1.0)
    level = np.flatnonzero((m == n) & (few > 0))
    if len(level):
        r, at = np.nonzero((x[level, : y.shape[1]] != y[level, : x.shape[1]]) & (np.arange(min(x.shape[1], y.shape[1])) < m[level, None]))
        most[level] = np.minimum(most[level], np.bincount(r, words.costs(x[level[r], at], y[level[r], at]), len(level)))
    left = most - abs(m - n) * gap + 1e-6
    spare = np.floor(left / gap / 2).astype(np.int64)
    return np.maximum(np.minimum(0, m - n) - spare, -n), np.minimum(np.maximum(0, m - n) + spare, m), left


def aligned(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray, words: Words, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """By row the steps of a least-cost global alignment and their number; among equals PAIR, then UP (a gap in the second), then LEFT.

    ``x`` and ``y``: matrices of words by number, of which a row's first ``m`` and ``n`` count. Only cells that a
    least-cost path can pass are filled, and words are compared where it can afford them as a pair; where these cells are
    wide, the whole tables.
    """
    low, high, left = bands(x, m, y, n, words, gap)
    ends, paths = np.zeros(len(m), dtype=np.int64), np.full((len(m), x.shape[1] + y.shape[1]), DONE, dtype=np.uint8)
    narrow, wide = np.flatnonzero(high - low < BITS), np.flatnonzero(high - low >= BITS)
    for own in parts((m[wide] + n[wide]) ** 2):
        own = wide[own]
        table, _, places = words.within([np.concatenate([x[r, : m[r]], y[r, : n[r]]]) for r in own])
        for r, path in zip(own.tolist(), _full([p[: m[r]] for p, r in zip(places, own)], [p[m[r] :] for p, r in zip(places, own)], table, gap)):
            paths[r, : len(path)], ends[r] = path, len(path)
    for own in parts((m[narrow] + 1) * (high - low + 1)[narrow], CELLS >> 2):
        own = narrow[own]
        h, w = int(m[own].max()), int(n[own].max())
        path, ends[own] = _banded(x[own, :h], m[own], y[own, :w], n[own], low[own], high[own], left[own], words, gap)
        paths[own, : path.shape[1]] = path
    return paths[:, : int(ends.max(initial=0))], ends


def _full(first: Sequence[np.ndarray], second: Sequence[np.ndarray], table: np.ndarray, gap: float) -> list[np.ndarray]:
    """By row the steps, from whole tables, a diagonal at a time; both sides are places in the row's ``table`` of distances."""
    (x, m), (y, n) = padded(first, 0), padded(second, 0)
    count, side, high, wide = len(m), table.shape[1] if len(table) else 0, x.shape[1], y.shape[1]
    cost, rows = table.reshape(-1), np.arange(count)
    x, y = np.ascontiguousarray(((rows * side)[:, None] + x).T) * side, np.ascontiguousarray(y.T)
    steps = np.empty((high + 1, wide + 1, count), dtype=np.uint8)
    steps[0], steps[:, 0], steps[0, 0] = LEFT, UP, DONE
    flat = steps.reshape(-1, count)
    one = two = np.zeros((high + 1, count))  # the two diagonals before, by place in the first
    for d in range(1, high + wide + 1):
        now = np.empty((high + 1, count))
        now[0] = d * gap
        if d <= high:
            now[d] = d * gap
        low, to = max(1, d - wide), min(high, d - 1)
        if low <= to:
            pair = two[low - 1 : to] + cost[x[low - 1 : to] + y[d - to - 1 : d - low][::-1]]
            up, left = one[low - 1 : to] + gap, one[low : to + 1] + gap
            best = np.minimum(np.minimum(pair, up), left)
            now[low : to + 1] = best
            i = np.arange(low, to + 1)
            flat[i * (wide + 1) + d - i] = np.where(best == pair, PAIR, np.where(best == up, UP, LEFT))
        two, one = one, now
    i, j, back = m.copy(), n.copy(), []
    while i.any() or j.any():
        step = steps[i, j, rows]
        back.append(step)
        i -= _DOWN[step]
        j -= _RIGHT[step]
    if not back:
        return [np.empty(0, np.uint8)] * count
    back = np.stack(back, axis=1)
    return [r[r != DONE][::-1] for r in back]


def _banded(x: np.ndarray, m: np.ndarray, y: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray, words: Words, gap: float) -> tuple[np.ndarray, np.ndarray]:
    rows, tall, width = np.arange(len(m)), int(m.max()), int((high - low).max()) + 1
    steps = np.full((tall + 1, width, len(m)), LEFT, dtype=np.uint8)
    # a cell's column is its place in the second, counted from the first that the band reaches
    at = np.arange(width)[:, None] - high
    place = np.arange(1, tall + 1)[:, None, None]
    i, c, r = np.nonzero((at + place > 0) & (at + place <= n) & (place <= m))
    a, b = x[r, i], y[r, i + at[c, r]]
    ahead, level = high - np.arange(width)[:, None], m - n
    spent = (abs(ahead) + abs(level - ahead) - abs(level)) * gap  # on gaps, by any path through the cell
    kept = np.flatnonzero(words.least(a, b) <= (left - spent)[c, r]) if gap > 0 else np.arange(len(a))
    costs = np.full((tall, width, len(m)), np.inf)
    costs[i[kept], c[kept], r[kept]] = words.costs(a[kept], b[kept])
    row = np.full((width + 2, len(m)), np.inf)  # with a column outside of the band on each side
    row[1:-1] = np.where((at >= 0) & (at <= n), at * gap, np.inf)
    for i in range(1, tall + 1):
        j = at + i
        outside, edge = (j < 0) | (j > n), j == 0
        pair, up = row[1:-1] + costs[i - 1], row[2:] + gap
        up[edge], up[outside] = i * gap, np.inf
        now, least = np.full_like(row, np.inf), np.minimum(pair, up)
        for k in range(width):
            np.minimum(least[k], now[k] + gap, out=now[k + 1])
        best, own = now[1:-1], steps[i]
        best[outside] = np.inf
        own[best == up] = UP
        own[best == pair] = PAIR
        own[edge] = UP
        row = now
    i, j, back, ends = m.copy(), n.copy(), [], np.zeros(len(m), dtype=np.int64)
    while (going := (i > 0) | (j > 0)).any():
        step = steps[i, np.where(going, j - i + high, 0), rows]
        step[~going] = DONE
        back.append(step)
        ends += going
        i -= _DOWN[step]
        j -= _RIGHT[step]
    if not back:
        return np.empty((len(m), 0), np.uint8), ends
    place = ends[:, None] - 1 - np.arange(len(back))
    return np.where(place >= 0, np.stack(back)[np.maximum(place, 0), rows[:, None]], DONE).astype(np.uint8), ends


def through(lattice: Sequence[Sequence[Sequence[int]]], words: Sequence[np.ndarray], skip: Sequence[Sequence[int]] | None = None) -> np.ndarray:
    """By row the least edits between a lattice (alternatives at each place) and words; ``skip``: the costs of leaving out a place."""
    places = np.array([len(x) for x in lattice], dtype=np.int64)
    width, most = int(places.max(initial=0)), max((len(b) for x in lattice for b in x), default=0)
    options = np.full((len(places), width, most), -1, dtype=np.int64)
    sizes = np.array([len(b) for x in lattice for b in x], dtype=np.int64)
    if len(sizes):
        row, at = np.repeat(np.arange(len(places)), places), np.arange(len(sizes)) - np.repeat(np.cumsum(places) - places, places)
        each = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        options[np.repeat(row, sizes), np.repeat(at, sizes), each] = np.fromiter((w for x in lattice for b in x for w in b), np.int64, int(sizes.sum()))
    said, n = padded(words, -2)
    cost = np.ones((len(places), width), dtype=np.int64) if skip is None else padded([np.asarray(s, dtype=np.int64) for s in skip], 1)[0]
    before = np.concatenate([np.zeros((len(places), 1), np.int64), np.cumsum(cost, axis=1)], axis=1)
    row, out = before, before[np.arange(len(places)), places].copy()
    for j in range(said.shape[1]):
        other = ~(options == said[:, j, None, None]).any(axis=2)
        best = row + 1
        np.minimum(best[:, 1:], row[:, :-1] + other, out=best[:, 1:])
        row = np.minimum.accumulate(best - before, axis=1) + before
        done = np.flatnonzero(n == j + 1)
        out[done] = row[done, places[done]]
    return out


def grid(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, fill: int) -> np.ndarray:
    """Runs of ``values`` as the rows of a matrix."""
    at = np.arange(int(sizes.max(initial=0)))
    inside = at < sizes[:, None]
    out = np.full(inside.shape, fill, dtype=np.int32)
    out[inside] = values[(starts[:, None] + at)[inside]]
    return out


def counted(options: Sequence[np.ndarray], m: np.ndarray, words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """By row the least edits between up to BITS places and words, a column of the table as the bits of one number.

    ``options``: matrices of the places' words, one for the first alternative of each, one for the second and so
    on; -1 where there is none. ``words`` holds no -1 but in places that ``n`` leaves out.
    """
    score, full = np.where(m > 0, m, n), np.uint64(0xFFFFFFFFFFFFFFFF)
    up, down = np.full(len(m), full), np.zeros(len(m), dtype=np.uint64)
    last = np.left_shift(np.uint64(1), np.maximum(m - 1, 0).astype(np.uint64))
    one, packed = np.uint64(1), np.zeros((len(m), 8), dtype=np.uint8)
    for j in range(words.shape[1] if len(options) else 0):
        said = words[:, j, None]
        same = options[0] == said
        for o in options[1:]:
            same |= o == said
        bits = np.packbits(same, axis=1, bitorder="little")
        packed[:, : bits.shape[1]] = bits
        equal = packed.view("<u8")[:, 0]
        diagonal = equal | down
        across = (((equal & up) + up) ^ up) | equal
        more, less = down | ~(across | up), up & across
        going = (n > j) & (m > 0)
        score += (going & ((more & last) != 0)).astype(np.int64) - (going & ((less & last) != 0))
        more, less = (more << one) | one, less << one
        up, down = less | ~(diagonal | more), more & diagonal
    return score


def counted_long(places: Sequence[Iterable[int]], words: Sequence[int]) -> int:
    """The same for one row of any length, with numbers of as many bits as there are places."""
    at: dict[int, int] = {}
    for i, place in enumerate(places):
        for w in place:
            at[w] = at.get(w, 0) | 1 << i
    m = len(places)
    if not m:
        return len(words)
    full, last = (1 << m) - 1, 1 << m - 1
    up, down, score = full, 0, m
    for w in words:
        equal = at.get(w, 0)
        diagonal = equal | down
        across = (((equal & up) + up) ^ up) | equal
        more, less = down | (full & ~(across | up)), up & across
        score += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | (full & ~(diagonal | more)), more & diagonal
    return score


class Runs:
    """Lists of Arrow lists by the starts and sizes of their runs; a null counts as empty."""

    def __init__(self, column: pa.Array):
        column = column.fill_null([]) if column.null_count else column
        self.inner = column.flatten()
        self.sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def most(self, sizes: np.ndarray) -> np.ndarray:
        """By run the most of its members' ``sizes``."""
        out, some = np.zeros(len(self.sizes), dtype=np.int64), self.sizes > 0
        if some.any():
            out[some] = np.maximum.reduceat(sizes, self.starts[some])
        return out


def numbered(*texts: pa.Array) -> list[np.ndarray]:
    """Words as numbers that are the same for the same word; null counts as the empty word."""
    coded = pa.concat_arrays([t.cast(pa.string()).fill_null("") for t in texts]).dictionary_encode()
    return np.split(coded.indices.to_numpy(zero_copy_only=False), np.cumsum([len(t) for t in texts])[:-1])


def lattice_counts(lattices: pa.Array, hyps: pa.Array) -> np.ndarray:
    """By row the least edits between a lattice, ``list<list<string>>``, and words."""
    bins, said = Runs(lattices), Runs(hyps)
    each = Runs(bins.inner)
    own, words = numbered(each.inner, said.inner)
    return counts(bins.starts, bins.sizes, bins.most(each.sizes), each.starts, each.sizes, own, said.starts, said.sizes, words)


def word_counts(refs: pa.Array, hyps: pa.Array) -> np.ndarray:
    """By row the edits between two sequences of words, ``list<string>``."""
    bins, said = Runs(refs), Runs(hyps)
    own, words = numbered(bins.inner, said.inner)
    single = np.ones(len(own), dtype=np.int64)
    return counts(bins.starts, bins.sizes, bins.most(single), np.arange(len(own)), single, own, said.starts, said.sizes, words)


def counts(
    first: np.ndarray, places: np.ndarray, most: np.ndarray, starts: np.ndarray, sizes: np.ndarray, own: np.ndarray, at: np.ndarray, n: np.ndarray, words: np.ndarray
) -> np.ndarray:
    """By row the least edits between a lattice and words.

    A row's bins are ``places`` from ``first`` on, of ``most`` alternatives; a bin's alternatives are ``sizes`` of
    ``own`` from ``starts`` on; a row's words are ``n`` of ``words`` from ``at`` on.
    """
    out = np.zeros(len(places), dtype=np.int64)
    before = np.r_[0, np.cumsum(sizes)]
    wide = (places > BITS) | (most * places > 4 * (before[first + places] - before[first] + BITS))
    for i in np.flatnonzero(wide).tolist():
        bins = range(first[i], first[i] + places[i])
        out[i] = counted_long([own[starts[b] : starts[b] + sizes[b]].tolist() for b in bins], words[at[i] : at[i] + n[i]].tolist())
    rest = np.flatnonzero(~wide)
    for part in parts((places[rest] + 1) * np.maximum(most[rest], 1) + n[rest], CELLS >> 4):
        rows = rest[part]
        bins = grid(np.arange(len(sizes)), first[rows], places[rows], -1)
        real, options = bins >= 0, []
        for k in range(max(int(most[rows].max(initial=0)), 1)):
            option, there = np.full(bins.shape, -1, dtype=np.int32), real.copy()
            there[real] = sizes[bins[real]] > k
            option[there] = own[starts[bins[there]] + k]
            options.append(option)
        out[rows] = counted(options, places[rows], grid(words, at[rows], n[rows], -2), n[rows])
    return out


def sizes_of(rows: Sequence[Sequence[np.ndarray]]) -> np.ndarray:
    """Cells of the tables between a lattice (all but the last) and words (the last), about."""
    return np.array([(len(r[-1]) + 1) * len(r) for r in rows], dtype=np.int64)


def parts(sizes: np.ndarray, most: int = CELLS) -> Iterator[np.ndarray]:
    """Rows by table size, so many at a time that their tables have ``most`` cells, about."""
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * sizes[order[to]] <= most:
            to += 1
        yield order[at:to]
        at = to


class Sequences:
    """Rows of sequences of words, from ``list<list<string>>``; words are numbered over the batch, null counts as empty."""

    def __init__(self, column: pa.Array):
        column = column.fill_null([]) if column.null_count else column
        inner = column.flatten()
        inner = inner.fill_null([]) if inner.null_count else inner
        coded = inner.flatten().fill_null("").dictionary_encode()
        self.words = coded.dictionary.to_pylist()
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(inner.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) if len(inner) else np.empty(0, np.int64)
        each = np.split(ids, ends[:-1]) if len(ends) else []
        ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)).tolist()
        self.rows = [each[a:b] for a, b in zip([0, *ends], ends)]
