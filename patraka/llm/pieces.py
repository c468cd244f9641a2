"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces drives one pass over a text: at each position the automaton's
output links give the pieces that end there, and each relaxes the best segmentation up to the position.
For unigram models the best is the Viterbi score. A BPE model has no additive score: its segmentation
of a prefix ends with the one piece that stays apart from the last piece of the prefix before it under
the model's merges, so that a piece is accepted if the pair is stable; that gives the library's result
in the same single pass. Segmented words are remembered in a cache of bounded size.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patraka.llm.common import rows_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
CACHE = 400_000  # words whose ids a worker remembers
PAIRS = 600_000  # pairs of pieces whose stability it remembers


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: numbers and values; a fixed 32-bit value comes as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class Vocabulary:
    """Pieces and options of a serialized model."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        self.model_type, self.byte_fallback, self.dummy_prefix, self.squeeze, escape, charsmap = UNIGRAM, False, True, True, True, b""
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(fields(value))
                self.model_type, self.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(fields(value))
                charsmap, self.dummy_prefix, self.squeeze, escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if charsmap or not escape or self.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models with the identity normalizer are supported")
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}


class Encoder:
    def __init__(self, data: bytes):
        self.v = v = Vocabulary(data)
        self.ids = {p: i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k in (NORMAL, USER)}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p), v.scores[i]))
        self.automaton.make_automaton()
        self.floor = min(v.scores) - UNKNOWN_PENALTY
        self.stable: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        # Words can be cut before a blank and around a line end if no piece spans either.
        free = not any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in self.ids)
        self.word = regex.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if free else r"(?s).+")
        self.raw = [v.pieces[i].encode() if k in (NORMAL, USER) else bytes([int(v.pieces[i][1:-1], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"" for i, k in enumerate(v.kinds)]

    def normalise(self, text: str) -> str:
        if self.v.squeeze:
            text = regex.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (SPACE if self.v.dummy_prefix else "") + text.replace(" ", SPACE)

    def encode(self, text: str) -> tuple[np.ndarray, int]:
        """Ids, and how many characters no piece covers."""
        parts, unknown = [], 0
        known = self.known
        for word in self.word.findall(self.normalise(text)):
            got = known.get(word)
            if got is None:
                got, n = self.segment(word)
                unknown += n
                # The first CACHE words stay: frequent words come early. Words with unknowns are counted anew.
                if not n and len(known) < CACHE and len(word) <= 64:
                    known[word] = got
            parts.append(got)
        return np.frombuffer(b"".join(parts), dtype=np.int32), unknown

    def segment(self, word: str) -> tuple[bytes, int]:
        """One pass of the automaton over ``word``, then back along the best pieces."""
        # By position: 1 + the id of the last piece (0: the character before is unknown), and its length.
        last, sizes = [0] * (len(word) + 1), [1] * (len(word) + 1)
        (self.viterbi if self.v.model_type == UNIGRAM else self.stable_pass)(word, last, sizes)
        ids: list[int] = []
        at, unknown = len(word), 0
        while at:
            i, size = last[at] - 1, sizes[at]
            at -= size
            if 0 <= i < len(self.v.pieces):
                ids.append(i)
                continue
            unknown += 1
            if self.v.byte_fallback:
                ids += [self.v.bytes[b] for b in reversed(word[at : at + size].encode("utf-8", "replace"))]
            elif not (ids and ids[-1] == self.v.unknown):
                ids.append(self.v.unknown)
        return array("i", ids[::-1]).tobytes(), unknown

    def viterbi(self, word: str, last: list[int], sizes: list[int]) -> None:
        """Relax the best score at each position; a character without a piece of its own may be unknown."""
        best = [0.0] + [-np.inf] * len(word)
        done = 0
        for end, (i, size, score) in chain(self.automaton.iter(word), [(len(word), (0, 0, 0.0))]):
            while done < end:
                if word[done] not in self.ids and best[done] + self.floor > best[done + 1]:
                    best[done + 1], last[done + 1], sizes[done + 1] = best[done] + self.floor, 0, 1
                done += 1
            if size and best[end + 1 - size] + score > best[end + 1]:
                best[end + 1], last[end + 1], sizes[end + 1] = best[end + 1 - size] + score, i + 1, size

    def stable_pass(self, word: str, last: list[int], sizes: list[int]) -> None:
        """Accept at each position the piece that stays apart from the piece before it under the merges."""
        stable, n = self.stable, len(self.v.pieces)
        for end, (i, size, _) in self.automaton.iter(word):
            to = end + 1
            if last[to]:
                continue
            start = to - size
            before = last[start] if start else -1
            if not before:
                before = last[start] = n + 1 + ord(word[start - 1])
            key = before << 20 | i
            ok = stable.get(key)
            if ok is None:
                if len(stable) >= PAIRS:
                    stable.clear()
                left = [word[start - sizes[start] : start]] if start else []
                ok = stable[key] = self.merge("".join(left) + self.v.pieces[i]) == [*left, self.v.pieces[i]]
            if ok:
                last[to], sizes[to] = i + 1, size

    def merge(self, text: str) -> list[str]:
        """The model's merges on a short string, best score first and leftmost among equals."""
        parts = list(text)
        while True:
            options = [(-self.v.scores[self.ids[p]], k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in self.ids]
            if not options:
                return parts
            k = min(options)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def decode(self, ids: np.ndarray) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.v.dummy_prefix and text.startswith(" ") else text


def model_bytes(path: str) -> bytes:
    """The model file, read by the driver and sent to the executors (about half a megabyte)."""
    return Path(path).read_bytes()


_encoders: dict[int, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    """This process's encoder for a model; its word cache serves all tasks of the worker."""
    key = hash(data)
    if key not in _encoders:
        _encoders[key] = Encoder(data)
    return _encoders[key]


def encode(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, token_ids, n_tokens, n_unknown, round_trip)`` by row, for whole texts.

    n_unknown counts characters that no piece covers (given as bytes, if the model has them); round_trip
    tells whether decoding the ids gives the text back (a text that holds U+2581 itself comes back with a
    blank in its place). Null and empty texts have no token; a null text's round_trip is true.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(path))
    kind = pa.list_(pa.int32())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared.value)
        for batch in it:
            for part in rows_of(batch, 2 << 20, "text"):
                ids, unknown, same = [], [], []
                for text in part.column(1).to_pylist():
                    got, n = e.encode(text or "")
                    ids.append(got)
                    unknown.append(n)
                    same.append(e.decode(got) == (text or ""))
                sizes = [len(x) for x in ids]
                offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(offsets, flat).cast(kind), pa.array(sizes, pa.int64()), pa.array(unknown, pa.int64()), pa.array(same)],
                    names=["doc_id", "token_ids", "n_tokens", "n_unknown", "round_trip"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, token_ids array<int>, n_tokens long, n_unknown long, round_trip boolean"
    )


def decode(tokens: DataFrame, path: str = MODEL, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """``(doc_id, text)``: the texts of id sequences; a null sequence gives a null text."""
    shared = tokens.sparkSession.sparkContext.broadcast(model_bytes(path))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared.value)
        for batch in it:
            texts = [None if x is None else e.decode(np.array(x, dtype=np.int32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("token_ids")).mapInArrow(run, "doc_id long, text string")
