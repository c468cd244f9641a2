"""SentencePiece encoding against the library, decoding, and Viterbi against brute force."""

from __future__ import annotations

import random
from functools import cache

import numpy as np
import pytest
import sentencepiece

from patraka.llm import pieces
from patraka.llm.queries import op5_sentencepiece


@cache
def both() -> tuple[pieces.Encoder, sentencepiece.SentencePieceProcessor]:
    return pieces.Encoder(pieces.model_bytes(pieces.MODEL)), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_query_like_the_library(spark, sf):
    _, library = both()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op5_sentencepiece(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert list(r.token_ids) == library.encode(texts[r.doc_id])
        assert r.n_tokens == len(r.token_ids)
        assert r.round_trip == (pieces.SPACE not in texts[r.doc_id])


ODD = ["", " ", "  a  b ", "\n\n x\ty", "aaaaaaaaaaaaaaaaaaaaaaaa", "été naïve 漢字 \U0001f600\U0001f601", "▁▁a▁", "<s> </s> <unk> <0x41>", "\x00\x01", "á", "l'été—“x”", "0123456789" * 5]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    own, library = both()
    ids, _ = own.encode(text)
    assert ids.tolist() == library.encode(text)
    assert own.decode(ids) == text.replace("▁", " ")


def test_random_texts():
    own, library = both()
    rng = random.Random(8)
    letters = "etaoinshrdlu ETA  \n.,'-éüß漢"
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert own.encode(text)[0].tolist() == library.encode(text)


def message(vocabulary: list[tuple[str, float, int]], kind: int, fallback: bool = False) -> bytes:
    """A serialized model with the identity normalizer."""

    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(number: int, body: bytes | int) -> bytes:
        return varint(number << 3) + varint(body) if isinstance(body, int) else varint(number << 3 | 2) + varint(len(body)) + body

    out = b""
    for piece, score, k in vocabulary:
        out += field(1, field(1, piece.encode()) + b"\x15" + np.float32(score).tobytes() + field(3, k))
    return out + field(2, field(3, kind) + field(35, int(fallback))) + field(3, field(3, 0) + field(4, 0))


def best_score(text: str, scores: dict[str, float], floor: float) -> float:
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            part = text[start:end]
            if part in scores:
                best[end] = max(best[end], best[start] + scores[part])
        if text[end - 1] not in scores:
            best[end] = max(best[end], best[end - 1] + floor)
    return best[-1]


def test_unigram_viterbi_finds_the_best_score():
    rng = random.Random(11)
    parts = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))): 0.0 for _ in range(25)} | {"a": 0.0, "b": 0.0}
    parts.pop("c", None)
    scores = {p: float(np.float32(-rng.random() * 5)) for p in parts}
    own = pieces.Encoder(message([("<unk>", 0.0, pieces.UNKNOWN), *((p, s, pieces.NORMAL) for p, s in scores.items())], pieces.UNIGRAM))
    floor = min(*scores.values(), 0.0) - pieces.UNKNOWN_PENALTY
    for _ in range(200):
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14)))
        ids, unknown = own.encode(text)
        got = sum(scores[own.v.pieces[i]] for i in ids if i) + floor * unknown
        assert got == pytest.approx(best_score(text, scores, floor))


def test_rows_and_decoding(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "x"), (2, None), (3, ""), (4, "word " * 300_000)], "doc_id long, text string").selectExpr("*", "1 as token_ids", "'a' as n_tokens")
    got = pieces.encode(df)
    rows = got.collect()
    assert len(rows) == 6 and all(r.round_trip for r in rows)
    assert [r.n_tokens for r in rows if r.doc_id in (2, 3)] == [0, 0]
    back = {(r.doc_id, r.text) for r in pieces.decode(got).collect()}
    assert back == {(1, "one two"), (None, "x"), (2, ""), (3, ""), (4, "word " * 300_000)}
    assert pieces.encode(df.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, token_ids array<int>")
    assert pieces.decode(nothing).first().text is None
