"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log probabilities, BUCKETS x languages, plus log priors. Its size is fixed by
BUCKETS and the number of labels (64 MB at MOST_LANGUAGES; more raise an error), so that it is broadcast;
texts are scored in slices of bounded size by gathering matrix rows and adding them up by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patraka.llm.common import mix64, rows_of, trim

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SAMPLE = 4000  # documents learned from, by language: about this many, picked by a hash of doc_id
MOST_LANGUAGES = 256
SMOOTHING = 0.1
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
SLICE = 1 << 18  # text bytes scored at once


@dataclass
class Model:
    languages: list[str]
    log_prob: np.ndarray  # float32, BUCKETS x languages
    log_prior: np.ndarray


def held_out(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def _between(low: str) -> np.ndarray:
    """Buckets of the n-grams that end after the second character of ``low``, which is lower-cased and padded."""
    return _coded(low)[0][2:].ravel()


def _coded(joined: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """By place the buckets of the n-grams that end there, and the code points."""
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    one = mix64(code + np.uint64(1))
    two = one[1:] ^ (one[:-1] << np.uint64(1) | one[:-1] >> np.uint64(63))
    three = one[2:] ^ (two[:-1] << np.uint64(1) | two[:-1] >> np.uint64(63))
    ids = np.empty((len(code), len(ORDERS)), dtype=np.int32)
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    for k, h in enumerate((one, two, three)):
        got = (h * np.uint64(0x9E3779B97F4A7C15 + 2 * k) >> shift).astype(np.int32)
        ids[len(code) - len(h) :, k] = got
        ids[: len(code) - len(h), k] = got[0] if len(got) else 0
    return ids, code


def grams(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of the lower-cased texts, and where each text's begin; texts are padded by blanks."""
    low = [t.lower() for t in texts]
    sizes = np.array([len(t) + 3 for t in low], dtype=np.int64)
    ids, code = _coded("".join(f"  {t} " for t in low), buckets)
    # the two blanks before each text keep its n-grams apart from the text before
    inside = np.ones(len(code), dtype=bool)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    inside[starts] = inside[starts + 1] = False
    return ids[inside].ravel(), np.r_[0, np.cumsum((sizes - 2) * len(ORDERS))]


def counted_grams(text: str, most: int = SLICE) -> Iterator[np.ndarray]:
    """The buckets of a text's n-grams, in parts of bounded size whose n-grams together are those of the whole text."""
    if len(text) <= most:
        yield grams([text])[0]
        return
    # A part is lower-cased with one more character on either side, as lower case may depend on its neighbours.
    before = "  "
    for i in range(0, len(text), most):
        part = text[i : i + most]
        low = before + _lower(text, i, i + most) + (" " if i + most >= len(text) else "")
        yield _between(low)
        before = low[-2:] if len(part) else before


def _lower(text: str, at: int, to: int) -> str:
    """``text.lower()[...]`` of a part: Greek final sigma is the one letter whose lower case depends on others."""
    low = text[at:to].lower()
    if "Σ" not in text[at:to]:
        return low
    first, last = max(0, at - 64), to + 64
    head = len(text[first:at].lower())
    return text[first:last].lower()[head : head + len(low)]


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from ``docs(doc_id, text, lang)``: whole texts of a sample bounded by ``sample`` a language.

    Every label is learned, MOST_LANGUAGES at most (more raise an error). Rows without id, text or label are
    left out; with none left the model has no language.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the matrix would be too large to broadcast")
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    share = {r["lang"]: min(1.0, sample / r["count"]) for r in sizes}
    pick = F.lit(False)
    unit = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    for lang in languages:
        pick = F.when(F.col("lang") == lang, unit < share[lang]).otherwise(pick)
    place = {lang: i for i, lang in enumerate(languages)}

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(place), BUCKETS), dtype=np.int64)
        for batch in it:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for ids in counted_grams(text):
                    total[place[lang]] += np.bincount(ids, minlength=BUCKETS)
        at, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"lang": at, "bucket": bucket, "n": total[at, bucket]})

    counted = known.where(pick).select("text", "lang").mapInArrow(count, "lang long, bucket long, n long")
    got = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS x languages at most
    counts = np.full((BUCKETS, len(languages)), SMOOTHING)
    counts[got["bucket"].to_numpy(), got["lang"].to_numpy()] += got["n"].to_numpy()
    prior = np.array([{r["lang"]: r["count"] for r in sizes}[x] for x in languages], dtype=float)
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32), np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` by row; score: the language's posterior probability, 0 for ``und``.

    ``und``: the text is null or has no letter, or nothing was learned. Ties go to the first language by
    code point. Repeated rows and null ids get a row each. Other columns, of whatever name, are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in it:
            for part in rows_of(batch, SLICE, "text"):
                yield score(part, m)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double"
    )


def keep(docs: DataFrame, model: Model, sure: float) -> DataFrame:
    """The rows of ``docs`` whose language is known with probability ``sure``; all columns stay as they are.

    Null texts and texts without a letter go; repeated rows are judged alike, ids are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.BooleanType())
    def known(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([pa.nulls(len(texts), pa.int64()), texts], names=["doc_id", "text"])
        parts = [score(part, shared.value) for part in rows_of(batch, SLICE, "text")]
        trim()
        return pa.array([n != UNKNOWN and p >= sure for x in parts for n, p in zip(x.column(1).to_pylist(), x.column(2).to_pylist())], pa.bool_())

    return docs.where(known(F.col("text").cast("string")))


def score(batch: pa.RecordBatch, m: Model) -> pa.RecordBatch:
    texts = batch.column(1).to_pylist()
    sure = [t is not None and bool(m.languages) and LETTER.search(t) is not None for t in texts]
    names = [UNKNOWN] * len(texts)
    scores = np.zeros(len(texts))
    rows = [i for i, ok in enumerate(sure) if ok]
    if rows:
        logs = np.tile(m.log_prior, (len(rows), 1))
        if len(rows) == 1:
            for ids in counted_grams(texts[rows[0]]):
                logs[0] += _sums(ids, np.array([0, len(ids)]), m)[0]
        else:
            logs += _sums(*grams([texts[i] for i in rows]), m)
        best = logs.argmax(axis=1)
        p = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        for i, b, x in zip(rows, best, p):
            names[i], scores[i] = m.languages[b], x
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores)], names=["doc_id", "lang_pred", "score"])


def _sums(ids: np.ndarray, offsets: np.ndarray, m: Model) -> np.ndarray:
    out = np.zeros((len(offsets) - 1, len(m.languages)))
    step = max(1, (4 << 20) // len(m.languages))
    total = np.zeros(len(m.languages))
    if len(ids) <= step:
        return np.add.reduceat(m.log_prob[ids], offsets[:-1], axis=0, dtype=np.float64)
    for d in range(len(out)):
        total[:] = 0
        for i in range(offsets[d], offsets[d + 1], step):
            total += m.log_prob[ids[i : min(i + step, offsets[d + 1])]].sum(axis=0, dtype=np.float64)
        out[d] = total
    return out


def identify(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``: learn from the rows not held out, predict every row.

    A row with a null doc_id is not learned from and counts as not held out. With no labelled row every
    prediction is ``und``. Repeated rows are learned from and predicted one by one. Columns besides doc_id,
    text and lang, of whatever name, are not read; an empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = train(own.where(~held_out(F.col("doc_id"), modulus, remainder)))
    return predict(own, model).select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "lang_pred", "score")
