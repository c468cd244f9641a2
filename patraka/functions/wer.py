"""Edit distances and word error rates.

Edits between sequences of words, and between lattices and words, are counted in Arrow batches, a row of a
table as the bits of one number (``patraka.functions.edits``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

from patraka.functions import edits


def normalized_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; 0 for equal words, 1 if one is empty."""
    return F.when(a == b, 0.0).when((a == "") | (b == ""), 1.0).otherwise(F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def word_distance(ref: Column, hyp: Column) -> Column:
    """Edits between two word arrays, of any number of distinct words; null if either is, null words are left out."""

    @F.arrow_udf("long")
    def count(refs: pa.Array, hyps: pa.Array) -> pa.Array:
        known = pa.compute.and_(refs.is_valid(), hyps.is_valid())
        both = (pa.array([x and [w for w in x if w is not None] for x in c.to_pylist()], c.type) if c.flatten().null_count else c for c in (refs, hyps))
        return pa.compute.if_else(known, pa.array(edits.word_counts(*both)), pa.scalar(None, pa.int64()))

    return count(ref, hyp)


def standard_wer(ref: Column, errors: Column) -> Column:
    """Errors by reference word; an empty reference counts as 0 whatever was inserted, an unknown number of errors stays unknown."""
    return F.when(F.size(ref) == 0, 0.0).otherwise(errors / F.size(ref))


def sentence_wer(ref: Column, errors: Column) -> Column:
    """As above, but an empty reference counts as wholly wrong."""
    return F.when(F.size(ref) == 0, 1.0).otherwise(standard_wer(ref, errors))


def lattice_errors(lattice: Column, hyp: Column, free: Column | None = None) -> Column:
    """Least edits between a lattice (arrays of alternatives) and words; null if either is.

    ``free``: booleans of bins that may be skipped at no cost, an extension; by default none.
    """

    @F.arrow_udf("long")
    def count(lattices: pa.Array, hyps: pa.Array) -> pa.Array:
        known = pa.compute.and_(lattices.is_valid(), hyps.is_valid())
        return pa.compute.if_else(known, pa.array(edits.lattice_counts(lattices, hyps)), pa.scalar(None, pa.int64()))

    @F.arrow_udf("long")
    def count_free(lattices: pa.Array, hyps: pa.Array, free: pa.Array) -> pa.Array:
        known = pa.compute.and_(lattices.is_valid(), hyps.is_valid())
        # the words of a hypothesis are numbered with those of its lattice, as its last bin
        both = [[*(x or []), h or []] for x, h in zip(lattices.to_pylist(), hyps.to_pylist())]
        held = edits.Sequences(pa.array(both, pa.list_(pa.list_(pa.string())))).rows
        skip = [[1 - bool(x) for x in r] if r else [1] * (len(rows) - 1) for r, rows in zip(free.to_pylist(), held)]
        out = np.zeros(len(held), dtype=np.int64)
        for own in edits.parts(edits.sizes_of(held)):
            out[own] = edits.through([held[i][:-1] for i in own], [held[i][-1] for i in own], [skip[i] for i in own])
        return pa.compute.if_else(known, pa.array(out), pa.scalar(None, pa.int64()))

    return count(lattice, hyp) if free is None else count_free(lattice, hyp, free)


def lattice_wer(lattice: Column, errors: Column) -> Column:
    """Errors by bin; a lattice without bins counts as 0, an unknown number of errors stays unknown."""
    return F.when(F.size(lattice) == 0, 0.0).otherwise(errors / F.size(lattice))


def lattice_text(lattice: Column) -> Column:
    """Bins joined by blanks, alternatives as ``[a|b]`` in code-point order."""
    return F.array_join(F.transform(lattice, lambda b: F.when(F.size(b) == 1, F.element_at(b, 1)).otherwise(F.concat(F.lit("["), F.array_join(F.array_sort(b), "|"), F.lit("]")))), " ")


def half_even(x: Column, digits: int) -> Column:
    """Rounding as numpy does: to even at the half."""
    return F.rint(x * 10.0**digits) / 10.0**digits
