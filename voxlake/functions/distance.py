"""Word-level edit distance with Arrow-batched helpers.

The distance kernel keeps a whole column of the table in big integers, so a pair of texts costs one pass over the reference's
bit vector per word of the hypothesis. Equal and empty pairs never reach Python.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT_TYPE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("sub", "ins", "del")])


class _Table:
    """The edit table of a reference, a column of step bits at a time."""

    def __init__(self, reference: Sequence[str]):
        self.full = (1 << len(reference)) - 1
        self.match: dict[str, int] = {}
        for i, word in enumerate(reference):
            self.match[word] = self.match.get(word, 0) | (1 << i)

    def column(self, up: int, down: int, word: str) -> tuple[int, int, int, int]:
        """Vertical (+1/-1) and horizontal (+1/-1) step bits of the column of ``word`` from the vertical ones before it."""
        full, eq = self.full, self.match.get(word, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        across_plus = down | (full & ~(diag | up))
        across_minus = up & diag
        plus, minus = ((across_plus << 1) | 1) & full, (across_minus << 1) & full
        return minus | (full & ~(diag | plus)), plus & diag, across_plus, across_minus


def edit_distance(reference: Sequence[str], hypothesis: Sequence[str]) -> int:
    """Levenshtein distance over words."""
    if not len(reference) or not len(hypothesis):
        return max(len(reference), len(hypothesis))
    table, distance, top = _Table(reference), len(reference), 1 << (len(reference) - 1)
    up, down = table.full, 0
    for word in hypothesis:
        up, down, plus, minus = table.column(up, down, word)
        distance += 1 if plus & top else -1 if minus & top else 0
    return distance


def error_split(reference: Sequence[str], hypothesis: Sequence[str]) -> tuple[int, int, int]:
    """Substitutions, insertions and deletions; ties go to match, substitution, insertion, deletion.

    The way back needs every column. One column in each stretch of them is kept, and a stretch is made again when the way
    comes to it, so the bits held grow with the root of the hypothesis times the reference.
    """
    i, j = len(reference), len(hypothesis)
    if not i or not j:
        return 0, j, i
    table, stretch = _Table(reference), math.isqrt(j) + 1
    up, down, kept = table.full, 0, []
    for k, word in enumerate(hypothesis):
        if k % stretch == 0:
            kept.append((up, down))
        up, down, _, _ = table.column(up, down, word)
    sub = ins = dele = 0
    first, columns = j, []
    while i and j:
        if reference[i - 1] == hypothesis[j - 1]:
            i, j = i - 1, j - 1
            continue
        if j - 1 < first:
            first = (j - 1) // stretch * stretch
            up, down = kept[first // stretch]
            columns = []
            for word in hypothesis[first:j]:
                before = up, down
                up, down, plus, minus = table.column(up, down, word)
                columns.append((*before, plus, minus))
        left_up, left_down, plus, minus = columns[j - 1 - first]
        bit = 1 << (i - 1)
        across = 1 if plus & bit else -1 if minus & bit else 0
        below = 1 if left_up & bit else -1 if left_down & bit else 0
        if across + below == 1:
            sub, i, j = sub + 1, i - 1, j - 1
        elif across == 1:
            ins, j = ins + 1, j - 1
        else:
            dele, i = dele + 1, i - 1
    return sub, ins + j, dele + i


#: Pairs whose words are Python objects at a time; the rest of a batch stays in Arrow's form.
PAIRS = 64


def _pairs(reference: pa.Array, hypothesis: pa.Array) -> Iterator[tuple]:
    for i in range(0, len(reference), PAIRS):
        yield from zip(reference.slice(i, PAIRS).to_pylist(), hypothesis.slice(i, PAIRS).to_pylist())


@F.arrow_udf(T.IntegerType())
def distance_udf(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    return pa.array([0 if r is None else edit_distance(r, h) for r, h in _pairs(reference, hypothesis)], pa.int32())


@F.arrow_udf(SPLIT_TYPE)
def split_udf(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    rows = [(0, 0, 0) if r is None else error_split(r, h) for r, h in _pairs(reference, hypothesis)]
    return pa.StructArray.from_arrays([pa.array([row[k] for row in rows], pa.int32()) for k in range(3)], SPLIT_TYPE.names)


def word_edit_distance(reference: Column, hypothesis: Column) -> Column:
    """Distance of two word arrays; trivial pairs are settled without shipping their words to Python."""
    hard = (F.size(reference) > 0) & (F.size(hypothesis) > 0) & (reference != hypothesis)
    shipped = distance_udf(F.when(hard, reference), F.when(hard, hypothesis))
    return F.when(hard, shipped).when(reference == hypothesis, 0).otherwise(
        F.greatest(F.size(reference), F.size(hypothesis))
    )


def word_errors(reference: Column, hypothesis: Column) -> Column:
    """Struct of substitutions, insertions and deletions."""
    hard = (F.size(reference) > 0) & (F.size(hypothesis) > 0) & (reference != hypothesis)
    shipped = split_udf(F.when(hard, reference), F.when(hard, hypothesis))
    equal = reference == hypothesis
    trivial = F.struct(
        F.lit(0).alias("sub"),
        F.when(equal, 0).otherwise(F.size(hypothesis)).alias("ins"),
        F.when(equal, 0).otherwise(F.size(reference)).alias("del"),
    )
    return F.when(hard, shipped).otherwise(trivial.cast(SPLIT_TYPE))


def wer_percent(errors: Column, ref_words: Column) -> Column:
    """Errors per reference word in percent; zero without reference words."""
    return F.when(ref_words > 0, errors / ref_words * 100.0).otherwise(0.0)


def word_overlap(left: Column, right: Column) -> Column:
    """Shared distinct words as a share of the left side's distinct words; one if the left side is empty."""
    mine = F.array_distinct(left)
    return F.when(F.size(mine) > 0, F.size(F.array_intersect(mine, right)) / F.size(mine)).otherwise(1.0)
