"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch. Texts may be long, so batches are kept small.
BATCH_ROWS, BATCH_BYTES = 256, 1 << 22
#: Bits of a membership table. Its size is fixed, so it may be broadcast whatever the input is.
MEMBER_BITS = 1 << 22
#: Entries of a task's memo of words, and the longest word it keeps: at most about 16 MB a memo.
MEMO, MEMO_BYTES = 1 << 16, 64

MIX1 = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
MIX3 = np.uint64(0x165667B19E3779F9)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BATCH_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of Python steps that see whole texts and run when the caller asks for the result."""
    for name, value in _BATCH_SETTINGS.items():
        spark.conf.set(name, str(value))


@contextmanager
def batch_rows(spark: SparkSession) -> Iterator[None]:
    """The same for steps that run inside the block; afterwards the session's settings are as they were."""
    before = {name: spark.conf.get(name) for name in _BATCH_SETTINGS}
    small_batches(spark)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def text_chunks(texts: list[bytes], size: int = 1 << 20) -> Iterator[list[bytes]]:
    """A batch of texts in order, cut where ``size`` bytes are reached; a longer text is a chunk of its own."""
    held, n = [], 0
    for text in texts:
        if held and n + len(text) > size:
            yield held
            held, n = [], 0
        held.append(text)
        n += len(text)
    if held:
        yield held


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def bit(place: Column) -> Column:
    """A long with the one bit that ``place`` has among 64."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))


def has_bit(word: Column, place: Column) -> Column:
    return word.bitwiseAND(bit(place)) != 0


def members(df: DataFrame, key: Column, among: DataFrame, among_key: Column, bits: int = MEMBER_BITS) -> DataFrame:
    """The rows of ``df`` whose key may be among ``among``'s keys: a filter before a join, never in place of it.

    The keys are hashed to a table of ``bits`` bits, at most ``bits / 64`` rows of two numbers, which is the proven bound
    of what is broadcast. Rows of keys that are not there may pass; a key that is there always passes.
    """
    slot = F.pmod(F.xxhash64(among_key), F.lit(bits))
    marks = among.select(slot.alias("_slot")).groupBy(F.shiftright("_slot", 6).alias("_word")).agg(
        F.bit_or(bit(F.col("_slot"))).alias("_bits")
    )
    own = F.pmod(F.xxhash64(key), F.lit(bits))
    keyed = df.withColumn("_own", own).withColumn("_word", F.shiftright("_own", 6))
    hit = keyed.join(F.broadcast(marks), "_word").filter(has_bit(F.col("_bits"), F.col("_own")))
    return hit.drop("_own", "_word", "_bits")


class Words(dict):
    """64-bit hashes of words (bytes), remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[word] = h
        return h

    def of(self, text: bytes) -> np.ndarray:
        """Hashes of the words of a text: A-Z lower-cased, split at [\\x20\\x09-\\x0D]."""
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash for each run of ``n`` word hashes, in order of position."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ words[i : len(words) - n + 1 + i]) * MIX1
        out ^= out >> np.uint64(29)
        out *= MIX2
        out ^= out >> np.uint64(32)
    return out
