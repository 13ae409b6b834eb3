"""Importance resampling towards a target distribution, on hashed word n-grams.

The texts of a batch are joined with a separator that is no part of a word, one regex pass over the joined bytes finds all
words, and the documents' offsets say by binary search which document a word is of; an n-gram whose first and last word are
of different documents is masked before the buckets are counted.

Two passes over the texts: the first counts buckets (a task sends its counters, never its words), the second turns the gains
of the buckets into a weight for each document. Documents are then drawn by weight and a noise that depends on the id alone
(the Gumbel top-k trick), in an order made by range partitions, so that no task ranks all documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import batch_rows, text_chunks
from voxlake.session import materialize

#: Words of the longest feature, buckets, per cent of the documents drawn, least words of a document to be drawn, seed.
N, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 10_000, 10, 20, 2024
#: A word, in UTF-8 with A-Z lower-cased: digits, letters and all beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Stands between two texts; no word has it.
SENTINEL = b"\x00"
#: Words of a task's memo of hashes, and the longest word that it keeps, so that its bytes are bounded.
MEMO_WORDS, MEMO_LENGTH = 1 << 16, 32


class Hashes(dict):
    """crc32 of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = zlib.crc32(word)
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = h
        return h


def features(texts: list[bytes], n: int, hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """crc32 and document (its place in ``texts``) of every feature of a batch, and the number of words of each document."""
    joined = SENTINEL.join(texts).lower()
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    words, starts = [], []
    for m in WORD.finditer(joined):
        words.append(m.group())
        starts.append(m.start())
    of = np.searchsorted(offsets, np.array(starts, np.int64), "right") - 1
    crc = [hashes[w] for w in words]
    every, docs = [np.array(crc, np.int64)], [of]
    for k in range(2, n + 1):  # an n-gram's hash goes on from that of the n-gram one word shorter
        crc = [zlib.crc32(b" " + w, c) for c, w in zip(crc, words[k - 1 :])]
        inside = of[: len(crc)] == of[k - 1 :]
        every.append(np.array(crc, np.int64)[inside])
        docs.append(of[: len(crc)][inside])
    return np.concatenate(every), np.concatenate(docs), np.bincount(of, minlength=len(texts))


def _texts(df: DataFrame) -> DataFrame:
    return df.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def bucket_counts(texts: DataFrame, n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. Tasks send counters; ``buckets`` numbers come back."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, total = Hashes(), np.zeros(buckets, np.int64)
        for pdf in batches:
            for chunk in text_chunks(pdf["text"].tolist()):
                crc, _, _ = features(chunk, n, hashes)
                total += np.bincount(crc % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    out = np.zeros(buckets, np.int64)
    with batch_rows(texts.sparkSession):
        counted = _texts(texts).mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        for row in counted.collect():
            out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier a bucket is in the target, both smoothed by one a bucket."""
    s, t, size = source.astype(float), target.astype(float), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, n: int = N) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row, to be written while small batches are in force."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, table = Hashes(), shared.value
        for pdf in batches:
            at = 0
            for chunk in text_chunks(pdf["text"].tolist()):
                crc, of, words = features(chunk, n, hashes)
                sums, many = np.zeros(len(chunk), np.int64), np.bincount(of, minlength=len(chunk))
                np.add.at(sums, of, table[crc % len(table)])
                ids = pdf["doc_id"].iloc[at : at + len(chunk)]
                at += len(chunk)
                yield pd.DataFrame({"doc_id": ids.to_numpy(), "n_words": words, "n_features": many, "weight": sums // np.maximum(many, 1)})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    out = rows.mapInPandas(weigh, "doc_id string, n_words long, n_features long, weight long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate that depends on seed and id alone."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, 3 ...) by falling ``score``, ties to the smaller ``doc_id``, null ids last.

    Range partitions are sorted apart; a row's rank is its place in its partition after the rows of those before.
    """
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    place = F.monotonically_increasing_id()  # partition and, in its lower 33 bits, the place in it
    dealt = rows.withColumn("_row", F.monotonically_increasing_id())
    dealt = materialize(dealt, "drawn").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place)
    dealt = materialize(dealt.withColumn("_part", F.shiftright("_place", 33)), "ranked")
    sizes = {r._part: r.n for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    before, rows_before = [], 0
    for part in sorted(sizes):
        before.append((part, rows_before))
        rows_before += sizes[part]
    offsets = rows.sparkSession.createDataFrame(before, "_part long, _before long")
    within = F.col("_place") - F.call_function("shiftleft", F.col("_part"), F.lit(33))
    return dealt.join(offsets, "_part").withColumn("rank", F.col("_before") + within + 1).drop("_row", "_place", "_part", "_before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    n: int = N,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: ``doc_id, n_features, weight, score, rank``; ``rank`` is null for documents not drawn.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased; features are all runs of 1 to ``n`` of
    them. ``percent`` of the documents with at least ``least_words`` words are drawn, rounded down, highest scores first. A
    null or empty text or one without words has no features and the weight 0; it counts towards nothing. Rows are
    documents, also those that repeat an id or have none (noise of the empty id, behind others of their score). Columns
    other than ``doc_id`` and ``text`` are ignored; an empty table gives no rows, an empty target is uniform.
    """
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    with batch_rows(docs.sparkSession):
        weighed = materialize(weights(docs, gain, n), "weights")
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    fit = scored.filter(F.col("n_words") >= least_words)
    drawn = percent * fit.count() // 100
    named = ["doc_id", "n_features", "weight", "score"]
    order = ranked(fit).select(*named, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return order.unionByName(scored.filter(F.col("n_words") < least_words).select(*named, F.lit(None).cast("long").alias("rank")))


#: crc32 bit by bit: a byte of the word is folded in, then eight steps (-1) follow.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
w AS (
  SELECT 0 AS kind, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM d
  UNION ALL
  SELECT 1, 0, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), h AS (SELECT DISTINCT word, hex(encode(word)) AS x FROM w),
b AS (
  SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
           range(1, length(x) + 1, 2), lambda i: [('0x' || substring(x, i, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, y: CASE WHEN y >= 0 THEN xor(c, y) ELSE xor(c >> 1, (c & 1) * 3988292384) END)) % 10000 AS bucket
  FROM h
), f AS (SELECT kind, r, bucket FROM w JOIN b USING (word)),
n AS (SELECT count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM f),
g AS (
  SELECT bucket, floor(1000 * ln((count(*) FILTER (kind = 1) + 1)::DOUBLE * (any_value(n.s) + 10000)
         / ((count(*) FILTER (kind = 0) + 1)::DOUBLE * (any_value(n.t) + 10000))))::BIGINT AS gain
  FROM f, n GROUP BY bucket
), m AS (
  SELECT r, count(*) AS n_features, floor(sum(gain) / count(*)::DOUBLE)::BIGINT AS weight
  FROM f JOIN g USING (bucket) WHERE kind = 0 GROUP BY r
), scored AS (
  SELECT r, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5)
                                                 / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN m USING (r)
), placed AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN p.rank <= 10 * (SELECT count(*) FROM placed) // 100 THEN p.rank END AS rank
FROM scored LEFT JOIN placed p USING (r)
"""
