"""Language-model scores by stupid backoff, computed as joins of n-gram count tables.

Documents are dealt into batches. A batch sends each of its distinct n-grams once, with its count, to the bucket of the
n-gram's hash; the buckets hold the count tables. A bucket adds up the counts of all batches and answers every batch with
the totals of what it sent, in the same order. The batch joins the totals to the n-grams of its documents and sums the
scores of each. An n-gram that every document has is one row a batch, so no bucket grows with a frequent n-gram.

A document is scored by what the other documents say: its own counts are taken off the totals. Without that every n-gram
of the corpus would be known and nothing would ever back off.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import Words, gram_hashes, small_batches
from voxlake.session import materialize

#: Longest n-gram, factor of a backoff, and the count of a word that no other document has.
ORDER, BACKOFF, UNSEEN = 2, 0.4, 0.5
#: Characters of a batch of documents, and n-grams of a bucket, on average.
BATCH_CHARS, BUCKET_GRAMS = 1 << 22, 1 << 21


def pack(sorted_grams: np.ndarray) -> bytes:
    """Gaps between sorted hashes, byte plane by byte plane: the high planes are zeros and cost nothing when compressed."""
    gaps = np.diff(sorted_grams, prepend=np.uint64(0))
    return np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def grams_of(texts: list[bytes], words: Words, order: int) -> list[list[np.ndarray]]:
    """For each text its n-gram hashes by order, 1 first."""
    each = [words.of(t) for t in texts]
    return [[gram_hashes(w, n) for n in range(1, order + 1)] for w in each]


def table_of(grams: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a batch in order, with their counts."""
    parts = [g for doc in grams for g in doc]
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.uint64), np.empty(0, np.int64))


def score(doc: list[np.ndarray], known: np.ndarray, totals: np.ndarray) -> tuple[int, int, int, float]:
    """Words, words that backed off, words judged alone, and the sum of log scores but for the corpus size."""
    size = len(doc[0])
    if not size:
        return 0, 0, 0, 0.0
    others = []
    for g in doc:
        own, place, count = np.unique(g, return_inverse=True, return_counts=True)
        others.append((totals[np.searchsorted(known, own)] - count)[place])
    total, open_ = 0.0, np.arange(size)
    backed = 0
    for n in range(len(doc), 1, -1):
        # The n-gram that ends at word i starts at i - n + 1; its context is the (n-1)-gram that starts there.
        fits = open_[open_ >= n - 1]
        there = others[n - 1][fits - n + 1] > 0
        hit = fits[there] - n + 1
        total += float(np.log(others[n - 1][hit]).sum() - np.log(others[n - 2][hit]).sum())
        open_ = np.concatenate([open_[open_ < n - 1], fits[~there]])
        missed = int((~there).sum())
        backed += missed if n == len(doc) else 0
        total += missed * math.log(BACKOFF)
    total += float(np.log(np.maximum(others[0][open_], UNSEEN)).sum())
    return size, backed, len(open_), total


def stupid_backoff(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_backoff, log_score, mean_log_score``.

    Words are runs other than [\\x20\\x09-\\x0D], A-Z lower-cased. A word's score is the share of its n-gram among those of
    its context; where no other document has the n-gram, BACKOFF times the score of the next shorter one; a word alone
    counts over all words of the other documents, as UNSEEN if none has it. The first words of a text have no longer context
    and back off without a factor. ``log_score`` sums natural logarithms. A null text or one without words has 0 for all.
    Rows are documents, also those that repeat an id or have none. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce("text", F.lit(""))
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    batches = max(1, math.ceil(chars / BATCH_CHARS))
    bits = max(0, math.ceil(math.log2(max(1, order * chars / 6 / BUCKET_GRAMS))))
    parts = max(batches, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text.cast("binary").alias("text"))
    dealt = base.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int")).repartition(parts, "batch")

    def send(key, pdf: pd.DataFrame) -> pd.DataFrame:
        known, counts = table_of(grams_of(pdf["text"].tolist(), Words(), order))
        ids = (known >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(known), np.int64)
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.empty(0, np.int64)
        rows = [(int(ids[a]), key[0], pack(known[a:b]), pack_counts(counts[a:b])) for a, b in zip(starts, np.r_[starts[1:], len(ids)])]
        return pd.DataFrame(rows, columns=["bucket", "batch", "grams", "counts"])

    sent = dealt.groupBy("batch").applyInPandas(send, "bucket int, batch int, grams binary, counts binary")

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        grams = [unpack(x) for x in pdf["grams"]]
        every = np.concatenate(grams)
        distinct, place = np.unique(every, return_inverse=True)
        totals = np.zeros(len(distinct), np.int64)
        np.add.at(totals, place, np.concatenate([unpack_counts(x) for x in pdf["counts"]]))
        cut = np.split(totals[place], np.cumsum([len(g) for g in grams])[:-1])
        return pd.DataFrame({"batch": pdf["batch"], "bucket": pdf["bucket"], "totals": [pack_counts(x) for x in cut]})

    answers = sent.groupBy("bucket").applyInPandas(answer, "batch int, bucket int, totals binary")

    def judge(texts: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        grams = grams_of(texts["text"].tolist(), Words(), order)
        known, _ = table_of(grams)
        totals = [unpack_counts(x) for x in replies.sort_values("bucket")["totals"]]
        totals = np.concatenate(totals) if totals else np.empty(0, np.int64)
        if len(totals) != len(known):
            raise ValueError("the answers of the count tables do not match the n-grams of the batch")
        rows = pd.DataFrame([score(g, known, totals) for g in grams], columns=["n_words", "n_backoff", "alone", "part"])
        return rows.assign(doc_id=texts["doc_id"].to_numpy())[["doc_id", "n_words", "n_backoff", "alone", "part"]]

    schema = "doc_id string, n_words long, n_backoff long, alone long, part double"
    scored = materialize(dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(judge, schema), "scores")
    size = scored.agg(F.sum("n_words")).first()[0] or 0
    rest = F.greatest(F.lit(size) - F.col("n_words"), F.lit(1))
    total = F.col("part") - F.when(F.col("alone") > 0, F.col("alone") * F.log(rest)).otherwise(0.0)
    mean = F.when(F.col("n_words") > 0, total / F.col("n_words")).otherwise(0.0)
    return scored.select(F.col("doc_id").cast("long"), "n_words", "n_backoff", total.alias("log_score"), mean.alias("mean_log_score"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents
), p AS (
  SELECT r, unnest(w) AS word, unnest(list_prepend(NULL, w[:-2])) AS prev FROM d WHERE len(w) > 0
), u AS (SELECT word, count(*) AS n FROM p GROUP BY word),
   ud AS (SELECT r, word, count(*) AS n FROM p GROUP BY r, word),
   b AS (SELECT prev, word, count(*) AS n FROM p WHERE prev IS NOT NULL GROUP BY prev, word),
   bd AS (SELECT r, prev, word, count(*) AS n FROM p WHERE prev IS NOT NULL GROUP BY r, prev, word),
   s AS (SELECT sum(n) AS n FROM u),
   scored AS (
  SELECT p.r, p.prev IS NOT NULL AND b.n - bd.n = 0 AS back,
         CASE WHEN p.prev IS NOT NULL AND b.n - bd.n > 0 THEN ln((b.n - bd.n) / (c.n - cd.n))
              ELSE CASE WHEN p.prev IS NOT NULL THEN ln(0.4) ELSE 0 END
                   + ln(greatest(u.n - ud.n, 0.5) / greatest((SELECT n FROM s) - len(d.w), 1)) END AS score
  FROM p JOIN d ON d.r = p.r JOIN u ON u.word = p.word JOIN ud ON ud.r = p.r AND ud.word = p.word
  LEFT JOIN u c ON c.word = p.prev LEFT JOIN ud cd ON cd.r = p.r AND cd.word = p.prev
  LEFT JOIN b ON b.prev = p.prev AND b.word = p.word
  LEFT JOIN bd ON bd.r = p.r AND bd.prev = p.prev AND bd.word = p.word
), t AS (SELECT r, count(*) AS n, count(*) FILTER (back) AS k, sum(score) AS x FROM scored GROUP BY r)
SELECT d.doc_id, coalesce(t.n, 0) AS n_words, coalesce(t.k, 0) AS n_backoff,
       round(coalesce(t.x, 0), 4) AS log_score, round(coalesce(t.x / t.n, 0), 6) AS mean_log_score
FROM d LEFT JOIN t ON t.r = d.r
"""
