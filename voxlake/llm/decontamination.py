"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts become words without case and punctuation. The n-grams of the test items are marked in a bit table of fixed size; one
pass over the documents keeps the n-grams that may be an item's, and a join finds those that are and in how many documents.
A passage is the stretch of a document around a diagonal of an item. Its seeds are the rarest n-grams that it has. Where even
these are common, as in an edited copy that shares its rest with verbatim ones, a passage needs two of the item's n-grams
along its diagonal. Only then is its text read again and the passage, as hashes of its words, joined to the item. The local
alignment of both says how much of the item is there, word changes, insertions and deletions included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import MEMO, MEMO_BYTES, batch_rows, gram_hashes, members
from voxlake.session import materialize

#: Words of a seed.
SEED_WORDS = 3
#: An n-gram is rare in so many documents, or in one of so many. Without a rare one a passage needs two of the item's n-grams
#: along its diagonal, or one if the item has no more words than this.
RARE_DOCS, RARE_ONE_IN, SHORT_ITEM = 20, 1000, 8
#: Diagonals of one passage. Around the seeds' diagonals a passage reaches as far on both sides.
BAND = 32
MATCH, MISMATCH, GAP = 2, -1, 1
#: Least alignment score, as a share of the score of the whole item.
LEAST_SCORE = 0.5
#: Bits of the table of item n-grams (1 MB, whatever the benchmark's size).
TABLE_BITS = 1 << 23


class PlainWords(dict):
    """Hashes of words without the punctuation around them; 0 for tokens that are nothing else."""

    def __missing__(self, token: bytes) -> int:
        word, a = token.decode("utf-8", "replace"), 0
        b = len(word)
        while a < b and not word[a].isalnum():
            a += 1
        while b > a and not word[b - 1].isalnum():
            b -= 1
        h = xxhash.xxh64_intdigest(word[a:b]) if a < b else 0
        if len(token) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[token] = h
        return h

    def of(self, text: str | None) -> np.ndarray:
        tokens = (text or "").lower().encode("utf-8", "replace").split()
        hashes = np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))
        return hashes[hashes != 0]


def local_alignment(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score and the place in the passage where it ends (exclusive)."""
    slope = GAP * np.arange(len(passage) + 1)
    above, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        row = np.zeros(len(passage) + 1, np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(passage == word, MATCH, MISMATCH), above[1:] - GAP)
        row = np.maximum(np.maximum.accumulate(np.maximum(row, 0) + slope) - slope, 0)
        row[0] = 0
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
        above = row
    return best, end


def item_grams(items: DataFrame, n: int) -> DataFrame:
    """``gram, item_id, q, size, k``: every n-gram of the items, with the words of its item and of itself; items of fewer
    words than n have the one of all their words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = PlainWords()
        for pdf in batches:
            for item, text in zip(pdf["item_id"], pdf["text"]):
                w = words.of(text)
                grams = gram_hashes(w, min(n, len(w))) if len(w) else np.empty(0, np.uint64)
                same = {"item_id": np.full(len(grams), item, np.int64), "size": np.full(len(grams), len(w)), "k": np.full(len(grams), min(n, len(w)))}
                yield pd.DataFrame({"gram": grams.view(np.int64), "q": np.arange(len(grams)), **same})

    return items.select("item_id", "text").mapInPandas(run, "gram long, q int, item_id long, size int, k int")


def bit_table(grams: DataFrame) -> np.ndarray:
    """Bytes of a bit for each hash slot; at most TABLE_BITS / 64 rows come back."""
    slot = F.pmod("gram", F.lit(TABLE_BITS))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    table = np.zeros(TABLE_BITS // 64, "<i8")
    for row in grams.groupBy((F.floor(slot / 64)).cast("int").alias("word")).agg(F.bit_or(one).alias("bits")).collect():
        table[row.word] = row.bits
    return table.view(np.uint8)


def hits(docs: DataFrame, table: np.ndarray, sizes: list[int], reach: int) -> DataFrame:
    """``doc_id, said, p, gram, near``: the n-grams of the documents, of all lengths that items have, whose slot is marked,
    and how many of them there are within ``reach`` words. ``said`` tells texts of the same id apart."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, marks = PlainWords(), shared.value
        for pdf in batches:
            ids, said, places, grams, near = [], [], [], [], []
            for doc, same, text in zip(pdf["doc_id"], pdf["said"], pdf["text"]):
                w = words.of(text)
                for k in sizes:
                    g = gram_hashes(w, k)
                    slot = g & np.uint64(TABLE_BITS - 1)
                    at = np.flatnonzero(marks[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
                    ids.append(np.full(len(at), doc, np.int64))
                    said.append(np.full(len(at), same, np.int64))
                    places.append(at)
                    grams.append(g[at].view(np.int64))
                    near.append(np.searchsorted(at, at + reach, "right") - np.searchsorted(at, at - reach))
            if ids:
                each = zip(["doc_id", "said", "p", "gram", "near"], [ids, said, places, grams, near])
                yield pd.DataFrame({name: np.concatenate(x) for name, x in each})

    return docs.select("doc_id", "said", "text").mapInPandas(run, "doc_id long, said long, p int, gram long, near int")


def passages_to_align(found: DataFrame, grams: DataFrame, documents: int) -> DataFrame:
    """``doc_id, said, item_id, band, n_seeds, size``: the passages with a rare seed, or with enough seeds on their diagonal.

    ``found``: hits that are an item's n-grams. An n-gram of many documents and many items is left out before it meets its
    items where no other is near.
    """
    rare = max(RARE_DOCS, documents // RARE_ONE_IN)
    needed = F.when(F.col("size") > SHORT_ITEM, 2).otherwise(1)
    spread = found.select("gram", "doc_id", "said").distinct().groupBy("gram").agg((F.count(F.lit(1)) <= rare).alias("rare"))
    least = grams.groupBy("gram").agg(F.min(needed).alias("least"))
    told = found.join(spread.join(least, "gram"), "gram").filter(F.col("rare") | (F.col("near") >= F.col("least")))
    joined = told.join(grams, "gram").filter(F.col("rare") | (F.col("near") >= needed))
    own = F.floor((F.col("p") - F.col("q")) / BAND).cast("int")
    aside = joined.withColumn("own", own).withColumn("aside", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    here = F.col("aside") == 0
    bands = aside.groupBy("doc_id", "said", "item_id", (F.col("own") + F.col("aside")).alias("band")).agg(
        F.count_if(here).alias("n_seeds"),
        F.max(here & F.col("rare")).alias("rare"),
        F.count_distinct("q").alias("along"),
        F.max("size").alias("size"),
    )
    return bands.filter((F.col("n_seeds") > 0) & (F.col("rare") | (F.col("along") >= needed))).drop("rare", "along")


def cut_passages(docs: DataFrame, bands: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_seeds, start, passage``: the word hashes of the passages.

    A document's text and then its bands stream through a task, so neither the bands of a document nor the documents of an
    id are held together.
    """
    none = F.lit(None)
    texts = members(docs, F.col("doc_id"), bands, F.col("doc_id"))
    rows = texts.select("doc_id", "said", none.cast("long").alias("item_id"), none.cast("int").alias("band"), none.cast("long").alias("n_seeds"), none.cast("int").alias("size"), "text")
    rows = rows.unionByName(bands.withColumn("text", none.cast("string")))
    sorted_ = rows.repartition("doc_id", "said").sortWithinPartitions("doc_id", "said", F.col("item_id").asc_nulls_first())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, key, w = PlainWords(), None, None
        for pdf in batches:
            out = []
            for doc, same, item, band, seeds, size, text in pdf.itertuples(index=False):
                if text is not None:
                    if key != (doc, same):
                        key, w = (doc, same), words.of(text)
                    continue
                start = max(0, (int(band) - 1) * BAND)
                passage = w[start : (int(band) + 2) * BAND + int(size)]
                out.append((doc, int(item), int(seeds), start, passage.view(np.int64)))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_seeds", "start", "passage"])

    # Item ids pass through pandas beside nulls, as text.
    sent = sorted_.withColumn("item_id", F.col("item_id").cast("string"))
    return sent.mapInPandas(cut, "doc_id long, item_id long, n_seeds long, start int, passage array<long>")


def contaminated(docs: DataFrame, items: DataFrame, n: int = SEED_WORDS, least_score: float = LEAST_SCORE) -> DataFrame:
    """``doc_id, item_id, score, n_seeds, start_word, end_word``: documents that say a test item, wholly or edited.

    ``score`` is the alignment score as a share of the item's own; the best passage of a document and item is reported, by
    its words in the document (words without letters or digits are not counted). An item of fewer than ``n`` words is found
    where all its words stand together. Null or empty texts say nothing and are never said. Rows that share an id are one
    document, whatever their texts. Documents and items with a null id are left out. Other columns are ignored; empty tables
    give no rows.
    """
    said = F.xxhash64("text").alias("said")
    docs = docs.filter("doc_id is not null and text is not null").select("doc_id", said, "text")
    items = items.filter("item_id is not null and text is not null").select("item_id", "text")
    with batch_rows(docs.sparkSession):
        grams = materialize(item_grams(items, n), "grams")
        sizes = sorted(r.k for r in grams.select("k").distinct().collect())  # n, and less for items of fewer words
        longest = grams.agg(F.max("size")).first()[0] or 0
        # Few rows pass; they are written once, or each of their uses below would read the documents again.
        marked = hits(docs, bit_table(grams), sizes, 3 * BAND + longest)
        found = materialize(marked.join(grams.select("gram").distinct(), "gram"), "hits")
        bands = materialize(passages_to_align(found, grams, docs.count()), "bands")
        passages = materialize(cut_passages(docs, bands), "passages")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = PlainWords()
        for pdf in batches:
            rows, said = [], {}
            for doc, item, seeds_, start, passage, text in pdf.itertuples(index=False):
                if text not in said:
                    said[text] = words.of(text)
                w, p = said[text], np.asarray(passage, np.int64).view(np.uint64)
                p = p[: 3 * BAND + len(w)]
                # No alignment scores more than all words of the item that the passage has.
                if np.isin(w, p).sum() < least_score * len(w):
                    continue
                score, end = local_alignment(w, p)
                if score >= least_score * MATCH * len(w):
                    _, back = local_alignment(w[::-1], p[:end][::-1])
                    rows.append((doc, item, score / (MATCH * len(w)), seeds_, start + end - back, start + end))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "n_seeds", "start_word", "end_word"])

    schema = "doc_id long, item_id long, score double, n_seeds long, start_word int, end_word int"
    pairs = passages.join(items, "item_id").select("doc_id", "item_id", "n_seeds", "start", "passage", "text")
    with batch_rows(docs.sparkSession):
        scored = materialize(pairs.mapInPandas(align, schema), "aligned")
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "n_seeds", -F.col("start_word"), "end_word")).alias("m"))
    return best.select(
        "doc_id", "item_id", "m.score", "m.n_seeds", (-F.col("m.col3")).alias("start_word"), F.col("m.end_word").alias("end_word")
    )
