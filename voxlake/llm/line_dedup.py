"""Line deduplication with column expressions only.

Lines become 128-bit hashes of their keys with document and position. They are partitioned by range of (hash, document)
and sorted by position within, so that a line found everywhere spreads over as many partitions as its documents need.
Within a partition the first occurrence of a line in a document is the row that opens a (hash, document) run; those rows
are counted by hash, combined before the shuffle. What comes back for a document is no text but a bitmap of the lines to
keep: 64 lines to a word, and only words with a line to drop are stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.common import bit, has_bit
from voxlake.session import materialize

#: ASCII white space, stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_array(text: Column) -> Column:
    """The lines of a text; a null or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def occurrences(docs: DataFrame, partitions: int, least_chars: int = 1) -> DataFrame:
    """Rows ``h1, h2, doc_id, said, pos``, one for each line whose key has ``least_chars`` code points, in range partitions of
    (hash, document), sorted by hash, document and position. ``said`` tells texts of the same id apart."""
    lines = docs.select("doc_id", "said", F.posexplode(F.transform(line_array(F.col("text")), line_key)).alias("pos", "key"))
    hashed = lines.filter(F.length("key") >= least_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "said", "pos"
    )
    return hashed.repartitionByRange(partitions, "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "said", "pos")


def drop_words(rows: DataFrame, least_docs: int, keep_first: bool) -> DataFrame:
    """Rows ``doc_id, said, word, bits``: the lines to drop, 64 to a word.

    A line goes if its key is in ``least_docs`` documents. With ``keep_first`` the first occurrence of the lowest document
    id stays.
    """
    marks = rows.groupBy("h1", "h2", "doc_id", "said", F.shiftright("pos", 6).alias("word")).agg(
        F.bit_or(bit(F.col("pos"))).alias("bits"), F.min("pos").alias("pos")
    )
    # The row that opens a (hash, document) run has its first position. The partitioning still holds, nothing moves. What
    # comes out is written, so that the frequent lines join it as a table of their own, which adaptive execution broadcasts
    # if it is small, or else splits where a line is hot.
    first = F.row_number().over(Window.partitionBy("h1", "h2", "doc_id").orderBy("said", "word")) == 1
    marks = materialize(marks.withColumn("opens", first), "lines")
    seen = marks.filter("opens").groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "said", "pos")).alias("first")
    )
    frequent = materialize(seen.filter(F.col("n") >= least_docs), "frequent")
    dropped = marks.select("h1", "h2", "doc_id", "said", "word", "bits").join(frequent, ["h1", "h2"])
    if keep_first:
        same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("said") == F.col("first.said"))
        stays = same & (F.shiftright("first.pos", 6) == F.col("word"))
        dropped = dropped.withColumn("bits", F.when(stays, F.col("bits").bitwiseXOR(bit(F.col("first.pos")))).otherwise(F.col("bits")))
    return dropped.groupBy("doc_id", "said", "word").agg(F.bit_or("bits").alias("bits"))


def keep_bitmaps(docs: DataFrame, least_docs: int, keep_first: bool = False, partitions: int | None = None, least_chars: int = 1) -> DataFrame:
    """Rows ``doc_id, said, drops``: for documents that lose lines, the sorted (word, bits) pairs of their compressed bitmap.

    The bitmap of a document holds one bit a line, so its size is bounded by the document.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = drop_words(occurrences(docs, n, least_chars), least_docs, keep_first)
    return words.groupBy("doc_id", "said").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("drops"))


def is_dropped(pos: Column, dense: Column) -> Column:
    return has_bit(F.coalesce(F.get(dense, F.shiftright(pos, 6)), F.lit(0).cast("long")), pos)


def dense_words(drops: Column) -> Column:
    """The bitmap with its empty words, so that a line's word is found by its place."""

    def upto(pair: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get(drops, i - 1)["word"])
        return F.concat(F.array_repeat(F.lit(0).cast("long"), pair["word"] - before - 1), F.array(pair["bits"]))

    return F.flatten(F.transform(drops, upto))


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and the text that is left, ``kept_text``."""
    found = bitmaps.withColumnsRenamed({"doc_id": "_id", "said": "_said"})
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("said") == F.col("_said")), "left").drop("_id", "_said")
    counted = joined.withColumn("_n", F.aggregate("drops", F.lit(0), lambda n, x: n + F.bit_count(x["bits"])))
    lines = line_array(F.col("text"))
    left = F.filter(lines, lambda _, i: ~is_dropped(i, F.col("_dense")))
    whole = F.coalesce("text", F.lit(""))
    return (
        counted.withColumn("_dense", F.when(F.col("drops").isNotNull(), dense_words(F.col("drops"))))
        .withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.col("_n").cast("long"), F.lit(0).cast("long")))
        .withColumn("kept_text", F.when(F.col("drops").isNull(), whole).otherwise(F.array_join(left, "\n")))
        .drop("_n", "_dense", "drops")
    )


def dedup_lines(docs: DataFrame, least_docs: int = 10, keep_first: bool = False, least_chars: int = 1) -> DataFrame:
    """Drop lines found in ``least_docs`` documents: ``doc_id, text, n_lines, n_dropped, kept_text``.

    A null or empty text is one empty line. Keys are compared by a 128-bit hash. Documents are counted by id: rows
    that repeat an id are one document, those with a null id another one. Each row loses its own lines, whatever other rows of
    its id say; repeated rows lose the same. Other columns are ignored.
    """
    base = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("said"))
    return drop_lines(base, keep_bitmaps(base, least_docs, keep_first, None, least_chars)).drop("said")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
