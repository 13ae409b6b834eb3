"""Exact deduplication with counting quotient filters.

Every partition builds a counting quotient filter over the 64-bit fingerprints of its texts. A fingerprint is cut into a
quotient (its high bits, the home slot) and a remainder. The filter holds its remainders in the order of their quotients,
sorted within the run of a quotient, with the length of every run and a counter for each remainder that occurs more than
once. Filters are cut at quotient ranges ("slices"), so that slices of the same range from all partitions meet in one task
and merge by their sorted remainders. Nothing is lost: quotient and remainder together are the fingerprint, counters add up.

Fingerprints counted more than once only say that texts may be equal. Their texts go to byte verification, a grouping by
the text itself. All other texts are known to be unique.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import members

#: Bits of the quotient below the slice: home slots of one slice.
SLOT_BITS = 12
#: Fingerprints that one slice of the merged filter is to hold, on average.
SLICE_ROWS = 1 << 14
#: Distinct fingerprints after which a partition hands out its filter and starts another one.
FLUSH_ROWS = 1 << 20


def encode(prints: np.ndarray, counts: np.ndarray, slice_bits: int) -> dict[str, bytes]:
    """The filter of distinct, sorted fingerprints that share a slice."""
    rest = prints << np.uint64(slice_bits) if slice_bits else prints
    slots = (rest >> np.uint64(64 - SLOT_BITS)).astype(np.uint16)
    occupied, runs = np.unique(slots, return_counts=True)
    low = np.uint64((1 << (64 - slice_bits - SLOT_BITS)) - 1)
    many = np.flatnonzero(counts > 1)
    return {
        "occupied": occupied.astype("<u2").tobytes(),
        "runs": runs.astype("<u4").tobytes(),
        "remainders": (prints & low).astype("<u8").tobytes(),
        "counted": many.astype("<u4").tobytes(),
        "counters": counts[many].astype("<u8").tobytes(),
    }


def decode(row: dict[str, bytes], part: int, slice_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and counts of one filter of slice ``part``."""
    slots = np.repeat(np.frombuffer(row["occupied"], "<u2"), np.frombuffer(row["runs"], "<u4")).astype(np.uint64)
    prints = np.frombuffer(row["remainders"], "<u8") | slots << np.uint64(64 - slice_bits - SLOT_BITS)
    if slice_bits:
        prints = prints | np.uint64(part << (64 - slice_bits))
    counts = np.ones(len(prints), np.int64)
    counts[np.frombuffer(row["counted"], "<u4")] = np.frombuffer(row["counters"], "<u8")
    return prints, counts


def add_up(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints in order, their counts added."""
    if not len(prints):
        return prints, counts
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    starts = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]])
    return prints[starts], np.add.reduceat(counts, starts)


SLICE_SCHEMA = "slice int, occupied binary, runs binary, remainders binary, counted binary, counters binary"


def build_filters(prints: DataFrame, slice_bits: int) -> DataFrame:
    """One row per partition and slice of its filter. ``prints`` has the one column ``fp``."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def slices(fp, counts):
            ids = (fp >> np.uint64(64 - slice_bits)).astype(np.int64) if slice_bits else np.zeros(len(fp), np.int64)
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            ends = np.r_[starts[1:], len(fp)]
            return pd.DataFrame([{"slice": int(ids[a])} | encode(fp[a:b], counts[a:b], slice_bits) for a, b in zip(starts, ends)])

        fp, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for pdf in batches:
            new = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            fp, counts = add_up(np.concatenate([fp, new]), np.concatenate([counts, np.ones(len(new), np.int64)]))
            if len(fp) >= FLUSH_ROWS:
                yield slices(fp, counts)
                fp, counts = fp[:0], counts[:0]
        if len(fp):
            yield slices(fp, counts)

    return prints.select("fp").mapInPandas(build, SLICE_SCHEMA)


def repeated(filters: DataFrame, slice_bits: int) -> DataFrame:
    """Merge the filters slice by slice: fingerprints counted more than once, with their count."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["slice"].iloc[0])
        each = [decode(row, part, slice_bits) for row in pdf.to_dict("records")]
        fp, counts = add_up(np.concatenate([x[0] for x in each]), np.concatenate([x[1] for x in each]))
        again = counts > 1
        return pd.DataFrame({"fp": fp[again].view(np.int64), "n": counts[again]})

    return filters.groupBy("slice").applyInPandas(merge, "fp long, n long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are; a null text is the empty text. The row with the largest id of a group stays.
    Rows with a null id never stay in place of others (a group of null ids only keeps id null, and all its rows). Repeated
    rows of the id that stays are one document and stay together. An empty table gives an empty result; other columns are
    ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    prints = base.select("doc_id", "text", F.xxhash64("text").alias("fp"))
    slice_bits = max(0, math.ceil(math.log2(max(1, docs.count() / SLICE_ROWS))))
    again = repeated(build_filters(prints, slice_bits), slice_bits)

    # Byte verification. The grouping compares whole texts; copies in one partition are combined before the shuffle.
    suspects = members(prints, F.col("fp"), again, F.col("fp")).join(again.select("fp"), "fp")
    verified = (
        suspects.select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"))
        .groupBy("text_sha256", "text")
        .agg(F.max("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
        .select("text_sha256", "_keep", "_size")
    )
    own = base.select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    joined = own.join(verified, "text_sha256", "left")
    keep_id = F.when(F.col("_size").isNotNull(), F.col("_keep")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
        keep_id.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
