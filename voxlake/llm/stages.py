"""Pipeline stages: each applies one operator to all its predecessor kept, and lets the operator's decisions take effect.

The filtering stages return the columns of their input. A document is told by its id; rows without an id cannot be pointed
at, so no stage drops them for what another row says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.llm import byte_bpe, decontamination, exact_dedup, ngram_join
from voxlake.llm.common import table
from voxlake.llm.queries import toxicity_scores


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the ids of ``gone``."""
    return docs.join(gone.filter("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. The model is fitted on the labels of the tables."""
    return _without(docs, toxicity_scores(spark, docs, sf_dir).filter("predicted = 1"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return _without(docs, exact_dedup.exact_groups(docs).filter("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by links of n-gram similarity, the one with the smallest id stays.

    Five words a shingle, Jaccard similarity of at least 0.8.
    """
    found = ngram_join.jaccard_components(docs, n=5, num=80, den=100)
    return _without(docs, found.filter("component_id != doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that say a benchmark item go."""
    return _without(docs, decontamination.contaminated(docs, table(spark, sf_dir, "benchmark")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document that is left."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.token_digests(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", tokenize),
]
