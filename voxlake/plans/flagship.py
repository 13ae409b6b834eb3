"""The query that runs the whole scoring path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions import timing
from voxlake.functions.distance import wer_percent
from voxlake.operators import scoring
from voxlake.plans import sql
from voxlake.plans.registry import query
from voxlake.plans.relations import utterances


@query(
    "flagship_turn_report",
    f"""WITH {sql.utterances()}, d AS (SELECT turn, len(ref) AS ref_words, {sql.distance('ref', 'hyp')} AS errors, len(ref) * 4e-1 AS audio_sec FROM utt),
b AS (SELECT *, {sql.bucket('audio_sec', timing.DURATION_BUCKETS)} AS bucket FROM d),
s AS (SELECT turn, bucket, count(*) AS samples, sum(errors)::BIGINT AS errors, sum(ref_words)::BIGINT AS ref_words FROM b GROUP BY 1, 2)
SELECT *, {sql.wer('errors', 'ref_words')} AS wer FROM s""",
)
def turn_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rate by turn and clip length: scan, join, normalization, edit distance, aggregation, order."""
    scored = scoring.score_pairs(utterances(spark, sf_dir).select("turn", "ref", "hyp"))
    bucketed = scored.withColumn("bucket", timing.bucket_label(F.size("ref") * 0.4, timing.DURATION_BUCKETS))
    sums = bucketed.groupBy("turn", "bucket").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("errors").alias("errors"), F.sum("ref_words").alias("ref_words")
    )
    rated = sums.withColumn("wer", wer_percent(F.col("errors"), F.col("ref_words")))
    return rated.orderBy("turn", "bucket")
