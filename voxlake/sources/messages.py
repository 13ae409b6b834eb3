"""Tagged wire messages, one JSON object per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE_SCHEMA = (
    "type STRING, text STRING, timestamp DOUBLE, code STRING, message STRING, retry_after_ms BIGINT, model STRING, "
    "sample_rate INT, version STRING, is_final BOOLEAN, speech_final BOOLEAN, endpoint_reason STRING"
)
# The known message types.
TYPES = ["ready", "partial", "final", "error"]


def parse_messages(lines: DataFrame, value: str = "value") -> DataFrame:
    """Messages of the known types; payloads that are not JSON or of another type are skipped."""
    parsed = lines.withColumn("_m", F.from_json(value, MESSAGE_SCHEMA, {"mode": "PERMISSIVE"}))
    return parsed.filter(F.col("_m.type").isin(TYPES)).select(*[c for c in lines.columns if c != value], "_m.*")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of line files."""
    return parse_messages(spark.read.text(path))


def stream_messages(spark: SparkSession, path: str, *, files_per_batch: int = 1000) -> DataFrame:
    """Messages of line files as they arrive; server-sent events may carry a ``data:`` prefix."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return parse_messages(lines.withColumn("value", strip_event_prefix(F.col("value"))))


def strip_event_prefix(line: Column) -> Column:
    """The payload of a server-sent event line."""
    return F.regexp_replace(line, r"^data:\s?", "")
