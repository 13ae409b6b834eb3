"""Relations the queries work on, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions.expr import words_of
from voxlake.functions.text import normalize_unicode
from voxlake.operators.scans import scan, time_block
from voxlake.session import materialize

DAY = 86_400
TEXT_TABLES = ("documents", "pages", "orders")
#: Tasks a core for the text tables.
TEXT_TASKS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. Text tables with few splits are dealt out to several tasks a core: their rows cost far more
    than a shuffle, and a task's share must not be all that a core has to do. The plan of the scan tells the splits; nothing
    is read or listed for it."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = TEXT_TASKS * spark.sparkContext.defaultParallelism
    return rows.repartition(tasks) if name in TEXT_TABLES and rows.rdd.getNumPartitions() < tasks else rows


def utterances(spark: SparkSession, sf_dir: str, normalizer=normalize_unicode) -> DataFrame:
    """User turns with the assistant turn that follows, whole texts on both sides; without one the hypothesis is empty."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("reference"), (F.col("turn") + 1).alias("_next")
    )
    reply = turns.filter(F.col("role") == "assistant").select(
        F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("text").alias("hypothesis")
    )
    paired = user.join(reply, (F.col("conv_id") == F.col("_conv")) & (F.col("_next") == F.col("_turn")), "left")
    paired = paired.withColumn("hypothesis", F.coalesce("hypothesis", F.lit("")))
    return paired.select(
        "conv_id",
        "turn",
        "reference",
        "hypothesis",
        normalizer(F.col("reference")).alias("ref"),
        normalizer(F.col("hypothesis")).alias("hyp"),
    )


def role_code(role: Column) -> Column:
    """Speaker number of a role."""
    return F.when(role == "user", 0).when(role == "assistant", 1).otherwise(2)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed words of every conversation: 0.4 s per word and an extra second before each turn."""
    turns = table(spark, sf_dir, "conversations").withColumn("_words", words_of(F.col("text")))
    counted = scan(
        turns,
        ["conv_id"],
        ["turn"],
        F.floor(F.col("turn") / 1024),
        sums={"_through": F.size("_words").cast("bigint")},
    )
    exploded = counted.select(
        F.col("conv_id").alias("recording_id"),
        "turn",
        role_code(F.col("role")).alias("speaker"),
        (F.col("_through") - F.size("_words")).alias("_before"),
        F.posexplode("_words").alias("_pos", "word"),
    )
    index = (F.col("_before") + F.col("_pos")).alias("word_idx")
    timed = exploded.select("recording_id", "turn", index, "word", "speaker")
    start = F.col("word_idx") * 0.4 + F.col("turn") * 1.0
    return timed.select(
        "*",
        start.alias("start"),
        (start + 0.3).alias("end"),
        ((F.length("word") % 10) / 10.0).alias("confidence"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker turns: the time span of each conversation turn."""
    spans = words(spark, sf_dir).groupBy("recording_id", "turn").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.first("speaker").alias("speaker")
    )
    return spans.select("recording_id", F.col("turn").alias("turn_idx"), "start", "end", "speaker")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as a frame probability sequence: value over the user's largest value."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    numbered = scan(
        events,
        ["user_id"],
        ["ts", "event_id"],
        time_block("ts", DAY),
        totals={"_peak": (F.max, F.col("value"))},
        row_number="_rn",
    )
    rows = numbered.select(
        F.col("user_id").alias("recording_id"),
        (F.col("_rn") - 1).alias("frame_idx"),
        (F.col("value") / F.col("_peak")).alias("prob"),
    )
    return materialize(rows, "frames")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a request log."""
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").cast("string").alias("client"),
        F.col("event_type").alias("path"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        F.col("value").alias("duration_s"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines as job events: submitted, an attempt per line, finished with the last line.

    A line counts no earlier than its order. The order status decides how a job ends: ``F`` done, ``P`` failed,
    ``O`` still running.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    submitted = orders.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_orderdate").alias("ts"),
        F.lit(0).alias("seq"),
        F.lit("submit").alias("event"),
        F.lit(0.0).alias("processed_seconds"),
        F.lit(None).cast("string").alias("error"),
        F.round(F.col("o_totalprice")).cast("bigint").alias("body_bytes"),
    )
    dated = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn(
        "l_shipdate", F.greatest("l_shipdate", "o_orderdate")
    )
    progress = dated.select(
        F.col("l_orderkey").alias("job_id"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_linenumber").cast("int").alias("seq"),
        F.lit("start").alias("event"),
        F.col("l_quantity").alias("processed_seconds"),
        F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("bigint").alias("body_bytes"),
    )
    last = dated.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ts"))
    ended = orders.filter(F.col("o_orderstatus") != "O").join(last, F.col("o_orderkey") == F.col("l_orderkey"))
    terminal = ended.select(
        F.col("o_orderkey").alias("job_id"),
        "ts",
        F.lit(1000).alias("seq"),
        F.when(F.col("o_orderstatus") == "F", "done").otherwise("fail").alias("event"),
        F.lit(0.0).alias("processed_seconds"),
        F.when(F.col("o_orderstatus") == "P", "worker panicked").alias("error"),
        F.lit(None).cast("bigint").alias("body_bytes"),
    )
    return submitted.unionByName(progress).unionByName(terminal)


def channel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring vectors as the left and right channel of a recording."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    left = vectors.filter(F.col("vec_id") % 2 == 0).select(
        F.floor(F.col("vec_id") / 2).alias("recording_id"), "pos", F.col("x").cast("double").alias("left")
    )
    right = vectors.filter(F.col("vec_id") % 2 == 1).select(
        F.floor(F.col("vec_id") / 2).alias("recording_id"), "pos", F.col("x").cast("double").alias("right")
    )
    return left.join(right, ["recording_id", "pos"])
