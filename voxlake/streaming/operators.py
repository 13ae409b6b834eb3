"""Streaming operators: endpoints, regions, sessions, limits, jobs, rates and ingest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.functions.predicates import is_counted_partial
from voxlake.operators import folds
from voxlake.operators.joins import latest_per_key
from voxlake.operators.scans import instant, micros
from voxlake.session import STATE_STORE, scratch_path
from voxlake.streaming.ordered import stream_fold


def read_table_stream(spark: SparkSession, folder: str, file: str, schema: T.StructType, batch_files: int = 256) -> DataFrame:
    """Parquet files of ``folder`` that match ``file`` as a stream, so many files a batch. A table ``file`` may also be a
    folder of files, as Spark writes them."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", batch_files)
    if "*" not in file:
        files = spark.read.schema(schema).parquet(f"{folder}/{file}").inputFiles()
        if not any(f.endswith(f"/{file}") for f in files):
            return source.parquet(f"{folder}/{file}")
    return source.option("pathGlobFilter", file).parquet(folder)


def run_available(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over what is available now, into files in the shared folder, and return them as a table."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    path = scratch_path(spark, label)
    run = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def silence_endpoints(frames: DataFrame, keys: list[str], ts: str, order: list[str], row_id: str, **settings) -> DataFrame:
    """Endpoint rows of live frames ``row_id, prob``."""
    fold = folds.Hangover(**settings)
    return stream_fold(frames, keys, ts, order, [row_id, "prob"], fold, [frames.schema[row_id]])


REGION_FIELDS = [
    T.StructField("region_idx", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
]


def speech_regions(frames: DataFrame, keys: list[str], ts: str, order: list[str], **settings) -> DataFrame:
    """Speech regions of live frames ``prob``; a null probability ends a signal."""
    return stream_fold(frames, keys, ts, order, ["prob"], folds.Segmenter(**settings), REGION_FIELDS)


def assemble(decodes: DataFrame, keys: list[str], ts: str, order: list[str], row_id: str, fold: folds.Assembler) -> DataFrame:
    """Partial and final messages of live decodes."""
    fields = [decodes.schema[row_id]] + [T.StructField(n, T.StringType()) for n in ("type", "text", "endpoint_reason")]
    return stream_fold(decodes, keys, ts, order, [row_id, "text", "over_cap", "blank", "vad"], fold, fields)


def decode_windows(chunks: DataFrame, keys: list[str], ts: str, *, window: str = "2500 milliseconds", stride: str = "800 milliseconds", delay: str = "1 second") -> DataFrame:
    """Audio that arrived in each sliding decode window, by event time."""
    timed = chunks.withColumn("_ts", instant(F.col(ts))).withWatermark("_ts", delay)
    return timed.groupBy(*keys, F.window("_ts", window, stride).alias("window")).agg(F.sum("samples").alias("samples"))


def rate_limit(requests: DataFrame, client: str, ts: str, row_id: str, ms: Column, *, rpm: float, burst: int, ttl_ms: int | None = None) -> DataFrame:
    """Verdict for every live request; idle clients leave the state after ``ttl_ms``."""
    timed = requests.withColumn("request_ms", ms)
    fields = [requests.schema[row_id], T.StructField("allowed", T.BooleanType())]
    return stream_fold(
        timed, [client], ts, [row_id], [row_id, "request_ms"], folds.TokenBucket(rpm, burst), fields, ttl_ms=ttl_ms
    )


class LiveJobs(folds.JobLifecycle):
    """Job lifecycle that reports the state after every event."""

    def step(self, state, key, row):
        before = state["status"], state["attempts"]
        state, _ = super().step(state, key, row)
        changed = (state["status"], state["attempts"]) != before and state["status"] is not None
        return state, self.finish(state, key) if changed else ()


def job_states(events: DataFrame, ts: str = "ts", *, max_retries: int = 2, ttl_ms: int | None = None) -> DataFrame:
    """Every state change of live jobs; the state of a job leaves the store after ``ttl_ms`` without events."""
    timed = events.withColumn("event_us", micros(F.col(ts)))
    columns = ["event", "event_us", "processed_seconds", "error", "body_bytes"]
    fold = LiveJobs(max_retries)
    return stream_fold(timed, ["job_id"], ts, ["seq"], columns, fold, folds.JOB_FIELDS, ttl_ms=ttl_ms)


def settled_files(polls: DataFrame, ts: str, *, settle_polls: int = 2) -> DataFrame:
    """Files to schedule from a stream of directory listings ``path, poll, kind, size, mtime``."""
    ranked = polls.withColumn("rank", F.when(F.col("kind") == "finished", 0).otherwise(1))
    fields = [T.StructField("scheduled_poll", T.LongType())]
    return stream_fold(
        ranked, ["path"], ts, ["poll", "rank"], ["poll", "kind", "size", "mtime"], folds.Settle(settle_polls), fields
    )


def session_latency(
    messages: DataFrame, keys: list[str], ts: str, order: list[str], *, idle_s: float, cap_s: float, delay: str = "10 seconds"
) -> DataFrame:
    """First partial and last final of each session as versions: open ones while they go on, ended ones for good.

    A session ends ``idle_s`` after its last message, by a timer, or with the first message more than ``cap_s`` after it
    began. :func:`latest_versions` keeps what counts.
    """
    timed = messages.withColumns({"at_ms": F.unix_millis(instant(F.col(ts))), "counted": is_counted_partial(F.col("type"), F.col("text"))})
    fold = folds.LiveSession(int(idle_s * 1000), int(cap_s * 1000))
    return stream_fold(timed, keys, ts, order, ["at_ms", "type", "counted"], fold, folds.SESSION_FIELDS, delay=delay)


def latest_versions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the versions of each key the highest one; an ended one goes before an open one of the same number."""
    order = F.struct(F.col("version"), (~F.col("open")).alias("ended"))
    return latest_per_key(rows, keys, order).drop("version")


def event_rate(events: DataFrame, keys: list[str], ts: str, *, window: str, slide: str, delay: str = "10 seconds") -> DataFrame:
    """Events per sliding window; in update mode a window is shown whenever it has changed, see :func:`run_updates`."""
    timed = events.withColumn("_ts", instant(F.col(ts))).withWatermark("_ts", delay)
    counted = timed.groupBy(*keys, F.window("_ts", window, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    seconds = (F.unix_millis("w.end") - F.unix_millis("w.start")) / 1000.0
    return counted.select(*keys, F.unix_seconds("w.end").alias("eval_s"), "n", (F.col("n") / seconds).alias("rate"))


def run_updates(stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Run an aggregation over what is available now in update mode; of the rows of each key the last one counts.

    A batch that is repeated after a failure overwrites its own folder.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    path = scratch_path(spark, label)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/version={batch_id}")

    run = (
        stream.writeStream.foreachBatch(store)
        .outputMode("update")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("version", T.LongType())])
    return latest_per_key(spark.read.schema(schema).parquet(f"{path}/data"), keys, F.col("version")).drop("version")


def audit(stream: DataFrame, keys: list[str], ts: str, label: str, *, delay: str, path: str | None = None) -> DataFrame:
    """Rows that a query with this delay drops or cannot place: ``keys, hour, reason, n``; ``reason`` is ``late`` for rows
    behind the watermark of the batches before theirs, ``undecodable`` for those without a time (``hour`` is null).

    Each batch stores its counts and its latest time under its number, so a batch that is repeated after a failure counts
    once, and the watermark is known again after a restart. ``path`` names the folder of an audit to go on with.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, label)
    at = F.unix_micros(instant(F.col(ts)))
    late_by = F.expr(f"INTERVAL {delay}")

    def store(batch: DataFrame, batch_id: int) -> None:
        before = None
        if batch_id:
            seen = spark.read.schema("latest bigint, batch bigint").parquet(f"{path}/latest").filter(F.col("batch") < batch_id)
            before = seen.agg(F.max("latest")).first()[0]
        # As the engine does, the watermark is cut to milliseconds.
        mark = F.floor(F.unix_micros(F.timestamp_micros(F.lit(before)) - late_by) / 1000) * 1000 if before is not None else F.lit(None)
        reason = F.when(at.isNull(), "undecodable").when(at < mark, "late")
        odd = batch.withColumns({"reason": reason, "hour": F.date_trunc("hour", F.timestamp_micros(at))}).filter("reason is not null")
        odd.groupBy(*keys, "hour", "reason").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/odd/batch={batch_id}")
        batch.agg(F.max(at).alias("latest")).write.mode("overwrite").parquet(f"{path}/latest/batch={batch_id}")

    run = stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    fields = [stream.schema[k] for k in keys] + [T.StructField("hour", T.TimestampType()), T.StructField("reason", T.StringType()), T.StructField("n", T.LongType())]
    stored = spark.read.schema(T.StructType(fields)).option("recursiveFileLookup", True).parquet(f"{path}/odd")
    return stored.groupBy(*keys, "hour", "reason").agg(F.sum("n").alias("n"))


def active_sessions(changes: DataFrame, keys: list[str], ts: str, row_id: str) -> DataFrame:
    """Open sessions after every change, per server instance or shard named by ``keys``."""
    fields = [changes.schema[row_id], T.StructField("active", T.LongType())]
    return stream_fold(changes, keys, ts, [row_id], [row_id, "delta"], folds.RunningGauge(), fields)


def ingest(
    source: DataFrame, process: Callable[[DataFrame], DataFrame], label: str, *, keys: list[str] | None = None
) -> DataFrame:
    """Process each arriving file once and return what was written.

    Files are tracked by the checkpoint. A batch that is repeated after a failure overwrites its own folder, so a
    result is never stored twice; ``keys`` drops repeats inside a batch.
    """
    spark = source.sparkSession
    path = scratch_path(spark, label)
    schema, stored = process(source).schema, []

    def store(batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropDuplicates(keys) if keys else batch
        process(rows).write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")
        stored.append(batch_id)

    run = (
        source.writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    if not stored:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/data").select(*schema.names)
