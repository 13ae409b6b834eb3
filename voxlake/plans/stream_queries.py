"""Streaming queries over the given tables, run over what is available and returned as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions.expr import words_of
from voxlake.operators import folds
from voxlake.operators.scans import micros
from voxlake.plans import sql
from voxlake.plans.registry import query
from voxlake.plans.relations import job_events, table
from voxlake.plans.service_queries import SETTLED, polls
from voxlake.session import scratch_path
from voxlake.streaming import operators as live


def events_stream(spark, sf_dir) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return live.read_table_stream(spark, sf_dir, "events.parquet", schema)


_QUIET = """q AS (SELECT user_id, event_id, row_number() OVER w - max(CASE WHEN value >= 15 THEN n END) OVER w AS quiet FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query("st01_live_endpoints", f"WITH {_QUIET} SELECT user_id, event_id FROM q WHERE quiet = 2")
def st01(spark, sf_dir):
    frames = events_stream(spark, sf_dir).withColumn("prob", F.col("value") / 100.0)
    out = live.silence_endpoints(
        frames, ["user_id"], "ts", ["event_id"], "event_id", threshold=0.15, min_silence=1024, frame=512
    )
    return live.run_available(out, "endpoints")


LIVE_REGIONS = """
frames AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, value / 100e0 AS prob FROM events),
total AS (SELECT user_id, count(*) * 512 AS total FROM frames GROUP BY 1),
loud AS (SELECT user_id, frame_idx, frame_idx - row_number() OVER (PARTITION BY user_id ORDER BY frame_idx) AS g FROM frames WHERE prob >= 15e-2),
runs AS (SELECT user_id, min(frame_idx) * 512 AS s, (max(frame_idx) + 1) * 512 AS e FROM loud GROUP BY user_id, g),
m1 AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY user_id ORDER BY s) < 1100 THEN 0 ELSE 1 END AS b FROM runs),
m2 AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY s) AS g FROM m1),
m3 AS (SELECT user_id, min(s) AS s, max(e) AS e FROM m2 GROUP BY user_id, g HAVING max(e) - min(s) >= 1024),
p1 AS (SELECT m3.user_id, greatest(s - 700, 0) AS s, least(e + 700, total) AS e FROM m3 JOIN total USING (user_id)),
p2 AS (SELECT *, CASE WHEN s <= lag(e) OVER (PARTITION BY user_id ORDER BY s) THEN 0 ELSE 1 END AS b FROM p1),
p3 AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY s) AS g FROM p2)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY min(s)) - 1 AS region_idx, min(s) AS start, max(e) AS "end" FROM p3 GROUP BY user_id, g"""


@query("st02_live_regions", f"WITH {LIVE_REGIONS}")
def st02(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("value") / 100.0).alias("prob"))
    # A closing row per user ends its signal.
    ends = events.groupBy("user_id").agg((F.max("ts") + F.expr("INTERVAL 1 SECOND")).alias("ts")).select(
        "user_id", "ts", F.lit(-1).cast("bigint").alias("event_id"), F.lit(None).cast("double").alias("prob")
    )
    path = scratch_path(spark, "frames")
    events.unionByName(ends).write.parquet(path)
    frames = live.read_table_stream(spark, path, "*.parquet", events.schema)
    out = live.speech_regions(
        frames, ["user_id"], "ts", ["event_id"], threshold=0.15, min_silence=1100, min_speech=1024, pad=700, frame=512
    )
    return live.run_available(out, "regions")


@query(
    "st03_live_assembler",
    """WITH RECURSIVE t AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type AS live,
  event_type = 'purchase' AS cap, event_type = 'error' AS vad FROM events),
walk AS (SELECT user_id, event_id, n, live AS full_text, vad, CASE WHEN vad THEN '' WHEN cap THEN live ELSE '' END AS kept FROM t WHERE n = 1
  UNION ALL SELECT t.user_id, t.event_id, t.n, trim(w.kept || ' ' || t.live), t.vad, CASE WHEN t.vad THEN '' WHEN t.cap THEN trim(w.kept || ' ' || t.live) ELSE w.kept END
  FROM walk w JOIN t ON t.user_id = w.user_id AND t.n = w.n + 1)
SELECT user_id, event_id, CASE WHEN vad THEN 'final' ELSE 'partial' END AS type, full_text AS text, CASE WHEN vad THEN 'vad' END AS endpoint_reason FROM walk""",
)
def st03(spark, sf_dir):
    kind = F.col("event_type")
    decodes = events_stream(spark, sf_dir).select(
        "user_id",
        "ts",
        "event_id",
        kind.alias("text"),
        (kind == "purchase").alias("over_cap"),
        F.lit(False).alias("blank"),
        (kind == "error").alias("vad"),
    )
    out = live.assemble(decodes, ["user_id"], "ts", ["event_id"], "event_id", folds.Assembler("auto"))
    return live.run_available(out, "assembler")


@query(
    "st06_live_rate_limit",
    """WITH RECURSIVE n AS (SELECT user_id, event_id, epoch_us(ts) / 500000e0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
walk AS (SELECT user_id, pos, event_id, t, 1e0 AS tokens, true AS allowed FROM n WHERE pos = 1
  UNION ALL SELECT x.user_id, x.pos, x.event_id, x.t, CASE WHEN x.have >= 1e0 THEN x.have - 1e0 ELSE x.have END, x.have >= 1e0
  FROM (SELECT n.*, least(w.tokens + (n.t - w.t) * (1e0 / 60000e0), 2e0) AS have FROM walk w JOIN n ON n.user_id = w.user_id AND n.pos = w.pos + 1) x)
SELECT user_id, event_id, allowed FROM walk""",
)
def st06(spark, sf_dir):
    requests = events_stream(spark, sf_dir).select("user_id", "ts", "event_id")
    out = live.rate_limit(requests, "user_id", "ts", "event_id", micros(F.col("ts")) / 500_000.0, rpm=1, burst=2)
    return live.run_available(out, "verdicts")


@query(
    "st07_live_jobs",
    """WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey AS job_id, 1 + coalesce(n, 0) + CASE WHEN n IS NOT NULL AND o_orderstatus <> 'O' THEN 1 ELSE 0 END AS changes,
  coalesce(n, 0)::INT AS attempts FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
)
def st07(spark, sf_dir):
    events = job_events(spark, sf_dir)
    path = scratch_path(spark, "job-events")
    events.write.parquet(path)
    out = live.run_available(live.job_states(live.read_table_stream(spark, path, "*.parquet", events.schema)), "jobs")
    return out.groupBy("job_id").agg(F.count(F.lit(1)).alias("changes"), F.max("attempts").alias("attempts"))


@query(
    "st08_st10_live_sessions",
    """WITH RECURSIVE n AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000 AS t, row_number() OVER w AS pos,
  lag(epoch_us(ts) // 1000) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
walk AS (SELECT user_id, pos, t AS s0 FROM n WHERE pos = 1
  UNION ALL SELECT n.user_id, n.pos, CASE WHEN n.t - n.p >= 43200000 OR n.t - w.s0 > 86400000 THEN n.t ELSE w.s0 END
  FROM walk w JOIN n ON n.user_id = w.user_id AND n.pos = w.pos + 1),
a AS (SELECT user_id, s0 AS session_start_ms, max(t) AS last_t, max(pos) AS last_pos, count(*) AS messages,
  min(CASE WHEN event_type = 'click' THEN t END) AS st, min(CASE WHEN event_type = 'view' THEN t END) AS fp,
  max(CASE WHEN event_type = 'purchase' THEN t END) AS fin FROM walk JOIN n USING (user_id, pos) GROUP BY 1, 2)
SELECT user_id, session_start_ms, messages, fp - st AS ttfp_ms, fin - st AS finalization_lag_ms,
  last_pos = max(last_pos) OVER (PARTITION BY user_id) AND last_t + 43200000 > (SELECT max(t) FROM n) AS open FROM a""",
)
def st08(spark, sf_dir):
    """Sessions of at most a day that end after half a day of silence; those still open are among them."""
    kind = F.col("event_type")
    messages = events_stream(spark, sf_dir).select(
        "user_id",
        "ts",
        "event_id",
        F.when(kind == "click", "send").when(kind == "view", "partial").when(kind == "purchase", "final").otherwise("ready").alias("type"),
        kind.alias("text"),
    )
    out = live.session_latency(messages, ["user_id"], "ts", ["event_id"], idle_s=12 * 3600, cap_s=86_400, delay="0 seconds")
    return live.latest_versions(live.run_available(out, "sessions"), ["user_id", "session_start_ms"])


@query(
    "st11_live_rate",
    """WITH h AS (SELECT event_type AS path, epoch_us(ts) // 3600000000 AS step FROM events), s AS (SELECT path, unnest(range(step, step + 6)) AS last FROM h)
SELECT path, (last + 1) * 3600 AS eval_s, count(*) AS n, count(*) / 21600e0 AS rate FROM s GROUP BY 1, 2""",
)
def st11(spark, sf_dir):
    """Every window, also those that are still open at the end."""
    events = events_stream(spark, sf_dir).select("ts", F.col("event_type").alias("path"))
    return live.run_updates(live.event_rate(events, ["path"], "ts", window="6 hours", slide="1 hour"), "rates", ["path", "eval_s"])


@query(
    "st11_late_rows",
    """WITH e AS (SELECT event_type, ts, event_id % 4 AS part FROM events),
m AS (SELECT part, max(ts) AS latest FROM e GROUP BY 1),
w AS (SELECT p.part, date_trunc('millisecond', max(m.latest) - INTERVAL 10 DAY) AS mark FROM m p JOIN m ON m.part < p.part GROUP BY 1)
SELECT event_type, epoch(date_trunc('hour', ts))::BIGINT AS hour_s, 'late' AS reason, count(*) AS n FROM e JOIN w USING (part) WHERE ts < mark GROUP BY 1, 2""",
)
def st11_late(spark, sf_dir):
    """Events in four deliveries, each of them over the whole time: what a query with a delay of ten days drops."""
    path, kept = scratch_path(spark, "deliveries"), scratch_path(spark, "late")
    events = table(spark, sf_dir, "events")
    source = spark.readStream.schema(events.schema).option("recursiveFileLookup", True)
    for part in range(4):  # each run takes up where the one before ended
        events.filter(F.col("event_id") % 4 == part).write.parquet(f"{path}/{part}")
        out = live.audit(source.parquet(path), ["event_type"], "ts", "late", delay="10 days", path=kept)
    return out.select("event_type", F.unix_seconds("hour").alias("hour_s"), "reason", "n")


@query(
    "st14_live_gauge",
    """SELECT user_id, event_id, (sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS active FROM events""",
)
def st14(spark, sf_dir):
    kind = F.col("event_type")
    changes = events_stream(spark, sf_dir).select(
        "user_id", "ts", "event_id", F.when(kind == "signup", 1).when(kind == "error", -1).otherwise(0).alias("delta")
    )
    return live.run_available(live.active_sessions(changes, ["user_id"], "ts", "event_id"), "gauge")


@query(
    "st15_directory_ingest",
    f"SELECT doc_id, len({sql.words('text')}) AS n_words FROM documents",
)
def st15(spark, sf_dir):
    source = live.read_table_stream(spark, sf_dir, "documents.parquet", table(spark, sf_dir, "documents").schema)
    score = lambda rows: rows.select("doc_id", F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
    return live.ingest(source, score, "ingest", keys=["doc_id"])


@query(
    "st05_live_windows",
    """WITH h AS (SELECT user_id, event_id % 10 AS samples, epoch_us(ts) // 21600000000 AS step FROM events),
s AS (SELECT user_id, samples, unnest([step, step + 1]) AS last FROM h)
SELECT user_id, (last + 1) * 21600 AS window_end_s, sum(samples)::BIGINT AS samples FROM s
WHERE (last + 1) * 21600 <= (SELECT max(epoch_us(ts)) / 1e6 FROM events) GROUP BY 1, 2""",
)
def st05(spark, sf_dir):
    chunks = events_stream(spark, sf_dir).select("user_id", "ts", (F.col("event_id") % 10).alias("samples"))
    windows = live.decode_windows(chunks, ["user_id"], "ts", window="12 hours", stride="6 hours", delay="0 seconds")
    shown = windows.select("user_id", F.unix_seconds("window.end").alias("window_end_s"), "samples")
    return live.run_available(shown, "decode-windows")


@query("st09_live_settle", SETTLED)
def st09(spark, sf_dir):
    listing = polls(spark, sf_dir)
    path = scratch_path(spark, "listings")
    listing.write.parquet(path)
    stream = live.read_table_stream(spark, path, "*.parquet", listing.schema)
    return live.run_available(live.settled_files(stream, "ts", settle_polls=1), "settled")
