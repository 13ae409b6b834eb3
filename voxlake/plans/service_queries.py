"""Queries over service telemetry, jobs and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.functions import predicates, timing
from voxlake.operators import folds, telemetry
from voxlake.operators.scans import micros, range_blocks, time_block
from voxlake.plans.registry import query
from voxlake.plans.relations import DAY, job_events, requests, table

HOUR = 3600
BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
_BOUND_LIST = "[1e0, 5e0, 10e0, 25e0, 50e0, 100e0, 250e0]"


@query(
    "ag16_cumulative_histogram",
    f"""WITH b AS (SELECT unnest({_BOUND_LIST}) AS b, unnest(['1.0', '5.0', '10.0', '25.0', '50.0', '100.0', '250.0']) AS le
  UNION ALL SELECT 1e300, '+Inf')
SELECT 'path=' || event_type || ',status=' || CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS series, le, count_if(value <= b) AS n
FROM events, b GROUP BY ALL""",
)
def ag16(spark, sf_dir):
    labels = F.create_map(F.lit("status"), F.col("status").cast("string"), F.lit("path"), F.col("path"))
    rows = requests(spark, sf_dir).withColumn("series", telemetry.label_key(labels))
    histogram = telemetry.cumulative_histogram(rows, ["series"], F.col("duration_s"), BOUNDS)
    return telemetry.histogram_rows(histogram, ["series"], BOUNDS)


@query(
    "ag17_counter_totals",
    "SELECT 'path=' || event_type || ',user=' || user_id % 10 AS series, sum(event_id % 3)::BIGINT AS total FROM events GROUP BY 1",
)
def ag17(spark, sf_dir):
    user = (F.col("user_id") % 10).cast("string")
    a = F.create_map(F.lit("user"), user, F.lit("path"), F.col("event_type"))
    b = F.create_map(F.lit("path"), F.col("event_type"), F.lit("user"), user)
    labels = F.when(F.col("event_id") % 2 == 0, a).otherwise(b)
    rows = table(spark, sf_dir, "events").select(telemetry.label_key(labels).alias("series"), (F.col("event_id") % 3).alias("delta"))
    return telemetry.counter_totals(rows, ["series"])


@query(
    "ag17_gauge_values",
    """WITH g AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 'set' ELSE 'inc' END AS op, event_id % 7 - 3 AS v FROM events),
l AS (SELECT user_id, max(event_id) AS at FROM g WHERE op = 'set' GROUP BY 1)
SELECT g.user_id, (coalesce(sum(CASE WHEN g.event_id = l.at THEN v END), 0) + coalesce(sum(CASE WHEN op = 'inc' AND g.event_id > coalesce(l.at, -1)
  THEN v END), 0))::BIGINT AS value FROM g LEFT JOIN l USING (user_id) GROUP BY 1""",
)
def ag17_gauge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "user_id",
        "event_id",
        F.when(F.col("event_type") == "purchase", "set").otherwise("inc").alias("op"),
        (F.col("event_id") % 7 - 3).alias("value"),
    )
    return telemetry.gauge_values(rows, ["user_id"], F.col("event_id"))


_WINDOWS = """steps AS (SELECT {keys}, epoch_us(ts) // 1000000 // {step} AS step, {sums} FROM {source} GROUP BY {by}),
spread AS (SELECT *, unnest(range(step, step + {cover})) AS last FROM steps)"""


@query(
    "st11_event_rate",
    f"""WITH {_WINDOWS.format(keys='event_type', step=HOUR, sums='count(*) AS n', source='events', by='1, 2', cover=6)}
SELECT event_type AS path, (last + 1) * 3600 AS eval_s, sum(n)::BIGINT AS n, sum(n)::BIGINT / 21600e0 AS rate FROM spread GROUP BY 1, 2""",
)
def st11(spark, sf_dir):
    return telemetry.event_rate(requests(spark, sf_dir), ["path"], window_s=6 * HOUR, step_s=HOUR)


@query(
    "st11_counter_rate",
    f"""WITH l AS (SELECT user_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
d AS (SELECT user_id, ts, round((CASE WHEN value >= p THEN value - p ELSE value END) * 100)::BIGINT AS g FROM l WHERE p IS NOT NULL),
{_WINDOWS.format(keys='user_id', step=DAY, sums='sum(g) AS g', source='d', by='1, 2', cover=3)}
SELECT user_id, (last + 1) * 86400 AS eval_s, sum(g)::BIGINT / 100e0 AS increase, sum(g)::BIGINT / 100e0 / 259200e0 AS rate FROM spread GROUP BY 1, 2""",
)
def st11_counter(spark, sf_dir):
    samples = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return telemetry.counter_rate(
        samples, ["user_id"], ["ts", "event_id"], time_block("ts", DAY), window_s=3 * DAY, step_s=DAY
    )


_RATIO = _WINDOWS.format(
    keys="1 AS one", step=HOUR, sums="count_if(event_type = 'error') AS e, count(*) AS t", source="events", by="2", cover=3
)
_ALERTS = f"""{_RATIO},
evals AS (SELECT (last + 1) * 3600 AS eval_s, sum(e)::BIGINT AS errors, sum(t)::BIGINT AS total, sum(e)::DOUBLE / sum(t) > 22e-2 AS firing
  FROM spread GROUP BY 1),
m AS (SELECT *, CASE WHEN firing IS DISTINCT FROM lag(firing) OVER (ORDER BY eval_s) OR eval_s - lag(eval_s) OVER (ORDER BY eval_s) > 3600 THEN 1 ELSE 0 END AS b FROM evals),
i AS (SELECT *, sum(b) OVER (ORDER BY eval_s) AS g FROM m)"""


@query(
    "st12_wn15_error_alerts",
    f"""WITH {_ALERTS} SELECT eval_s, errors, total, firing, firing AND eval_s - min(eval_s) OVER (PARTITION BY g) >= 7200 AS alert FROM i""",
)
def st12(spark, sf_dir):
    return telemetry.error_alerts(
        requests(spark, sf_dir), [], window_s=3 * HOUR, step_s=HOUR, above=0.22, for_seconds=2 * HOUR
    )


@query(
    "st13_histogram_quantile",
    f"""WITH b AS (SELECT unnest(range(7)) AS i, unnest({_BOUND_LIST}) AS b, unnest([0e0, 1e0, 5e0, 10e0, 25e0, 50e0, 100e0]) AS lo),
c AS (SELECT event_type, i, b, lo, count_if(value <= b) AS n, count(value) AS total FROM events, b GROUP BY ALL),
d AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY event_type ORDER BY i), 0) AS p FROM c),
q AS (SELECT event_type, q, i, total, lo + (b - lo) * (total * q - p) / (n - p) AS v FROM d, (VALUES (5e-1), (95e-2), (99e-2)) t(q)
  WHERE n >= total * q AND p < total * q)
SELECT e.event_type AS path, round(coalesce(max(CASE WHEN q = 5e-1 THEN v END), 250e0), 6) AS p50,
  round(coalesce(max(CASE WHEN q = 95e-2 THEN v END), 250e0), 6) AS p95, round(coalesce(max(CASE WHEN q = 99e-2 THEN v END), 250e0), 6) AS p99
FROM (SELECT DISTINCT event_type FROM events) e LEFT JOIN q ON q.event_type = e.event_type GROUP BY 1""",
)
def st13(spark, sf_dir):
    histogram = telemetry.cumulative_histogram(requests(spark, sf_dir), ["path"], F.col("duration_s"), BOUNDS)
    at = {
        name: F.round(telemetry.histogram_quantile(q, F.col("counts"), F.col("count"), BOUNDS), 6).alias(name)
        for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))
    }
    return histogram.select("path", *at.values())


@query(
    "st14_active_sessions",
    """WITH d AS (SELECT epoch_us(ts) // 1000000 AS second, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) AS d FROM events GROUP BY 1)
SELECT second, (sum(d) OVER (ORDER BY second))::BIGINT AS active FROM d""",
)
def st14(spark, sf_dir):
    kind = F.col("event_type")
    changes = table(spark, sf_dir, "events").select(
        "ts", F.when(kind == "signup", 1).when(kind == "error", -1).otherwise(0).alias("delta")
    )
    return telemetry.active_sessions(changes, [])


@query(
    "st10_capped_sessions",
    """WITH RECURSIVE n AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER w AS pos,
  lag(epoch_us(ts) / 1e6) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
walk AS (SELECT user_id, pos, pos AS s, t AS s0 FROM n WHERE pos = 1
  UNION ALL SELECT n.user_id, n.pos, CASE WHEN n.t - n.p > 43200 OR n.t - w.s0 > 86400 THEN n.pos ELSE w.s END,
  CASE WHEN n.t - n.p > 43200 OR n.t - w.s0 > 86400 THEN n.t ELSE w.s0 END FROM walk w JOIN n ON n.user_id = w.user_id AND n.pos = w.pos + 1)
SELECT w.user_id, min(event_id) AS first_event, count(*) AS events, round(max(t) - min(t), 3) AS seconds
FROM walk w JOIN n ON n.user_id = w.user_id AND n.pos = w.pos GROUP BY w.user_id, w.s""",
)
def st10(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    out = telemetry.capped_sessions(events, ["user_id"], "event_id", idle_s=12 * HOUR, cap_s=DAY)
    return out.withColumn("seconds", F.round("seconds", 3))


def messages(spark, sf_dir) -> DataFrame:
    """Events as session messages: clicks send, views and errors are partials (errors empty), purchases finals."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "user_id",
        "event_id",
        "ts",
        F.floor(micros(F.col("ts")) / 1000).alias("t_ms"),
        F.when(kind == "click", "send").when(kind.isin("view", "error"), "partial").when(kind == "purchase", "final").otherwise("ready").alias("type"),
        F.when(kind == "error", " ").otherwise(kind).alias("text"),
    )


_MESSAGES = """m AS (SELECT user_id, event_id, ts, epoch_us(ts) // 1000 AS t, event_type AS k,
  last_value(CASE WHEN event_type = 'click' THEN epoch_us(ts) // 1000 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sent FROM events)"""


@query(
    "st08_session_latency",
    f"""WITH {_MESSAGES}, s AS (SELECT user_id, min(CASE WHEN k = 'click' THEN t END) AS st, min(CASE WHEN k = 'view' THEN t END) AS fp,
  max(CASE WHEN k = 'purchase' THEN t END) AS fin, count_if(k = 'error') AS empty_partials, count_if(k = 'view' AND sent IS NOT NULL) AS n_lags,
  max(CASE WHEN k = 'view' THEN t - sent END) AS max_lag_ms FROM m GROUP BY 1)
SELECT user_id, (fp - st)::DOUBLE AS ttfp_ms, CASE WHEN fp - st - 36e5 >= 0 THEN fp - st - 36e5 END AS ttfs_ms, (fin - st)::DOUBLE AS finalization_lag_ms,
  empty_partials, n_lags, max_lag_ms, fp IS NULL AS no_partial FROM s""",
)
def st08(spark, sf_dir):
    rows, block = range_blocks(messages(spark, sf_dir), ["user_id"], ["ts", "event_id"])
    out = telemetry.session_latency(rows, ["user_id"], ["ts", "event_id"], block, onset_s=F.lit(3600.0))
    return out.withColumns({c: F.col(c).cast("double") for c in ("ttfp_ms", "finalization_lag_ms")})


@query(
    "fl05_counted_partials",
    "SELECT event_id FROM events WHERE event_type = 'view'",
)
def fl05(spark, sf_dir):
    rows = messages(spark, sf_dir)
    return rows.filter(predicates.is_counted_partial(F.col("type"), F.col("text"))).select("event_id")


@query(
    "fl09_client_identity",
    """WITH h AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN '10.0.0.' || user_id % 200 WHEN 1 THEN '8.8.4.' || user_id % 200 WHEN 2 THEN '127.0.0.1' ELSE 'fd12::1' END AS peer,
  CASE event_id % 3 WHEN 0 THEN '203.0.113.' || event_id % 250 || ', 10.1.1.1' WHEN 1 THEN 'unknown' END AS fwd,
  CASE event_id % 2 WHEN 0 THEN '198.51.100.' || event_id % 250 ELSE 'bad' END AS real FROM events)
SELECT event_id, CASE WHEN peer LIKE '8.%' THEN peer WHEN fwd LIKE '203%' THEN string_split(fwd, ',')[1] WHEN real <> 'bad' THEN real ELSE peer END AS client FROM h""",
)
def fl09(spark, sf_dir):
    user, event = F.col("user_id"), F.col("event_id")
    peer = (
        F.when(user % 4 == 0, F.concat(F.lit("10.0.0."), user % 200))
        .when(user % 4 == 1, F.concat(F.lit("8.8.4."), user % 200))
        .when(user % 4 == 2, "127.0.0.1")
        .otherwise("fd12::1")
    )
    forwarded = F.when(event % 3 == 0, F.concat(F.lit("203.0.113."), event % 250, F.lit(", 10.1.1.1"))).when(event % 3 == 1, "unknown")
    real = F.when(event % 2 == 0, F.concat(F.lit("198.51.100."), event % 250)).otherwise("bad")
    return table(spark, sf_dir, "events").select("event_id", predicates.client_identity(peer, forwarded, real).alias("client"))


@query(
    "fl10_failure_classes",
    """SELECT event_id, user_id % 4 = 0 AS retryable, CASE user_id % 4 WHEN 1 THEN 'Inference timed out.' WHEN 2 THEN 'Failed to decode audio file. Check format.'
  WHEN 3 THEN 'Audio too long: ' || event_id || 's exceeds the maximum of 600s.' ELSE 'Transcription failed.' END AS public FROM events WHERE event_type = 'error'""",
)
def fl10(spark, sf_dir):
    user = F.col("user_id") % 4
    message = (
        F.when(user == 0, "worker panicked at 'index out of bounds'")
        .when(user == 1, "inference_timeout after 30s")
        .when(user == 2, "Invalid audio: bad header")
        .otherwise(F.concat(F.lit("Audio too long: "), F.col("event_id"), F.lit("s exceeds the maximum of 600s.")))
    )
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'").withColumn("m", message)
    return rows.select("event_id", predicates.is_retryable(F.col("m")).alias("retryable"), predicates.public_error(F.col("m")).alias("public"))


@query(
    "st06_rate_limit",
    """WITH RECURSIVE n AS (SELECT user_id, event_id, epoch_us(ts) / 500000e0 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
walk AS (SELECT user_id, pos, event_id, t, 1e0 AS tokens, true AS allowed FROM n WHERE pos = 1
  UNION ALL SELECT x.user_id, x.pos, x.event_id, x.t, CASE WHEN x.have >= 1e0 THEN x.have - 1e0 ELSE x.have END, x.have >= 1e0
  FROM (SELECT n.*, least(w.tokens + (n.t - w.t) * (1e0 / 60000e0), 2e0) AS have FROM walk w JOIN n ON n.user_id = w.user_id AND n.pos = w.pos + 1) x)
SELECT user_id, event_id, allowed FROM walk""",
)
def st06(spark, sf_dir):
    # The events of one user are hours apart, so the clock runs 500 times slower to make one request a minute a limit.
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return folds.rate_limit(rows, "user_id", "event_id", micros(F.col("ts")) / 500_000.0, rpm=1, burst=2)


@query(
    "st07_job_lifecycle",
    """WITH l AS (SELECT l_orderkey, count(*) AS attempts, sum(l_quantity) AS processed FROM lineitem GROUP BY 1)
SELECT o_orderkey AS job_id, CASE WHEN attempts IS NULL THEN 'queued' WHEN o_orderstatus = 'F' THEN 'done'
  WHEN o_orderstatus = 'P' AND attempts <= 2 THEN 'queued' WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'processing' END AS status,
  coalesce(attempts, 0)::INT AS attempts, coalesce(processed, 0) AS processed_seconds FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
)
def st07(spark, sf_dir):
    return folds.job_states(job_events(spark, sf_dir)).select("job_id", "status", "attempts", "processed_seconds")


_JOBS = """j AS (SELECT o_orderkey AS job_id, o_orderdate AS enq, CASE WHEN n IS NULL THEN 'queued' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' AND n <= 2 THEN 'queued'
  WHEN o_orderstatus = 'P' THEN 'failed' WHEN n IS NULL THEN 'queued' ELSE 'processing' END AS status, round(o_totalprice)::BIGINT AS body
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


@query("tk06_oldest_queued", f"WITH {_JOBS} SELECT job_id FROM j WHERE status = 'queued' ORDER BY enq, job_id LIMIT 1")
def tk06(spark, sf_dir):
    events = job_events(spark, sf_dir)
    enqueued = events.filter("event = 'submit'").select("job_id", micros(F.col("ts")).alias("enqueued_us"))
    return telemetry.oldest_queued(folds.job_states(events).join(enqueued, "job_id"))


@query(
    "ag21_store_occupancy",
    f"""WITH {_JOBS} SELECT count(*) AS jobs, sum(CASE WHEN status IN ('queued', 'processing') THEN body ELSE 0 END)::BIGINT AS body_bytes,
  count(*) >= 1000000 OR sum(CASE WHEN status IN ('queued', 'processing') THEN body ELSE 0 END) >= 500000000 AS at_capacity FROM j""",
)
def ag21(spark, sf_dir):
    return telemetry.store_occupancy(folds.job_states(job_events(spark, sf_dir)), max_jobs=1_000_000, max_bytes=500_000_000)


@query(
    "tx28_job_percent",
    """WITH l AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE trunc(q / (o_totalprice / 1000) * 100)::INT END AS percent FROM orders JOIN l ON l_orderkey = o_orderkey""",
)
def tx28(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    total = F.when(F.col("o_orderstatus") == "O", 0.0).otherwise(F.col("o_totalprice") / 1000)
    rows = table(spark, sf_dir, "orders").join(lines, "o_orderkey")
    return rows.select(F.col("o_orderkey").alias("job_id"), timing.job_percent(F.col("q"), total).alias("percent"))


def _decodes(spark, sf_dir) -> DataFrame:
    """Conversation turns as live decodes of a session."""
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        "text",
        (F.col("turn") % 3 == 1).alias("over_cap"),
        F.lit(False).alias("blank"),
        (F.col("turn") % 4 == 3).alias("vad"),
    )


_TRIM = "trim(text, ' ' || chr(9) || chr(10) || chr(13))"


@query(
    "st03_st04_assembler",
    f"""WITH RECURSIVE t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, {_TRIM} AS live, turn % 3 = 1 AS cap, turn % 4 = 3 AS vad FROM conversations),
walk AS (SELECT conv_id, turn, n, live AS full_text, vad, CASE WHEN vad THEN '' WHEN cap THEN live ELSE '' END AS kept FROM t WHERE n = 1
  UNION ALL SELECT t.conv_id, t.turn, t.n, trim(w.kept || ' ' || t.live), t.vad, CASE WHEN t.vad THEN '' WHEN t.cap THEN trim(w.kept || ' ' || t.live) ELSE w.kept END
  FROM walk w JOIN t ON t.conv_id = w.conv_id AND t.n = w.n + 1)
SELECT conv_id, turn, CASE WHEN vad THEN 'final' ELSE 'partial' END AS type, md5(full_text) AS digest, CASE WHEN vad THEN 'vad' END AS endpoint_reason FROM walk WHERE full_text <> ''""",
)
def st03(spark, sf_dir):
    fold = folds.Assembler("auto", vad_attached=True)
    out = folds.assemble(_decodes(spark, sf_dir), ["conv_id"], ["turn"], "turn", fold, block=F.floor(F.col("turn") / 1024))
    return out.select("conv_id", "turn", "type", F.md5("text").alias("digest"), "endpoint_reason")


@query(
    "st05_stride_gate",
    """WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) * 20 AS samples, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
walk AS (SELECT conv_id, turn, n, 0::BIGINT AS ws, samples AS held, samples AS pending FROM c WHERE n = 1
  UNION ALL SELECT c.conv_id, c.turn, c.n, w.ws + CASE WHEN w.held >= 40000 THEN w.held - 24000 ELSE 0 END,
  CASE WHEN w.held >= 40000 THEN 24000 ELSE w.held END + c.samples,
  CASE WHEN w.pending >= 12800 OR w.held >= 40000 THEN 0 ELSE w.pending END + c.samples
  FROM walk w JOIN c ON c.conv_id = w.conv_id AND c.n = w.n + 1)
SELECT conv_id, turn, ws AS window_start, held AS window_samples, held >= 40000 AS over_cap FROM walk WHERE pending >= 12800 OR held >= 40000""",
)
def st05(spark, sf_dir):
    chunks = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") * 20).alias("samples"))
    return folds.decode_steps(chunks, ["conv_id"], ["turn"], "turn", folds.StrideGate())


_POLLS = f"""polls AS (SELECT '/in/' || o_custkey || '.wav' AS path, epoch_us(o_orderdate) // {DAY * 1_000_000} AS poll, max(length(o_orderpriority)) AS size FROM orders GROUP BY 1, 2)"""
SETTLED = f"""WITH {_POLLS}, l AS (SELECT *, lag(poll) OVER w AS pp, lag(size) OVER w AS ps FROM polls WINDOW w AS (PARTITION BY path ORDER BY poll))
SELECT path, min(poll) AS scheduled_poll FROM l WHERE pp = poll - 1 AND ps = size GROUP BY 1"""


def polls(spark, sf_dir) -> DataFrame:
    """Each customer is a file, each day with an order a poll that sees the longest priority as its size."""
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("/in/"), F.col("o_custkey"), F.lit(".wav")).alias("path"),
        F.floor(micros(F.col("o_orderdate")) / (DAY * 1_000_000)).alias("poll"),
        F.col("o_orderdate").alias("ts"),
        F.length("o_orderpriority").cast("bigint").alias("size"),
    )
    seen = orders.groupBy("path", "poll").agg(F.max("ts").alias("ts"), F.max("size").alias("size"))
    return seen.withColumns({"kind": F.lit("seen"), "mtime": F.lit(0).cast("bigint")})


@query("st09_settled_files", SETTLED)
def st09(spark, sf_dir):
    return folds.settled_files(polls(spark, sf_dir), settle_polls=1)


_ISLANDS = """m AS (SELECT *, CASE WHEN firing IS DISTINCT FROM lag(firing) OVER (PARTITION BY path ORDER BY eval_s)
  OR eval_s - lag(eval_s) OVER (PARTITION BY path ORDER BY eval_s) > 3600 THEN 1 ELSE 0 END AS b FROM evals),
i AS (SELECT *, sum(b) OVER (PARTITION BY path ORDER BY eval_s) AS g FROM m)"""


@query(
    "st12_pool_alerts",
    f"""WITH evals AS (SELECT event_type AS path, epoch_us(ts) // 3600000000 * 3600 AS eval_s, greatest(count(*) - 2, 0) AS available, count(*) <= 2 AS firing FROM events GROUP BY 1, 2),
{_ISLANDS} SELECT path, eval_s, available, firing, firing AND eval_s - min(eval_s) OVER (PARTITION BY path, g) >= 3600 AS alert FROM i""",
)
def st12_pool(spark, sf_dir):
    hour = (F.floor(telemetry.seconds_of(F.col("ts")) / HOUR) * HOUR).alias("eval_s")
    busy = requests(spark, sf_dir).groupBy("path", hour).agg(F.count(F.lit(1)).alias("n"))
    samples = busy.select("path", "eval_s", F.greatest(F.col("n") - 2, F.lit(0)).alias("available"))
    return telemetry.pool_alerts(samples, ["path"], for_seconds=HOUR, step_s=HOUR)


@query(
    "st12_timeout_alerts",
    f"""WITH {_WINDOWS.format(keys='event_type AS path', step=HOUR, sums='count(*) AS n', source='events', by='1, 2', cover=2)},
evals AS (SELECT path, (last + 1) * 3600 AS eval_s, sum(n)::BIGINT AS n, sum(n)::BIGINT / 7200e0 AS rate, sum(n)::BIGINT / 7200e0 > 8e-4 AS firing FROM spread GROUP BY 1, 2),
{_ISLANDS} SELECT path, eval_s, n, rate, firing, firing AND eval_s - min(eval_s) OVER (PARTITION BY path, g) >= 7200 AS alert FROM i""",
)
def st12_timeouts(spark, sf_dir):
    rows = requests(spark, sf_dir)
    return telemetry.timeout_alerts(rows, ["path"], window_s=2 * HOUR, step_s=HOUR, above=8e-4, for_seconds=2 * HOUR)
