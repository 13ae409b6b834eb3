"""Service telemetry: histograms, counters, rates, quantiles, alerts and sessions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.functions.predicates import is_counted_partial
from voxlake.operators.joins import safe_join
from voxlake.operators.scans import micros, scan
from voxlake.operators.spans import Limit, greedy_spans
from voxlake.operators.windows import sustained
from voxlake.session import materialize

# Default histogram bounds in seconds.
DEFAULT_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def label_key(labels: Column) -> Column:
    """Identity of a label map: its entries in name order."""
    entries = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(entries, ",")


def cumulative_histogram(
    observations: DataFrame, keys: list[str], value: Column, bounds: list[float] | None = None
) -> DataFrame:
    """Per series: observations at or below each bound (``counts``), their sum and number.

    One conditional count per bound inside a single aggregation, combined before the shuffle.
    """
    bounds = sorted(set(bounds or DEFAULT_BUCKETS))
    return observations.groupBy(*keys).agg(
        F.array(*[F.count_if(value <= b) for b in bounds]).alias("counts"),
        F.sum(value).alias("sum"),
        F.count(value).alias("count"),
    )


def histogram_rows(histogram: DataFrame, keys: list[str], bounds: list[float] | None = None) -> DataFrame:
    """A histogram as one row per bound, ``+Inf`` last."""
    bounds = sorted(set(bounds or DEFAULT_BUCKETS))
    labels = F.array(*[F.lit(str(b)) for b in bounds], F.lit("+Inf"))
    cells = F.arrays_zip(labels.alias("le"), F.array_append("counts", F.col("count")).alias("n"))
    return histogram.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.le", "_c.n")


def histogram_quantile(q: float, counts: Column, total: Column, bounds: list[float] | None = None) -> Column:
    """Quantile of a cumulative histogram, linear inside its bucket; the largest bound if it lies beyond."""
    bounds = sorted(set(bounds or DEFAULT_BUCKETS))
    rank = total * F.lit(q)
    out = F.when(total == 0, F.lit(None).cast("double"))
    for i, upper in enumerate(bounds):
        n = F.get(counts, F.lit(i))
        lower = bounds[i - 1] if i else 0.0
        before = F.get(counts, F.lit(i - 1)) if i else F.lit(0)
        inside = F.lit(lower) + (upper - lower) * (rank - before) / (n - before)
        value = F.lit(upper) if i == 0 and upper <= 0 else F.when(n == before, F.lit(lower)).otherwise(inside)
        out = out.when(n >= rank, value)
    return out.otherwise(F.lit(bounds[-1]))


def counter_totals(increments: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of counter increments per series."""
    return increments.groupBy(*keys).agg(F.sum("delta").alias("total"))


def gauge_values(changes: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Gauge per series: its last set value plus the increments after it. ``op`` is ``set`` or ``inc``."""
    placed = changes.withColumn("_at", order)
    last = placed.filter(F.col("op") == "set").groupBy(*keys).agg(F.max(F.struct("_at", "value")).alias("_set"))
    joined = safe_join(placed, last, keys, "left")
    later = (F.col("op") == "inc") & (F.col("_set").isNull() | (F.col("_at") > F.col("_set._at")))
    sums = joined.groupBy(*keys).agg(
        F.max("_set.value").alias("_base"), F.coalesce(F.sum(F.when(later, F.col("value"))), F.lit(0)).alias("_added")
    )
    return sums.select(*keys, (F.coalesce("_base", F.lit(0)) + F.col("_added")).alias("value"))


def windowed_sums(
    df: DataFrame, keys: list[str], second: Column, sums: dict[str, Column], *, window_s: int, step_s: int
) -> DataFrame:
    """Sums over the windows ``[eval_s - window_s, eval_s)`` that end at whole steps, one row per window that saw a row.

    Rows are summed per unit first, the common divisor of window and step, so that a window is covered exactly. Only those
    few rows are copied into the windows that cover them.
    """
    unit = math.gcd(window_s, step_s)
    per_unit = df.groupBy(*keys, F.floor(second / unit).alias("_unit")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    # A window that ends at step k covers the unit if k * step_s lies behind it and at most a window away.
    first = F.floor(F.col("_unit") * unit / step_s) + 1
    last = F.floor((F.col("_unit") * unit + window_s) / step_s)
    spread = per_unit.filter(first <= last).withColumn("_end", F.explode(F.sequence(first, last)))
    summed = spread.groupBy(*keys, "_end").agg(*[F.sum(n).alias(n) for n in sums])
    return summed.select(*keys, (F.col("_end") * step_s).alias("eval_s"), *sums)


def seconds_of(ts: Column) -> Column:
    """Whole epoch seconds of a zoneless timestamp."""
    return F.floor(micros(ts) / 1_000_000)


def event_rate(events: DataFrame, keys: list[str], *, window_s: int, step_s: int) -> DataFrame:
    """Events per second over a sliding window."""
    sums = windowed_sums(events, keys, seconds_of(F.col("ts")), {"n": F.lit(1)}, window_s=window_s, step_s=step_s)
    return sums.withColumn("rate", F.col("n") / float(window_s))


def counter_rate(
    samples: DataFrame, keys: list[str], order: list[str], block: Column, *, window_s: int, step_s: int, cents: int = 100
) -> DataFrame:
    """Rate of a sampled counter; a drop counts as a restart from zero.

    Increases are summed as integers of ``1 / cents`` so that the sum does not depend on its order.
    """
    looked = scan(samples, keys, order, block, lags={"_prev": F.col("value")})
    grown = F.when(F.col("value") >= F.col("_prev"), F.col("value") - F.col("_prev")).otherwise(F.col("value"))
    rows = looked.filter(F.col("_prev").isNotNull()).withColumn("_grown", F.round(grown * cents).cast("bigint"))
    sums = windowed_sums(rows, keys, seconds_of(F.col("ts")), {"increase": F.col("_grown")}, window_s=window_s, step_s=step_s)
    increase = F.col("increase") / float(cents)
    return sums.withColumns({"increase": increase, "rate": increase / float(window_s)})


def error_ratio(requests: DataFrame, keys: list[str], *, window_s: int, step_s: int) -> DataFrame:
    """Share of 5xx answers over a sliding window."""
    failed = (F.col("status") >= 500).cast("int")
    sums = windowed_sums(
        requests, keys, seconds_of(F.col("ts")), {"errors": failed, "total": F.lit(1)}, window_s=window_s, step_s=step_s
    )
    return sums.withColumn("ratio", F.col("errors") / F.col("total"))


def error_alerts(
    requests: DataFrame, keys: list[str], *, window_s: int, step_s: int, above: float, for_seconds: int
) -> DataFrame:
    """Evaluations of the error ratio with ``firing`` and, once it has held, ``alert``."""
    ratios = error_ratio(requests, keys, window_s=window_s, step_s=step_s)
    group = keys or ["_all"]
    rated = ratios if keys else ratios.withColumn("_all", F.lit(0))
    firing = materialize(rated.withColumn("firing", F.col("ratio") > above), "evaluations")
    out = sustained(firing, group, for_seconds=for_seconds, block_s=step_s * 4096, step_s=step_s)
    return out.select(*keys, "eval_s", "errors", "total", "firing", "alert")


def pool_alerts(
    samples: DataFrame, keys: list[str], *, for_seconds: int, ts: str = "eval_s", step_s: int | None = None
) -> DataFrame:
    """Pool exhaustion: no session available at every sample for ``for_seconds``."""
    return sustained(samples.withColumn("firing", F.col("available") == 0), keys, for_seconds=for_seconds, ts=ts, step_s=step_s)


def timeout_alerts(
    events: DataFrame, keys: list[str], *, window_s: int, step_s: int, above: float, for_seconds: int
) -> DataFrame:
    """Sustained rate of timeout events above a threshold per second."""
    rates = event_rate(events, keys, window_s=window_s, step_s=step_s)
    firing = materialize(rates.withColumn("firing", F.col("rate") > above), "timeout-rates")
    return sustained(firing, keys, for_seconds=for_seconds, block_s=step_s * 4096, step_s=step_s)


def active_sessions(changes: DataFrame, keys: list[str], *, block_s: int = 86_400) -> DataFrame:
    """Running number of open sessions; deltas are summed per second before the scan."""
    group = keys or ["_all"]
    rows = changes if keys else changes.withColumn("_all", F.lit(0))
    per_second = rows.groupBy(*group, seconds_of(F.col("ts")).alias("second")).agg(F.sum("delta").alias("delta"))
    out = scan(per_second, group, ["second"], F.floor(F.col("second") / block_s), sums={"active": F.col("delta")})
    return out.select(*keys, "second", "active")


def capped_sessions(
    events: DataFrame, keys: list[str], row_id: str, *, idle_s: float, cap_s: float, block_s: int = 86_400
) -> DataFrame:
    """Sessions that end after ``idle_s`` without an event, or ``cap_s`` after they began."""
    timed = events.select(*keys, row_id, (micros(F.col("ts")) / 1_000_000).alias("_t"))
    block = F.floor(F.col("_t") / block_s)
    numbered = scan(timed, keys, ["_t", row_id], block, row_number="_pos", lags={"_prev": F.col("_t")})
    spans = greedy_spans(
        numbered,
        keys,
        "_pos",
        F.floor(F.col("_pos") / 65_536),
        [Limit("_t", "_t", cap_s)],
        forced=F.col("_prev").isNull() | (F.col("_t") - F.col("_prev") > idle_s),
        span="_session",
    )
    sessions = spans.groupBy(*keys, "_session").agg(
        F.min(row_id).alias("first_event"),
        F.count(F.lit(1)).alias("events"),
        F.min("_t").alias("_from"),
        F.max("_t").alias("_to"),
    )
    return sessions.select(*keys, "first_event", "events", (F.col("_to") - F.col("_from")).alias("seconds"))


def session_latency(
    messages: DataFrame, keys: list[str], order: list[str], block: Column, *, onset_s: Column | None = None
) -> DataFrame:
    """Latencies of each session in milliseconds from messages ``t_ms, type, text``.

    ``send`` rows are audio going out. Time to the first counted partial, its distance to the speech onset (null
    if negative), the last final, and the lag of every counted partial behind the send before it, as a sum, a
    maximum and a count; the lags themselves are ``partial_lags``.
    """
    lags = partial_lags(messages, keys, order, block)
    counted = is_counted_partial(F.col("type"), F.col("text"))
    times = messages.groupBy(*keys).agg(
        F.min(F.when(F.col("type") == "send", F.col("t_ms"))).alias("_started"),
        F.min(F.when(counted, F.col("t_ms"))).alias("_first_partial"),
        F.max(F.when(F.col("type") == "final", F.col("t_ms"))).alias("_final"),
        F.count_if((F.col("type") == "partial") & ~counted).alias("empty_partials"),
    )
    per_session = lags.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lags"), F.max("lag_ms").alias("max_lag_ms"))
    joined = safe_join(times, per_session, keys, "left")
    ttfp = F.col("_first_partial") - F.col("_started")
    ttfs = ttfp - (F.lit(0.0) if onset_s is None else onset_s * 1000.0)
    return joined.select(
        *keys,
        ttfp.alias("ttfp_ms"),
        F.when(ttfs >= 0, ttfs).alias("ttfs_ms"),
        (F.col("_final") - F.col("_started")).alias("finalization_lag_ms"),
        "empty_partials",
        F.coalesce("n_lags", F.lit(0)).alias("n_lags"),
        "max_lag_ms",
        F.col("_first_partial").isNull().alias("no_partial"),
    )


def partial_lags(messages: DataFrame, keys: list[str], order: list[str], block: Column) -> DataFrame:
    """Lag of every counted partial behind the latest send."""
    sent = scan(messages, keys, order, block, lasts={"_sent": F.when(F.col("type") == "send", F.col("t_ms"))})
    counted = sent.filter(is_counted_partial(F.col("type"), F.col("text")) & F.col("_sent").isNotNull())
    return counted.select(*keys, (F.col("t_ms") - F.col("_sent")).alias("lag_ms"))


def store_occupancy(jobs: DataFrame, *, max_jobs: int, max_bytes: int) -> DataFrame:
    """Live jobs and resident body bytes against their caps."""
    sums = jobs.agg(F.count(F.lit(1)).alias("jobs"), F.coalesce(F.sum("body_bytes"), F.lit(0)).cast("bigint").alias("body_bytes"))
    return sums.withColumn("at_capacity", (F.col("jobs") >= max_jobs) | (F.col("body_bytes") >= max_bytes))


def live_jobs(jobs: DataFrame, *, now_us: Column, ttl_seconds: int) -> DataFrame:
    """Jobs that have not expired: terminal ones go after their time to live; zero keeps them."""
    if ttl_seconds == 0:
        return jobs
    terminal = F.col("status").isin("done", "failed", "cancelled")
    return jobs.filter(~(terminal & (now_us - F.col("updated_us") > ttl_seconds * 1_000_000)))


def oldest_queued(jobs: DataFrame) -> DataFrame:
    """The queued job that was enqueued first."""
    return jobs.filter(F.col("status") == "queued").agg(F.min_by("job_id", F.struct("enqueued_us", "job_id")).alias("job_id"))
