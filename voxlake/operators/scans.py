"""Ordered scans over a key without putting a whole key in one task.

A window partitioned by recording sends every row of a recording to one task, and one recording (session, user,
series) may hold a third of all rows. These scans cut each key into blocks that follow the order, run the window
inside (key, block), reduce every block to one summary row, scan the summaries per key, and join the carried
values back. Rows are shuffled once on (key, block); only the summaries are ever grouped by key alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.session import materialize

BLOCK = "_block"
BLOCK_ROWS = 1 << 16


def index_block(index: str, rows: int = BLOCK_ROWS) -> Column:
    """Block number for a dense integer order."""
    return F.floor(F.col(index) / rows)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a zoneless timestamp, whatever the session's time zone."""
    since = ts - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (since.cast("interval second").cast("decimal(18,6)") * 1_000_000).cast("bigint")


def instant(ts: Column) -> Column:
    """A zoneless timestamp read as UTC, whatever the session's time zone."""
    return F.timestamp_micros(micros(ts))


def time_block(ts: str, seconds: int) -> Column:
    """Block number for a timestamp order."""
    return F.floor(micros(F.col(ts)) / (seconds * 1_000_000))


def range_blocks(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, Column]:
    """``df`` and a block number for scans along ``order``: the range partition of (keys, order) that a row falls into.

    The bounds are sampled from the data, so a block has a bounded share of the rows however they crowd in time.
    """
    dealt = df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id().cast("bigint"))
    return materialize(dealt, "ranges"), F.col("_range")


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    *,
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
    leads: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    totals: dict[str, tuple[Callable[[str], Column], Column]] | None = None,
    row_number: str | None = None,
) -> DataFrame:
    """Add running columns along ``order`` within ``keys``.

    ``sums`` and ``maxima`` include the current row. ``lags`` and ``leads`` look one row back and ahead.
    ``lasts`` is the latest non-null value up to and including the row. ``totals`` are (aggregate, value) over the
    whole key, such as ``(F.max, F.col("x"))``, which reach the rows by block and so need no join on the key.
    ``row_number`` counts from one.
    ``block`` must not decrease along ``order``.
    """
    sums, maxima, lags = dict(sums or {}), dict(maxima or {}), dict(lags or {})
    leads, lasts, totals = dict(leads or {}), dict(lasts or {}), dict(totals or {})
    if row_number:
        sums[row_number] = F.lit(1).cast("bigint")
    # A constant is not moved into the window's own sort, so inputs become columns first.
    inputs = {f"_in_{n}": c for d in (sums, maxima, lags, leads, lasts) for n, c in d.items()}
    inputs |= {f"_in_{n}": c for n, (_, c) in totals.items()}
    base = df.withColumns({BLOCK: block, **inputs})
    at = F.struct(*[F.col(c) for c in order])

    summary = {}
    for n in sums:
        summary[f"_s_{n}"] = F.sum(F.col(f"_in_{n}"))
    for n in maxima:
        summary[f"_s_{n}"] = F.max(F.col(f"_in_{n}"))
    if lags:
        summary["_s_tail"] = F.max(F.struct(at.alias("at"), F.struct(*[F.col(f"_in_{n}").alias(n) for n in lags]).alias("v")))
    if leads:
        summary["_s_head"] = F.min(F.struct(at.alias("at"), F.struct(*[F.col(f"_in_{n}").alias(n) for n in leads]).alias("v")))
    for n in lasts:
        value = F.col(f"_in_{n}")
        summary[f"_s_{n}"] = F.max(F.when(value.isNotNull(), F.struct(at.alias("at"), value.alias("v"))))
    for n, (aggregate, _) in totals.items():
        summary[f"_s_{n}"] = aggregate(f"_in_{n}")
    per_block = base.groupBy(*keys, BLOCK).agg(*[c.alias(n) for n, c in summary.items()])

    over_blocks = Window.partitionBy(*keys).orderBy(BLOCK)
    before = over_blocks.rowsBetween(Window.unboundedPreceding, -1)
    carried = {}
    for n in sums:
        carried[f"_c_{n}"] = F.sum(f"_s_{n}").over(before)
    for n in maxima:
        carried[f"_c_{n}"] = F.max(f"_s_{n}").over(before)
    if lags:
        carried["_c_tail"] = F.lag("_s_tail").over(over_blocks)
    if leads:
        carried["_c_head"] = F.lead("_s_head").over(over_blocks)
    for n in lasts:
        carried[f"_c_{n}"] = F.last(f"_s_{n}", ignorenulls=True).over(before)
    for n, (aggregate, _) in totals.items():
        carried[f"_c_{n}"] = aggregate(f"_s_{n}").over(Window.partitionBy(*keys))
    carry = per_block.select(*keys, BLOCK, *[c.alias(n) for n, c in carried.items()])

    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {}
    for n in sums:
        local[f"_l_{n}"] = F.sum(f"_in_{n}").over(so_far)
    for n in maxima:
        local[f"_l_{n}"] = F.max(f"_in_{n}").over(so_far)
    for n in lags:
        local[f"_l_{n}"] = F.lag(f"_in_{n}").over(inside)
    for n in leads:
        local[f"_l_{n}"] = F.lead(f"_in_{n}").over(inside)
    for n in lasts:
        local[f"_l_{n}"] = F.last(f"_in_{n}", ignorenulls=True).over(so_far)
    if lags:
        local["_first"] = F.lag(F.lit(False), 1, True).over(inside)
    if leads:
        local["_final"] = F.lead(F.lit(False), 1, True).over(inside)

    right = carry.select(*[F.col(k).alias(f"_k_{k}") for k in [*keys, BLOCK]], *carried)
    matched = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*keys, BLOCK]]
    joined = base.withColumns(local).join(right, matched, "left")
    done = {}
    for n in sums:
        done[n] = F.coalesce(F.col(f"_c_{n}") + F.col(f"_l_{n}"), F.col(f"_l_{n}"), F.col(f"_c_{n}"))
    for n in maxima:
        done[n] = F.greatest(F.col(f"_c_{n}"), F.col(f"_l_{n}"))
    for n in lags:
        done[n] = F.when(F.col("_first"), F.col(f"_c_tail.v.{n}")).otherwise(F.col(f"_l_{n}"))
    for n in leads:
        done[n] = F.when(F.col("_final"), F.col(f"_c_head.v.{n}")).otherwise(F.col(f"_l_{n}"))
    for n in lasts:
        done[n] = F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}.v"))
    for n in totals:
        done[n] = F.col(f"_c_{n}")
    kept = [c for c in df.columns if c not in done]
    return joined.select(*kept, *[c.alias(n) for n, c in done.items()])


def number_rows(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with ``name``, the row's number along ``order`` over the whole table, from one.

    The order is cut into range partitions that are sorted apart. A row's number is its place in its partition after the rows
    of the partitions before, of which the driver sees one count each.
    """
    place = F.monotonically_increasing_id()  # partition and, in its lower 33 bits, the place in it
    dealt = materialize(df.withColumn("_row", place), "rows").repartitionByRange(*order, "_row").sortWithinPartitions(*order, "_row")
    placed = materialize(dealt.drop("_row").withColumn("_place", place).withColumn("_part", F.shiftright("_place", 33)), "numbered")
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, rows = [], 0
    for part in sorted(sizes):
        before.append((part, rows))
        rows += sizes[part]
    offsets = df.sparkSession.createDataFrame(before, "_part long, _before long")
    within = F.col("_place") - F.call_function("shiftleft", F.col("_part"), F.lit(33))
    return placed.join(offsets, "_part").withColumn(name, F.col("_before") + within + 1).drop("_place", "_part", "_before")


def islands(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    *,
    look_back: dict[str, Column],
    starts: Column,
    island: str = "island",
) -> DataFrame:
    """Number the runs that begin where ``starts`` holds.

    ``look_back`` names the previous-row values ``starts`` may use; the first row of a key always starts one.
    Inside a block only the first row's flag is open; it is settled on the block summaries.
    """
    inputs = {f"_in_{n}": c for n, c in look_back.items()}
    base = df.withColumns({BLOCK: block, **inputs})
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    flag = F.coalesce(starts, F.lit(False)).cast("bigint")
    local = base.withColumns(
        {"_head": F.lag(F.lit(False), 1, True).over(inside), **{n: F.lag(f"_in_{n}").over(inside) for n in look_back}}
    ).withColumn("_flag", F.when(F.col("_head"), F.lit(0).cast("bigint")).otherwise(flag))

    at = F.struct(*[F.col(c) for c in order])
    rest = [c for c in df.columns if c not in keys]
    per_block = local.groupBy(*keys, BLOCK).agg(
        F.sum("_flag").alias("_n"),
        F.min_by(F.struct(*rest), at).alias("_first"),
        F.max_by(F.struct(F.lit(True).alias("_seen"), *inputs), at).alias("_tail"),
    )
    over_blocks = Window.partitionBy(*keys).orderBy(BLOCK)
    edges = per_block.withColumn("_before", F.lag("_tail").over(over_blocks)).select(
        *keys,
        BLOCK,
        "_n",
        F.col("_before").isNull().alias("_opens"),
        "_first.*",
        *[F.col(f"_before._in_{n}").alias(n) for n in look_back],
    )
    edges = edges.withColumn("_first_flag", F.when(F.col("_opens"), F.lit(1).cast("bigint")).otherwise(flag))
    earlier = F.sum(F.col("_n") + F.col("_first_flag")).over(over_blocks.rowsBetween(Window.unboundedPreceding, -1))
    carry = edges.select(
        *[F.col(k).alias(f"_k_{k}") for k in [*keys, BLOCK]],
        (F.coalesce(earlier, F.lit(0)) + F.col("_first_flag")).alias("_carry"),
    )
    matched = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*keys, BLOCK]]
    running = F.sum("_flag").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = local.withColumn("_running", running).join(carry, matched, "left")
    return numbered.select(*df.columns, (F.col("_carry") + F.col("_running")).alias(island))


def gather_text(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    text: Column,
    separator: str,
    *,
    index: str | None = None,
    block: Column | None = None,
    part_rows: int = BLOCK_ROWS,
    out: str = "text",
) -> DataFrame:
    """Join the texts of each key in order, in parts of at most ``part_rows`` rows: ``keys, part, text``.

    The parts of a key, put together in order as they are, are its whole text: a part after the first begins with the
    separator. No task builds an unbounded string and no row is lost; :func:`whole_text` makes one value where one is
    wanted. ``index`` names a dense zero-based order column;
    without it rows are numbered by a scan over ``block``.
    """
    if index is None:
        df = scan(df, keys, order, block, row_number="_rn")
        number = F.col("_rn") - 1
    else:
        number = F.col(index)
    parts = df.select(
        *keys,
        F.floor(number / part_rows).alias("part"),
        F.struct(number.alias("n"), text.alias("t")).alias("_piece"),
    )
    pieces = F.array_sort(F.collect_list("_piece"))
    joined = parts.groupBy(*keys, "part").agg(F.array_join(F.transform(pieces, lambda p: p["t"]), separator).alias(out))
    if not separator:
        return joined
    return joined.withColumn(out, F.concat(F.when(F.col("part") > 0, separator).otherwise(""), F.col(out)))


def whole_text(parts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One value per key from its parts, however many."""
    pieces = F.array_sort(F.collect_list(F.struct("part", F.col(text).alias("t"))))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda p: p["t"]), "").alias(text))
