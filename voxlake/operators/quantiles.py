"""Exact order statistics and interpolated percentiles of groups of any size.

Values are counted per (group, value) first. The counts are partitioned by range of (group, value), so that each partition
holds a stretch of a group's order; the totals of the partitions say which of them holds a wanted rank, and only that one is
looked through. No task ever sorts a whole group, and outliers do not crowd the others together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.operators.joins import safe_join
from voxlake.session import materialize


def _pick_ranks(counts: DataFrame, ranks: DataFrame, keys: list[str]) -> DataFrame:
    """``ranks`` (keys, name, rank) with the value at each zero-based rank; ``counts`` is (keys, _v, _n)."""
    # Written, so that a partition keeps its number.
    placed = materialize(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()), "ranges")
    totals = placed.groupBy(*keys, "_part").agg(F.sum("_n").alias("_m"))
    through = F.sum("_m").over(Window.partitionBy(*keys).orderBy("_part"))
    totals = totals.withColumn("_before", through - F.col("_m"))
    found = safe_join(ranks, totals, keys).filter(
        (F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_m"))
    )
    found = found.select(*keys, "_part", "name", (F.col("rank") - F.col("_before")).alias("rank"))
    stretch = safe_join(placed, found.select(*keys, "_part").distinct(), [*keys, "_part"], "left_semi")
    inside = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_v"))
    ordered = stretch.withColumn("_before", inside - F.col("_n"))
    hits = safe_join(found, ordered, [*keys, "_part"]).filter(
        (F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_n"))
    )
    return hits.select(*keys, "name", F.col("_v").alias("value"))


def _counted(df: DataFrame, keys: list[str], value: Column) -> tuple[DataFrame, list[str]]:
    keyed = df.select(*(keys or [F.lit(0).alias("_all")]), value.cast("double").alias("_v"))
    group = keys or ["_all"]
    counts = keyed.filter(F.col("_v").isNotNull()).groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_n"))
    return materialize(counts, "value-counts"), group


def percentiles(df: DataFrame, keys: list[str], value: Column, points: dict[str, float]) -> DataFrame:
    """Count, maximum and interpolated percentiles of the non-null values of each group."""
    counts, group = _counted(df, keys, value)
    totals = counts.groupBy(*group).agg(F.sum("_n").alias("n"), F.max("_v").alias("max"))
    wanted = []
    for name, p in points.items():
        rank = (F.col("n") - 1) * F.lit(p)
        low = F.floor(rank)
        wanted.append(F.struct(F.lit(f"{name}/lo").alias("name"), low.alias("rank")))
        wanted.append(F.struct(F.lit(f"{name}/hi").alias("name"), F.least(low + 1, F.col("n") - 1).alias("rank")))
    ranks = totals.select(*group, F.explode(F.array(*wanted)).alias("_w")).select(*group, "_w.name", "_w.rank")
    values = _pick_ranks(counts, ranks, group)
    picked = [F.max(F.when(F.col("name") == w, F.col("value"))).alias(w) for p in points for w in (f"{p}/lo", f"{p}/hi")]
    wide = safe_join(totals, values.groupBy(*group).agg(*picked), group)
    out = {}
    for name, p in points.items():
        rank = (F.col("n") - 1) * F.lit(p)
        frac = rank - F.floor(rank)
        out[name] = F.col(f"`{name}/lo`") * (1.0 - frac) + F.col(f"`{name}/hi`") * frac
    return wide.select(*keys, "n", "max", *[c.alias(name) for name, c in out.items()])


def order_statistic(df: DataFrame, keys: list[str], value: Column, rank: Column, out: str) -> DataFrame:
    """The value at a zero-based rank computed from the group size ``n``."""
    counts, group = _counted(df, keys, value)
    totals = counts.groupBy(*group).agg(F.sum("_n").alias("n"))
    ranks = totals.select(*group, F.lit(out).alias("name"), rank.cast("bigint").alias("rank"))
    return _pick_ranks(counts, ranks, group).select(*keys, F.col("value").alias(out))


def latency_rollup(df: DataFrame, series: dict[str, Column], points: dict[str, float]) -> DataFrame:
    """``series, n, max`` and percentiles of several series at once, one row each.

    A series is a column of numbers or of lists, whose numbers are pooled. Nulls and negative values (an onset before its
    reference) do not count. A series without values has n = 0 and nulls.
    """
    pooled = [
        F.struct(F.lit(name).alias("series"), (v if dict(df.select(v.alias("v")).dtypes)["v"].startswith("array") else F.array(v)).alias("vs"))
        for name, v in series.items()
    ]
    rows = df.select(F.explode(F.array(*pooled)).alias("s")).select("s.series", F.explode("s.vs").alias("v")).filter("v >= 0")
    names = df.sparkSession.createDataFrame([(name,) for name in series], "series string")
    found = names.join(percentiles(rows, ["series"], F.col("v"), points), "series", "left")
    return found.withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
