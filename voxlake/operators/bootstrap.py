"""Bootstrap intervals that repeat a 64-bit linear congruential generator exactly.

The generator after k steps is an affine map of its seed, so any stretch of draws can be produced on its own.
Groups of bounded size are resampled in blocks of replicates next to a copy of their values. Larger groups are
never held in one place: stretches of draws are shuffled to the blocks of rows they hit and summed there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.operators.joins import safe_join
from voxlake.operators.scans import scan
from voxlake.session import materialize

# Generator seed, multiplier and increment.
SEED = 123456789
MULTIPLIER = 6364136223846793005
INCREMENT = 1
MASK = (1 << 64) - 1

ITERATIONS = 1000
MAX_GROUP = 100_000
REPLICATES_PER_TASK = 25
DRAWS_PER_TASK = 1_000_000
ROWS_PER_BLOCK = 4096
STRETCH = 1 << 16


def jump(steps: int) -> tuple[int, int]:
    """Factor and offset of ``steps`` generator steps."""
    factor, offset, a, c = 1, 0, MULTIPLIER, INCREMENT
    while steps:
        if steps & 1:
            factor, offset = factor * a & MASK, (offset * a + c) & MASK
        a, c = a * a & MASK, (a * c + c) & MASK
        steps >>= 1
    return factor, offset


def _step_table(length: int) -> tuple[np.ndarray, np.ndarray]:
    factor, offset = np.empty(length, "uint64"), np.empty(length, "uint64")
    factor[0], offset[0], done = MULTIPLIER, INCREMENT, 1
    while done < length:
        more = min(done, length - done)
        a, c = factor[done - 1], offset[done - 1]
        factor[done : done + more] = factor[:more] * a
        offset[done : done + more] = factor[:more] * c + offset[:more]
        done += more
    return factor, offset


def draw_indices(first: int, count: int, n: int) -> np.ndarray:
    """Row indices of draws ``first .. first+count-1`` for a group of ``n`` rows."""
    factor, offset = _step_table(min(count, STRETCH))
    out = np.empty(count, "int64")
    for lo in range(0, count, STRETCH):
        size = min(STRETCH, count - lo)
        a, c = jump(first + lo)
        state = np.uint64((SEED * a + c) & MASK)
        with np.errstate(over="ignore"):
            states = factor[:size] * state + offset[:size]
        out[lo : lo + size] = ((states >> np.uint64(32)) % np.uint64(n)).astype("int64")
    return out


def bootstrap_sums(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    measures: list[str],
    *,
    iterations: int = ITERATIONS,
    max_group: int = MAX_GROUP,
) -> DataFrame:
    """Sums of ``measures`` in every replicate of every group: ``keys, replicate, measures``."""
    group = keys or ["_all"]
    slim = df.select(*(keys or [F.lit(0).alias("_all")]), *order, *measures)
    # Scored rows are dear to compute and are read by both routes.
    rows = materialize(slim, "bootstrap-rows")
    sizes = materialize(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")), "bootstrap-sizes")
    few, many = sizes.filter(F.col("_n") <= max_group), sizes.filter(F.col("_n") > max_group)
    small = _small_groups(safe_join(rows, few, group), group, order, measures, iterations)
    numbered = scan(safe_join(rows, many, group), group, order, block, row_number="_rn")
    large = _large_groups(numbered, many, group, measures, iterations)
    return small.unionByName(large).select(*keys, "replicate", *measures)


def _sum_schema(df: DataFrame, group: list[str], measures: list[str]) -> T.StructType:
    fields = [df.schema[k] for k in group] + [T.StructField("replicate", T.IntegerType())]
    return T.StructType(fields + [T.StructField(m, T.LongType()) for m in measures])


def _small_groups(df, group, order, measures, iterations):
    rows = F.array_sort(F.collect_list(F.struct(*order, *[F.col(m).cast("bigint").alias(f"_m_{m}") for m in measures])))
    packed = df.groupBy(*group).agg(rows.alias("_rows"))
    arrays = packed.select(*group, *[F.col(f"_rows._m_{m}").alias(m) for m in measures])
    tasks = -(-iterations // REPLICATES_PER_TASK)
    spread = arrays.withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    spread = spread.repartition(*group, "_task")

    def resample(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                values = [np.asarray(row[m], dtype="int64") for m in measures]
                n = len(values[0])
                lo = row["_task"] * REPLICATES_PER_TASK
                hi = min(lo + REPLICATES_PER_TASK, iterations)
                picks = draw_indices(lo * n, (hi - lo) * n, n).reshape(hi - lo, n)
                out = pd.DataFrame({k: [row[k]] * (hi - lo) for k in group})
                out["replicate"] = np.arange(lo, hi, dtype="int32")
                for m, v in zip(measures, values):
                    out[m] = v[picks].sum(axis=1)
                yield out

    return spread.mapInPandas(resample, _sum_schema(df, group, measures))


def _large_groups(numbered, sizes, group, measures, iterations):
    schema = _sum_schema(numbered, group, measures)
    blocks = numbered.select(
        *group,
        F.floor((F.col("_rn") - 1) / ROWS_PER_BLOCK).alias("_rows"),
        ((F.col("_rn") - 1) % ROWS_PER_BLOCK).cast("int").alias("_at"),
        *[F.col(m).cast("bigint").alias(m) for m in measures],
    )
    draws = F.col("_n") * iterations
    tasks = sizes.withColumn(
        "_task", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((draws - 1) / DRAWS_PER_TASK)))
    ).repartition(*group, "_task")
    hit_schema = T.StructType(
        [numbered.schema[k] for k in group]
        + [
            T.StructField("_rows", T.LongType()),
            T.StructField("replicate", T.IntegerType()),
            T.StructField("_hits", T.ArrayType(T.IntegerType())),
        ]
    )

    def draw(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                n, first = int(row["_n"]), int(row["_task"]) * DRAWS_PER_TASK
                count = min(DRAWS_PER_TASK, n * iterations - first)
                index = draw_indices(first, count, n)
                replicate = (first + np.arange(count)) // n
                rank = np.lexsort((index, replicate))
                index, replicate = index[rank], replicate[rank]
                cell = index // ROWS_PER_BLOCK
                edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(replicate) != 0)) + 1
                starts = np.concatenate([[0], edges])
                out = pd.DataFrame({k: [row[k]] * len(starts) for k in group})
                out["_rows"] = cell[starts]
                out["replicate"] = replicate[starts].astype("int32")
                out["_hits"] = [h.tolist() for h in np.split((index % ROWS_PER_BLOCK).astype("int32"), edges)]
                yield out

    def add_up(hits: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_at")
        values = {m: rows[m].to_numpy() for m in measures}
        out = hits[[*group, "replicate"]].copy()
        for m in measures:
            out[m] = [int(values[m][np.asarray(h)].sum()) for h in hits["_hits"]]
        return out

    hits = tasks.mapInPandas(draw, hit_schema)
    partial = hits.groupBy(*group, "_rows").cogroup(blocks.groupBy(*group, "_rows")).applyInPandas(add_up, schema)
    return partial.groupBy(*group, "replicate").agg(*[F.sum(m).alias(m) for m in measures])


def interval(sums: DataFrame, keys: list[str], value: Column, iterations: int = ITERATIONS) -> DataFrame:
    """The 95 % interval: sorted replicate values at 2.5 % and 97.5 %. A group has ``iterations`` values."""
    ranked = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_v"))
    return ranked.select(
        *keys,
        F.get("_v", F.lit(iterations * 25 // 1000)).alias("ci_low"),
        F.get("_v", F.lit(iterations * 975 // 1000)).alias("ci_high"),
    )


def wer_interval(df, keys, order, block, **options) -> DataFrame:
    """Interval of the micro-averaged error rate."""
    sums = bootstrap_sums(df, keys, order, block, ["ref_words", "errors"], **options)
    value = F.when(F.col("ref_words") > 0, F.col("errors") / F.col("ref_words") * 100.0).otherwise(0.0)
    return interval(sums, keys, value, options.get("iterations", ITERATIONS))


def delta_interval(df, keys, order, block, **options) -> DataFrame:
    """Interval of the difference between two paired error rates."""
    sums = bootstrap_sums(df, keys, order, block, ["ref_words", "batch_errors", "stream_errors"], **options)
    ref = F.col("ref_words")
    value = F.when(ref > 0, (F.col("stream_errors") / ref - F.col("batch_errors") / ref) * 100.0).otherwise(0.0)
    return interval(sums, keys, value, options.get("iterations", ITERATIONS))
