"""Join helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key matches a null key; the right side's key columns are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def lookup_join(left: DataFrame, dimension: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """Join a dictionary. Whether it is broadcast is left to the optimizer's size check."""
    return left.join(dimension, on, how)


def latest_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the last along ``order``; combined on the map side, so hot keys do not pile up."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(order.alias("_at"), F.struct(*rest).alias("_row"))).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best._row.*")
