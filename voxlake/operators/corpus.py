"""Corpus preparation: caches, duplicates, scans and model runs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.functions.predicates import OVERSIZE_SECONDS

SALTS = 32

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("cache_key", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("proc_sec", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
    ]
)


#: Results of a model that are held at a time.
ROWS = 256


def cache_key(engine: str, config: str | None, content: Column) -> Column:
    """Identity of a result: engine, settings and content."""
    parts = [F.lit(engine), *([F.lit(config)] if config else []), F.sha2(content, 256)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def split_by_cache(work: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``cache_key`` has a stored result, and rows that have to be computed."""
    hits = work.join(cache, "cache_key", "inner").withColumn("cached", F.lit(True))
    fresh = work.join(cache.select("cache_key"), "cache_key", "left_anti")
    return hits, fresh


def with_cache(work: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stored results and fresh ones together."""
    hits, fresh = split_by_cache(work, cache)
    return hits.unionByName(compute(fresh).withColumn("cached", F.lit(False)), allowMissingColumns=True)


def run_model(
    work: DataFrame, make_model: Callable[[], Callable], columns: list[str], *, retries: int = 0, backoff_s: float = 0.0
) -> DataFrame:
    """Run a model over rows; ``make_model`` is called once per Python worker batch stream.

    The model takes the values of ``columns`` and returns ``(text, seconds)``. A row that keeps failing comes back
    with status, error and attempts; it never fails the stage.
    """

    def attempt(model: Callable, values: tuple) -> tuple:
        for n in range(1, retries + 2):
            try:
                text, seconds = model(*values)
                return text, float(seconds), "processed", None, n
            except Exception as e:  # noqa: BLE001
                error = str(e)
                if n <= retries and backoff_s:
                    time.sleep(backoff_s * n)
        return "", 0.0, "failed", error, retries + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            model = model or make_model()
            for begin in range(0, len(batch), ROWS):  # results are handed on before the next rows are run
                pdf = batch.iloc[begin : begin + ROWS]
                rows = [
                    (key, *attempt(model, values))
                    for key, values in zip(pdf["cache_key"], pdf[columns].itertuples(index=False, name=None))
                ]
                yield pd.DataFrame(rows, columns=RESULT_SCHEMA.names)

    return work.select("cache_key", *columns).mapInPandas(run, RESULT_SCHEMA)


def transcribe_table(
    audio: DataFrame,
    make_model: Callable[[], Callable],
    *,
    engine: str,
    content: str,
    columns: list[str],
    config: str | None = None,
    cache: DataFrame | None = None,
    retries: int = 0,
    backoff_s: float = 0.0,
) -> DataFrame:
    """Results ``cache_key, text, proc_sec, status, error, attempts, cached`` for every distinct content.

    Equal contents are computed once. Join the result back on ``cache_key`` for per-row output.
    """
    keyed = audio.withColumn("cache_key", cache_key(engine, config, F.col(content)))
    distinct = keyed.select("cache_key", *columns).dropDuplicates(["cache_key"])
    compute = lambda rows: run_model(rows, make_model, columns, retries=retries, backoff_s=backoff_s)
    if cache is None:
        return compute(distinct).withColumn("cached", F.lit(False))
    return with_cache(distinct, cache, compute).select(*RESULT_SCHEMA.names, "cached")


def duplicate_contents(files: DataFrame, path: str, content: Column) -> DataFrame:
    """Files whose content occurs more than once: ``digest, path, copies, keeper``.

    Copies are rows, not lists. The largest group of copies may be a large part of all files, so the join back
    to them is salted.
    """
    hashed = files.select(F.sha2(content, 256).alias("digest"), F.col(path).alias("path"))
    groups = hashed.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("keeper")).filter("copies > 1")
    spread = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = hashed.withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, ["digest", "_salt"]).drop("_salt")


def scan_rollup(clips: DataFrame, keys: list[str]) -> DataFrame:
    """Clips by how they were measured, the longest one, and how many are over the limit.

    ``outcome`` is probed, decoded, undecodable or malformed; every clip must fall in one of them.
    """
    is_ = lambda name: F.col("outcome") == name
    measured = is_("probed") | is_("decoded")
    sums = clips.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("clips"),
        *[F.count_if(is_(n)).alias(n) for n in ("probed", "decoded", "undecodable", "malformed")],
        F.coalesce(F.max(F.when(measured, F.col("seconds"))), F.lit(0.0)).alias("max_seconds"),
        F.count_if(measured & (F.col("seconds") > OVERSIZE_SECONDS)).alias("over"),
    )
    accounted = F.col("probed") + F.col("decoded") + F.col("undecodable") + F.col("malformed")
    return sums.withColumn("accounted", accounted == F.col("clips"))


def nearest_threshold(clips: DataFrame, threshold: float = OVERSIZE_SECONDS, k: int = 24) -> DataFrame:
    """The clips closest to a length threshold."""
    return clips.orderBy(F.abs(F.col("seconds") - threshold), "path").limit(k)
