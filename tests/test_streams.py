"""Streams that arrive out of order and in several files give the batch result."""

import random

from pyspark.sql import functions as F

from voxlake.operators import folds
from voxlake.operators.scans import micros
from voxlake.streaming import operators as live


def test_out_of_order_verdicts(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"c{rng.randint(0, 3)}", i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}.{rng.randint(0, 999):03d}") for i in range(300)]
    schema = "client string, id bigint, ts string"
    table = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    # Two files, each shuffled: inside a file rows are not in time order.
    for part, half in enumerate((table.filter("id < 150"), table.filter("id >= 150"))):
        half.orderBy(F.rand(part)).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    ms = micros(F.col("ts")) / 1000.0
    out = live.run_available(live.rate_limit(stream, "client", "ts", "id", ms, rpm=20, burst=3), "test-verdicts")
    batch = folds.rate_limit(table, "client", "id", ms, rpm=20, burst=3, block_s=30)
    assert {(r["id"], r["allowed"]) for r in out.collect()} == {(r["id"], r["allowed"]) for r in batch.collect()}
    assert len({r["allowed"] for r in batch.collect()}) == 2
