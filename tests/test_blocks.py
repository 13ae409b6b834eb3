"""Balanced blocks in slices against the sequential plan."""

import random

import pytest

from tests.sequential_blocks import Backward, Forward
from voxlake.operators import blocks
from voxlake.operators.blocks import assign_blocks, balanced_blocks


def run(fold, rows):
    state, out = fold.start(()), []
    for row in rows:
        state, produced = fold.step(state, (), row)
        out += produced
    return out


def sequential(seconds, target, lo, hi):
    """First and last position of each block."""
    pointers = run(Forward(target, lo, hi), [(s,) for s in seconds])
    return sorted(run(Backward(), pointers[::-1]))


def plan(spark, data, **band):
    rows = [(k, 3 * i, s) for k, seconds in data.items() for i, s in enumerate(seconds)]
    frame = spark.createDataFrame(rows, "k string, seg bigint, seconds double").selectExpr("*", "'x' AS slice", "'y' AS own", "1 AS end").repartition(4)
    found = {k: [] for k in data}
    for r in balanced_blocks(frame, ["k"], "seg", **band).orderBy("k", "block_idx").collect():
        assert r.block_idx == len(found[r.k])
        found[r.k].append((r.first_segment // 3 + 1, r.last_segment // 3 + 1))
        assert r.seconds == pytest.approx(sum(data[r.k][r.first_segment // 3 : r.last_segment // 3 + 1]))
    return found


@pytest.mark.parametrize("slice_, fan, low", [(1.5, 2, 8.0), (2, 3, 0.0), (64, 64, 8.0)])
def test_blocks_are_the_sequential_ones(spark, monkeypatch, slice_, fan, low):
    monkeypatch.setattr(blocks, "SLICE", slice_)
    monkeypatch.setattr(blocks, "FAN", fan)
    rng = random.Random(slice_)
    data = {f"r{i}": [float(rng.randint(0, 12)) for _ in range(rng.choice([1, 2, 9, 60, 400]))] for i in range(12)}
    data["long"] = [rng.choice([0.25, 0.5, 1.0, 7.5]) for _ in range(3000)]
    data["gap"] = [5.0] * 30 + [500.0] + [5.0] * 30
    data["start"] = [25.0] + [5.0] * 50
    data["short"] = [1.0]
    data["even"] = [5.0] * 500  # many plans cost the same
    got = plan(spark, data, target=15.0, min_len=low, max_len=20.0)
    assert got == {k: sequential(s, 15.0, low, 20.0) for k, s in data.items()}
    assert got["gap"] == got["start"] == [] and len(got["even"]) > 100 and len(got["long"]) > 200


def test_every_segment_has_its_block(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SLICE", 1.5)
    monkeypatch.setattr(blocks, "FAN", 2)
    rng = random.Random(3)
    seconds = [float(rng.randint(1, 9)) for _ in range(300)]
    rows = spark.createDataFrame([(None, i, s) for i, s in enumerate(seconds)] + [("z", 0, None)], "k string, seg int, seconds double")
    got = assign_blocks(rows, ["k"], "seg", target=15.0, min_len=0.0, max_len=20.0).orderBy("seg").collect()
    first = {p: a for a, b in sequential(seconds, 15.0, 0.0, 20.0) for p in range(a, b + 1)}
    assert [(r.seg + 1, r.position, r.first_position) for r in got if r.k is None] == [(p, p, first[p]) for p in range(1, 301)]
    assert [(r.seg, r.seconds, r.first_position) for r in got if r.k == "z"] == [(0, 0.0, 1)]


def test_a_long_recording_spreads(spark):
    """No group holds more than a slice, its lead, or FAN tables."""
    rows = spark.range(60_000).selectExpr("'r' AS k", "id AS seg", "0.5 + (id * 7919 % 97) / 20 AS seconds")
    out = assign_blocks(rows, ["k"], "seg", target=15.0, min_len=5.0, max_len=20.0)
    sizes = [r["count"] for r in out.withColumn("slice", (out.before / (blocks.SLICE * 20)).cast("long")).groupBy("slice").count().collect()]
    assert len(sizes) > blocks.FAN and max(sizes) < 1000 and sum(sizes) == 60_000
    assert out.groupBy("first_position").agg({"seconds": "sum"}).filter("`sum(seconds)` > 20.00001 or `sum(seconds)` < 4.99999").count() == 0


def test_rows_are_numbered_over_partitions(spark):
    from voxlake.operators.scans import number_rows

    rows = spark.range(500).selectExpr("id % 7 AS k", "(id * 37) % 100 AS v").repartition(5)
    got = number_rows(rows, ["v"], "n").collect()
    assert sorted(r.n for r in got) == list(range(1, 501))
    by = sorted(got, key=lambda r: r.n)
    assert all(a.v <= b.v for a, b in zip(by, by[1:]))
    assert number_rows(rows.limit(0), ["v"], "n").collect() == []


def test_a_crowded_day_spreads(spark):
    """A user with a third of all events in one second meets in no single block, and the scan is the window's."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from voxlake.operators.scans import range_blocks, scan

    rows = spark.range(6000).selectExpr("IF(id % 3 = 0, 1, id % 50) AS user_id", "IF(id % 3 = 0, 7L, id % 97) AS ts", "id", "IF(id % 5 = 0, id, NULL) AS v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    try:
        placed, block = range_blocks(rows, ["user_id"], ["ts", "id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = scan(placed, ["user_id"], ["ts", "id"], block, lasts={"latest": F.col("v")}, row_number="n")
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    want = rows.withColumns({"latest": F.last("v", True).over(w), "n": F.row_number().over(w)})
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    sizes = placed.filter("user_id = 1 AND ts = 7").groupBy("_range").count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in placed.groupBy("_range").count().collect()) < 3000


@pytest.mark.parametrize(
    "seconds, band, want",
    [
        ([24 * 0.4, 28 * 0.4, 24 * 0.4], (15.0, 0.0, 40.0), [(1, 2), (3, 3)]),
        ([n / 40.0 for n in (75, 931, 23, 224, 152, 505, 125)], (25.0, 1.0, 60.0), [(1, 2), (3, 7)]),
    ],
)
def test_equal_ways_are_told_apart_by_the_sums_themselves(spark, seconds, band, want):
    """Ways that are equal on paper: the roundings of the running sums decide, as they do in the SQL."""
    target, lo, hi = band
    assert plan(spark, {"a": seconds, "b": [1.0, *seconds[1:]]}, target=target, min_len=lo, max_len=hi)["a"] == want
