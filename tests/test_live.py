"""Live sessions, updated windows and late rows over several batches."""

import json
import random

from pyspark.sql import functions as F

from voxlake.operators import folds
from voxlake.streaming import operators as live
from voxlake.streaming import ordered

SCHEMA = "user string, id bigint, ts string, type string"


def deliveries(spark, tmp_path, batches):
    """A stream that takes one delivery a batch."""
    for i, rows in enumerate(batches):
        table = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        table.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return source.parquet(f"{tmp_path}/in")


def at(minute, second=0):
    return f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:{second:02d}"


BATCHES = [
    [("a", 1, at(0), "send"), ("a", 2, at(1), "partial"), ("b", 3, at(0), "send")],
    [("a", 4, at(9), "final"), ("c", 5, at(12), "send"), ("b", 6, at(11), "final")],
    [("a", 7, at(18), "send"), ("a", 8, at(27), "partial"), ("c", 9, at(30), "final"), ("d", 10, None, "send")],
    [("a", 11, at(36), "final"), ("c", 12, at(1), "final"), ("a", 13, at(2), "send"), ("a", 14, at(44), "send")],
]


def test_sessions_close_cap_and_stay_open(spark, tmp_path):
    stream = deliveries(spark, tmp_path, BATCHES).filter("ts is not null").withColumn("text", F.lit("words"))
    rows = live.run_available(live.session_latency(stream, ["user"], "ts", ["id"], idle_s=600, cap_s=1800, delay="1 minute"), "test-sessions")
    final = {(r.user, r.session_start_ms // 60_000 % 1440): (r.messages, r.ttfp_ms, r.finalization_lag_ms, r.open) for r in live.latest_versions(rows, ["user", "session_start_ms"]).collect()}
    # a: within ten minutes each time, but capped at half an hour; b: silent for eleven minutes; c: for eighteen.
    assert final == {
        ("a", 0): (5, 60_000, 540_000, False),
        ("a", 36): (1, None, None, True),  # what came at 44 is younger than the watermark
        ("b", 0): (1, None, None, False),
        ("b", 11): (1, None, None, False),
        ("c", 12): (1, None, None, False),
        ("c", 30): (1, None, None, False),
    } | {k: v for k, v in final.items() if k == ("c", 30) and v[3]}
    versions = [(r.version, r.open) for r in rows.filter("user = 'a'").orderBy("session_start_ms", "version").collect()]
    assert len(versions) > 3 and versions[0] == (0, True)


def test_late_rows_are_told(spark, tmp_path):
    got = live.audit(deliveries(spark, tmp_path, BATCHES), ["user"], "ts", "test-late", delay="10 minutes")
    rows = [(r.user, r.hour and r.hour.hour, r.reason, r.n) for r in got.collect()]
    assert sorted(rows, key=str) == [("a", 0, "late", 1), ("c", 0, "late", 1), ("d", None, "undecodable", 1)]


def test_open_windows_are_shown(spark, tmp_path):
    stream = deliveries(spark, tmp_path, BATCHES).filter("ts is not null")
    out = live.run_updates(live.event_rate(stream, ["user"], "ts", window="1 hour", slide="1 hour", delay="2 hours"), "test-rates", ["user", "eval_s"])
    assert {r.user: r.n for r in out.collect()} == {"a": 8, "b": 2, "c": 3}


class Handle:
    """State of one key in memory, as the engine gives it to a processor."""

    def __init__(self):
        self.slices, self.value, self.timers, self.read = {}, None, set(), 0

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return Value(self)

    def registerTimer(self, at_ms):
        self.timers.add(at_ms)

    def containsKey(self, k):
        return k in self.slices

    def getValue(self, k):
        self.read += len(json.loads(self.slices[k][0]))
        return self.slices[k]

    def updateValue(self, k, v):
        self.slices[k] = v

    def removeKey(self, k):
        del self.slices[k]

    def keys(self):
        return iter(list(self.slices))


class Value:
    def __init__(self, handle):
        self.handle = handle

    def exists(self):
        return self.handle.value is not None

    def get(self):
        return self.handle.value

    def update(self, v):
        self.handle.value = v


class Times:
    def __init__(self, mark):
        self.mark = mark

    def getCurrentWatermarkInMs(self):
        return self.mark


class Noting(folds.Fold):
    def step(self, state, key, row):
        return None, [(row[0],)]


def test_a_timer_reads_what_is_due():
    import pandas as pd

    handle = Handle()
    processor = ordered.OrderedFold(Noting(), ["key", "n"], ["ev_us"], ["n"], None, slice_ms=100)
    processor.init(handle)
    rng = random.Random(1)
    times = [rng.randrange(100_000) for _ in range(2000)]
    rows = pd.DataFrame({"ev_ms": times, "ev_us": [t * 1000 + i for i, t in enumerate(times)], "n": range(2000)})
    for i in range(0, 2000, 500):
        list(processor.handleInputRows(("k",), iter([rows[i : i + 500]]), Times(-1)))
    handle.read, out = 0, []
    for mark in range(1000, 101_001, 1000):
        due = sorted(t for t in handle.timers if t <= mark)
        handle.timers -= set(due)
        for _ in due:
            out += next(iter(processor.handleExpiredTimer(("k",), Times(mark), None)))["n"].tolist()
    assert out == sorted(range(2000), key=lambda i: times[i] * 1000 + i)
    assert handle.read < 3 * 2000 and not handle.slices


class Maps(Handle):
    """State of one slot: a map of its own for each name."""

    def __init__(self):
        super().__init__()
        self.maps, self.calls = {}, 0

    def getMapState(self, name, *_):
        self.maps[name] = Handle()
        return self.maps[name]

    def registerTimer(self, at_ms):
        self.calls += 1
        super().registerTimer(at_ms)


def test_keys_share_a_slot():
    """A slot folds each key's rows in order and is woken once, however many keys and times wait."""
    import pandas as pd

    handle = Maps()
    processor = ordered.SlotFold(folds.RunningGauge(), ["key", "n", "active"], ["ev_us"], ["n", "delta"])
    processor.init(handle)
    rng = random.Random(2)
    times = [rng.randrange(10**9) for _ in range(3000)]
    rows = pd.DataFrame({"ev_ms": times, "ev_us": [t * 1000 for t in times], "n": range(3000), "delta": 1, "slot_key": [f"[{i % 300}]" for i in range(3000)]})
    for i in (0, 1500):
        list(processor.handleInputRows((7,), iter([rows[i : i + 1500]]), Times(-1)))
    assert handle.calls == 2
    out = pd.concat(processor.handleExpiredTimer((7,), Times(5 * 10**8), None))
    out = pd.concat([out, *processor.handleExpiredTimer((7,), Times(10**9), None)])
    for key, got in out.groupby("key"):
        assert got["n"].tolist() == sorted(range(int(key), 3000, 300), key=lambda i: times[i])
        assert got["active"].tolist() == list(range(1, 11))
    assert not handle.maps["waiting"].slices
