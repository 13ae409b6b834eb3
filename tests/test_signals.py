"""Regions, endpoints, latencies, limits and job states against golden cases and sequential code."""

import random

import pytest
from pyspark.sql import functions as F

from tests.sequential_blocks import Backward, Forward
from voxlake.operators import folds, windows
from voxlake.operators import words as ops
from voxlake.operators.bootstrap import MASK, MULTIPLIER, SEED, bootstrap_sums, draw_indices, wer_interval
from voxlake.operators.blocks import balanced_blocks
from voxlake.operators.quantiles import order_statistic, percentiles


def regions(spark, probs, total=None, **settings):
    rows = [("r", i, float(p), total) for i, p in enumerate(probs)]
    frames = spark.createDataFrame(rows, "recording_id string, frame_idx bigint, prob double, total bigint")
    out = windows.speech_regions(frames, ["recording_id"], total="total" if total else None, **settings)
    return [(r["start"], r["end"]) for r in out.orderBy("region_idx").collect()]


@pytest.mark.parametrize(
    "probs, total, silence, pad, expected",
    [
        ([0.1, 0.9, 0.9, 0.1], 400, 0, 0, [(100, 300)]),
        ([0.1, 0.9, 0.9], 250, 0, 0, [(100, 250)]),
        ([0.9, 0.1, 0.9], 300, 100, 0, [(0, 300)]),
        ([0.1, 0.9, 0.1], 1000, 0, 10, [(0, 360)]),
        ([0.9, 0.1, 0.1, 0.9, 0.1], 2000, 0, 50, [(0, 1200)]),
        ([0.1, 0.1], 200, 0, 0, []),
    ],
)
def test_region_golden(spark, probs, total, silence, pad, expected):
    found = regions(spark, probs, total, frame_samples=100, min_silence_ms=silence, min_speech_ms=0, pad_ms=pad)
    assert found == expected


def run_fold(fold, rows, key=("k",)):
    state, out = fold.start(key), []
    for row in rows:
        state, produced = fold.step(state, key, row)
        out += list(produced)
    return out + list(fold.finish(state, key))


def sequential_regions(probs, silence, speech, pad, frame):
    total, runs = len(probs) * frame, []
    for i, p in enumerate(probs):
        if p >= 0.5:
            if runs and runs[-1][1] == i * frame:
                runs[-1][1] += frame
            else:
                runs.append([i * frame, (i + 1) * frame])
    merged = []
    for s, e in runs:
        if merged and s - merged[-1][1] < silence:
            merged[-1][1] = e
        else:
            merged.append([s, e])
    out = []
    for s, e in [m for m in merged if m[1] - m[0] >= speech]:
        s, e = max(s - pad, 0), min(e + pad, total)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed", range(300))
def test_live_segmenter_equals_sequential(seed):
    rng = random.Random(seed)
    probs = [rng.choice([0.1, 0.9]) for _ in range(rng.randint(0, 40))]
    silence, speech, pad = rng.choice([0, 60, 100, 250]), rng.choice([0, 100, 200, 350]), rng.choice([0, 30, 100, 260])
    fold = folds.Segmenter(min_silence=silence, min_speech=speech, pad=pad, frame=100)
    live = [(s, e) for _, s, e in run_fold(fold, [(p,) for p in probs])]
    assert live == sequential_regions(probs, silence, speech, pad, 100)


def test_batch_regions_equal_sequential(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for k in range(60):
        probs = [rng.choice([0.1, 0.1, 0.9]) for _ in range(rng.randint(1, 60))]
        rows += [(k, i, p) for i, p in enumerate(probs)]
        expected[k] = sequential_regions(probs, 1600, 1024, 640, 512)
    frames = spark.createDataFrame(rows, "recording_id bigint, frame_idx bigint, prob double")
    out = windows.speech_regions(frames, ["recording_id"], min_silence_ms=100, min_speech_ms=64, pad_ms=40)
    found = {k: [] for k in expected}
    for r in out.orderBy("recording_id", "region_idx").collect():
        found[r["recording_id"]].append((r["start"], r["end"]))
    assert found == expected


def test_endpoint_fires_once(spark):
    probs = [0.9] + [0.1] * 9 + [0.9] + [0.1] * 2
    assert run_fold(folds.Hangover(min_silence=1600), list(enumerate(probs))) == [(4,)]
    frames = spark.createDataFrame([("r", i, p) for i, p in enumerate(probs)], "recording_id string, frame_idx bigint, prob double")
    assert [r["frame_idx"] for r in windows.silence_endpoints(frames, ["recording_id"], min_silence_ms=100).collect()] == [4]


def test_remap_golden(spark):
    points = spark.createDataFrame([("r", 0.5), ("r", 1.0), ("r", 1.5), ("r", 10.0), ("r", 0.0), ("none", 3.0)], "recording_id string, t double")
    kept = spark.createDataFrame([("r", 0, 0, 16000), ("r", 1, 48000, 64000)], "recording_id string, region_idx bigint, start bigint, end bigint")
    out = ops.remap_compressed(points, kept, ["recording_id"], "t").collect()
    assert {(r["recording_id"], r["t"]): r["original_s"] for r in out} == {
        ("r", 0.5): 0.5, ("r", 1.0): 1.0, ("r", 1.5): 3.5, ("r", 10.0): 4.0, ("r", 0.0): 0.0, ("none", 3.0): 3.0
    }


def test_confidence_weights(spark):
    rows = [("a", 0.0, 1.0, 0.9), ("a", 1.0, 4.0, 0.5), ("b", 1.0, 1.0, 0.8), ("b", 2.0, 2.0, 0.6)]
    words = spark.createDataFrame(rows, "recording_id string, start double, end double, confidence double")
    found = {r[0]: round(r[1], 6) for r in ops.mean_confidence(words, ["recording_id"]).collect()}
    assert found == {"a": 0.6, "b": 0.7}


def test_token_bucket():
    burst = run_fold(folds.TokenBucket(1, 5), [(i, 0.0) for i in range(6)])
    assert [ok for _, ok in burst] == [True] * 5 + [False]
    refill = run_fold(folds.TokenBucket(60_000, 2), [(0, 0.0), (1, 0.0), (2, 0.0), (3, 3.0)])
    assert [ok for _, ok in refill] == [True, True, False, True]


def test_job_lifecycle():
    fold = folds.JobLifecycle(max_retries=1)
    events = [("submit", 1, 0.0, None, 10), ("start", 2, 0.0, None, None), ("fail", 3, 0.0, "worker panicked", None)]
    assert run_fold(fold, events)[0][:2] == ("queued", 1)
    again = events + [("start", 4, 1.5, None, None), ("fail", 5, 0.0, "worker panicked", None)]
    assert run_fold(fold, again)[0][:4] == ("failed", 2, 1.5, 0)
    late = events[:2] + [("cancel", 3, 0.0, None, None), ("done", 4, 0.0, None, None)]
    assert run_fold(fold, late)[0][0] == "cancelled"


def test_settle():
    seen = lambda poll, size: (poll, "seen", size, 0)
    fold = folds.Settle(2)
    assert run_fold(fold, [seen(0, 5), seen(1, 5), seen(2, 5), seen(3, 5)]) == []
    assert run_fold(fold, [seen(1, 5), seen(2, 5), seen(3, 5)]) == [(3,)]
    assert run_fold(fold, [seen(1, 5), seen(2, 6), seen(3, 6), seen(4, 6)]) == [(4,)]
    assert run_fold(fold, [seen(1, 5), seen(2, 5), seen(4, 5), seen(5, 5)]) == []
    changed = [seen(1, 5), seen(2, 5), seen(3, 5), seen(4, 9), (5, "finished", None, None), seen(5, 9), seen(6, 9)]
    assert run_fold(fold, changed) == [(3,), (6,)]


def test_assembler_modes():
    rows = [(0, "a", False, False, False), (1, "a b", True, False, False), (2, "c", False, True, False), (3, "c", False, False, True)]
    kinds = [(r[1], r[2]) for r in run_fold(folds.Assembler("auto"), rows)]
    assert kinds == [("partial", "a"), ("partial", "a b"), ("partial", "a b c"), ("final", "a b c")]
    assert [r[1] for r in run_fold(folds.Assembler("auto", vad_attached=False), rows)][2] == "final"
    assert all(r[1] == "partial" for r in run_fold(folds.Assembler("manual"), rows))


def sequential_draws(count, n):
    state, out = SEED, []
    for _ in range(count):
        state = (state * MULTIPLIER + 1) & MASK
        out.append((state >> 32) % n)
    return out


def test_generator_jumps():
    assert draw_indices(0, 500, 37).tolist() == sequential_draws(500, 37)
    assert draw_indices(123, 200, 37).tolist() == sequential_draws(323, 37)[123:]


@pytest.mark.parametrize("limit", [1000, 5])
def test_bootstrap_equals_sequential(spark, monkeypatch, limit):
    rng = random.Random(3)
    rows = [("a", i, rng.randint(1, 9), rng.randint(0, 4)) for i in range(40)] + [("b", i, 2, i % 3) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, i bigint, ref_words bigint, errors bigint").repartition(3)
    out = bootstrap_sums(df, ["g"], ["i"], F.floor(F.col("i") / 8), ["ref_words", "errors"], iterations=60, max_group=limit)
    found = {(r["g"], r["replicate"]): (r["ref_words"], r["errors"]) for r in out.collect()}
    for g in "ab":
        mine = [r for r in rows if r[0] == g]
        draws = sequential_draws(60 * len(mine), len(mine))
        for rep in range(60):
            picks = [mine[d] for d in draws[rep * len(mine) : (rep + 1) * len(mine)]]
            assert found[(g, rep)] == (sum(p[2] for p in picks), sum(p[3] for p in picks))


def test_interval_of_equal_rows(spark):
    df = spark.createDataFrame([(i, 10, 1) for i in range(20)], "i bigint, ref_words bigint, errors bigint")
    assert tuple(wer_interval(df, [], ["i"], F.floor(F.col("i") / 8)).first()) == (10.0, 10.0)


def test_percentiles_equal_interpolation(spark):
    rng = random.Random(9)
    rows = [("a", rng.choice([1.0, 1.0, rng.uniform(0, 1e6), rng.uniform(0, 1e-3)])) for _ in range(301)] + [("b", 5.0), ("c", None)]
    out = percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], F.col("v"), {"p50": 0.5, "p95": 0.95})
    found = {r["g"]: r for r in out.collect()}
    assert set(found) == {"a", "b"}
    ordered = sorted(v for g, v in rows if g == "a")
    for name, p in (("p50", 0.5), ("p95", 0.95)):
        rank = 300 * p
        lo = int(rank)
        want = ordered[lo] * (1 - (rank - lo)) + ordered[min(lo + 1, 300)] * (rank - lo)
        assert found["a"][name] == pytest.approx(want, rel=1e-12)
    assert (found["b"]["n"], found["b"]["p95"], found["a"]["max"]) == (1, 5.0, ordered[-1])
    median = order_statistic(spark.createDataFrame(rows, "g string, v double"), ["g"], F.col("v"), F.floor(F.col("n") / 2), "m")
    assert {r["g"]: r["m"] for r in median.collect()}["a"] == ordered[150]


def test_ttfp_percentile_golden(spark):
    rows = spark.createDataFrame([(400.0,), (800.0,), (1200.0,), (None,)], "ttfp double")
    found = percentiles(rows, [], F.col("ttfp"), {"p50": 0.5}).first()
    assert (found["n"], found["p50"]) == (3, 800.0)


def brute_blocks(seconds, target, lo, hi):
    best = (float("inf"), None)

    def grow(at, cost, plan):
        nonlocal best
        if at == len(seconds):
            best = min(best, (cost, plan), key=lambda x: x[0])
            return
        for end in range(at + 1, len(seconds) + 1):
            size = sum(seconds[at:end])
            if lo - 1e-6 <= size <= hi + 1e-6:
                grow(end, cost + (size - target) ** 2, [*plan, (at, end)])

    grow(0, 0.0, [])
    return best


def check_plan(seconds, plan):
    cost, want = brute_blocks(seconds, 15.0, 8.0, 20.0)
    assert bool(plan) == (want is not None)
    if plan:
        assert sum((sum(seconds[a:b]) - 15.0) ** 2 for a, b in plan) == pytest.approx(cost)
        assert [a for a, _ in plan] == [0, *[b for _, b in plan[:-1]]] and plan[-1][1] == len(seconds)


@pytest.mark.parametrize("seed", range(40))
def test_blocks_are_optimal(seed):
    rng = random.Random(seed)
    seconds = [float(rng.randint(1, 12)) for _ in range(rng.randint(1, 9))]
    pointers = run_fold(Forward(15.0, 8.0, 20.0), [(s,) for s in seconds])
    check_plan(seconds, sorted((a - 1, b) for a, b in run_fold(Backward(), pointers[::-1])))


def test_blocks_of_many_recordings(spark):
    rng = random.Random(1)
    data = {k: [float(rng.randint(1, 12)) for _ in range(rng.randint(1, 9))] for k in range(12)}
    rows = [(k, 10 * i, s) for k, seconds in data.items() for i, s in enumerate(seconds)]
    out = balanced_blocks(spark.createDataFrame(rows, "k int, seg bigint, seconds double"), ["k"], "seg", target=15.0, min_len=8.0, max_len=20.0)
    found = out.orderBy("k", "block_idx").collect()
    for k, seconds in data.items():
        check_plan(seconds, [(r["first_segment"] // 10, r["last_segment"] // 10 + 1) for r in found if r["k"] == k])
