import random

import pytest
from pyspark.sql import functions as F

from voxlake.functions.distance import edit_distance, error_split
from voxlake.operators import gates, scoring, telemetry


def table_split(ref, hyp):
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(hyp) + 1)] for i in range(len(ref) + 1)]
    for i in range(1, len(ref) + 1):
        for j in range(1, len(hyp) + 1):
            same = ref[i - 1] == hyp[j - 1]
            d[i][j] = d[i - 1][j - 1] if same else 1 + min(d[i - 1][j - 1], d[i - 1][j], d[i][j - 1])
    i, j, sub, ins, dele = len(ref), len(hyp), 0, 0, 0
    while i or j:
        if i and j and ref[i - 1] == hyp[j - 1]:
            i, j = i - 1, j - 1
        elif i and j and d[i][j] == d[i - 1][j - 1] + 1:
            sub, i, j = sub + 1, i - 1, j - 1
        elif j and d[i][j] == d[i][j - 1] + 1:
            ins, j = ins + 1, j - 1
        else:
            dele, i = dele + 1, i - 1
    return d[-1][-1], (sub, ins, dele)


@pytest.mark.parametrize("seed", range(200))
def test_distance_and_split(seed):
    rng = random.Random(seed)
    ref, hyp = ([rng.choice("abcd") for _ in range(rng.randint(0, 90 if seed % 9 == 0 else 12))] for _ in range(2))
    distance, split = table_split(ref, hyp)
    assert edit_distance(ref, hyp) == distance and error_split(ref, hyp) == split and sum(split) == distance


def test_phone_number_scores_clean(spark):
    from voxlake.functions.text import normalize_for_wer

    row = spark.createDataFrame([("семь девятьсот девятнадцать триста тридцать пять восемьдесят девять тридцать один", "+79193358931")], ["r", "h"])
    scored = scoring.score_pairs(row.select(normalize_for_wer(F.col("r")).alias("ref"), normalize_for_wer(F.col("h")).alias("hyp"))).first()
    assert scored["errors"] == 0


def test_paired_golden(spark):
    cols = "file string, sample_idx bigint, errors bigint, ref_words bigint"
    batch = spark.createDataFrame([("a", 0, 9, 10), ("a", 1, 1, 10), ("b", 2, 0, 10)], cols)
    stream = spark.createDataFrame([("a", 0, 2, 10), ("b", 1, 1, 0), ("c", 2, 7, 10)], cols)
    out = scoring.paired_summary(scoring.paired_delta(batch, stream, ["file"]), []).first()
    assert (out["paired"], out["wer_batch"], out["wer_stream"], out["delta_pp"]) == (2, 5.0, 15.0, 10.0)


def test_empty_histogram_buckets(spark):
    rows = spark.createDataFrame([("e", 2.0, 4, 1, 25.0)], "engine string, audio_sec double, ref_words bigint, errors bigint, wer double")
    out = scoring.histograms(rows, ["engine"]).collect()
    assert len(out) == 14 and sum(r["samples"] for r in out) == 3


def test_histogram_golden(spark):
    df = spark.createDataFrame([(v,) for v in (0.001, 0.03, 0.3, 1.5)], ["v"])
    rows = telemetry.histogram_rows(telemetry.cumulative_histogram(df, [], F.col("v")), [])
    found = {r["le"]: r["n"] for r in rows.collect()}
    assert (found["0.005"], found["0.05"], found["0.5"], found["+Inf"]) == (1, 2, 3, 4)


def test_label_order_does_not_matter(spark):
    df = spark.createDataFrame([({"b": "2", "a": "1"}, 2), ({"a": "1", "b": "2"}, 3)], "m map<string,string>, delta int")
    out = telemetry.counter_totals(df.withColumn("s", telemetry.label_key(F.col("m"))), ["s"]).collect()
    assert [(r["s"], r["total"]) for r in out] == [("a=1,b=2", 5)]


def test_dual_gate_rules(spark):
    schema = "freeze struct<warm_rtf_long40_best:double,warm_rtf_long40_mean:double,fixture_texts:array<string>,pool_size:int>, post struct<warm_rtf_long40_best:double,warm_rtf_long40_mean:double,fixture_texts:array<string>,pool_size:int>"
    names = ["warm_rtf_long40_best", "warm_rtf_long40_mean", "fixture_texts"]

    def failed(freeze, post):
        df = spark.createDataFrame([(freeze, post)], schema)
        return sorted(r["rule"] for r in gates.dual_gate(df, names, protocol=["pool_size"]).collect())

    assert failed((0.03, 0.03, ["a"], 1), (0.029, 0.03, ["a"], 1)) == []
    assert failed((0.03, 0.03, ["a"], 1), (0.03, 0.04, ["b"], 2)) == ["protocol:pool_size", "quality:fixture_text", "rtf:best_improved", "rtf:mean"]
    assert failed((None, None, ["a"], 1), (0.04, None, [], 1)) == ["quality:fixture_missing", "rtf:best_missing"]


def test_quantile_edges(spark):
    row = spark.createDataFrame([([0, 0, 4], 8)], "counts array<bigint>, n bigint")
    q = lambda p: row.select(telemetry.histogram_quantile(p, F.col("counts"), F.col("n"), [1.0, 2.0, 4.0]).alias("q")).first()["q"]
    assert q(0.25) == 3.0 and q(0.99) == 4.0


def plain_split(ref, hyp):
    d = [[i + j if not i or not j else 0 for j in range(len(hyp) + 1)] for i in range(len(ref) + 1)]
    for i in range(1, len(ref) + 1):
        for j in range(1, len(hyp) + 1):
            d[i][j] = min(d[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]), d[i][j - 1] + 1, d[i - 1][j] + 1)
    i, j, out = len(ref), len(hyp), [0, 0, 0]
    while i or j:
        if i and j and ref[i - 1] == hyp[j - 1]:
            i, j = i - 1, j - 1
        elif i and j and d[i][j] == d[i - 1][j - 1] + 1:
            out[0], i, j = out[0] + 1, i - 1, j - 1
        elif j and d[i][j] == d[i][j - 1] + 1:
            out[1], j = out[1] + 1, j - 1
        else:
            out[2], i = out[2] + 1, i - 1
    return tuple(out)


def test_error_split_is_that_of_the_plain_table():
    import random

    from voxlake.functions.distance import edit_distance, error_split

    rng = random.Random(8)
    for _ in range(400):
        ref, hyp = ([rng.choice("abcde") for _ in range(rng.randint(0, 40))] for _ in range(2))
        split = error_split(ref, hyp)
        assert split == plain_split(ref, hyp) and sum(split) == edit_distance(ref, hyp)


def test_error_split_of_long_texts_needs_little_memory():
    import random
    import tracemalloc

    from voxlake.functions.distance import edit_distance, error_split

    rng = random.Random(9)
    ref = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    hyp = [w if rng.random() < 0.8 else f"x{rng.randrange(50)}" for w in ref if rng.random() < 0.9] + ["more"] * 2000
    tracemalloc.start()
    split = error_split(ref, hyp)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000_000 and sum(split) == edit_distance(ref, hyp) and split[1] - split[2] == len(hyp) - len(ref)
