"""Whole pipelines without SQL, against sequential code on a small fixture or the smallest tables."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_scoring import table_split
from tests.test_signals import run_fold, sequential_draws
from voxlake.functions.text import normalize_for_wer, normalize_verbatim
from tests.sequential_blocks import Backward, Forward
from voxlake.plans import catalog, pipelines
from voxlake.plans.relations import utterances

SF_DIR = "/root/testdata/sf0.001"


def interval(pairs):
    draws, n, rates = sequential_draws(1000 * len(pairs), len(pairs)), len(pairs), []
    for r in range(1000):
        picks = [pairs[d] for d in draws[r * n : (r + 1) * n]]
        ref, err = sum(p[0] for p in picks), sum(p[1] for p in picks)
        rates.append(err / ref * 100.0 if ref else 0.0)
    rates.sort()
    return rates[25], rates[975]


def test_rescore_equals_sequential(spark):
    rng = random.Random(2)
    words = "два тысячи пять 3 000 ₽ мир привет, tv плюс".split()
    rows = [(d, i, *(" ".join(rng.choices(words, k=rng.randint(0, 7))) for _ in "rh")) for d in "ab" for i in range(9)]
    df = spark.createDataFrame(rows, "dataset string, i bigint, reference string, hypothesis string")
    out = {r["dataset"]: r for r in pipelines.rescore(df, ["dataset"], "i", F.floor(F.col("i") / 4)).collect()}
    tokens = {}
    for name, fn in (("", normalize_for_wer), ("naive_", normalize_verbatim)):
        for r in df.select("dataset", "i", fn(F.col("reference")).alias("r"), fn(F.col("hypothesis")).alias("h")).orderBy("i").collect():
            tokens.setdefault((r["dataset"], name), []).append((len(r["r"]), table_split(r["r"], r["h"])[0]))
    for (dataset, name), pairs in tokens.items():
        ref, err = sum(p[0] for p in pairs), sum(p[1] for p in pairs)
        got = out[dataset]
        assert (got[f"{name}ref_words"], got[f"{name}errors"]) == (ref, err)
        assert got[f"{name}wer"] == pytest.approx(err / ref * 100.0)
        assert (got[f"{name}ci_low"], got[f"{name}ci_high"]) == pytest.approx(interval(pairs))


def test_block_scores_equal_sequential(spark):
    recordings = {}
    for r in utterances(spark, SF_DIR).orderBy("conv_id", "turn").collect():
        recordings.setdefault(r["conv_id"], []).append((r["ref"], r["hyp"]))
    want = {}
    for conv, pairs in recordings.items():
        pointers = run_fold(Forward(15.0, 0.0, 40.0), [(len(ref) * 0.4,) for ref, _ in pairs])
        for n, (first, last) in enumerate(sorted(run_fold(Backward(), pointers[::-1]))):
            splits = [table_split(*p)[1] for p in pairs[first - 1 : last]]
            words = sum(len(ref) for ref, _ in pairs[first - 1 : last])
            want[(conv, n)] = (*(sum(s[i] for s in splits) for i in range(3)), words)
    found = catalog.QUERIES["sg08_block_scores"](spark, SF_DIR).collect()
    assert {(r["conv_id"], r["block_idx"]): (r["sub"], r["ins"], r["del"], r["ref_words"]) for r in found} == want


def test_token_histogram_adds_up(spark):
    tokens = catalog.QUERIES["tx21_subword_tokens"](spark, SF_DIR).agg(F.sum("n")).first()[0]
    counts = catalog.QUERIES["tx21_subword_counts"](spark, SF_DIR).agg(F.sum("n_tokens")).first()[0]
    assert tokens == counts > 0


def test_readable_text_of_windows_shuffles_stretches(spark):
    """Over the edge of a part, with failed windows and labels too few; no join and no row per word."""
    said = [f"w{i}" for i in range(66_000)]
    said[210 * 5] = said[210 * 312] = "stop"

    def make():
        def label(words):
            if words[0] == "stop":
                raise RuntimeError("no labels")
            return ["UPPER_COMMA" if w.endswith("7") else "LOWER_O" for w in words][:240]

        return label

    wanted = []
    last = -(-(len(said) - 250) // 210)
    for i, word in enumerate(said):
        window = 0 if i < 230 else min((i - 20) // 210, last)
        labelled = said[window * 210] != "stop" and i - window * 210 < 240
        wanted.append(word.capitalize() + "," if labelled and word.endswith("7") else word)
    df = spark.createDataFrame([(1, " ".join(said)), (2, "a b7"), (3, ""), (4, None)], "k long, text string")
    out = pipelines.restore_readable(df, ["k"], make, itn=False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    rows = {(r["k"], r["part"]): r["text"] for r in out.collect()}
    assert rows == {(1, 0): " ".join(wanted[:65536]), (1, 1): " " + " ".join(wanted[65536:]), (2, 0): "a B7,"}
