"""Nearest neighbours, importance resampling and the source audit against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from voxlake.llm import divergence, importance, stable_projection

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def neighbours_by_hand(rows, queries, k):
    out = {}
    for qid, q in queries:
        if q is None or any(c is None or not math.isfinite(c) for c in q) or not any(q) or qid is None:
            continue
        scores = {}
        for i, v in rows:
            if i is None or i == qid or v is None or any(c is None or not math.isfinite(c) for c in v) or not any(v):
                continue
            s = float((np.array(v[: len(q)], float) * np.array(q[: len(v)], float)).sum())
            scores[i] = max(s, scores.get(i, -math.inf))
        out[qid] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def run_nearest(spark, rows, queries, **more):
    data = spark.createDataFrame(rows, "vec_id long, vector array<double>").selectExpr("*", "'x' AS cell", "1 AS block", "2 AS bound")
    asked = spark.createDataFrame(queries, "query_id long, vector array<double>").selectExpr("*", "'x' AS home_cell", "3 AS vec_id")
    out = defaultdict(list)
    for r in stable_projection.nearest(data.repartition(3), asked, **more).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_nearest_recall(spark, monkeypatch):
    monkeypatch.setattr(stable_projection, "BLOCK_ROWS", 150)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 24))
    x = centres[rng.integers(0, 12, 1500)] + 0.3 * rng.standard_normal((1500, 24))
    x *= rng.uniform(0.2, 3, (1500, 1))  # norms far apart
    x[700:1100] = x[700]  # copies of one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = neighbours_by_hand(rows, rows[::20], 10)
    got = run_nearest(spark, rows, rows[::20], k=10)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.95 * 10 * len(want)
    exact = dict(rows)
    assert all(abs(s - sum(a * b for a, b in zip(exact[q], exact[i]))) < 1e-9 for q in got for i, s in got[q])
    assert [i for i, _ in got[720]] == [i for i, _ in want[720]]  # hundreds of ties: the smallest ids


def test_nearest_stops_early():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.standard_normal((20, 16)), 100, 0) + 0.01 * rng.standard_normal((2000, 16))
    p = stable_projection.Projection(16, float((x * x).sum(1).max()), 8, 1)
    index = stable_projection.BlockIndex(np.arange(2000), x, p, stable_projection.chi_square_quantile(0.95, 8), 5)
    seen = []
    plain = stable_projection.inner
    try:
        stable_projection.inner = lambda rows, q: seen.append(len(rows)) or plain(rows, q)
        index.search(0, x[0], p.queries(x[:1])[0], -math.inf)
    finally:
        stable_projection.inner = plain
    assert sum(seen) < 1000


def test_chi_square_quantile():
    # Fixed values of the chi-square table.
    for p, dims, x in [(0.95, 2, 5.991465), (0.95, 8, 15.507313), (0.99, 12, 26.216967)]:
        assert abs(stable_projection.chi_square_quantile(p, dims) - x) < 1e-5


def test_nearest_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [math.nan, 1.0]), (6, [math.inf, 1.0]), (7, [None, 1.0]),
            (None, [9.0, 9.0]), (8, [2.0]), (9, [1.0, 1.0, 1.0]), (9, [5.0, 0.0]), (10, [])]
    got = run_nearest(spark, rows, rows, k=3)
    assert dict(got) == neighbours_by_hand(rows, [(i, v) for i, v in rows if i != 9], 3) | {9: got[9]}
    assert got[9] == [(8, 10.0), (1, 5.0), (2, 5.0)]  # the best of both vectors
    assert run_nearest(spark, [], rows) == {} and run_nearest(spark, rows, []) == {}
    assert run_nearest(spark, rows[:1], rows[:1]) == {}


def resample_by_hand(pairs, target, n, buckets, percent, least, seed):
    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = (Counter(b for x in texts for b in grams(x)[1]) for texts in ([x for _, x in pairs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out, fit = [], []
    for i, x in pairs:
        w, g = grams(x)
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(w) >= least:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_resampling(spark, docs, n, monkeypatch):
    monkeypatch.setattr(importance, "MEMO_WORDS", 20)
    rng = random.Random(n)
    pool = ["Alpha", "beta", "beta", "été", "x1", "漢字", "z-z", "\x00", "O'Neil"] + [f"w{i}" for i in range(40)]
    pairs = [(i, rng.choice([" ", "\n", ", "]).join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    target = [" ".join(rng.choice(pool[:9]) for _ in range(30)) for _ in range(5)] + [None, ""]
    got = importance.resample(docs(pairs), spark.createDataFrame([(t,) for t in target], "text string"), n, 500, 30, 10, 11)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == resample_by_hand(pairs, target, n, 500, 30, 10, 11)


def test_ranks_over_many_partitions(spark, docs):
    pairs = [(i % 150, "a b c " * 5) for i in range(300)] + [(None, "a b c d") for _ in range(200)]
    got = importance.resample(docs(pairs), docs([]).select("text"), percent=100, least_words=1).collect()
    assert sorted(r.rank for r in got) == list(range(1, 501))
    by = sorted(got, key=lambda r: r.rank)
    assert all((-a.score, a.doc_id is None, a.doc_id or 0) <= (-b.score, b.doc_id is None, b.doc_id or 0) for a, b in zip(by, by[1:]))


def test_resampling_of_odd_rows(odd_docs, docs):
    got = importance.resample(odd_docs, odd_docs.select("text"), percent=50).collect()
    assert len(got) == 14 and sum(r.rank is not None for r in got) == 1  # of the two texts of many words
    assert {r.n_features for r in got if r.doc_id in (0, 1, 2, 3, 4, 5)} == {0}
    assert importance.resample(docs([]), docs([])).collect() == []


def audit_by_hand(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(UPPER)) for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        df, count = Counter(), defaultdict(Counter)
        for (_, at, source), w in zip(rows, words):
            if at == lang:
                df.update(set(w))
                count[source].update(w)
        kept = [t for t, n in df.items() if n >= least]
        everything = sum((Counter({t: c[t] for t in kept}) for c in count.values()), Counter())

        def p(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        own, q = {s: p(c) for s, c in count.items()}, p(everything)
        for s in own:
            pairs = [(sum(abs(own[s][t] - own[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(own[s][t] - q[t], t) for t in kept if count[s][t] and own[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


SOURCED = "text string, lang string, source string"


def sourced(spark, rows, parts=7):
    return spark.createDataFrame(rows, SOURCED).selectExpr("*", *(f"'x' AS {c}" for c in "term run shard base total place low part".split())).repartition(parts)


@pytest.mark.parametrize("small", [False, True])
def test_audit(spark, monkeypatch, small):
    if small:  # spills in the middle, many chunks, several merge passes, several blocks of sources and parts of terms
        for name, value in {"BLOCK_POSTINGS": 60, "CHUNK_TERMS": 3, "FAN_IN": 3, "PAIR_SOURCES": 2, "PAIR_POSTINGS": 40}.items():
            monkeypatch.setattr(divergence, name, value)
    rng = random.Random(9)
    pool = ["Alpha", "beta", "été", "Éte", "漢字", "a1b", "x"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for _ in range(150):
        source = rng.choice(["s1", "s2", "s3", None, "é"])
        text = " ".join(rng.choice(pool[: 27 if source == "s1" else 12]) for _ in range(rng.randint(0, 25)))
        rows.append((rng.choice([text, text, text, None, ""]), rng.choice(["en", "de", None]), source))
    rows += [("only here", "xx", "s9"), (None, "xx", "s8"), ("one source", "yy", "s1")]
    got = divergence.audit(sourced(spark, rows), least_docs=6, top=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audit_by_hand(rows, 6, 4)


def test_audit_of_odd_rows(spark):
    rows = [(None, None, None), ("", "", ""), ("word " * 30_000, "en", "a"), ("x" * 50_000, "en", "b"), ("word", "en", "b"), ("word", "en", "b")]
    assert sorted(map(tuple, divergence.audit(sourced(spark, rows), 1).collect())) == audit_by_hand(rows, 1, 50)
    assert divergence.audit(sourced(spark, rows), 9).filter("value != 0").collect() == []
    assert divergence.audit(sourced(spark, [])).collect() == []


def test_shares_are_exact_beyond_64_bits():
    big = 10**12 + 7
    assert divergence.shares(np.array([0, 3, 10**11]), big, 1000).tolist() == [1 + 10**9 * (c + 5) // (big + 5000) for c in (0, 3, 10**11)]
