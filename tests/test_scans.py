"""Block-wise scans, spans and stitching against plain sequential code, with blocks far smaller than the keys."""

import random

import pytest
from pyspark.sql import functions as F

from voxlake.operators import words as ops
from voxlake.operators.scans import gather_text, index_block, islands, scan
from voxlake.operators.spans import Limit, greedy_spans


def series(seed, keys=3, n=60):
    rng = random.Random(seed)
    return [(f"k{k}", i, rng.randint(-5, 5), rng.choice([None, rng.randint(0, 9)])) for k in range(keys) for i in range(rng.randint(1, n))]


def test_scan_equals_sequential(spark):
    rows = series(1)
    df = spark.createDataFrame(rows, "k string, i bigint, v int, w int").repartition(3)
    out = scan(
        df, ["k"], ["i"], index_block("i", 7),
        sums={"total": F.col("v")}, maxima={"top": F.col("v")}, lags={"before": F.col("w")}, leads={"after": F.col("w")},
        lasts={"latest": F.col("w")}, row_number="rn",
    )
    found = {(r["k"], r["i"]): r for r in out.collect()}
    assert len(found) == len(rows)
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        total, top, latest = 0, None, None
        for p, (_, i, v, w) in enumerate(mine):
            total += v
            top = v if top is None else max(top, v)
            latest = w if w is not None else latest
            got = found[(k, i)]
            assert (got["total"], got["top"], got["latest"], got["rn"]) == (total, top, latest, p + 1)
            assert got["before"] == (mine[p - 1][3] if p else None)
            assert got["after"] == (mine[p + 1][3] if p + 1 < len(mine) else None)


def test_totals_reach_every_row(spark):
    df = spark.createDataFrame(series(3), "k string, i bigint, v int, w int")
    out = scan(df, ["k"], ["i"], index_block("i", 4), totals={"top": (F.max, F.col("v")), "all": (F.sum, F.col("v"))})
    want = {r["k"]: (r["t"], r["s"]) for r in df.groupBy("k").agg(F.max("v").alias("t"), F.sum("v").alias("s")).collect()}
    assert {(r["k"], r["top"], r["all"]) for r in out.collect()} == {(k, *v) for k, v in want.items()}


def test_micros_ignore_the_session_zone(spark):
    from voxlake.operators.scans import instant, micros

    df = spark.createDataFrame([("2024-07-01 12:00:00.123456",), ("1969-12-31 23:59:59.5",)], ["s"])
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        ts = F.col("s").cast("timestamp_ntz")
        rows = df.select(micros(ts).alias("m"), F.unix_micros(instant(ts)).alias("i")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [tuple(r) for r in rows] == [(1719835200123456, 1719835200123456), (-500000, -500000)]


def test_scan_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 0, 1), (None, 9, 2), ("a", 3, 5)], "k string, i bigint, v int")
    out = scan(df, ["k"], ["i"], index_block("i", 2), sums={"s": F.col("v")})
    assert sorted((r["k"] or "", r["i"], r["s"]) for r in out.collect()) == [("", 0, 1), ("", 9, 3), ("a", 3, 5)]


def test_islands_equal_sequential(spark):
    rows = series(2)
    df = spark.createDataFrame(rows, "k string, i bigint, v int, w int")
    out = islands(df, ["k"], ["i"], index_block("i", 5), look_back={"p": F.col("v")}, starts=F.col("v") < F.col("p"))
    found = {(r["k"], r["i"]): r["island"] for r in out.collect()}
    for k in {r[0] for r in rows}:
        island, before = 0, None
        for _, i, v, _ in [r for r in rows if r[0] == k]:
            island += before is None or v < before
            before = v
            assert found[(k, i)] == island


def test_gather_text_in_parts(spark):
    df = spark.createDataFrame([("a", i, f"w{i}") for i in range(10)], "k string, i bigint, t string").repartition(4)
    parts = gather_text(df, ["k"], ["i"], F.col("t"), " ", index="i", part_rows=4).orderBy("part").collect()
    assert "".join(p["text"] for p in parts) == " ".join(f"w{i}" for i in range(10)) and len(parts) == 3


def brute_spans(rows, most):
    """rows: (end, start, forced)."""
    spans, anchor, at = [], None, None
    for i, (end, start, forced) in enumerate(rows):
        if anchor is None or forced or end - anchor > most:
            anchor, at = start, i
        spans.append(at)
    return spans


@pytest.mark.parametrize("seed, block, jitter", [(0, 4, 0), (1, 1, 0), (2, 9, 0), (3, 6, 3), (4, 1000, 2)])
def test_greedy_spans_across_blocks(spark, seed, block, jitter):
    rng = random.Random(seed)
    data, expected = [], {}
    for k in range(4):
        t, rows = 0.0, []
        for i in range(rng.randint(1, 80)):
            t += rng.choice([0.5, 1.0, 2.5])
            start = t - rng.uniform(0, jitter)
            rows.append((start + 0.4, start, i == 0 or rng.random() < 0.04))
        expected |= {(f"k{k}", i): s for i, s in enumerate(brute_spans(rows, 7.0))}
        data += [(f"k{k}", i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "k string, i bigint, e double, s double, f boolean").repartition(3)
    out = greedy_spans(df, ["k"], "i", index_block("i", block), [Limit("e", "s", 7.0)], forced=F.col("f"))
    assert {(r["k"], r["i"]): r["span_start"] for r in out.collect()} == expected


def brute_cues(words, max_bytes, max_words):
    cues, text, start, end, speaker, count = [], "", words[0][2], words[0][3], None, 0

    def flush():
        nonlocal text
        if text:
            cues.append((start, end, text.rstrip()))
        text = ""

    for _, word, s, e, who in words:
        label = f"[SPEAKER_{who}] " if who is not None else ""
        if who != speaker:
            flush()
            start, speaker, count, text = s, who, 0, label
        size = len(word.encode()) + (len(text.encode()) + 1 if text else 0)
        if text and ((max_bytes and size > max_bytes) or (max_words and count + 1 > max_words)):
            flush()
            start, end, count, text = s, e, 0, label
        text += (" " if text and not text.endswith(" ") else "") + word
        end, count = e, count + 1
    flush()
    return cues


@pytest.mark.parametrize("seed, labelled, rows", [(0, True, 8), (1, False, 8), (2, True, 3), (3, True, 1 << 16)])
def test_caption_cues_equal_sequential(spark, monkeypatch, seed, labelled, rows):
    rng = random.Random(seed)
    who, words = None, []
    for i in range(90):
        if labelled and (i == 0 or rng.random() < 0.15):
            who = rng.choice([0, 1, 12])
        word = "".join(rng.choice("абвabc") for _ in range(rng.choice([1, 3, 6, 30])))
        words.append((i, word, i * 0.5, i * 0.5 + 0.4, who))
    monkeypatch.setattr(ops, "index_block", lambda name, n=rows: index_block(name, rows))
    df = spark.createDataFrame([("r", *w) for w in words], "recording_id string, word_idx bigint, word string, start double, end double, speaker int")
    cues = ops.number_cues(ops.caption_cues(df, ["recording_id"], max_bytes=40, max_words=6), ["recording_id"]).orderBy("cue_idx").collect()
    assert [(c["start"], c["end"], c["text"]) for c in cues] == brute_cues(words, 40, 6)


def test_caption_golden(spark):
    words = [("r", 0, "привет", 0.0, 0.5, 0), ("r", 1, "как", 0.6, 0.9, 0), ("r", 2, "дела", 1.0, 1.4, 1)]
    df = spark.createDataFrame(words, "recording_id string, word_idx bigint, word string, start double, end double, speaker int")
    cues = ops.number_cues(ops.caption_cues(df, ["recording_id"]), ["recording_id"]).orderBy("cue_idx").collect()
    assert [(c["start"], c["end"], c["text"]) for c in cues] == [(0.0, 0.9, "[SPEAKER_0] привет как"), (1.0, 1.4, "[SPEAKER_1] дела")]


def brute_stitch(chunks):
    merged = []
    for seam, words in chunks:
        if not merged:
            merged = list(words)
        else:
            merged = [w for w in merged if w[1] <= seam] + [w for w in words if w[1] > seam]
    return sorted(w[0] for w in merged)


@pytest.mark.parametrize("seed", range(6))
def test_stitch_equals_sequential(spark, seed):
    rng = random.Random(seed)
    chunk_rows, word_rows, expected = [], [], {}
    for r in range(30):
        chunks = []
        for c in range(rng.randint(1, 6)):
            seam = c * 22.0 + 1.0
            # Sparse words, so that whole chunks are empty or have words on one side of a seam only.
            starts = sorted(c * 22.0 + rng.uniform(0, 24) for _ in range(rng.choice([0, 0, 1, 2])))
            words = [(f"{c}-{n}", s) for n, s in enumerate(starts)]
            chunks.append((seam, words))
            chunk_rows.append((f"r{r}", c, seam))
            word_rows += [(f"r{r}", c, w, s) for w, s in words]
        expected[f"r{r}"] = brute_stitch(chunks)
    chunks = spark.createDataFrame(chunk_rows, "recording_id string, chunk_id bigint, seam_s double")
    words = spark.createDataFrame(word_rows, "recording_id string, chunk_id bigint, word string, start double")
    kept = ops.stitch_chunks(words, chunks, ["recording_id"]).collect()
    found = {r: sorted(w["word"] for w in kept if w["recording_id"] == r) for r in expected}
    assert found == expected


def test_natural_segment_cap(spark):
    words = [("r", i, f"w{i}", i * 0.89, i * 0.89 + 0.5, None, 0.5) for i in range(35)]
    df = spark.createDataFrame(words, "recording_id string, word_idx bigint, word string, start double, end double, speaker int, confidence double")
    out = ops.natural_segments(df, ["recording_id"]).orderBy("segment_start").collect()
    assert [r["n_words"] for r in out] == [34, 1]
