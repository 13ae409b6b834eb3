"""Results do not change with size, and nothing is cut."""

from pyspark.sql import functions as F

from voxlake.functions.predicates import is_address
from voxlake.functions.table_functions import register_sql
from voxlake.operators import captions, telemetry, windows, words
from voxlake.operators.scans import whole_text

N = 70_000


def test_long_recordings_are_whole(spark):
    rows = spark.range(N).select(
        F.lit("r").alias("recording_id"), F.col("id").alias("word_idx"), F.concat(F.lit("w"), F.col("id")).alias("word"),
        F.col("id").cast("double").alias("start"), (F.col("id") + 0.5).alias("end"), F.lit(0.5).alias("confidence"), F.lit(0).alias("speaker"),
    )
    said = " ".join(f"w{i}" for i in range(N))
    assert whole_text(captions.render_txt(rows, ["recording_id"]), ["recording_id"], "document").first()["document"] == said
    markdown = captions.render_markdown(rows, ["recording_id"]).orderBy("section", "part").collect()
    assert "".join(r["document"] for r in markdown).endswith(f"# Transcript\n\n{said}\n\n")
    merged = words.merge_channels(rows, ["recording_id"]).orderBy("part").collect()
    assert "".join(r["text"] for r in merged) == said


def test_pieces_keep_the_space_at_a_part_s_edge(spark):
    vocab = spark.createDataFrame([(0, "▁a"), (1, "b")], "token_id int, piece string")
    ids = spark.range(N).select(F.lit(1).alias("k"), F.col("id").alias("tok_idx"), (F.col("id") % 2).cast("int").alias("token_id"))
    parts = words.ids_to_text(ids, vocab, ["k"], blank_id=9).orderBy("part").collect()
    assert len(parts) == 2 and "".join(r["text"] for r in parts) == " ".join(["ab"] * (N // 2))


def test_windows_that_are_no_whole_steps(spark):
    events = spark.range(200).select(F.lit("p").alias("path"), F.timestamp_seconds(F.col("id")).alias("ts"))
    got = {r["eval_s"]: (r["n"], r["rate"]) for r in telemetry.event_rate(events, ["path"], window_s=50, step_s=20).collect()}
    assert got[100] == (50, 1.0) and got[20] == (20, 0.4) and got[240] == (10, 0.2) and set(got) == set(range(20, 241, 20))
    sparse = {r["eval_s"]: r["n"] for r in telemetry.event_rate(events, ["path"], window_s=10, step_s=25).collect()}
    assert sparse == {25 * k: 10 for k in range(1, 9)}


def test_a_gap_resets_an_alert(spark):
    rows = [("p", s, True) for s in (0, 60, 120, 180, 240, 300, 360, 36_000, 36_060)]
    frame = spark.createDataFrame(rows, "path string, eval_s bigint, firing boolean")
    got = windows.sustained(frame, ["path"], for_seconds=300, step_s=60).filter("alert").collect()
    assert sorted(r["eval_s"] for r in got) == [300, 360]


def test_window_functions_in_sql(spark):
    register_sql(spark)
    plan = windows.audio_windows(spark.createDataFrame([(1, 2_000_000), (2, 480_000), (3, 1)], "id int, total bigint"), "total")
    want = {(r["id"], r["chunk_id"], r["start_sample"], r["end_sample"]) for r in plan.collect()}
    spark.createDataFrame([(1, 2_000_000), (2, 480_000), (3, 1), (4, 0), (5, None)], "id int, total bigint").createOrReplaceTempView("t")
    got = spark.sql("SELECT id, chunk_id, start_sample, end_sample FROM t, LATERAL audio_windows(total)").collect()
    assert {tuple(r) for r in got} == want


def test_addresses(spark):
    good = ["1.2.3.4", "::", "::1", "1::", "fe80::1:2", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::ffff:10.0.0.1", "1:2:3:4:5:6:1.2.3.4"]
    bad = ["", ":", ":::", "1::2::3", "1:2:3", "1:2:3:4:5:6:7:8:9", "::12345", "1.2.3", "256.1.1.1", "::1.2.3.300", "g::1", "1:2:3:4:5:6:7:8::", None]
    rows = spark.createDataFrame([(a,) for a in [*good, *bad]], "a string").select("a", is_address(F.col("a")).alias("ok")).collect()
    assert [r["a"] for r in rows if r["ok"]] == good
