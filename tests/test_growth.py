"""Steps whose cost must not grow faster than the input."""

from pyspark.sql import functions as F

from voxlake.functions.expr import lookup
from voxlake.operators import windows
from voxlake.operators import words as ops
from voxlake.plans import relations


def test_a_dictionary_is_folded(spark):
    # Two words leave most cells empty. What is not constant would be built again for every key.
    rows = spark.createDataFrame([(["a", "b", "c", ""],)], ["ts"]).select(F.transform("ts", lambda t: lookup({"a": "1L", "b": "2L"}, t)).alias("x"))
    assert rows.first()["x"] == [1, 2, None, None]
    found = spark.range(1).select(lookup({"a": "1L", "b": "2L"}, F.col("id").cast("string")))
    assert "map_filter" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_text_tables_are_dealt_to_several_tasks_a_core(spark):
    cores = spark.sparkContext.defaultParallelism
    assert relations.table(spark, "/root/testdata/sf0.01", "orders").rdd.getNumPartitions() == 4 * cores


def test_labels_are_spliced_by_window(spark):
    # Windows are joined, not words: nothing of the size of the words is shuffled.
    sizes = spark.createDataFrame([(k, n) for k, n in enumerate([0, 1, 9, 10, 11, 14, 15, 47])], "k long, n long")
    plan = windows.label_windows(sizes, "n", window=10, overlap=4)
    offsets = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("end") - F.col("start") - 1), lambda o: F.col("window_idx") * 100 + o)
    labels = plan.filter("window_idx <> 1").select("k", "window_idx", offsets.alias("labels"))
    out = windows.splice_labels(plan, labels, ["k"])
    want = {}
    for k, n in [(r.k, r.n) for r in sizes.collect()]:
        for w in range(n):
            i = 0 if w < 8 else (w - 2) // 6
            i = min(i, max(-(-(n - 10) // 6), 0))
            want[k, w] = None if i == 1 else i * 100 + w - i * 6
    got = out.collect()
    assert out.columns == ["k", "word_idx", "label"] and len(got) == len(want)
    assert {(r.k, r.word_idx): r.label for r in got} == want
    assert "hashpartitioning(word_idx" not in out._jdf.queryExecution().executedPlan().toString()


def test_labels_are_not_broadcast(spark, tmp_path):
    # By the optimizer's estimate these labels are small; as arrays they are thirty times the size of their plan.
    windows.label_windows(spark.range(2000).selectExpr("id k", "1000L n"), "n").write.parquet(str(tmp_path / "plan"))
    plan = spark.read.parquet(str(tmp_path / "plan"))
    labels = plan.select("k", "window_idx", F.sequence(F.lit(0).cast("bigint"), F.col("end") - F.col("start") - 1).alias("labels"))
    out = windows.splice_labels(plan, labels, ["k"])
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "BroadcastExchange" not in text
    assert out.agg(F.count("label")).first()[0] == 2_000_000


def test_cues_take_words_once(spark):
    words = spark.createDataFrame(
        [(1, i, w, i * 1.0, i + 0.5, i // 3) for i, w in enumerate(["a", None, "b" * 90, "c" * 90, None, "d"])],
        "recording_id long, word_idx long, word string, start double, end double, speaker int",
    )
    cues = ops.caption_cues(words, ["recording_id"])
    assert "Union" not in cues._jdf.queryExecution().optimizedPlan().toString()
    got = [(r.cue_start, r.cue_part, r.end, r.text) for r in cues.orderBy("cue_start", "cue_part").collect()]
    assert (3, 0, 2.5, "[SPEAKER_1]") in got and (3, 1, 3.5, "[SPEAKER_1] " + "c" * 90) in got
