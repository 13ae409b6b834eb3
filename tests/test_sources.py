import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from voxlake.operators import audio, corpus, vocab
from voxlake.sources import files, manifests, messages, sinks


def test_object_and_list_manifests(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"dataset": "d", "audio_root": "/root/audio/", "samples": [
        {"filename": "x.wav", "reference": "one", "duration": 1.5}, {"filename": "/abs/y.wav", "reference": " "}]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps([{"filename": "z.wav", "reference": "two"}]))
    rows = manifests.read_manifest(spark, str(tmp_path))
    kept, counts = manifests.drop_empty_references(rows, ["manifest"])
    found = sorted((r["filename"], r["reference"], r["duration"]) for r in kept.collect())
    assert found == sorted([(f"{tmp_path}/z.wav", "two", None), ("/root/audio/x.wav", "one", 1.5)])
    assert sum(r["skipped_empty_refs"] for r in counts.collect()) == 1


def test_other_manifests_raise(spark, tmp_path):
    (tmp_path / "c.json").write_text("{broken")
    with pytest.raises(PySparkException):
        manifests.read_manifest(spark, str(tmp_path)).select("dataset", "filename").collect()


def test_wav_header_with_odd_chunk(spark):
    def pack(v, n):
        return int(v).to_bytes(n, "little")

    fmt = b"fmt " + pack(16, 4) + pack(1, 2) + pack(2, 2) + pack(8000, 4) + pack(32000, 4) + pack(4, 2) + pack(16, 2)
    odd = b"LIST" + pack(3, 4) + b"abc\0"
    wav = b"RIFF" + pack(0, 4) + b"WAVE" + odd + fmt + b"data" + pack(40, 4) + bytes(40)
    df = spark.createDataFrame([(bytearray(wav),), (bytearray(b"RIFFxxxx"),), (None,)], "content binary")
    out = [tuple(r["h"]) for r in df.select(files.wav_header(F.col("content")).alias("h")).collect()]
    assert out == [(8000, 2, 10), (None, None, None), (None, None, None)]


def test_pcm_frames(spark):
    df = spark.createDataFrame([("a", bytearray(11200)), ("b", bytearray(b""))], "id string, pcm binary")
    sizes = [len(r["frame"]) for r in files.pcm_frames(df, "pcm").orderBy("chunk_idx").collect()]
    assert sizes == [3200, 3200, 3200, 1600]


def test_discovery(spark, tmp_path):
    for name in ("a.WAV", "sub/b.mp3", "sub/c.txt", "done/d.wav"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x")
    listing = files.list_files(spark, str(tmp_path)).withColumn("path", F.regexp_replace("path", "^file:", ""))
    found = [r["path"] for r in files.audio_files(listing, exclude=f"{tmp_path}/done").collect()]
    assert found == [f"{tmp_path}/a.WAV", f"{tmp_path}/sub/b.mp3"]


def test_stems(spark):
    df = spark.createDataFrame([("/a/b.tar.gz",), ("c",), ("/x/.wav",)], ["p"])
    assert [r[0] for r in df.select(sinks.output_name(F.col("p"), "srt")).collect()] == ["b.tar.srt", "c.srt", ".wav.srt"]


def test_messages_skip_garbage(spark):
    lines = ['{"type":"partial","text":"a"}', "nonsense", '{"type":"other"}', '{"type":"final","text":""}', "[1]"]
    out = messages.parse_messages(spark.createDataFrame([(x,) for x in lines], ["value"]))
    assert sorted(r["type"] for r in out.collect()) == ["final", "partial"]


def test_pcm_decode_over_odd_chunks(spark):
    values = np.array([1, -2, 300, -32768, 32767, 5], dtype="<i2")
    raw = values.tobytes()
    cuts = [raw[0:3], b"", raw[3:4], raw[4:9], raw[9:12]]
    df = spark.createDataFrame([("r", i, bytearray(c)) for i, c in enumerate(cuts)], "recording_id string, chunk_idx bigint, content binary")
    out = audio.decode_pcm16(df, ["recording_id"]).orderBy("start_sample").collect()
    assert [round(x * 32768) for r in out for x in r["samples"]] == values.tolist()


def test_mel_blocks_equal_whole_signal(spark):
    rng = np.random.default_rng(1)
    signal = rng.normal(size=2000).astype("float32")
    df = spark.createDataFrame([("r", s, signal[s : s + 333].tolist()) for s in range(0, 2000, 333)], "recording_id string, start_sample bigint, samples array<float>")
    blocks = audio.sample_blocks(df, ["recording_id"], size=480)
    out = audio.mel_features(blocks, ["recording_id"], size=480).orderBy("frame").collect()
    whole = audio.mel_frames(signal)
    assert [r["frame"] for r in out] == list(range(len(whole))) and len(whole) == (2000 - 320) // 160 + 1
    np.testing.assert_allclose(np.array([r["mel"] for r in out]), whole, atol=1e-4)


def test_mel_rows_are_handed_on_in_arrow_batches(spark):
    rng = np.random.default_rng(2)
    signals = {("a", 1): rng.normal(size=900), ("a", 2): rng.normal(size=100), (None, 3): rng.normal(size=1700)}
    rows = [(k, c, s, x[s : s + 400].astype("float32").tolist()) for (k, c), x in signals.items() for s in range(0, len(x), 400)]
    df = spark.createDataFrame(rows, "recording_id string, channel int, start_sample bigint, samples array<float>")
    keys = ["recording_id", "channel"]
    out = audio.mel_features(audio.sample_blocks(df, keys, size=480), keys, size=480)
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = out.orderBy("frame").collect()
    for (k, c), x in signals.items():
        whole = audio.mel_frames(x.astype("float32"))
        mine = [r for r in got if (r["recording_id"], r["channel"]) == (k, c)]
        assert [r["frame"] for r in mine] == list(range(len(whole)))
        np.testing.assert_allclose(np.array([r["mel"] for r in mine]), whole, atol=1e-4)


def test_resample_doubles():
    assert audio.resample_line(np.array([0.0, 1.0, 2.0]), 8000).tolist() == [0, 16383, 32767, 32767, 32767, 32767]


def test_model_failures_stay_rows(spark):
    class Model:
        calls = 0

        def __call__(self, text):
            Model.calls += 1
            if text == "bad" or (text == "flaky" and Model.calls < 2):
                raise ValueError("no")
            return text.upper(), 0.5

    df = spark.createDataFrame([("good",), ("bad",)], ["t"]).coalesce(1)
    out = corpus.transcribe_table(df, Model, engine="e", content="t", columns=["t"], retries=1)
    assert sorted((r["text"], r["status"], r["attempts"]) for r in out.collect()) == [("", "failed", 2), ("GOOD", "processed", 1)]


def test_subwords(spark):
    known = {p: i for i, p in enumerate(["[UNK]", "при", "##вет", "##в", "мир", "!", "中"])}
    df = spark.createDataFrame([(1, "привет мир!​ при中x"), (2, "")], "id int, t string")
    out = vocab.subword_tokens(df, "id", "t", known).orderBy("position").collect()
    assert [(r["word_idx"], r["token_id"]) for r in out] == [(0, 1), (0, 2), (1, 4), (2, 5), (3, 1), (4, 6), (5, 0)]


def test_phrase_pieces(spark):
    known = {"<blk>": 0, "<unk>": 1, "▁": 2, "п": 3, "е": 4, "тр": 5, "т": 6, "р": 7}
    df = spark.createDataFrame([("Пётр",), ("xyz",), ("т р",)], ["p"])
    out = [(r["f"]["pieces"], r["f"]["spelling"]) for r in df.select(vocab.phrase_to_pieces(F.col("p"), known).alias("f")).collect()]
    assert out == [([2, 3, 4, 5], "петр"), (None, None), ([2, 6, 2, 7], "т р")]
