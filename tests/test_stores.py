"""Data sources in Python: WAV headers by seeking, document files with a commit, growing message logs."""

import io
import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from voxlake.operators import captions
from voxlake.sources import files
from voxlake.plans import catalog
from voxlake.sources import document_files
from voxlake.sources.document_files import Written, read_files, write_files
from voxlake.sources.message_log import read_message_log, whole_lines
from voxlake.sources.wav_headers import read_wav_headers, walk_chunks


def chunk(name, body, size=None):
    n = len(body) if size is None else size
    return name + struct.pack("<I", n) + body + b"\0" * (len(body) % 2)


def form(rate=16000, channels=1, bits=16):
    return chunk(b"fmt ", struct.pack("<HHIIHH", 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits))


def wav(*chunks):
    body = b"WAVE" + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


CASES = {
    "plain": (wav(form(), chunk(b"data", b"\0" * 320)), (16000, 1, 160)),
    "megabyte": (wav(chunk(b"LIST", b"x" * (1 << 20)), form(8000, 2), chunk(b"data", b"\0" * 400)), (8000, 2, 100)),
    "odd": (wav(chunk(b"LIST", b"xyz"), form(), chunk(b"data", b"\0" * 4)), (16000, 1, 2)),
    "data first": (wav(chunk(b"data", b"\0" * 640), chunk(b"LIST", b"z" * 9001), form(44100, 2, 24)), (44100, 2, 106)),
    "many": (wav(*[chunk(b"junk", b"ab")] * 3000, form(), chunk(b"data", b"\0" * 20)), (16000, 1, 10)),
    "cut off": (wav(form(), chunk(b"data", b"\0" * 20, size=32000)), (16000, 1, 16000)),
    "no data": (wav(form()), None),
    "no format": (wav(chunk(b"data", b"\0" * 20)), None),
    "no rate": (wav(form(rate=0), chunk(b"data", b"\0" * 20)), None),
    "other": (b"OggS" + b"\0" * 60, None),
    "empty": (b"", None),
}


def test_wav_headers(spark, tmp_path):
    for name, (content, _) in CASES.items():
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "a.WAV").write_bytes(content)
    (tmp_path / "in" / "text.txt").write_text("RIFF")
    got = read_wav_headers(spark, f"file://{tmp_path}/in", files_per_task=3)
    assert got.rdd.getNumPartitions() == 4
    found = {r.path.split("/")[-2]: ((r.rate, r.channels, r.frames), r.len) for r in got.collect()}
    assert found == {name: (want or (None, None, None), len(content)) for name, (content, want) in CASES.items()}
    (tmp_path / "none").mkdir()
    assert read_wav_headers(spark, str(tmp_path / "none")).collect() == []


def test_wav_headers_of_contents(spark):
    rows = spark.createDataFrame([(n, bytearray(c)) for n, (c, _) in CASES.items()] + [("null", None)], "name string, content binary")
    got = rows.select("name", files.wav_header(F.col("content")).alias("h")).collect()
    assert {r.name: tuple(r.h) for r in got} == {n: want or (None, None, None) for n, (_, want) in CASES.items()} | {"null": (None,) * 3}


class Counting(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        out = super().read(n)
        self.taken += len(out)
        return out


def test_only_headers_are_read():
    f = Counting(wav(chunk(b"LIST", b"x" * (1 << 20)), form(), chunk(b"data", b"\0" * (1 << 20))))
    assert walk_chunks(f) and f.taken < 100


def below(path):
    return sorted(os.path.relpath(os.path.join(d, n), path) for d, _, names in os.walk(path) for n in names if not n.startswith("."))


def test_documents_are_files(spark, tmp_path):
    path = str(tmp_path / "out")
    pieces = [(f"d{d}/{i}.txt", p, f"{i}:{p}é\n") for d in range(2) for i in range(20) for p in range(i % 5 + 1)]
    write_files(spark.createDataFrame(pieces, "output string, part long, document string").repartition(5), f"file://{path}", ["part"])
    want = {}
    for name, _, text in pieces:
        want[name] = want.get(name, "") + text
    assert below(path) == sorted([*want, "_SUCCESS"])
    assert all((tmp_path / "out" / n).read_bytes() == t.encode() for n, t in want.items())
    more = spark.createDataFrame([("d0/0.txt", bytearray(b"new")), ("z.bin", bytearray(b"\xff\0"))], "output string, document binary")
    write_files(more, path, [])
    assert (tmp_path / "out/d0/0.txt").read_bytes() == b"new" and len(below(path)) == 42
    write_files(more, path, [], mode="overwrite")
    assert below(path) == ["_SUCCESS", "d0/0.txt", "z.bin"] and (tmp_path / "out/z.bin").read_bytes() == b"\xff\0"


def test_files_are_read_without_a_listing_in_the_driver(spark, tmp_path):
    path = tmp_path / "out"
    assert read_files(spark, str(path)).count() == 0
    want = {"a": b"x" * 5_000_000, "b.gz": b"", "d/1.bin": bytes(range(256)) * 100, "d/e/f.txt": "é".encode(), "g/1.bin": b"z"}
    hidden = {"_SUCCESS": b"", ".a.crc": b"1", "_temporary-1/3/a": b"2", "d/.b": b"3", "d/_e/f": b"4"}
    for name, content in {**want, **hidden}.items():
        (path / name).parent.mkdir(parents=True, exist_ok=True)
        (path / name).write_bytes(content)
    for given in (str(path), f"file://{path}"):
        got = [(os.path.relpath(r.path, path), r.length, bytes(r.content)) for r in read_files(spark, given).collect()]
        assert sorted(got) == sorted((n, len(c), c) for n, c in want.items())
    assert [bytes(r.content) for r in read_files(spark, str(path / "d/e/f.txt")).collect()] == ["é".encode()]
    # An index of files is held by the driver.
    back = catalog.QUERIES["sc13_document_files"](spark, "/root/testdata/sf0.001")
    assert "binaryFile" not in back._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bits", [64, 1])
def test_commits_know_names_by_their_hash(tmp_path, monkeypatch, bits):
    plain = document_files._hash
    monkeypatch.setattr(document_files, "_hash", lambda n: plain(n) if bits == 64 else bytes([len(n) % 2]) + bytes(7))
    root = tmp_path / "out"

    def written(writer, tasks):
        for t, names in enumerate(tasks):
            for n in names:
                (at := root / f"_temporary-{writer.job}/{t}/{n}").parent.mkdir(parents=True, exist_ok=True)
                at.write_text(f"{t} {n}")
        made = [Written(f"{root}/_temporary-{writer.job}/{t}", b"".join(map(document_files._hash, names))) for t, names in enumerate(tasks)]
        assert all(len(w.hashes) == 8 * len(names) for w, names in zip(made, tasks))
        return [*made, None]

    def commit(overwrite, *tasks):
        writer = document_files.DocumentFileWriter(str(root), overwrite)
        writer.commit(written(writer, tasks))
        return {n: (root / n).read_text() for n in below(root) if n != "_SUCCESS"}

    first = commit(False, ["a", "d/b"], [], ["cc", "d/e"])
    assert first == {"a": "0 a", "d/b": "0 d/b", "cc": "2 cc", "d/e": "2 d/e"}
    with pytest.raises(ValueError, match="two tasks: d/b"):
        commit(False, ["x", "d/b"], ["zz", "z"], ["d/b", "y"])
    assert commit(False, []) == first
    assert commit(True, ["q"], ["a", "d/b"]) == {"q": "0 q", "a": "1 a", "d/b": "1 d/b"}
    assert commit(True) == {}


def test_failed_writes_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"{i}.txt", "x") for i in range(40)], "output string, document string")
    broken = rows.withColumn("document", F.when(F.col("output") == "33.txt", F.raise_error(F.lit("broken"))).otherwise(F.col("document")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        write_files(broken, path, [])
    assert below(path) == []
    for name in ("../up.txt", "/abs", "", "a//b", "_hidden", None):
        with pytest.raises(Exception, match="not the name of a file"):
            write_files(spark.createDataFrame([(name, "x")], "output string, document string"), path, [])
        assert below(path) == []
    twice = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "3")], "output string, document string")
    with pytest.raises(Exception, match="written by two tasks"):
        twice.repartition(3).write.format("document_files").mode("append").save(path)
    assert below(path) == []


def test_json_in_parts(spark, monkeypatch):
    said = [('say "hi"', 0.0, 0.4), ("back\\slash", 0.5, 0.9), ("é\t", 1.0, 1.25)] * 7
    rows = [(k, i, *w, 0.5, 0) for k in ("a", "b") for i, w in enumerate(said)]
    words = spark.createDataFrame(rows, "k string, word_idx long, word string, start double, end double, confidence double, speaker int")
    monkeypatch.setattr(captions, "gather_text", lambda *a, gather=captions.gather_text, **b: gather(*a, **b | {"part_rows": 4}))
    parts = captions.render_json(words, ["k"]).orderBy("k", "section", "part").collect()
    for k in ("a", "b"):
        made = json.loads("".join(p.document for p in parts if p.k == k))
        assert made == {"text": " ".join(w for w, _, _ in said), "words": [{"word": w, "start": s, "end": e} for w, s, e in said], "duration": 1.25}


def lines_of(n, start=0):
    return "".join(json.dumps({"type": "final", "text": f"m{i}é"}, ensure_ascii=False) + "\n" for i in range(start, start + n))


def test_messages_are_read_once(spark, tmp_path):
    log, out, state = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "state")
    log.mkdir()
    (log / "a.jsonl").write_text(lines_of(50) + '{"type": "final", "te')

    def run():
        stream = read_message_log(spark, str(log), range_bytes=101).writeStream.format("parquet").option("path", out)
        query = stream.option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        seen = [p.observedMetrics["message_log"] for p in query.recentProgress if p.observedMetrics and p.numInputRows]
        return [tuple(m[k] for k in ("messages", "unknown", "undecodable")) for m in seen]

    assert run() == [(50, 0, 0)]
    with (log / "a.jsonl").open("a") as f:
        f.write('xt": "late"}\n' + lines_of(3, 50))
    (log / "b.sse").write_text('event: final\r\ndata: {"type":"final","text":"sse"}\r\n\r\n: comment\nid: 7\ndata: {"type":"other"}\n{broken\n[1]\n')
    assert run() == [(8, 1, 2)]  # started anew from the checkpoint
    assert run() == []
    rows = spark.read.parquet(out)
    texts = sorted(r.text for r in rows.filter("kind = 'final'").collect())
    assert texts == sorted([f"m{i}é" for i in range(53)] + ["late", "sse"])
    assert sorted(r.kind for r in rows.filter("kind != 'final'").collect()) == ["undecodable", "undecodable", "unknown"]


def test_end_of_the_last_line():
    f = io.BytesIO(b"a\n" + b"b" * 200_000)
    assert whole_lines(f, 0, 200_002) == 2 and whole_lines(f, 2, 200_002) == 2 and whole_lines(f, 0, 1) == 0
