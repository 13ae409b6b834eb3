import random

import pytest

import corpus_pipeline
from voxlake.llm.queries import QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Tables with planted cases, and the ids that each stage has to drop."""
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("ra", "lo", "ne", "ti", "su")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels, gone = {}, [], {"toxic": set(), "exact": set(), "near": set(), "bench": set()}
    for i in range(600):
        rows[i] = say(rng.randint(60, 90))
        labels.append((i, int(i % 5 == 0)))
        if i % 5 == 0:
            w = rows[i].split()
            w[rng.randrange(len(w))] = rng.choice(["moron", "idiot", "scumbag"])
            rows[i] = " ".join(w)
            gone["toxic"].add(i)
    rows[600] = "a plain text that is " + rows[11] + " m0r0n"
    gone["toxic"].add(600)
    for k, i in enumerate(range(601, 621)):  # copies: the largest id stays
        rows[i] = rows[1 + 5 * k]
        gone["exact"].add(1 + 5 * k)
    for k, i in enumerate(range(621, 641)):  # near copies: the smallest id stays
        w = rows[302 + 5 * k].split()
        w[5] = "edited"
        rows[i] = " ".join(w)
        gone["near"].add(i)
    bench = [(i, say(25)) for i in range(6)]
    for i in range(641, 653):
        rows[i] = f"{say(40)} {bench[i % 6][1]} {say(30)}"
        gone["bench"].add(i)
    rows[653], rows[654], rows[655], rows[656] = None, "", "ok", None
    gone["exact"] |= {653, 654}
    path = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, set(rows), gone


def test_stages_drop_what_they_should(spark, corpus):
    path, left, gone = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for (name, stage), dropped in zip(corpus_pipeline.STAGES, [*gone.values(), set()]):
        out = f"{path}/out-{name.replace(' ', '-')}"
        stage(spark, docs, path).write.parquet(out)
        docs = spark.read.parquet(out)
        left = left - dropped
        assert {r.doc_id for r in docs.select("doc_id").collect()} == left, name
        if name != "byte-level BPE":
            assert docs.columns == COLUMNS
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_empty_tables(spark, corpus, tmp_path):
    path, _, _ = corpus
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_every_operator_has_its_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
