"""Queries on small tables of their own: tables as folders, values next to a boundary, runs of several names."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tests.compare import differences
from voxlake.plans import catalog


def run(spark, tmp_path, name):
    return catalog.QUERIES[name](spark, str(tmp_path))


def test_a_table_may_be_a_folder(spark, tmp_path):
    rows = [(1, "one two"), (2, ""), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.repartition(2).write.parquet(f"{tmp_path}/a/documents.parquet")
    got = run(spark, tmp_path / "a", "st15_directory_ingest").collect()
    assert sorted((r.doc_id, r.n_words) for r in got)[:2] == [(1, 2), (2, 0)] and len(got) == 3
    docs.filter("false").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert run(spark, tmp_path / "b", "st15_directory_ingest").count() == 0


def test_pieces_next_to_a_boundary(spark, tmp_path):
    # In single precision -0.025 times forty is -1, in double precision it lies below.
    values = pa.array([[-0.025, 0.1], [-0.1, 0.2]], pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": pa.array([1, 2], pa.int64()), "embedding": values}), f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.text for r in run(spark, tmp_path, "tx20_ids_to_text").collect()}
    assert got == {1: "p19 p24", 2: "p16p28"}


def test_runs_meet_all_later_runs(spark, tmp_path):
    import duckdb

    rows = [(run_, "O", price, discount, tax) for run_, price, discount, tax in [("A", 10.0, 0.0, 0.0), ("N", 20.0, 0.1, 0.5), ("R", 90.0, 0.2, 2.0)]]
    fields = "l_returnflag string, l_linestatus string, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(rows, fields).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    query = catalog.QUERIES["tx29_dual_gate"]
    assert differences(spark, con, str(tmp_path), query, catalog.ORACLES["tx29_dual_gate"]) == []
    pairs = {(r.freeze_run, r.post_run) for r in run(spark, tmp_path, "tx29_dual_gate").collect()}
    assert pairs == {("A", "N"), ("A", "R"), ("N", "R")}


def test_subwords_of_odd_texts(spark):
    """Null, empty and repeated words; Python gets Arrow arrays, not lists of all words of a batch."""
    from voxlake.operators import vocab

    known = {"[UNK]": 0, "a": 1, "##b": 2, "ab": 3}
    docs = spark.createDataFrame([(1, "ab abb ab ?"), (2, None), (3, ""), (4, "a ab")], "doc_id bigint, text string").coalesce(1)
    out = docs.select("doc_id", vocab.subword_ids(F.col("text"), known).alias("w"))
    assert {r.doc_id: r.w for r in out.collect()} == {1: [[3], [3, 2], [3], [0]], 2: None, 3: [], 4: [[1], [3]]}
    assert vocab.token_counts(docs, "doc_id", "text", known).filter("doc_id = 1").first()["n_tokens"] == 5
    assert ", 250" in out._jdf.queryExecution().executedPlan().toString()


def test_distances_of_many_pairs(spark):
    from voxlake.functions import distance

    rows = [(i, ["a"] * (i % 5), ["a", "b"] * (i % 3)) for i in range(300)] + [(300, None, ["a"])]
    pairs = spark.createDataFrame(rows, "i int, r array<string>, h array<string>").coalesce(1)
    got = pairs.select("i", distance.word_edit_distance(F.col("r"), F.col("h")).alias("d"), distance.word_errors(F.col("r"), F.col("h")).alias("e"))
    for row in got.filter("i < 300").collect():
        r, h = rows[row.i][1:]
        assert row.d == distance.edit_distance(r, h) and tuple(row.e) == distance.error_split(r, h)
    assert "250" in got._jdf.queryExecution().executedPlan().toString()


def test_model_results_are_handed_on():
    import pandas as pd

    from voxlake.operators import corpus

    class Work:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            return run

    run_ = corpus.run_model(Work(), lambda: lambda text: (text.upper(), 1), ["text"])
    parts = list(run_(iter([pd.DataFrame({"cache_key": range(1000), "text": "a"})])))
    assert max(map(len, parts)) <= 256 and pd.concat(parts)["cache_key"].tolist() == list(range(1000))
