"""Table functions in SQL against the DataFrame operators."""

import random

import pytest

from voxlake.functions.table_functions import register_sql
from voxlake.operators import words as ops

WORDS = "who string, part int, word_idx long, word string, start double, end double, confidence double, speaker int"


@pytest.fixture
def spoken(spark):
    rng = random.Random(6)
    rows = []
    for who in ("a", "b", None):
        t = 0.0
        for i in range(200):
            t += rng.choice([0.1, 0.1, 0.1, 1.5])
            word = rng.choice(["é" * 70, "word", "end.", "x" * 30, "why?", "stop. "])
            rows.append((who, 1, i, word, round(t, 2), round(t + 0.3, 2), rng.choice([None, 0.5, 1.0]), rng.choice([None, 0, 0, 0, 1])))
            t += 0.3
    return spark.createDataFrame(rows, WORDS).repartition(4)


def same(a, b):
    key = lambda rows: sorted(str([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows.collect())
    assert a.columns == b.columns and key(a) == key(b)


def test_segments_and_cues(spark, spoken):
    register_sql(spark)
    spoken.createOrReplaceTempView("spoken")
    for name, operator in (("natural_segments", ops.natural_segments), ("caption_cues", ops.caption_cues)):
        got = spark.sql(f"SELECT * FROM {name}(TABLE(spoken) PARTITION BY (who, part) ORDER BY (word_idx), 'who, part')")
        same(got, operator(spoken, ["who", "part"]))


def test_words(spark):
    rng = random.Random(7)
    text = lambda: rng.choice(["▁", ""]) + rng.choice(["ab", "c", "", "é"])
    rows = [(k, i, text(), i * 3, rng.random()) for k in (1, 2) for i in range(120)]
    tokens = spark.createDataFrame(rows, "k int, tok_idx long, text string, frame long, confidence double").repartition(3)
    tokens.createOrReplaceTempView("tokens")
    register_sql(spark)
    got = spark.sql("SELECT * FROM tokens_to_words(TABLE(tokens) PARTITION BY k ORDER BY (tok_idx), 'k')")
    same(got, ops.tokens_to_words(tokens, ["k"]))


def test_wrong_calls_are_told(spark, spoken):
    register_sql(spark)
    spoken.drop("speaker").createOrReplaceTempView("bare")
    with pytest.raises(Exception, match="no column speaker"):
        spark.sql("SELECT * FROM natural_segments(TABLE(bare) PARTITION BY who ORDER BY (word_idx), 'who')").collect()


def test_sql_cues_read_no_row_by_name():
    """A lookup by name for every row costs more than the packing; the size of a cue is a running one."""
    from pyspark.sql import Row

    from voxlake.functions.table_functions import SqlCues

    class Plain(Row):
        def __getitem__(self, item):
            assert not isinstance(item, str)
            return tuple.__getitem__(self, item)

    names, rng, rows = ["recording_id", "word_idx", "word", "start", "end", "speaker"], random.Random(3), []
    for i in range(400):
        rows.append((7, i, "ж" * rng.choice([1, 3, 9, 39]), float(i), i + 0.5, rng.choice([0, 0, 0, 1, None])))
    fold, got = SqlCues(), []
    for values in rows:
        row = Plain(*values)
        row.__fields__ = names
        got += fold.eval(row, "recording_id")
    got += fold.terminate()

    wanted, cue, before = [], [], None
    label = lambda r: "" if r[5] is None else f"[SPEAKER_{r[5]}] "
    done = lambda: wanted.append((cue[0][1], 1, (label(cue[0]) + " ".join(r[2] for r in cue)).rstrip(" "), len(cue)))
    for r in rows:
        changed = before is None or r[5] != before[5]
        if cue and (changed or len(cue) == 14 or len((label(cue[0]) + " ".join(x[2] for x in [*cue, r])).encode()) > 80):
            done()
            cue = []
        if changed and label(r) and len((label(r) + r[2]).encode()) + 1 > 80:
            wanted.append((r[1], 0, label(r).rstrip(" "), 0))
        cue.append(r)
        before = r
    done()
    assert [(g[1], g[2], g[5], g[6]) for g in got] == wanted
    assert {g[0] for g in got} == {7}
