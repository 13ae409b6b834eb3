"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its context, and only that reply is trainable.
The contexts of a conversation are prefixes of one another, so what an example adds to the one before is made first: the turns
since the previous reply, then the reply. ``example_parts`` joins blocks of these to the examples they are context of, so each
example comes with its whole context in parts of bounded size. That output grows with the square of a conversation's length;
no task holds a conversation or an example.

Turns are put in order by range partitions of (conversation, turn), so that a long conversation spreads over many tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.llm.common import small_batches
from voxlake.operators.joins import safe_join
from voxlake.session import materialize

START, END, TARGET = "<|im_start|>", "<|im_end|>", "assistant"
TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)
#: Context after which a row is written though no reply has come yet.
ROW_CHARS = 1 << 16
#: Rows of a block of context.
BLOCK_ROWS = 32


def escape(text: Column) -> Column:
    """No control string is left inside: a backslash is doubled, ``<|`` becomes ``<\\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


EXAMPLES = "conv_id long, part int, seq long, added string, loss_start int, loss_end int"


def expand_turns(conversations: DataFrame) -> DataFrame:
    """Rows ``conv_id, part, seq, added, loss_start, loss_end``, in order of (part, seq) within a conversation.

    A row with a loss span is the example of one assistant turn; the span, in code points of ``added``, is the escaped
    reply. Rows without one carry context: turns after the last reply, or a long stretch without a reply.

    Turns are ordered by turn, then role, then text (nulls first); repeated rows stay. Null texts and roles are empty.
    Rows with a null conversation id form one conversation. An empty table gives no rows; other columns are ignored.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rendered = conversations.select(
        "conv_id",
        "turn",
        role.alias("role"),
        text.alias("text"),
        F.concat(F.lit(START), escape_role(role), F.lit("\n")).alias("head"),
        escape(text).alias("body"),
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rendered.repartitionByRange(n, "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        added, size, conv, opened = [], 0, None, False

        def close(start=None, end=None):
            nonlocal added, size, seq
            if added:
                rows.append((conv, part, seq, "".join(added), start, end))
                added, size, seq = [], 0, seq + 1

        def batch():
            cols = list(zip(*rows)) if rows else [[]] * 6
            rows.clear()
            types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
            names = ["conv_id", "part", "seq", "added", "loss_start", "loss_end"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for b in batches:
            for c, r, head, body in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "head", "body"))):
                if opened and c != conv:
                    close()
                conv, opened = c, True
                added += [head, body, END, "\n"]
                begin = size + len(head)
                size = begin + len(body) + len(END) + 1
                if r == TARGET:
                    close(begin, begin + len(body))
                elif size >= ROW_CHARS:
                    close()
            yield batch()
        close()
        yield batch()

    return ordered.select("conv_id", "role", "head", "body").mapInArrow(run, EXAMPLES)


def example_parts(examples: DataFrame) -> DataFrame:
    """``conv_id, part, seq, block_part, block, text, loss_start, loss_end``: every example with all its context, a row for
    each block of BLOCK_ROWS rows of :func:`expand_turns`. Its texts, in order of (block_part, block), are the example; the
    loss span, in code points of the text, is in the last one.
    """
    keyed = examples.withColumn("block", F.floor(F.col("seq") / BLOCK_ROWS))
    within = Window.partitionBy("conv_id", "part", "block").orderBy("seq")
    keyed = keyed.withColumn("added_chars", F.length("added")).withColumn("upto", F.sum("added_chars").over(within))
    keyed = materialize(keyed, "examples")
    texts = keyed.groupBy("conv_id", "part", "block").agg(F.sort_array(F.collect_list(F.struct("seq", "added"))).alias("rows"))
    texts = texts.select("conv_id", F.col("part").alias("block_part"), "block", F.array_join("rows.added", "").alias("whole"))
    # A conversation's parts are range partitions, so there are no more of them than partitions.
    parts = keyed.groupBy("conv_id", "part").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    parts = parts.groupBy("conv_id").agg(F.collect_list(F.struct("part", "low", "high")).alias("parts"))
    asked = safe_join(keyed.filter("loss_start is not null").drop("added"), parts, ["conv_id"]).withColumnRenamed("block", "own")
    asked = asked.withColumn("p", F.explode(F.filter("parts", lambda p: p["part"] <= F.col("part")))).drop("parts")
    upto = F.when(F.col("p.part") == F.col("part"), F.col("own")).otherwise(F.col("p.high"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.col("p.low"), upto))).withColumn("block_part", F.col("p.part"))
    joined = safe_join(asked.drop("p"), texts, ["conv_id", "block_part", "block"])
    last = (F.col("block_part") == F.col("part")) & (F.col("block") == F.col("own"))
    text = F.when(last, F.substring(F.col("whole"), F.lit(1), F.col("upto").cast("int"))).otherwise(F.col("whole"))
    own = F.col("upto") - F.col("added_chars")
    return joined.select(
        "conv_id", "part", "seq", "block_part", "block", text.alias("text"),
        *(F.when(last, own + F.col(c)).cast("int").alias(c) for c in ("loss_start", "loss_end")),
    )


def whole_examples(examples: DataFrame) -> DataFrame:
    """``conv_id, part, seq, text, loss_start, loss_end``: each example written out with its whole context.

    The result grows with the square of a conversation's length, as full contexts do.
    """
    w = Window.partitionBy("conv_id").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum(F.length("added")).over(w) - F.length("added")
    whole = examples.withColumn("text", F.array_join(F.collect_list("added").over(w), "")).withColumn("_before", before)
    shifted = {c: (F.col(c) + F.col("_before")).cast("long") for c in ("loss_start", "loss_end")}
    return whole.filter("loss_start is not null").withColumns(shifted).drop("_before", "added")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string"


def read_back(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation say: its turns, the text under the loss masks, and the code points of all
    its examples, each with its whole context, counted on :func:`example_parts`.

    A digest of a whole conversation is sequential by nature; its rows stream through one task in constant memory.
    """
    small_batches(examples.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh(conv):
            return {"conv": conv, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "loss_n": 0}

        def batch(done):
            cols = [[x[k] for x in done] for k in ("conv", "n", "turns", "loss_n", "loss")]
            cols[2], cols[4] = [x.hexdigest() for x in cols[2]], [x.hexdigest() for x in cols[4]]
            names = [f.split()[0] for f in DIGESTS.split(", ")]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        state = None
        for b in batches:
            done = []
            for conv, added, start, end in zip(*(b.column(k).to_pylist() for k in ("conv_id", "added", "loss_start", "loss_end"))):
                if state is None or state["conv"] != conv:
                    if state is not None:
                        done.append(state)
                    state = fresh(conv)
                for m in TURN.finditer(added):
                    state["n"] += 1
                    state["turns"].update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                if start is not None:
                    reply = unescape(added[start:end])
                    state["loss"].update(reply.encode())
                    state["loss_n"] += len(reply)
            yield batch(done)
        if state is not None:
            yield batch([state])

    examples = materialize(examples, "turns")
    said = examples.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(run, DIGESTS)
    written = example_parts(examples).groupBy("conv_id").agg(F.sum(F.length("text")).alias("formatted_chars"))
    return safe_join(said, written, ["conv_id"], "left").fillna(0, ["formatted_chars"])


ORACLE = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), piece AS (
  SELECT *, 24 + length(replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'),
                                chr(10), chr(92) || 'n'))
              + length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')) AS chars
  FROM c
), placed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS so_far FROM piece
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(coalesce(sum(so_far) FILTER (role = 'assistant'), 0) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""
