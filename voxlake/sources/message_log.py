"""Growing message files as a streaming source: ``spark.readStream.format("message_log").load(folder)``.

Files are JSON lines or server-sent events to which writers append. An offset holds, for each file, the bytes up to the end
of its last whole line, so a line is read once, when it is complete, also after a restart from a checkpoint. New bytes are
cut into ranges that tasks read apart.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from voxlake.sources.messages import MESSAGE_SCHEMA, TYPES, strip_event_prefix
from voxlake.sources.stores import files_below, open_store

#: Bytes that one task reads, and bytes looked through at a time for the end of the last line.
RANGE_BYTES, TAIL_BYTES = 1 << 26, 1 << 16


class LineRange(InputPartition):
    """Bytes of a file; the lines that begin in them are read."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class MessageLog(DataSource):
    """Options: ``path``, ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return "path string, offset bigint, value string"

    def streamReader(self, schema: StructType) -> MessageLogReader:
        return MessageLogReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


class MessageLogReader(DataSourceStreamReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes
        self.ends: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, root = open_store(self.path)
        for f in files_below(store, root):
            if f.size > self.ends.get(f.path, 0):
                with store.open_input_file(f.path) as opened:
                    self.ends[f.path] = whole_lines(opened, self.ends.get(f.path, 0), f.size)
        return dict(self.ends)

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        ranges = []
        for path, upto in sorted(end.items()):
            at = start.get(path, 0)
            while at < upto:
                ranges.append(LineRange(path, at, min(at + self.range_bytes, upto)))
                at = ranges[-1].end
        return ranges

    def read(self, partition: LineRange) -> Iterator[tuple]:
        if not isinstance(partition, LineRange):
            return
        store, _ = open_store(self.path)
        with io.BufferedReader(store.open_input_file(partition.path)) as f:
            at = partition.start
            if at:  # a line that began before is read by the task of its first byte
                f.seek(at - 1)
                at += len(f.readline()) - 1
            while at < partition.end:
                line = f.readline()
                if not line:
                    break
                text = line.decode("utf-8", "replace").rstrip("\r\n")
                if text:
                    yield partition.path, at, text
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


def whole_lines(f, start: int, size: int) -> int:
    """The end of the last whole line between ``start``, where a line begins, and ``size``."""
    end = size
    while end > start:
        begin = max(start, end - TAIL_BYTES)
        f.seek(begin)
        at = f.read(end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return start


def message_kind(message: Column, value: Column) -> Column:
    """``ready``, ``partial``, ``final`` or ``error``; ``unknown`` for another type, ``undecodable`` for what is no object."""
    kind = message["type"]
    known = F.when(kind.isin(TYPES), kind).when(kind.isNotNull(), "unknown")
    return F.coalesce(known, F.when(F.get_json_object(value, "$").rlike(r"^\s*\{"), "unknown").otherwise("undecodable"))


def read_message_log(spark: SparkSession, path: str, *, range_bytes: int = RANGE_BYTES, metrics: str = "message_log") -> DataFrame:
    """Every payload below ``path`` as it becomes complete: ``path, offset, kind`` and the message's fields.

    Server-sent events may carry ``data:``; their other fields and comments are no payloads. Payloads of no known type stay
    as rows of their kind, and each batch counts them in the observed metrics ``messages``, ``unknown`` and ``undecodable``.
    """
    spark.dataSource.register(MessageLog)
    lines = spark.readStream.format("message_log").option("rangeBytes", range_bytes).load(path)
    payloads = lines.filter(~F.col("value").rlike(r"^(event|id|retry)?:")).withColumn("value", strip_event_prefix(F.col("value")))
    parsed = payloads.withColumn("_m", F.from_json("value", MESSAGE_SCHEMA, {"mode": "PERMISSIVE"}))
    rows = parsed.withColumn("kind", message_kind(F.col("_m"), F.col("value")))
    counted = rows.observe(
        metrics,
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.col("kind") == "unknown").alias("unknown"),
        F.count_if(F.col("kind") == "undecodable").alias("undecodable"),
    )
    return counted.select("path", "offset", "kind", "_m.*")
