"""Headers of WAV files as a data source: ``spark.read.format("wav_headers").load(folder)``.

A task opens its files one by one and seeks from chunk to chunk, so a file costs a few small reads wherever its format and
data chunks are, and no samples are read.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from voxlake.sources.stores import files_below, open_store

#: Files that one task looks into.
FILES_PER_TASK = 256


def walk_chunks(f: BinaryIO) -> tuple[int, int, int] | None:
    """Rate, channels and frames of an open WAV file; None where it is none or lacks its format or data.

    Chunks may come in any order, number and size; of several of a kind the first counts. A chunk of odd size is padded.
    """
    head = f.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        return None
    at, form, size = 12, None, None
    while form is None or size is None:
        f.seek(at)
        head = f.read(8)
        if len(head) < 8:
            return None
        name, length = struct.unpack("<4sI", head)
        if name == b"fmt " and form is None:
            form = f.read(min(length, 16))
            if len(form) < 16:
                return None
        elif name == b"data" and size is None:
            size = length
        at += 8 + length + length % 2
    _, channels, rate, _, _, bits = struct.unpack("<HHIIHH", form)
    width = bits // 8 * max(channels, 1)
    return (rate, channels, size // width) if width and rate else None


def header_of(content: bytes) -> tuple[int, int, int] | None:
    return walk_chunks(io.BytesIO(content))


class FileGroup(InputPartition):
    """Files of one task."""

    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class WavHeaders(DataSource):
    """Options: ``path``, ``filesPerTask``."""

    @classmethod
    def name(cls) -> str:
        return "wav_headers"

    def schema(self) -> str:
        return "path string, len bigint, rate bigint, channels int, frames bigint"

    def reader(self, schema: StructType) -> WavHeaderReader:
        return WavHeaderReader(self.options["path"], int(self.options.get("filesPerTask", FILES_PER_TASK)))


class WavHeaderReader(DataSourceReader):
    """One row a file; rate, channels and frames are null for files that are no WAV or are cut short."""

    def __init__(self, path: str, files_per_task: int):
        self.path, self.files_per_task = path, files_per_task

    def partitions(self) -> list[FileGroup]:
        store, root = open_store(self.path)
        files = [(f.path, f.size) for f in files_below(store, root) if f.path.lower().endswith(".wav")]
        return [FileGroup(files[i : i + self.files_per_task]) for i in range(0, len(files), self.files_per_task)]

    def read(self, partition: FileGroup) -> Iterator[tuple]:
        if not isinstance(partition, FileGroup):  # no files: Spark asks for one empty partition
            return
        store, _ = open_store(self.path)
        for path, size in partition.files:
            with store.open_input_file(path) as f:
                found = walk_chunks(f)
            yield (path, size, *(found or (None, None, None)))


def read_wav_headers(spark: SparkSession, path: str, *, files_per_task: int = FILES_PER_TASK) -> DataFrame:
    """``path, len, rate, channels, frames`` of every ``.wav`` file below a folder."""
    spark.dataSource.register(WavHeaders)
    return spark.read.format("wav_headers").option("filesPerTask", files_per_task).load(path)
