"""Files of any number of documents as a data sink: ``df.write.format("document_files").save(folder)``.

Rows are pieces of documents: ``output`` (a file name below the folder) and ``document`` (text or bytes). The pieces of an
output must come to one task in order, see :func:`write_files`; a task appends them to a file in a folder of its own, so
nothing is collected. When all tasks have succeeded, the driver moves the files to their names, a task's files at a time; of all
others it knows eight bytes each. Until then none is visible, and a run that fails leaves none.

:func:`read_files` reads such a folder; its tasks list the folders, so the driver knows no name at all.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from voxlake.sources.stores import directly_below, files_below, open_store

#: Tasks a core that list folders and read files.
READ_TASKS = 4
#: Bytes of files and number of names that are handed on at once.
READ_BYTES = 1 << 22
LISTED_NAMES = 10_000


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: its folder and a hash of each name in it."""

    folder: str
    hashes: bytes


class DocumentFiles(DataSource):
    """Option: ``path``."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentFileWriter:
        return DocumentFileWriter(self.options["path"], overwrite)


class DocumentFileWriter(DataSourceArrowWriter):
    """Appending replaces files of the same name and keeps others; overwriting removes all files that were there."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _temporary(self, root: str) -> str:
        return f"{root}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = open_store(self.path)
        folder = f"{self._temporary(root)}/{TaskContext.get().taskAttemptId()}"
        store.create_dir(folder, recursive=True)
        names: set[str] = set()
        name, out = None, None
        try:
            for batch in iterator:
                for output, document in zip(batch.column("output").to_pylist(), batch.column("document").to_pylist()):
                    if out is None or output != name:
                        if out is not None:
                            out.close()
                        _check(output, names)
                        names.add(output)
                        name, out = output, _open(store, folder, output)
                    out.write(document.encode() if isinstance(document, str) else document or b"")
        except BaseException:
            if out is not None:
                out.close()
            store.delete_dir(folder)
            raise
        if out is not None:
            out.close()
        return Written(folder, b"".join(map(_hash, names)))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = open_store(self.path)
        tasks = _Tasks(store, [m for m in messages if m is not None])
        if twice := tasks.written_twice():
            self.abort(messages)
            raise ValueError(f"pieces of an output were written by two tasks: {twice}")
        before = [f.path for f in files_below(store, root)] if self.overwrite else []
        stale = [path for path in before if not tasks.has(path[len(root) + 1 :])]
        folders: set[str] = set()
        for task in range(len(tasks.folders)):
            for name in tasks.names(task):
                if (folder := posixpath.dirname(f"{root}/{name}")) not in folders:
                    store.create_dir(folder, recursive=True)
                    folders.add(folder)
                store.move(f"{tasks.folders[task]}/{name}", f"{root}/{name}")
        for path in stale:
            store.delete_file(path)
        store.create_dir(root, recursive=True)
        self.abort(messages)
        store.open_output_stream(f"{root}/_SUCCESS").close()

    def abort(self, messages: list[Written | None]) -> None:
        store, root = open_store(self.path)
        if store.get_file_info(self._temporary(root)).type == fs.FileType.Directory:
            store.delete_dir(self._temporary(root))


class _Tasks:
    """The names that all tasks have written, as sorted hashes; the names themselves are looked up in the folder of a task."""

    def __init__(self, store: fs.FileSystem, written: list[Written]):
        self.store, self.folders = store, [w.folder for w in written]
        hashes = np.frombuffer(b"".join(w.hashes for w in written), "<u8")
        self.sizes = np.array([len(w.hashes) // 8 for w in written], "int64")
        order = np.argsort(hashes)
        self.hashes, self.task = hashes[order], np.repeat(np.arange(len(written)), self.sizes)[order]

    def names(self, task: int) -> list[str]:
        folder = self.folders[task]
        found = [f.path[len(folder) + 1 :] for f in files_below(self.store, folder)]
        if len(found) != self.sizes[task]:
            raise OSError(f"{folder} has {len(found)} files of {self.sizes[task]} that were written")
        return found

    def has(self, name: str) -> bool:
        """Whether a task has written this name and not only one of the same hash."""
        at = np.frombuffer(_hash(name), "<u8")[0]
        same = self.task[self.hashes.searchsorted(at) : self.hashes.searchsorted(at, side="right")]
        return any(self.store.get_file_info(f"{self.folders[t]}/{name}").type == fs.FileType.File for t in same)

    def written_twice(self) -> str | None:
        """The least name that two tasks have written."""
        again = np.flatnonzero(self.hashes[1:] == self.hashes[:-1])
        shared, seen, twice = set(self.hashes[again].tolist()), set(), []
        for task in np.unique(self.task[np.concatenate([again, again + 1])]).tolist():
            names = {n for n in self.names(task) if int.from_bytes(_hash(n), "little") in shared}
            twice += seen & names
            seen |= names
        return min(twice, default=None)


def _hash(name: str) -> bytes:
    return hashlib.blake2b(name.encode(), digest_size=8).digest()


def _check(output: str | None, names: set[str]) -> None:
    parts = (output or "").split("/")
    if not output or output.startswith("/") or any(p in ("", ".", "..") or p[0] in "._" for p in parts):
        raise ValueError(f"not the name of a file below the folder: {output!r}")
    if output in names:
        raise ValueError(f"pieces of an output are not next to each other: {output}")


def _open(store: fs.FileSystem, folder: str, output: str):
    if "/" in output:
        store.create_dir(posixpath.dirname(f"{folder}/{output}"), recursive=True)
    return store.open_output_stream(f"{folder}/{output}")


def write_files(pieces: DataFrame, path: str, order: list[str], *, mode: str = "append") -> None:
    """Write ``output, document`` rows as files below ``path``; pieces of an output are put together by ``order``."""
    pieces.sparkSession.dataSource.register(DocumentFiles)
    dealt = pieces.repartition("output").sortWithinPartitions("output", *order).select("output", "document")
    dealt.write.format("document_files").mode(mode).save(path)


def _listed(found: Iterable[fs.FileInfo]) -> Iterator[pa.RecordBatch]:
    rows = [(f.path, f.type == fs.FileType.Directory) for f in found]
    for at in range(0, len(rows), LISTED_NAMES):
        paths, folders = zip(*rows[at : at + LISTED_NAMES])
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(folders, pa.bool_())], names=["path", "folder"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, content`` of every file below a folder; hidden ones and those in hidden folders are left out.

    A task lists what is directly below ``path``, others the folders that it found, and all files are dealt out again to be read.
    """
    tasks = READ_TASKS * spark.sparkContext.defaultParallelism

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield from _listed(directly_below(*open_store(path)))

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(path)
        for batch in batches:
            folders = batch.column("folder")
            yield batch.filter(pc.invert(folders))
            for folder in batch.column("path").filter(folders).to_pylist():
                yield from _listed(files_below(store, folder))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(path)
        names, held, size = [], [], 0

        def made() -> pa.RecordBatch:
            lengths = pa.array([len(c) for c in held], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), lengths, pa.array(held, pa.binary())], names=["path", "length", "content"])

        for batch in batches:
            for name in batch.column("path").to_pylist():
                with store.open_input_file(name) as f:
                    held.append(f.read())
                names.append(name)
                size += len(held[-1])
                if size >= READ_BYTES or len(held) == LISTED_NAMES:
                    yield made()
                    names, held, size = [], [], 0
        if held:
            yield made()

    listed = spark.range(0, 1, 1, 1).mapInArrow(top, "path string, folder boolean")
    files = listed.repartition(tasks, "path").mapInArrow(below, "path string, folder boolean")
    return files.repartition(tasks, "path").mapInArrow(contents, "path string, length bigint, content binary")
