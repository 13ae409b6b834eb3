"""Files of the data sources that run in Python: local paths and URIs of the stores that Arrow opens."""

from __future__ import annotations

import os

from pyarrow import fs


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    if "://" in path or path.startswith("file:"):
        store, inside = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        return store, inside.rstrip("/")
    return fs.LocalFileSystem(), os.path.abspath(path)


def files_below(store: fs.FileSystem, root: str) -> list[fs.FileInfo]:
    """Files below a folder, or the file itself, by path; hidden ones and those in hidden folders are left out."""
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        return [info]
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    kept = [f for f in found if f.type == fs.FileType.File and not any(p[:1] in "._" for p in f.path[len(root) :].strip("/").split("/"))]
    return sorted(kept, key=lambda f: f.path)


def directly_below(store: fs.FileSystem, root: str) -> list[fs.FileInfo]:
    """Files and folders directly below a folder, or the file itself, by path; hidden ones are left out."""
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        return [info]
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((f for f in found if f.base_name[:1] not in "._"), key=lambda f: f.path)
