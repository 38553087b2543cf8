"""Parts of files by their paths: a mounted folder's path, or the URI of a store that pyarrow opens."""

from __future__ import annotations

import os

from pyarrow import fs


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def length(path: str) -> int:
    system, name = store(path)
    return system.get_file_info(name).size


def part(path: str, at: int, size: int) -> bytes:
    """Some bytes of a file, without the rest of it."""
    system, name = store(path)
    with system.open_input_file(name) as f:
        return f.read_at(size, at)
