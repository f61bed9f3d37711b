"""Paths opened outside Spark's readers: by pyarrow's file systems, in data sources."""

from __future__ import annotations

import pyarrow.fs as fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
