"""Files of a log on any file system that Arrow knows: local or mounted folders, hdfs://, s3://, gs://, abfs://."""

from __future__ import annotations

import os

from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def read_text(system: fs.FileSystem, path: str) -> str | None:
    """A small file's text; None without the file."""
    try:
        with system.open_input_stream(path) as f:
            return f.read().decode()
    except FileNotFoundError:
        return None


def size_of(system: fs.FileSystem, path: str) -> int | None:
    """Bytes of a file; None without it."""
    info = system.get_file_info(path)
    return info.size if info.type == fs.FileType.File else None


def sync(system: fs.FileSystem, path: str) -> None:
    """Have a closed local file on disk; other systems are durable when a file has been closed."""
    if isinstance(system, fs.LocalFileSystem):
        fd = os.open(path, os.O_RDONLY)
        try:
            os.fsync(fd)
        finally:
            os.close(fd)


def append_text(system: fs.FileSystem, path: str, text: str) -> None:
    """Add to a small file; where a system cannot append, the file is written anew."""
    try:
        out = system.open_append_stream(path)
    except (NotImplementedError, OSError):
        text = (read_text(system, path) or "") + text
        out = system.open_output_stream(path)
    with out as f:
        f.write(text.encode())
    sync(system, path)
