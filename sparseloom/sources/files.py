"""Files by path or URI on whatever file system Arrow knows (local, HDFS, object stores), for the driver and for tasks.

Text and Parquet go through Spark; this is for binary formats, small property files and writers of single files.
"""

from __future__ import annotations

import gzip
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs

_uri = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]+:")


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it. Paths without a scheme are local."""
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if _uri.match(path) else (fs.LocalFileSystem(), os.path.abspath(path))


def _info(path: str) -> fs.FileInfo:
    system, at = file_system(path)
    return system.get_file_info(at)


def exists(path: str) -> bool:
    return _info(path).type != fs.FileType.NotFound


def is_file(path: str) -> bool:
    return _info(path).type == fs.FileType.File


def files_of(path: str) -> list[str]:
    """The files of a directory in the order of their names, without hidden ones; the path itself if it is a file."""
    info = _info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    system, at = file_system(path)
    names = [f.base_name for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File]
    return [path.rstrip("/") + "/" + n for n in sorted(names) if not n.startswith((".", "_"))]


@contextmanager
def reading(path: str):
    """A binary file to read and seek in; what a name with .gz holds is decompressed."""
    system, at = file_system(path)
    with system.open_input_file(at) as raw:
        if path.endswith(".gz"):
            with gzip.GzipFile(fileobj=raw) as f:
                yield f
        else:
            yield raw


def size_of(path: str) -> int:
    """Bytes of a file as it is read. A compressed file does not say them (its trailer has them modulo 4 GB), so it is read."""
    if not path.endswith(".gz"):
        return _info(path).size
    n = 0
    with reading(path) as f:
        while block := f.read(1 << 22):
            n += len(block)
    return n


@contextmanager
def writing(path: str, mark: str = "tmp"):
    """A binary file that gets its name only when it is complete. `mark` tells attempts at the same file apart."""
    system, at = file_system(path)
    folder, _, name = at.rpartition("/")
    system.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{name}.{mark}"
    with system.open_output_stream(temporary) as f:
        yield f
    system.move(temporary, at)


def lines_of(path: str) -> Iterator[str]:
    with reading(path) as f:
        yield from f.read().decode("utf-8").splitlines()
