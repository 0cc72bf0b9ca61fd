"""Files as byte ranges, in any store that Arrow's file systems reach (local, HDFS, S3, GCS, ...)."""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow.fs as pafs
from pyspark.sql.datasource import InputPartition

#: Bytes of a range, and bytes read at once.
RANGE, STEP = 64 << 20, 4 << 20


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match(r"[A-Za-z][\w+.-]*:/", path):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), os.path.abspath(path)


def files(path: str) -> list[tuple[str, int]]:
    """(URI or path, size) of a file, of a folder's files without those that begin with ``_`` or ``.``, or of a pattern's."""
    store, inner = located(path)
    outer = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = store.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [(outer + inner, info.size)]
    folder, pattern = (inner, "*") if info.type == pafs.FileType.Directory else posixpath.split(inner)
    found = store.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    found = [f for f in found if f.type == pafs.FileType.File and fnmatch(f.base_name, pattern) and f.base_name[0] not in "_."]
    if not found:
        raise FileNotFoundError(path)
    return sorted((outer + f.path, f.size) for f in found)


class Range(InputPartition):
    """The records of a file that begin at ``start`` or later and before ``stop``."""

    def __init__(self, path: str, start: int, stop: int, size: int) -> None:
        self.path, self.start, self.stop, self.size = path, start, stop, size


def ranges(path: str, length: int, whole: tuple[str, ...] = ()) -> list[Range]:
    """Ranges of ``length`` bytes of all files; a file with a suffix of ``whole`` is one range."""
    out = []
    for name, size in files(path):
        step = max(1, size if name.endswith(whole) else length)
        out += [Range(name, at, min(size, at + step), size) for at in range(0, max(1, size), step)]
    return out


def pieces(file: pafs.NativeFile, start: int, stop: int, step: int = STEP) -> Iterator[bytes]:
    """The bytes from ``start`` to ``stop``, up to ``step`` at a time."""
    while start < stop:
        data = file.read_at(min(step, stop - start), start)
        if not data:
            return
        start += len(data)
        yield data


def lines(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The lines, with their ends, that the parts make when joined."""
    held: list[bytes] = []
    for data in parts:
        first = data.find(b"\n") + 1
        if not first:
            held.append(data)
            continue
        yield b"".join([*held, data[:first]])
        last = data.rfind(b"\n") + 1
        yield from data[first:last].splitlines(keepends=True) if b"\r" not in data else [x + b"\n" for x in data[first:last].split(b"\n")[:-1]]
        held = [data[last:]]
    if rest := b"".join(held):
        yield rest
