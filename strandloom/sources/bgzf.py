"""Gzip in blocks (BGZF): blocks found from any byte on, and what lies between two of them.

A place in the contents is a block's offset times 65536 and the offset in the block's
contents, which are never longer.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

from strandloom.sources.ranges import located

# Fixed values of the format: the block without contents that ends a file, and a header's bytes around the extra length.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
HEAD = re.compile(rb"\x1f\x8b\x08\x04.{6}(?=(..))", re.S)
#: Most bytes of a block, and of the contents that a writer puts in one.
MOST, CONTENT = 65_536, 0xFF00


class Broken(ValueError):
    """A block that isn't whole; ``at`` is its offset."""

    def __init__(self, at: int, why: str) -> None:
        super().__init__(f"block at {at}: {why}")
        self.at, self.why = at, why


def length_of(data: bytes, at: int = 0) -> int | None:
    """Bytes of the block whose header is at ``at``; null if none is there."""
    if data[at : at + 4] != b"\x1f\x8b\x08\x04" or len(data) < at + 12:
        return None
    (extra,) = struct.unpack_from("<H", data, at + 10)
    i, stop = at + 12, at + 12 + extra
    while i + 4 <= min(stop, len(data)):
        kind, n = data[i : i + 2], struct.unpack_from("<H", data, i + 2)[0]
        if kind == b"BC" and n == 2 and i + 6 <= len(data):
            return struct.unpack_from("<H", data, i + 4)[0] + 1
        i += 4 + n
    return None


class Blocks:
    """The blocks of an open file."""

    def __init__(self, file, size: int) -> None:  # noqa: ANN001
        self.file, self.size = file, size

    def is_end(self) -> bool:
        """Whether the file ends with the block that says so."""
        return self.size >= len(END) and self.file.read_at(len(END), self.size - len(END)) == END

    def first(self, at: int) -> int:
        """Offset of the first block at ``at`` or later, ``size`` if there is none.

        A header's bytes may stand in compressed data too, so the block after it must be one
        as well, or the file's end.
        """
        if at <= 0 or at >= self.size:
            return max(0, min(at, self.size))
        while at < self.size:
            data = self.file.read_at(3 * MOST, at)
            for m in HEAD.finditer(data, 0, MOST + 3):
                n = length_of(data, m.start())
                if n is not None and (at + m.start() + n == self.size or length_of(data, m.start() + n) is not None):
                    return at + m.start()
            at += MOST
        return self.size

    def from_(self, at: int) -> Iterator[tuple[int, bytes]]:
        """(offset, contents) of the block at ``at`` and of all that follow."""
        held, begin = b"", at
        while at < self.size:
            if at - begin + MOST > len(held):
                held, begin = self.file.read_at(32 * MOST, at), at
            n = length_of(held, at - begin)
            if n is None or at + n > self.size:
                raise Broken(at, "no block header" if n is None else "cut short")
            block = held[at - begin : at - begin + n]
            (extra,) = struct.unpack_from("<H", block, 10)
            crc, size = struct.unpack_from("<II", block, n - 8)
            try:
                data = zlib.decompress(block[12 + extra : n - 8], -15)
            except zlib.error as e:
                raise Broken(at, str(e)) from e
            if len(data) != size or zlib.crc32(data) != crc:
                raise Broken(at, "wrong length or checksum")
            yield at, data
            at += n


def place(blocks: Blocks, at: int, skipped: Callable[[Iterator[bytes]], int | None]) -> tuple[int, int]:
    """(offset of a block, offset in its contents) where the first record after the first block at ``at`` begins.

    ``skipped`` tells from contents on how many bytes come before a record; null: there is none.
    """
    start = blocks.first(at)
    if start <= 0 or start >= blocks.size:
        return start, 0
    n = skipped(data for _, data in blocks.from_(start))
    if n is None:
        return blocks.size, 0
    for offset, data in blocks.from_(start):
        if n < len(data):
            return offset, n
        n -= len(data)
    return blocks.size, 0


def between(blocks: Blocks, a: tuple[int, int], b: tuple[int, int]) -> Iterator[bytes]:
    """The contents from place ``a`` to place ``b``."""
    if a < b:
        for offset, data in blocks.from_(a[0]):
            if (offset, 0) >= b:
                return
            yield data[a[1] if offset == a[0] else 0 : b[1] if offset == b[0] else None]


def is_blocked(path: str) -> bool:
    """Whether a file begins with a block."""
    store, inner = located(path)
    with store.open_input_file(inner) as f:
        return length_of(f.read_at(1 << 10, 0)) is not None


def compressed(data: bytes, level: int = 6) -> bytes:
    """The data as blocks, without the end marker."""
    out = []
    for at in range(0, len(data), CONTENT):
        part = data[at : at + CONTENT]
        z = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out.append(struct.pack("<4BIBBHBBHH", 0x1F, 0x8B, 8, 4, 0, 0, 0xFF, 6, 0x42, 0x43, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out)
