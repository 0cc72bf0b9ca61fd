"""FASTQ files as a data source whose partitions are byte ranges.

A range begins at the first record whose header starts in it and ends where the next one
begins, so every byte of a file is in one range. What a line is can't be told from its
first sign, as qualities may begin with ``@``: of the four ways to count lines from a
range's start on, that one is taken in which most groups of four are records.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from strandloom.sources import bgzf
from strandloom.sources.blockfiles import BlockWriter
from strandloom.sources.ranges import RANGE, Range, files, lines, located, pieces, ranges

SCHEMA = "file string, offset long, name string, seq string, plus string, qual string"
#: Records by which a way to count is judged, and rows of a batch.
LOOK, ROWS = 8, 8192


def is_record(lines_: list[bytes], exact: bool) -> bool:
    """Whether lines may be a record; ``exact``: with as many qualities as bases. The last one of a file may lack its qualities."""
    if len(lines_) < 3 or not (lines_[0].startswith(b"@") and lines_[2].startswith(b"+")):
        return False
    return not exact or len(lines_) < 4 or len(lines_[1].rstrip(b"\r\n")) == len(lines_[3].rstrip(b"\r\n"))


def skipped(following: Iterable[bytes]) -> int | None:
    """Bytes of ``following`` (lines) before the first header; null if too few lines come for one."""
    window = list(islice(following, 4 * LOOK + 3))
    if len(window) < 3:
        return None
    ended = len(window) < 4 * LOOK + 3

    def score(p: int) -> tuple[float, float, int]:
        groups = [window[i : i + 4] for i in range(p, len(window), 4)]
        groups = [g for g in groups if len(g) == 4 or (ended and len(g) == 3)]
        share = lambda exact: sum(is_record(g, exact) for g in groups) / max(1, len(groups))
        return share(True), share(False), -p

    best = max(range(4), key=score)
    if len(window) < 4 and not score(best)[1]:
        return None
    return sum(map(len, window[:best]))


def first_header(file, size: int, at: int) -> int:  # noqa: ANN001
    """Offset of the first header at ``at`` or later, ``size`` if there is none; the same for the ranges on both sides."""
    if at <= 0 or at >= size:
        return max(0, min(at, size))
    following = lines(pieces(file, at - 1, size, 1 << 16))
    start = at - 1 + len(next(following))  # what is left of the line that holds the byte before
    more = skipped(following)
    return size if more is None else start + more


def batches(path: str, start: int, rows: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """SCHEMA from the lines of whole records; null parts where the lines end within a record.

    Four empty lines, and empty ones at the end, are no record.
    """
    at = start
    while group := list(islice(rows, 4 * ROWS)):
        ends = np.cumsum([len(x) for x in group])
        offsets = at + np.concatenate(([0], ends[:-1]))[::4]
        at += int(ends[-1])
        bare = [x.rstrip(b"\r\n").decode("utf-8", "replace") for x in group]
        bare += [None] * (-len(bare) % 4)
        columns = [pa.array([path] * len(offsets)), pa.array(offsets, pa.int64()), *(pa.array(bare[i::4], pa.string()) for i in range(4))]
        some = pa.array([any(bare[i : i + 4]) for i in range(0, len(bare), 4)])
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")]).filter(some)


class FastqReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.length = options["path"], int(options.get("rangeBytes", RANGE))

    def partitions(self) -> list[Range]:
        out = []
        for name, _ in files(self.path):
            out += ranges(name, self.length, () if not name.endswith(".gz") or bgzf.is_blocked(name) else (".gz",))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        store, inner = located(partition.path)
        if not partition.path.endswith(".gz"):
            with store.open_input_file(inner) as f:
                a, b = (first_header(f, partition.size, x) for x in (partition.start, partition.stop))
                yield from batches(partition.path, a, lines(pieces(f, a, b)))
        elif bgzf.is_blocked(partition.path):
            with store.open_input_file(inner) as f:
                blocks = bgzf.Blocks(f, partition.size)
                a, b = (bgzf.place(blocks, x, in_blocks) for x in (partition.start, partition.stop))
                yield from batches(partition.path, (a[0] << 16) + a[1], lines(bgzf.between(blocks, a, b)))
        else:
            with store.open_input_stream(inner, compression=None) as f, gzip.open(f) as z:
                yield from batches(partition.path, 0, lines(iter(lambda: z.read(1 << 20), b"")))


def in_blocks(data: Iterator[bytes]) -> int | None:
    """Bytes before the first header after the first line end in the contents of blocks."""
    following = lines(data)
    first = len(next(following, b""))
    more = skipped(following)
    return None if more is None else first + more


class FastqSource(DataSource):
    """``format("fastq")``: one row a record, as in SCHEMA; option ``rangeBytes`` is the length of a range.

    ``offset`` orders a file's records: the byte where one begins; in the contents, for gzip
    files; for files in blocks the bytes of contents since the range's first record, added to
    65536 times the offset of its block. Plain files and gzip files in blocks are read by many
    tasks, other gzip files by one each. The writer makes gzip files in blocks.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FastqReader:
        return FastqReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> BlockWriter:
        return BlockWriter(self.options["path"], "fq.gz", b"", records, self.options.get("single", "false") == "true")


def records(batch: pa.RecordBatch) -> Iterator[bytes]:
    """Rows with name, seq, qual as text; a name may have its ``@`` or not."""
    for name, seq, qual in zip(*(batch.column(c).to_pylist() for c in ("name", "seq", "qual")), strict=True):
        yield f"@{name.removeprefix('@')}\n{seq}\n+\n{qual}\n".encode()


def read(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("rangeBytes", range_bytes).load(path)


def write(reads: DataFrame, path: str, single: bool = False) -> None:
    """Write ``reads`` (name, seq, qual) as gzip files in blocks, one for each partition, or as one file."""
    reads.sparkSession.dataSource.register(FastqSource)
    reads.select("name", "seq", "qual").write.format("fastq").option("single", str(single).lower()).mode("append").save(path)
