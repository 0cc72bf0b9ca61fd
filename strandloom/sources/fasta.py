"""FASTA files by index: the index made from byte ranges, and sequences read piece by piece.

No row holds a chromosome: a base's byte follows from the contig's offset and the length
of its lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.operators.lineage import checkpointed
from strandloom.sources.ranges import RANGE, files, located, ranges

#: Longest header line, and bases that are read at once.
HEADER, SPAN = 1 << 20, 1 << 20

RUNS = "file string, start long, header long, name string, offset long, line_bases long, line_width long, bases long, first long, final long, low long, high long"


def range_rows(spark: SparkSession, path: str, length: int) -> DataFrame:
    """file, start, stop, size of the ranges of all files, a task each."""
    rows = [(r.path, r.start, r.stop, r.size) for r in ranges(path, length)]
    return spark.createDataFrame(rows, "file string, start long, stop long, size long").repartition(len(rows), "file", "start")


def line_end(f, at: int, size: int) -> int:  # noqa: ANN001
    """Offset after the end of the line that holds byte ``at``."""
    while at < size:
        data = f.read_at(1 << 16, at)
        n = data.find(b"\n")
        if n >= 0:
            return at + n + 1
        at += len(data)
    return size


def line_begin(f, at: int) -> int:  # noqa: ANN001
    """Offset where the line that holds byte ``at`` begins, or HEADER bytes before it if the line is longer."""
    low = max(0, at - HEADER)
    return low + f.read_at(at - low, low).rfind(b"\n") + 1


def runs(f, start: int, stop: int, size: int) -> Iterator[tuple]:  # noqa: ANN001
    """RUNS without file: the bases of a range before its first header, and of each of its contigs."""
    data = np.frombuffer(f.read_at(stop - start, start), np.uint8)
    feeds = np.flatnonzero(data == 10)
    starts = feeds + 1
    begin = line_begin(f, start)
    if begin == start:
        starts = np.concatenate(([0], starts))
    starts = starts[starts < len(data)]
    starts = starts[(data[starts] != 10) & (data[starts] != 13)]  # empty lines are none
    headers = starts[data[starts] == ord(">")]

    def after_line(at: int) -> int:
        """``line_end``, from what has been read where that will do."""
        k = np.searchsorted(feeds, at - start)
        return start + int(feeds[k]) + 1 if k < len(feeds) else line_end(f, max(at, start + len(data)), size)

    def text(low: int, high: int) -> bytes:
        return data[low - start : high - start].tobytes() if high <= start + len(data) else f.read_at(high - low, low)

    at = 0
    if begin < start and f.read_at(1, begin) == b">":  # the range begins in a header
        at = min(line_end(f, start, size), stop) - start
    ends = np.sort(np.concatenate((feeds, np.flatnonzero(data == 13))))
    for h, to in zip([None, *headers.tolist()], [*headers.tolist(), len(data)], strict=True):
        header = name = offset = width = bases = None
        if h is not None:
            header, offset = start + h, after_line(start + h)
            name = text(header, min(offset, header + HEADER))[1:].decode("utf-8", "replace").rstrip("\r\n")
            at = min(offset - start, len(data))
            following = after_line(offset) if offset < size else size
            if text(offset, min(offset + 1, following)) == b">":
                following = offset
            tail = text(max(offset, following - 16), following)
            width = following - offset
            bases = width - len(tail) + len(tail.rstrip(b"\r\n"))
        low, high = np.searchsorted(starts, (at, max(at, to)))
        inner = starts[low:high]
        gaps = np.diff(inner)  # the last line's length is left out: it may be shorter
        if h is not None or to > at:
            lines = (start + int(inner[0]), start + int(inner[-1])) if len(inner) else (None, None)
            yield start, header, name, offset, bases, width, max(0, to - at) - int(np.diff(np.searchsorted(ends, (at, max(at, to))))[0]), *lines, (int(gaps.min()) if len(gaps) else None), (int(gaps.max()) if len(gaps) else None)


def index(spark: SparkSession, path: str, cut: str = r"[ \t|]", range_bytes: int = RANGE) -> DataFrame:
    """file, chrom, length, offset, line_bases, line_width, uniform of every contig of the file or the folder's files.

    As in a .fai file; ``uniform`` tells whether all lines but the last are equally long, so
    that bases can be found by arithmetic. A contig whose lines lie in many ranges is added
    up from them. Windows go over one row a range.
    """

    def found(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            for file, start, stop, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, inner = located(file)
                with store.open_input_file(inner) as f:
                    rows = [(file, *r) for r in runs(f, start, stop, size)]
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 8]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in RUNS.split(", ")])

    every = checkpointed(range_rows(spark, path, range_bytes).mapInArrow(found, RUNS))  # used twice
    # the contig of what comes before a range's first header: the last header of earlier ranges
    by_range = every.groupBy("file", "start").agg(F.max("header").alias("last"))
    earlier = by_range.select("file", "start", F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)).alias("open"))
    placed = every.join(earlier, ["file", "start"]).withColumn("header", F.coalesce("header", "open"))
    first_line = lambda c: F.max(c).alias(c)
    contigs = placed.where(F.col("header").isNotNull()).groupBy("file", "header").agg(
        first_line("name"), first_line("offset"), first_line("line_bases"), first_line("line_width"),
        F.sum("bases").alias("length"), F.min("low").alias("low"), F.max("high").alias("high"), F.collect_set(F.col("first")).alias("firsts"), F.max("final").alias("final"),
    )
    even = F.coalesce(F.least("low", "high") == F.col("line_width"), F.lit(True)) & F.coalesce(F.col("high") == F.col("line_width"), F.lit(True))
    aligned = F.forall("firsts", lambda x: F.coalesce((x - F.col("offset")) % F.greatest("line_width", F.lit(1)) == 0, F.lit(True)))
    # what lies before the last line follows from its place, and the rest must fit in a line
    before = F.floor((F.col("final") - F.col("offset")) / F.greatest("line_width", F.lit(1))) * F.col("line_bases")
    fits = F.coalesce(F.col("length") - before <= F.col("line_bases"), F.lit(True))
    return contigs.select("file", F.split("name", cut, 2)[0].alias("chrom"), "length", "offset", "line_bases", "line_width", (even & aligned & fits).alias("uniform"))


def from_fai(spark: SparkSession, fai_path: str, fasta_path: str) -> DataFrame:
    """The same columns from a .fai file of one FASTA file."""
    rows = spark.read.csv(fai_path, sep="\t", schema="chrom string, length long, offset long, line_bases long, line_width long")
    return rows.select(F.lit(fasta_path).alias("file"), "chrom", "length", "offset", "line_bases", "line_width", F.lit(True).alias("uniform"))


def pieces(contigs: DataFrame, size: int = 32_768, halo: int = 0, regions: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """chrom, start, piece: upper-cased pieces of ``size`` bases and ``halo`` more from the next one, of ``index``'s contigs.

    With ``regions`` (chrom, start, end), whose ends are clipped to the contigs, only these
    are read, each from its own start. Only the bytes of the pieces are read, by tasks that
    have about SPAN bases a row; no row is longer than a piece with its halo. A contig whose
    lines aren't uniform raises an error.
    """
    spark = contigs.sparkSession
    ok = contigs.withColumn("line_width", F.when(F.col("uniform"), F.col("line_width")).otherwise(F.raise_error(F.concat(F.lit("lines of different length in "), "chrom"))))
    if regions is None:
        spans = ok.select("*", F.lit(0).cast("long").alias("begin"), F.col("length").alias("stop"))
    else:
        spans = ok.join(regions.select("chrom", F.greatest("start", F.lit(0)).alias("begin"), F.col("end").alias("stop")), "chrom").withColumn("stop", F.least("stop", "length"))
    step = max(1, SPAN // size) * size
    spans = spans.where(F.col("begin") < F.col("stop")).withColumn("at", F.explode(F.sequence("begin", F.col("stop") - 1, F.lit(step).cast("long"))))
    rows = spans.select("file", "chrom", "offset", "line_bases", "line_width", "at", F.least(F.col("at") + step, "stop").alias("to"), F.least(F.col("at") + step + halo, "stop").alias("end"))
    rows = rows.repartition(tasks or spark.sparkContext.defaultParallelism, "file", "chrom", "at").sortWithinPartitions("file", "offset", "at")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        held: list[tuple[str, int, str]] = []
        size_held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["chrom", "start", "piece"])

        for b in frames:
            for file, chrom, offset, bases, width, at, to, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != name:
                    store, inner = located(file)
                    name, f = file, store.open_input_file(inner)
                byte = lambda x, o=offset, n=bases, w=width: o + x // n * w + x % n
                text = f.read_at(byte(end - 1) + 1 - byte(at), byte(at)).translate(None, b"\r\n").upper().decode("ascii", "replace")
                held += [(chrom, s, text[s - at : s - at + size + halo]) for s in range(at, to, size)]
                size_held += len(text)
                if size_held >= SPAN:  # many short contigs make one batch
                    yield out()
                    held, size_held = [], 0
        if held:
            yield out()

    return rows.mapInArrow(run, "chrom string, start long, piece string")


def tasks_for(path: str, range_bytes: int = RANGE) -> int:
    """Tasks for the files' bytes, a range each."""
    return max(1, sum(-(-size // range_bytes) for _, size in files(path)))
