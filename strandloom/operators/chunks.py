"""Long sequences in pieces, so that no operator walks a whole chromosome in one row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import BASES, TRINUCLEOTIDES, gc_count
from strandloom.operators.intervals import overlaps


def chunked(seqs: DataFrame, size: int = 1024, halo: int = 2) -> DataFrame:
    """chrom, start, piece: pieces of ``size`` bases and ``halo`` more from the next one (from chrom, seq).

    One pass of a pattern over the sequence: the look-ahead takes the piece with its
    halo, the rest goes on to the next piece. Time is in proportion to the length.
    """
    pattern = rf"(?s)(?=(.{{1,{size + halo}}})).{{1,{size}}}"
    pieces = seqs.select("chrom", F.posexplode(F.regexp_extract_all("seq", F.lit(pattern), F.lit(1))).alias("at", "piece"))
    return pieces.select("chrom", (F.col("at").cast("long") * size).alias("start"), "piece")


def recut(pieces: DataFrame, size: int) -> DataFrame:
    """``pieces`` (chrom, start, piece) without halo as pieces of ``size`` bases, by which theirs must be divisible."""
    small = pieces.select("chrom", "start", F.posexplode(F.regexp_extract_all("piece", F.lit(rf"(?s)(.{{1,{size}}})"), F.lit(1))).alias("at", "piece"))
    return small.select("chrom", (F.col("start") + F.col("at").cast("long") * size).alias("start"), "piece")


def gc_profile(seqs: DataFrame, window: int) -> DataFrame:
    """chrom, start, end, gc of windows along each sequence (chrom, seq).

    Windows that end before the sequence does stand next to each other; what is left, at
    most a window, has the count of the sequence's last ``window`` bases.
    """
    length = F.char_length("seq").cast("long")
    size = max(1, 65_536 // window) * window
    lengths = seqs.select(F.col("chrom").alias("of"), length.alias("length"))
    tiles = recut(chunked(seqs, size, 0), window).join(lengths, F.col("chrom") == F.col("of")).where(F.col("start") + window < F.col("length"))
    tiles = tiles.select("chrom", "start", (F.col("start") + window).alias("end"), gc_count(F.col("piece")).alias("gc"))
    tail = seqs.where(length > 0).select("chrom", (F.floor((length - 1) / window) * window).alias("start"), length.alias("end"), gc_count(F.right("seq", F.lit(window))).alias("gc"))
    return tiles.unionByName(tail)


#: Code of each base, 64 for all other signs.
CODES = np.full(256, 64, np.int64)
CODES[[ord(b) for b in BASES]] = range(4)


def counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, counts: the 64 numbers of overlapping trinucleotides of each row's ``piece``, by position of TRINUCLEOTIDES.

    Each Arrow batch is counted as one array of base codes; what spans two rows isn't counted.
    """
    kind = dict(rows.dtypes)
    schema = "".join(f"{k} {kind[k]}, " for k in keys) + "counts array<bigint>"

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            if not b.num_rows:
                continue
            text = b.column("piece").cast(pa.binary()).to_pylist()
            size = np.array([len(t) for t in text], np.int64)
            code = CODES[np.frombuffer(b"".join(text), np.uint8)]
            row = np.repeat(np.arange(len(text)), size)
            tri = code[:-2] * 16 + code[1:-1] * 4 + code[2:]
            good = (np.maximum(np.maximum(code[:-2], code[1:-1]), code[2:]) < 64) & (row[:-2] == row[2:])
            if keys:
                n = np.bincount(row[:-2][good] * 64 + tri[good], minlength=64 * len(text)).reshape(-1, 64)
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(n.tolist(), pa.list_(pa.int64()))], names=[*keys, "counts"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array([np.bincount(tri[good], minlength=64).tolist()], pa.list_(pa.int64()))], names=["counts"])

    return rows.select(*keys, "piece").mapInArrow(run, schema)


def trinucleotide_counts(seqs: DataFrame, by_contig: bool = False, regions: DataFrame | None = None) -> DataFrame:
    """Overlapping trinucleotides of all sequences: (chrom,) tri, n; all 64 are there, absent ones with 0.

    With ``regions`` (chrom, start, end) those that lie whole in a region count, once for
    each region that holds them; a region longer than a piece is counted piece by piece.
    """
    size = 65_536 if regions is None else 4096
    pieces = chunked(seqs, size, 2)
    if regions is not None:
        # a trinucleotide belongs to the piece and region that hold its first base
        inner = regions.select("chrom", "start", (F.col("end") - 2).alias("end"))
        spans = pieces.select("chrom", "start", (F.col("start") + size).alias("end"), "piece")
        met = overlaps(spans, inner, size)
        begin = F.greatest("start", "r_start")
        pieces = met.select("chrom", F.substring("piece", (begin - F.col("start") + 1).cast("int"), (F.least("end", "r_end") - begin + 2).cast("int")).alias("piece"))
    return piece_trinucleotides(pieces, by_contig)


def piece_trinucleotides(pieces: DataFrame, by_contig: bool = False) -> DataFrame:
    """The same from pieces (chrom, piece) that have the next one's two first bases as their halo."""
    keys = ["chrom"] if by_contig else []
    part = counted(pieces, keys)
    total = part.groupBy(*keys).agg(*[F.sum(F.col("counts")[i]).alias(t) for i, t in enumerate(TRINUCLEOTIDES)])
    each = F.array(*[F.struct(F.lit(t).alias("tri"), F.coalesce(t, F.lit(0)).cast("long").alias("n")) for t in TRINUCLEOTIDES])
    return total.select(*keys, F.explode(each).alias("of")).select(*keys, "of.*")


def bases_at(points: DataFrame, seqs: DataFrame, before: int = 1, length: int = 3, size: int = 256) -> DataFrame:
    """``points`` (chrom, pos, ...) with ``around``: ``length`` bases from ``before`` ahead of pos.

    Joined on (chrom, piece), so that a chromosome's points are spread over its pieces
    and the sequence isn't copied for each point. ``seqs`` has sequences (chrom, seq), or
    pieces (chrom, start, piece) of ``size`` bases with ``length`` more at least.
    """
    pieces = (seqs if "piece" in seqs.columns else chunked(seqs, size, length)).withColumnsRenamed({"chrom": "s_chrom", "start": "s_start"})
    first = F.greatest(F.col("pos") - before, F.lit(0))
    hit = (F.col("chrom") == F.col("s_chrom")) & ((F.floor(first / size) * size) == F.col("s_start"))
    around = F.substring("piece", (first - F.col("s_start") + 1).cast("int"), F.lit(length))
    return points.join(pieces, hit).withColumn("around", around).drop("s_chrom", "s_start", "piece")
