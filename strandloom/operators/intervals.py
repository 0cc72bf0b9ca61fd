"""Interval operators. Intervals are 0-based and half-open: chrom, start, end.

Range predicates become equi-joins on (chrom, level, bin): levels of ever wider bins hold
intervals of every length, each in one or two bins, so joins hash and shuffle on bins
instead of comparing all pairs, and a crowded chromosome is spread over many bins.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.lineage import checkpointed

BIN = 4096


#: A level's bins are so many times wider than those of the level below, and the highest level (bins of 10^14 bases).
FANOUT, HIGHEST = 8, 12


def width_at(level: Column | int, width: int) -> Column:
    """Bases of a bin of the level."""
    if isinstance(level, int):
        return F.lit(width * FANOUT**level)
    return F.element_at(F.array(*[F.lit(width * FANOUT**k) for k in range(HIGHEST + 1)]), level + 1)


def met(width: Column) -> Column:
    """The bins that an interval meets: one or two, if it is no longer than a bin."""
    first, last = F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)
    return F.when(first == last, F.array(first)).otherwise(F.array(first, last))


def at_home(intervals: DataFrame, width: int = BIN) -> tuple[DataFrame, list[int]]:
    """``intervals`` with ``bin_level``, the lowest whose bins are as long, and the levels in use.

    Empty intervals meet nothing. The rows are written once; the levels are HIGHEST + 1 numbers at most.
    """
    length = F.col("end") - F.col("start")
    level = F.coalesce(*[F.when(length <= width * FANOUT**k, F.lit(k)) for k in range(HIGHEST)], F.lit(HIGHEST))
    rows = checkpointed(intervals.where(length > 0).withColumn("bin_level", level))
    return rows, sorted(r[0] for r in rows.select("bin_level").distinct().collect())


def strictly_inside(points: DataFrame, intervals: DataFrame, width: int = BIN) -> DataFrame:
    """Points with the intervals that hold them beyond their first base: start < pos < end."""
    return points_in_intervals(points, intervals, "inner", width).where(F.col("pos") > F.col("start"))


def points_in_intervals(points: DataFrame, intervals: DataFrame, how: str = "inner", width: int = BIN) -> DataFrame:
    """Join (inner, left or left_semi) of points (chrom, pos, ...) with the intervals that hold them: start <= pos < end.

    An interval lies in one or two bins of its level, however long it is; a point is looked
    up in one bin of each level in use.
    """
    i, levels = at_home(intervals, width)
    i = i.withColumn("i_bin", F.explode(met(width_at(F.col("bin_level"), width)))).withColumnsRenamed({"chrom": "i_chrom", "bin_level": "i_level"})
    of = F.explode(F.array(*[F.struct(F.lit(k).alias("bin_level"), F.floor(F.col("pos") / width_at(k, width)).alias("bin")) for k in levels or [0]]))
    p = points.withColumn("p_of", of)
    hit = (F.col("chrom") == F.col("i_chrom")) & (F.col("p_of.bin_level") == F.col("i_level")) & (F.col("p_of.bin") == F.col("i_bin")) & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))
    if how == "inner" or len(levels) < 2:
        return p.join(i, hit, how).drop("i_chrom", "i_level", "i_bin", "p_of")
    # what one level doesn't hold another may, so places are judged over all levels
    places = lambda rows: rows.select(F.col("chrom").alias("h_chrom"), F.col("pos").alias("h_pos")).distinct()
    same = (F.col("chrom") == F.col("h_chrom")) & (F.col("pos") == F.col("h_pos"))
    if how == "left_semi":
        return points.join(places(p.join(i, hit, "left_semi")), same, "left_semi")
    found = checkpointed(p.join(i, hit).drop("i_chrom", "i_level", "i_bin", "p_of"))
    return found.unionByName(points.join(places(found), same, "left_anti"), allowMissingColumns=True)


def overlaps(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """Pairs of overlapping intervals with ``overlap`` in bases; ``right``'s columns get the prefix r_.

    Of a pair, the one of the lower level is looked up in the bins of the other's. A pair
    that shares two bins comes out of the first one alone.
    """
    (lefts, of_left), (rights, of_right) = at_home(left, width), at_home(right, width)

    def placed(rows: DataFrame, others: list[int]) -> tuple[DataFrame, DataFrame | None]:
        """Rows in the bins of their own level, and in those of the others' higher levels."""
        own = rows.withColumn("bin", F.explode(met(width_at(F.col("bin_level"), width))))
        higher = [k for k in others if k > of_lowest]
        if not higher:
            return own, None
        up = rows.withColumn("to", F.explode(F.filter(F.array(*map(F.lit, higher)), lambda k: k > F.col("bin_level"))))
        return own, up.withColumn("bin", F.explode(met(width_at(F.col("to"), width)))).withColumn("bin_level", F.col("to")).drop("to")

    of_lowest = min([*of_left, *of_right], default=0)
    (l_own, l_up), (r_own, r_up) = placed(lefts, of_right), placed(rights, of_left)
    meet = (F.col("chrom") == F.col("r_chrom")) & (F.col("bin_level") == F.col("r_bin_level")) & (F.col("bin") == F.col("r_bin")) & (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
    first = F.floor(F.greatest("start", "r_start") / width_at(F.col("bin_level"), width)) == F.col("bin")
    bases = F.least("end", "r_end") - F.greatest("start", "r_start")
    named = lambda r: r.withColumnsRenamed({c: f"r_{c}" for c in r.columns})
    pairs = l_own.join(named(r_own if r_up is None else r_own.unionByName(r_up)), meet & first)
    if l_up is not None:
        pairs = pairs.unionByName(l_up.join(named(r_own), meet & first))
    return pairs.withColumn("overlap", bases).drop("bin", "r_bin", "bin_level", "r_bin_level")


def by_bins(rows: DataFrame, pos: str, key: str = "chrom", width: int = BIN) -> DataFrame:
    """``rows`` with ``bin`` of their position, dealt out by chromosome and bin."""
    return rows.withColumn("bin", F.floor(F.col(pos) / width)).repartition(key, "bin")


def whole_bins(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[pa.Table]:
    """Batches ordered by chrom and bin, as tables of whole bins of about ``least`` rows in all."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = int(starts_of_bins(table)[-1])
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        n = table.num_rows - cut
        least = max(least, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def starts_of_bins(table: pa.Table) -> np.ndarray:
    """Numbers of the rows with which a bin begins."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in ("chrom", "bin"):
        codes = table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def carried(rows: DataFrame, value: Column, name: str, order: list[Column], strict: bool = True, key: str = "chrom", fold: Callable[[Column | str], Column] = F.max, back: bool = False) -> DataFrame:
    """``rows`` (of ``by_bins``) with ``fold`` of ``value`` over the chromosome's rows ahead (and, unless ``strict``, the row itself).

    Each bin is folded, then the bins' results, a row for each bin; no task walks a
    chromosome's rows. ``back`` goes from the end to the beginning; ``order`` must agree.
    The rows are written once, dealt out by bins, as they are needed twice.
    """
    own = checkpointed(rows.withColumn(name, value))
    along = Window.partitionBy(key).orderBy(F.desc("bin") if back else F.asc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = own.groupBy(key, "bin").agg(fold(name).alias("of_bin")).select(key, "bin", fold("of_bin").over(along).alias("of_bins"))
    within = Window.partitionBy(key, "bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    both = F.array_compact(F.array(fold(name).over(within), "of_bins"))
    joined = {"max": F.array_max, "min": F.array_min, "sum": lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b))}[fold.__name__](both)
    return own.join(bins, [key, "bin"]).withColumn(name, joined).drop("of_bins")


def merge(intervals: DataFrame, touch: bool = True) -> DataFrame:
    """Unions of overlapping (and, by default, touching) intervals of a chromosome, with how many they hold."""
    marked = islands(intervals.select("chrom", "start", "end"), touch)
    return marked.groupBy("chrom", "island").agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).withColumnRenamed("island", "start").select("chrom", "start", "end", "n")


def islands(intervals: DataFrame, touch: bool = True) -> DataFrame:
    """``intervals`` with ``island``: where the union that holds them begins."""
    order = [F.col("start"), F.col("end")]
    reached = carried(by_bins(intervals, "start"), F.col("end"), "reach", order)
    apart = F.col("start") > F.col("reach") if touch else F.col("start") >= F.col("reach")
    first = F.when(F.col("reach").isNull() | apart, F.col("start"))
    # of rows at one place the one that begins a union leads
    return carried(reached, first, "island", [*order, F.col("island").isNull()], strict=False).drop("bin", "reach")


def complement(intervals: DataFrame, lengths: DataFrame) -> DataFrame:
    """What ``intervals`` leave uncovered of every chromosome (chrom, length)."""
    whole = lengths.select("chrom", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))
    last = lengths.select("chrom", F.col("length").cast("long").alias("start"), F.col("length").cast("long").alias("end"))
    edges = by_bins(merge(intervals).select("chrom", "start", "end").unionByName(whole).unionByName(last), "start")
    order = [F.desc("start"), F.desc("end")]
    upto = carried(edges, F.col("start"), "upto", order, fold=F.min, back=True)
    return upto.where(F.col("upto") > F.col("end")).select("chrom", F.col("end").alias("start"), F.col("upto").alias("end"))


def gap_clusters(points: DataFrame, gap: int, key: str = "chrom", pos: str = "pos") -> DataFrame:
    """Runs of points whose neighbours are at most ``gap`` apart: key, first, last, n."""
    order = [F.col(pos)]
    rows = carried(by_bins(points.select(key, pos), pos, key), F.col(pos), "previous", order, key=key)
    first = F.when(F.col("previous").isNull() | (F.col(pos) - F.col("previous") > gap), F.col(pos))
    marked = carried(rows, first, "first", [*order, F.col("first").isNull()], strict=False, key=key)
    return marked.groupBy(key, "first").agg(F.max(pos).alias("last"), F.count(F.lit(1)).alias("n"))


def numbered(rows: DataFrame, pos: str, order: list[Column], key: str = "chrom") -> DataFrame:
    """``rows`` with ``place``: their number from 0 along the chromosome."""
    return carried(by_bins(rows, pos, key), F.lit(1).cast("long"), "place", order, key=key, fold=F.sum).withColumn("place", F.coalesce("place", F.lit(0).cast("long"))).drop("bin")


def moving_sum(rows: DataFrame, value: str, width: int, name: str, key: str = "chrom", stretch: int = 1024) -> DataFrame:
    """``rows`` (``numbered``) with the sum of ``value`` over their own and the next ``width`` - 1 places.

    Stretches of places are summed apart, each with copies of the rows that follow it.
    """
    own = F.floor(F.col("place") / stretch)
    reached = F.floor((F.col("place") - width + 1) / stretch)
    copies = rows.withColumn("stretch", F.explode(F.sequence(F.greatest(reached, F.lit(0)), own)))
    ahead = Window.partitionBy(key, "stretch").orderBy("place").rowsBetween(0, width - 1)
    return copies.withColumn(name, F.sum(value).over(ahead)).where(F.col("stretch") == own).drop("stretch")


def moving_mean(rows: DataFrame, pos: str, value: str, span: int, key: str = "chrom") -> DataFrame:
    """``rows`` with ``mean``: the sum of ``value`` at positions from their own to ``span`` bases on, over ``span``.

    Bins of positions are summed apart, each with copies of the rows that follow it.
    """
    width = max(BIN, span)
    own, reached = F.floor(F.col(pos) / width), F.floor((F.col(pos) - span + 1) / width)
    copies = rows.withColumn("bin", F.explode(F.sequence(F.greatest(reached, F.lit(0)), own)))
    ahead = Window.partitionBy(key, "bin").orderBy(pos).rangeBetween(0, span - 1)
    return copies.withColumn("mean", F.sum(value).over(ahead) / span).where(F.col("bin") == own).drop("bin")


def shifted(rows: DataFrame, value: str, by: int, name: str, key: str = "chrom", stretch: int = 1024) -> DataFrame:
    """``rows`` (``numbered``) with ``value`` of ``by`` places before, 0 where there is none."""
    own = F.floor(F.col("place") / stretch)
    copies = rows.withColumn("stretch", F.explode(F.sequence(own, F.floor((F.col("place") + by) / stretch))))
    order = Window.partitionBy(key, "stretch").orderBy("place")
    before = F.coalesce(F.lag(value, by).over(order), F.lit(0))
    return copies.withColumn(name, before).where(F.col("stretch") == own).drop("stretch")


def quantised_runs(rows: DataFrame, value: str, blocks: int = 10, key: str = "chrom", least: float = 1e-12) -> DataFrame:
    """key, first, last, level: runs of neighbouring places (``numbered``) whose values lie in one of ``blocks`` equal ranges.

    The ranges go from the least to the largest value of the key that is at least ``least``
    of its sum; smaller values belong to no run. ``level`` is where the range begins.
    """
    sums = rows.groupBy(F.col(key).alias("of")).agg(F.sum(value).cast("double").alias("total"))
    known = rows.select(key, "place", F.col(value).cast("double").alias("x")).join(sums, F.col(key) == F.col("of")).where(F.col("x") >= F.lit(least) * F.col("total"))
    ends = known.groupBy(F.col(key).alias("of")).agg(F.min("x").alias("low"), F.max("x").alias("high"))
    edges = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.col("low") + (i / F.lit(float(blocks))) * (F.col("high") - F.col("low")))
    levels = known.drop("of").join(ends, F.col(key) == F.col("of")).select(key, "place", F.array_max(F.filter(edges, lambda e: e <= F.col("x"))).alias("level"))
    order = [F.col("place")]
    rows = carried(by_bins(levels, "place", key), F.struct("place", "level"), "previous", order, key=key)
    first = F.col("previous").isNull() | (F.col("previous.place") < F.col("place") - 1) | (F.col("previous.level") != F.col("level"))
    marked = carried(rows, F.when(first, F.col("place")), "first", order, strict=False, key=key)
    return marked.groupBy(key, "first").agg(F.max("place").alias("last"), F.max("level").alias("level"))


def runs_of(seqs: DataFrame, pattern: str = "[^ACGTU]+", size: int = 65_536) -> DataFrame:
    """Maximal runs that match a one-sign pattern: chrom, start, end (from chrom, seq).

    Found in pieces of the sequences, each as one array, in time in proportion to their
    length. Those that reach an edge of their piece are put together with their neighbours.
    """
    from strandloom.operators.chunks import chunked

    return piece_runs(chunked(seqs, size, 0), pattern)


def piece_runs(pieces: DataFrame, pattern: str = "[^ACGTU]+") -> DataFrame:
    """The same from pieces (chrom, start, piece) that follow each other without gap or halo."""
    one = re.compile(pattern.removesuffix("+"))
    inside = np.array([one.fullmatch(chr(i)) is not None for i in range(256)])
    kind = dict(pieces.dtypes)["chrom"]

    def found(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            for i, (at, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                hit = inside[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
                edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False]))))
                starts, ends = edges[::2], edges[1::2]
                if len(starts):
                    open_ = (starts == 0) | (ends == len(hit))
                    yield pa.RecordBatch.from_arrays([pa.repeat(b.column(0)[i], len(starts)), pa.array(starts + at), pa.array(ends + at), pa.array(open_)], names=["chrom", "start", "end", "open"])

    # long rows go to tasks one by one
    runs = checkpointed(pieces.select("chrom", "start", "piece").mapInArrow(found, f"chrom {kind}, start long, end long, open boolean"))
    return runs.where(~F.col("open")).drop("open").unionByName(merge(runs.where("open").drop("open")).drop("n"))


def balanced_parts(regions: DataFrame, parts: int) -> DataFrame:
    """``regions`` with ``part``: runs of regions with about equal total length.

    Chromosomes are summed first, then regions along each, so a task holds a bin's
    regions or one number a chromosome.
    """
    length = F.col("end") - F.col("start")
    of_chrom = regions.groupBy("chrom").agg(F.sum(length).alias("of_chrom"))
    along = Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)
    ahead = of_chrom.select("chrom", F.coalesce(F.sum("of_chrom").over(along), F.lit(0)).alias("of_chroms"))
    total = of_chrom.agg(F.sum("of_chrom").alias("total"))
    placed = carried(by_bins(regions, "start"), length, "before", [F.col("start")], fold=F.sum).join(ahead, "chrom").join(F.broadcast(total))
    before = F.coalesce("before", F.lit(0)) + F.col("of_chroms")
    return placed.withColumn("part", F.least(F.floor(before * parts / F.col("total")), F.lit(parts - 1))).drop("before", "total", "bin", "of_chroms")
