"""Comparison of call sets with the truth, and of mutation models with each other."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.intervals import BIN, merge, overlaps, points_in_intervals, starts_of_bins, whole_bins

ALLELE = ["chrom", "pos", "ref", "alt"]
#: Bases on each side of a wrong call within which missed variants may say the same.
NEIGHBOURHOOD = 50


def judged(golden: DataFrame, called: DataFrame) -> DataFrame:
    """chrom, pos, ref, alt, in_golden, in_called, solved of every variant of either set, from one pass over both.

    A position at which some allele is in both sets is solved, with everything there.
    """
    return judged_rows(golden.select(*ALLELE, F.lit(True).alias("g")).unionByName(called.select(*ALLELE, F.lit(False).alias("g"))))


def judged_rows(both: DataFrame, *by: str) -> DataFrame:
    """The same from one set of rows with ``g``, which marks the golden ones; ``by`` are columns that follow from chrom and pos and say how rows are dealt out."""
    alleles = both.groupBy(*by, *ALLELE).agg(F.count_if("g").alias("n_golden"), F.count_if(~F.col("g")).alias("n_called"))
    place = F.struct("ref", "alt", "n_golden", "n_called")
    # the alleles of a position are few
    at = alleles.groupBy(*by, "chrom", "pos").agg(F.collect_list(place).alias("alleles"), F.max((F.col("n_golden") > 0) & (F.col("n_called") > 0)).alias("solved"))
    return at.select("chrom", "pos", "solved", F.explode("alleles").alias("of")).select("chrom", "pos", "of.*", "solved")


def missed_and_wrong(golden: DataFrame, called: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Golden variants and calls at positions that aren't solved."""
    rest = judged(golden, called).where(~F.col("solved"))
    side = lambda n: rest.where(F.col(n) > 0).select(*ALLELE, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias("copy")).drop("copy")
    return side("n_golden"), side("n_called")


def summary(golden: DataFrame, called: DataFrame) -> DataFrame:
    """One row: variants of both sets, solved positions, missed and wrong variants, and the two rates in percent."""
    j = judged(golden, called)
    count = lambda n, when=None: F.coalesce(F.sum(n if when is None else F.when(when, F.col(n))), F.lit(0)).cast("long")
    row = j.groupBy("chrom", "pos").agg(F.max("solved").alias("solved"), F.sum("n_golden").alias("n_golden"), F.sum("n_called").alias("n_called"))
    row = row.agg(
        count("n_golden").alias("n_golden"),
        count("n_called").alias("n_called"),
        F.count_if("solved").alias("n_perfect"),
        count("n_golden", ~F.col("solved")).alias("n_missed"),
        count("n_called", ~F.col("solved")).alias("n_wrong"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.round(100.0 * F.col(a) / F.col(b), 6)).otherwise(0.0)
    return row.select("*", share("n_missed", "n_golden").alias("missed_pct"), share("n_wrong", "n_called").alias("wrong_pct"))


def attribution(missed: DataFrame, mappable: DataFrame, depth: DataFrame, least_depth: int = 10) -> DataFrame:
    """``missed`` with unmappable, low_depth and unknown (neither); depth is (chrom, start, end, depth).

    A variant that no depth is known of has a null depth, and that is no reason.
    """
    marks = mappable.select("chrom", "start", "end", F.lit(None).cast("long").alias("depth"), F.lit(True).alias("hard"))
    marks = marks.unionByName(depth.select("chrom", "start", "end", F.col("depth").cast("long").alias("depth"), F.lit(False).alias("hard")))
    located = points_in_intervals(missed.select(ALLELE).distinct(), marks, "left")
    flags = located.groupBy(ALLELE).agg(F.coalesce(F.max("hard"), F.lit(False)).alias("unmappable"), F.sum("depth").alias("depth"))
    low = F.coalesce(F.col("depth") < least_depth, F.lit(False))
    return flags.withColumn("low_depth", low).withColumn("unknown", ~F.col("unmappable") & ~F.col("low_depth"))


def long_targets(targets: DataFrame, least: int) -> DataFrame:
    """Targets of ``least`` bases or more; variants in shorter ones take no part in a comparison."""
    return targets.where(F.col("end") - F.col("start") >= least)


def sided(rest: DataFrame) -> DataFrame:
    """chrom, pos, ref, alt, g: a row for each copy of the variants of ``judged`` on either side."""
    copies = F.concat(F.array_repeat(F.lit(True), F.col("n_golden").cast("int")), F.array_repeat(F.lit(False), F.col("n_called").cast("int")))
    return rest.select(*ALLELE, F.explode(copies).alias("g"))


def equivalents(missed: DataFrame, wrong: DataFrame, seqs: DataFrame, reach: int = NEIGHBOURHOOD) -> DataFrame:
    """Wrong calls that give the same haplotype as missed variants near them: chrom, pos, ref, alt, n_missed.

    Both sets within ``reach`` of a call are put into the reference around it; equal
    strings say the same. Variants in each other's way, or whose reference bases aren't
    there, aren't applied: such a set is equal to none.
    """
    return equivalents_among(missed.select(*ALLELE, F.lit(True).alias("g")).unionByName(wrong.select(*ALLELE, F.lit(False).alias("g"))), seqs, reach)


def equivalents_among(rows: DataFrame, seqs: DataFrame, reach: int = NEIGHBOURHOOD) -> DataFrame:
    """The same from one set of rows with ``g``, which marks the missed ones.

    Rows are dealt out once by bins, those near an edge to both sides of it. Calls whose
    sets can't be equal go where they are (``neighbourhoods``); pairs of calls and near
    variants never are rows. What is left meets the sequence, piece by piece.
    """
    from strandloom.operators.chunks import bases_at

    end = F.col("pos") + F.char_length("ref")
    low, high = F.floor((F.col("pos") - reach) / BIN), F.floor((end + reach - 1) / BIN)
    placed = rows.where(F.char_length("ref") > 0).withColumn("bin", F.explode(F.sequence(low, high)))
    kind = dict(rows.dtypes)["chrom"]
    schema = f"chrom {kind}, pos long, ref string, alt string, missed array<struct<pos:long,ref:string,alt:string>>, wrong array<struct<pos:long,ref:string,alt:string>>"
    order = ["chrom", "bin", "g", "pos", "ref", "alt"]
    dealt = placed.select("chrom", "bin", F.col("pos").cast("long").alias("pos"), "ref", "alt", "g").repartition("chrom", "bin").sortWithinPartitions(*order)
    sets = dealt.mapInArrow(lambda batches: neighbourhoods(batches, reach), schema)
    margin = 2 * reach
    framed = bases_at(sets, seqs, before=margin, length=2 * margin + 1, size=2048).withColumn("begin", F.greatest(F.col("pos") - margin, F.lit(0)))
    same = local_haplotype("missed") == local_haplotype("wrong")
    return framed.where(same).select(*ALLELE, F.size("missed").cast("long").alias("n_missed"))


class Side:
    """The variants of one side, ordered by bin and position, and sums along them."""

    def __init__(self, at: np.ndarray, rows: np.ndarray, size: np.ndarray, gain: np.ndarray) -> None:
        self.rows, self.starts, self.ends = rows, at[rows], (at + size)[rows]
        n = len(rows)
        self.sorted_ends = np.sort(self.ends)
        meets = np.concatenate((self.starts[1:] < self.ends[:-1], [False]))[:n]
        self.meets, self.gain = (np.concatenate(([0], np.cumsum(x))) for x in (meets, gain[rows]))
        self.furthest = np.maximum.accumulate(np.where(self.ends >= np.maximum.accumulate(self.ends), np.arange(n), 0)) if n else np.zeros(0, int)

    def near(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each stretch: first and last of its places, the place of what reaches into it (or -1), whether no two meet, and the bases gained."""
        first, last = np.searchsorted(self.starts, low, "left"), np.searchsorted(self.starts, high, "left")
        into = first - np.searchsorted(self.sorted_ends, low, "right")
        reaching = np.where(into > 0, self.furthest[first - 1], -1) if len(self.rows) else np.full(len(low), -1)
        free = (into < 2) & (self.meets[np.maximum(last - 1, first)] == self.meets[first])
        both = (reaching >= 0) & (first < last)
        free[both] &= self.starts[first[both]] >= self.ends[reaching[both]]
        gained = self.gain[last] - self.gain[first] + np.where(reaching >= 0, self.gain[reaching + 1] - self.gain[reaching], 0)
        return first, last, reaching, free, gained

    def lists(self, first: np.ndarray, last: np.ndarray, reaching: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each stretch's list, and the rows of all lists."""
        extra = (reaching >= 0).astype(np.int64)
        size = last - first + extra
        offsets = np.concatenate(([0], np.cumsum(size)))
        step = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size)
        place = np.repeat(first - extra, size) + step
        place[offsets[:-1][extra > 0]] = reaching[extra > 0]
        return offsets, self.rows[place]


def neighbourhoods(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """Calls with the missed and the wrong variants within ``reach``, from rows ordered by chrom, bin, g and position.

    Left out, as their haplotypes can't be equal: calls without a missed variant, those
    of which two variants of a side meet, and those whose sides gain unlike numbers of
    bases. A call is looked at in its own bin alone.
    """
    for t in whole_bins(batches):
        pos = t.column("pos").to_numpy()
        size, longer = (pa.compute.utf8_length(t.column(c)).fill_null(0).to_numpy().astype(np.int64) for c in ("ref", "alt"))
        g, of_bin = t.column("g").to_numpy(), t.column("bin").to_numpy()
        begins = starts_of_bins(t)
        number = np.searchsorted(begins, np.arange(len(pos)), "right") - 1
        # bins follow each other on one line, far enough apart
        local = pos - of_bin * BIN
        room = BIN + 2 * int(max(np.abs(local).max(), 0) + size.max() + 2 * reach)
        at = number * room + local
        missed, wrong = (Side(at, rows, size, longer - size) for rows in (np.flatnonzero(g), np.flatnonzero(~g)))
        calls = wrong.rows[of_bin[wrong.rows] == pos[wrong.rows] // BIN]
        low, high = at[calls] - reach, at[calls] + reach + 1
        m, w = missed.near(low, high), wrong.near(low, high)
        kept = m[3] & w[3] & (m[4] == w[4]) & ((m[1] > m[0]) | (m[2] >= 0))
        calls = calls[kept]
        if not len(calls):
            continue
        one = pa.StructArray.from_arrays([t.column(c).combine_chunks() for c in ("pos", "ref", "alt")], names=["pos", "ref", "alt"])
        lists = []
        for side, of in ((missed, m), (wrong, w)):
            offsets, rows = side.lists(*(x[kept] for x in of[:3]))
            lists.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), one.take(pa.array(rows))))
        columns = [t.column(c).combine_chunks().take(pa.array(calls)) for c in ALLELE]
        yield pa.RecordBatch.from_arrays([*columns, *lists], names=[*ALLELE, "missed", "wrong"])


def local_haplotype(rows: str) -> Column:
    """``around``, which begins at ``begin``, with the ordered variants of ``rows`` applied; null where they don't fit."""
    bases = lambda at, n: F.substring(F.col("around"), (at - F.col("begin") + 1).cast("int"), n.cast("int"))
    stop = lambda v: v["pos"] + F.char_length(v["ref"])
    before = lambda i: F.coalesce(stop(F.get(F.col(rows), i - 1)), F.col("begin"))
    fits = F.transform(F.col(rows), lambda v, i: (v["pos"] >= before(i)) & (bases(v["pos"], F.char_length(v["ref"])) == v["ref"]))
    parts = F.transform(F.col(rows), lambda v, i: F.concat(bases(before(i), F.greatest(v["pos"] - before(i), F.lit(0))), v["alt"]))
    tail = bases(stop(F.element_at(F.col(rows), -1)), F.lit(1 << 30))
    return F.when(F.forall(fits, lambda ok: ok), F.concat(F.array_join(parts, ""), tail))


def model_overlap(regions: dict[str, DataFrame], common: dict[str, DataFrame]) -> DataFrame:
    """For each pair of models: shared bases of their regions, shared common variants, and both Jaccard indices."""
    out = None
    for a, b in combinations(sorted(regions), 2):
        size = lambda df: df.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("size"))
        ra, rb = merge(regions[a]), merge(regions[b])
        shared = overlaps(ra.select("chrom", "start", "end"), rb.select("chrom", "start", "end")).agg(F.coalesce(F.sum("overlap"), F.lit(0)).alias("shared_bp"))
        both = common[a].select(ALLELE).intersect(common[b].select(ALLELE)).agg(F.count(F.lit(1)).alias("shared_variants"))
        n = lambda df: df.select(ALLELE).distinct().agg(F.count(F.lit(1)).alias("n"))
        row = shared.join(both).join(size(ra).withColumnRenamed("size", "size_a")).join(size(rb).withColumnRenamed("size", "size_b")).join(n(common[a]).withColumnRenamed("n", "n_a")).join(n(common[b]).withColumnRenamed("n", "n_b"))
        index = lambda s, x, y: F.when(F.col(x) + F.col(y) - F.col(s) > 0, F.col(s) / (F.col(x) + F.col(y) - F.col(s))).otherwise(0.0)
        row = row.select(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), "shared_bp", "shared_variants", index("shared_bp", "size_a", "size_b").alias("region_jaccard"), index("shared_variants", "n_a", "n_b").alias("variant_jaccard"))
        out = row if out is None else out.unionByName(row)
    return out
