"""The read simulator as one plan: windows, variants, haplotypes, fragments, reads.

Every draw is a hash of the seed and of what it is for (chromosome, window, ploid,
number), so results don't depend on partitions or on tasks that ran twice, and windows
need nothing from each other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.random import draw, normal_lengths, random_dna, uniform, uniform_int
from strandloom.functions.sequence import BASES, TRINUCLEOTIDES, apply_variants, haplotype_cigar, reverse_complement, wp_string
from strandloom.operators.chunks import chunked
from strandloom.operators.intervals import BIN, overlaps, points_in_intervals, starts_of_bins, whole_bins
from strandloom.plans import reads as reads_


@dataclass(frozen=True)
class MutationModel:
    """The default model of germline variation."""

    rate: float = 0.001
    homozygous: float = 0.010
    indel: float = 0.05
    insertion: float = 0.6
    insertion_lengths: dict[int, float] = field(default_factory=lambda: {n: 1.0 for n in range(1, 11)})
    deletion_lengths: dict[int, float] = field(default_factory=lambda: {n: 1.0 for n in range(1, 6)})
    transition: float = 0.7
    bias: dict[str, float] = field(default_factory=lambda: dict.fromkeys(TRINUCLEOTIDES, 1.0))
    #: For each trinucleotide the chances of A, C, G and T in its middle; None: ``transition`` for all.
    substitutions: dict[str, tuple[float, float, float, float]] | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.rate <= 0.3:
            raise ValueError("the mutation rate must be between 0 and 0.3")


@dataclass(frozen=True)
class ReadModel:
    """Lengths, coverage and errors of reads."""

    length: int = 100
    coverage: float = 10.0
    fragment: tuple[float, float] | None = None  # mean and standard deviation; None: single reads
    #: Learned fragment lengths and their weights, in place of the normal ones; shorter than a read are left out.
    fragment_lengths: tuple[tuple[int, ...], tuple[float, ...]] | None = None
    #: Learned qualities: chances at the first place, and at each later one by the quality before.
    chain: tuple[np.ndarray, np.ndarray] | None = field(default=None, compare=False)
    ploidy: int = 2
    qualities: tuple[int, ...] = (2, 11, 25, 37)
    #: Chance of each quality after each other one; the default stays mostly.
    stay: float = 0.9
    error_scale: float = 1.0
    indel_error: float = 0.01
    insertion_error: float = 0.4
    #: Lengths of inserted and deleted stretches and their weights.
    error_lengths: tuple[tuple[int, ...], tuple[float, ...]] = ((1, 2), (0.999, 0.001))
    mask_below: int | None = None
    seed: int = 1

    def __post_init__(self) -> None:
        checks = ((10 <= self.length <= 1_000_000, "read length"), (0 < self.coverage <= 1_000_000, "coverage"), (1 <= self.ploidy <= 100, "ploidy"))
        for ok, what in checks:
            if not ok:
                raise ValueError(f"{what} out of range")
        if self.paired and self.mean_fragment <= self.length:
            raise ValueError("fragments must be longer than reads")

    @property
    def paired(self) -> bool:
        return self.fragment is not None or self.fragment_lengths is not None

    def lengths(self) -> tuple[list[int], list[float]]:
        """Fragment lengths and weights to draw from."""
        if self.fragment_lengths is None:
            return normal_lengths(*self.fragment, least=self.length)
        kept = [(n, w) for n, w in zip(*self.fragment_lengths, strict=True) if n > self.length]
        return [n for n, _ in kept], [w for _, w in kept]

    @property
    def mean_fragment(self) -> float:
        if self.fragment_lengths is None:
            return self.fragment[0]
        values, weights = self.lengths()
        return sum(n * w for n, w in zip(values, weights, strict=True)) / sum(weights) if values else 0.0

    @property
    def span(self) -> int:
        return int(self.mean_fragment) if self.paired else self.length


def window_plan(regions: DataFrame, size: int, overlap: int) -> DataFrame:
    """chrom, win, start, core_end, end: equal windows of about ``size`` bases (chrom, start, end in).

    A window's core ends where the next one begins; ``end`` reaches ``overlap`` beyond it.
    """
    span = F.col("end") - F.col("start")
    n = F.greatest(F.floor(span / size), F.lit(1))
    rows = regions.where(span > 0).select("chrom", F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("win"), n.alias("n"))
    step = F.floor((F.col("e") - F.col("s")) / F.col("n"))
    begin, last = F.col("s") + F.col("win") * step, F.col("win") == F.col("n") - 1
    core = F.when(last, F.col("e")).otherwise(begin + step)
    return rows.select("chrom", "win", begin.alias("start"), core.alias("core_end"), F.least(core + overlap, F.col("e")).alias("end"))


#: Bases of the pieces that are sent on at once.
SENT = 1 << 22


def window_pieces(seqs: DataFrame, size: int, overlap: int) -> DataFrame:
    """``window_plan`` of whole sequences (chrom, seq) with ``piece``, the bases from ``start`` to ``end``: cut in one pass, without a join."""
    kind = dict(seqs.dtypes)["chrom"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chrom", "win", "start", "core_end", "end", "piece"]
        for b in batches:
            rows, held = [], 0

            def out(rows: list, b: pa.RecordBatch = b) -> pa.RecordBatch:
                of, *columns = zip(*rows, strict=True)
                kinds = [*[pa.int64()] * 4, pa.string()]
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

            for i, text in enumerate(b.column(1)):
                text = text.as_py() or ""
                n = max(len(text) // size, 1)
                step = len(text) // n
                for win in range(n if text else 0):
                    core_end = len(text) if win == n - 1 else (win + 1) * step
                    end = min(core_end + overlap, len(text))
                    rows.append((i, win, win * step, core_end, end, text[win * step : end]))
                    held += end - win * step
                    if held >= SENT:
                        yield out(rows)
                        rows, held = [], 0
            if rows:
                yield out(rows)

    return seqs.select("chrom", "seq").mapInArrow(run, f"chrom {kind}, win long, start long, core_end long, end long, piece string")


#: Greatest rate that one Poisson draw has.
POISSON_RATE = 300


def stretches(spans: DataFrame, seqs: DataFrame, begin: str, end: str, keys: list[str]) -> DataFrame:
    """``spans`` (chrom, keys, ...) with ``piece``, the bases from ``begin`` to ``end``: joined with short pieces of the sequence by (chrom, bin)."""
    s = spans.select("chrom", *keys, F.col(begin).alias("start"), F.col(end).alias("end"))
    met = overlaps(s, chunked(seqs, BIN, 0).select("chrom", "start", (F.col("start") + F.char_length("piece")).alias("end"), "piece"))
    low = F.greatest("start", "r_start")
    part = F.substring("r_piece", (low - F.col("r_start") + 1).cast("int"), (F.least("end", "r_end") - low).cast("int"))
    whole = met.groupBy("chrom", *keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_start", part.alias("part")))), lambda x: x["part"]), "").alias("piece"))
    return spans.join(whole, ["chrom", *keys])


def poisson_count(u: Column, rate: Column) -> Column:
    """Inverse distribution function of a Poisson count whose rate is a column, POISSON_RATE at most."""
    # the state holds rate and u, which would be worked out again at each step
    held = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cum"), F.lit(0).alias("k"), rate.alias("rate"), u.alias("u"))
    ks = F.sequence(F.lit(1), F.ceil(rate * 3 + 20).cast("int"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * s["rate"] / k
        return F.struct(p.alias("p"), (s["cum"] + p).alias("cum"), F.when(s["cum"] <= s["u"], k).otherwise(s["k"]).alias("k"), s["rate"].alias("rate"), s["u"].alias("u"))

    return F.aggregate(ks, held, step, lambda s: s["k"])


def poisson_sum(rate: Column, *key: object) -> Column:
    """A Poisson count of any rate: the sum of independent ones of POISSON_RATE at most, drawn by ``key``."""
    parts = F.ceil(rate / POISSON_RATE).cast("int")
    many = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, part: n + poisson_count(uniform(*key, part), rate / parts))
    return F.when(parts <= 1, poisson_count(uniform(*key), rate)).otherwise(many)


def random_variants(windows: DataFrame, seqs: DataFrame, model: MutationModel, ploidy: int, seed: int, rates: DataFrame | None = None) -> DataFrame:
    """Variants drawn in each window's core: chrom, win, pos, ref, alt, ploids.

    Places come from a Poisson process of the highest rate any place has, thinned to each
    one's own, which gives exactly the biased process. ``rates`` (chrom, start, end,
    rate, not overlapping) hold in their intervals, the model's rate elsewhere. Windows
    that come with their ``piece`` need no sequence.
    """
    top = max(model.bias.values()) or 1.0
    most = model.rate if rates is None else max(model.rate, rates.agg(F.max("rate")).first()[0] or 0.0)
    if "piece" in windows.columns:
        core = once(windows.select("chrom", "win", "start", "core_end", F.col("piece").alias("reaching")), F.left("reaching", (F.col("core_end") - F.col("start")).cast("int")).alias("piece")).drop("core_end", "reaching")
    else:
        core = stretches(windows, seqs, "start", "core_end", ["win"]).select("chrom", "win", "start", "piece")
    key = lambda what: ("mut", seed, what, F.col("chrom"), F.col("win"), F.col("k"))
    n = F.col("n")
    count = poisson_sum(n * F.lit(most * top), "mut", seed, "n", F.col("chrom"), F.col("win"))
    rows = once(once(core, F.char_length("piece").alias("n")).where(n > 2), count.alias("count")).where(F.col("count") > 0)
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("count"))))
    # from here on a variant has its own few bases, from the one ahead of it to where the longest deletion ends
    rows = once(rows, (uniform_int(n - 2, *key("pos")) + 1).cast("int").alias("off"))
    rows = once(rows, F.substring("piece", F.col("off"), F.lit(max(model.deletion_lengths) + 2)).alias("near")).drop("piece", "n", "count")
    weight = F.create_map(*[F.lit(x) for t, w in model.bias.items() for x in (t, w / top)])
    tri = F.left("near", F.lit(3))
    local = F.lit(model.rate / most if most else 0.0)
    if rates is not None:
        rows = points_in_intervals(rows.withColumn("pos", F.col("start") + F.col("off")).withColumnRenamed("start", "w_start"), rates.select("chrom", "start", "end", "rate"), "left")
        rows = rows.drop("start", "end").withColumnRenamed("w_start", "start")
        local = F.coalesce("rate", F.lit(model.rate)) / F.lit(most or 1.0)
    rows = rows.where(uniform(*key("thin")) < local * F.coalesce(F.try_element_at(weight, tri), F.lit(0.0)))
    base = F.substring("near", F.lit(2), F.lit(1))
    other = F.translate(base, "ACGT", "GTAC")
    snp = F.when(uniform(*key("alt")) < model.transition, other).when(uniform(*key("tv")) < 0.5, F.translate(base, "ACGT", "CAAA")).otherwise(F.translate(base, "ACGT", "TGTG"))
    if model.substitutions is not None:
        share = {t: [sum(p[:i]) / (sum(p) or 1.0) for i in range(4)] for t, p in model.substitutions.items()}
        low = F.create_map(*[x for t, c in share.items() for x in (F.lit(t), F.array(*map(F.lit, c)))])
        drawn = uniform(*key("alt"))
        snp = F.element_at(F.array(*map(F.lit, BASES)), F.size(F.filter(F.try_element_at(low, tri), lambda c: c <= drawn)))
    inserted = F.concat(base, random_dna(draw(uniform(*key("len")), list(model.insertion_lengths), list(model.insertion_lengths.values())), *key("ins")))
    gone = draw(uniform(*key("len")), list(model.deletion_lengths), list(model.deletion_lengths.values()))
    deleted = F.substring("near", F.lit(2), gone + 1)
    rows = once(rows, (uniform(*key("type")) < model.indel).alias("is_indel"), (uniform(*key("ins?")) < model.insertion).alias("is_ins"))
    is_indel, is_ins = F.col("is_indel"), F.col("is_ins")
    one = F.array(uniform_int(ploidy, *key("ploid")).cast("int"))
    every = F.sequence(F.lit(0), F.lit(ploidy - 1))
    ref = F.when(is_indel & ~is_ins, deleted).otherwise(base)
    alt = F.when(is_indel & is_ins, inserted).when(is_indel, base).otherwise(snp)
    placed = once(rows, ref.alias("ref"), alt.alias("alt"), F.when(uniform(*key("hom")) < model.homozygous, every).otherwise(one).alias("ploids"))
    found = placed.select("chrom", "win", (F.col("start") + F.col("off")).alias("pos"), "ref", "alt", "ploids")
    return found.where((F.col("ref") != F.col("alt")) & F.col("ref").rlike("^[ACGT]+$"))


def once(rows: DataFrame, *columns: Column) -> DataFrame:
    """``rows`` with columns that are worked out once a row, as the explode of one value; else Spark does so wherever they are used."""
    return rows.select("*", F.inline(F.array(F.struct(*columns))))


def without_conflicts(variants: DataFrame, ploids: str | None = None) -> DataFrame:
    """Variants (chrom, pos, ref, alt, ...) less those that meet bases of one applied before, ploid by ploid.

    Variants are applied by position, of those at one place indels first, as they mask
    SNPs. Only what is applied blocks: of a chain whose second one meets the first and
    the third, the first and the third stay. With ``ploids`` (an array column) each
    variant keeps the ploids in which it is applied. Bins are folded apart, so no task
    walks a chromosome (``applied_in_bins``); what hangs on the bin before, a few rows at
    its beginning, is told afterwards (``told_by_bins``). The rows are dealt out once.
    """
    kept = [c for c in variants.columns if c not in ("chrom", "pos", "ref", "alt", ploids)]
    on = ploids or "on_ploids"
    rows = variants if ploids else variants.withColumn(on, F.array(F.lit(0)))
    end = F.col("pos") + F.greatest(F.char_length("ref"), F.lit(1))
    names = ["chrom", "pos", "ref", "alt", *kept, on]
    placed = rows.select(*names, F.explode(F.sequence(F.floor(F.col("pos") / BIN), F.floor((end - 1) / BIN))).alias("bin"))
    plain = (F.char_length("ref") == F.char_length("alt")).cast("int")
    dealt = placed.repartition("chrom", "bin").sortWithinPartitions("chrom", "bin", "pos", plain, "ref", "alt", *kept)
    schema = ", ".join(f"`{c}` {k}" for c, k in rows.select(*names).dtypes)
    folded = dealt.mapInArrow(lambda batches: applied_in_bins(batches, names), f"{schema}, bin long, kind int, told array<struct<ploid:int,into:long,out:long>>")
    later = folded.where("kind > 0").repartition("chrom").sortWithinPartitions("chrom", "bin", "kind")
    found = folded.where("kind = 0").select(*names).unionByName(later.mapInArrow(lambda batches: told_by_bins(batches, names), schema))
    return found.select(*variants.columns)


#: Where the bases taken in the bin before end: none reach into this one, or it is all the same.
NONE, ANY = -1, -2


def applied_in_bins(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by chrom, bin and position, with the ploids in which they are applied (kind 0).

    A bin has copies of the rows that reach into it, so it knows all places where the
    bases taken before may end, and is folded for each of them. The ways soon become one;
    rows before that (kind 1) say in ``told`` for which ploids and places they are
    applied. Kind 2 says where a bin's own taken bases end, if that is in the next one.
    """
    on = names[-1]
    for t in whole_bins(batches):
        pos, size = t.column("pos").to_pylist(), pa.compute.utf8_length(t.column("ref")).to_pylist()
        bins, lists = t.column("bin").to_pylist(), t.column(on).combine_chunks().fill_null([])
        flat, edges = lists.flatten().to_pylist(), np.concatenate(([0], np.cumsum(pa.compute.list_value_length(lists).to_numpy()))).tolist()
        ploids = [flat[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        again = same_as_before(t, ["bin", "pos", "ref", "alt", *names[4:-1]])
        begins = [*starts_of_bins(t).tolist(), len(pos)]
        out: list[tuple] = []  # row, ploids, kind, told
        for low, high in zip(begins, begins[1:], strict=False):
            start, stop = bins[low] * BIN, (bins[low] + 1) * BIN
            ways: dict[int, dict[int, int]] = {}
            reach: dict[int, int] = {}
            i = low
            while i < high and pos[i] < start:
                for p in ploids[i]:
                    ways.setdefault(p, {NONE: NONE})[pos[i] + size[i]] = pos[i] + size[i]
                i += 1
            while i < high:
                at, row, mine = pos[i], i, ploids[i]
                end = at + size[i]
                i += 1
                while i < high and again[i]:  # the same variant on other ploids
                    mine, i = [*mine, *ploids[i]], i + 1
                sure, told = [], []
                for p in sorted(set(mine)) if len(mine) > 1 else mine:
                    if p not in ways:
                        if at >= reach.get(p, NONE):
                            sure.append(p)
                            reach[p] = end
                        continue
                    way = ways[p]
                    free = [k for k, r in way.items() if at >= r]
                    way.update(dict.fromkeys(free, end))
                    if len(free) == len(way):
                        sure.append(p)
                    else:
                        told += [(p, k, None) for k in free]
                    if len(set(way.values())) == 1:
                        reach[p] = next(iter(way.values()))
                        del ways[p]
                if sure or told:
                    out.append((row, sure, int(bool(told)), told))
            after = [(p, ANY, r) for p, r in reach.items() if r > stop] + [(p, k, r) for p, way in ways.items() for k, r in way.items() if r > stop]
            if after:
                out.append((low, [], 2, after))
        if out:
            row, sure, kind, told = zip(*out, strict=True)
            take = pa.array(row)
            columns = [t.column(c).combine_chunks().take(take) for c in (*names[:-1], "bin")]
            columns.insert(len(names) - 1, listed(sure, t.schema.field(on).type))
            told = listed([[{"ploid": p, "into": k, "out": r} for p, k, r in x] if x else x for x in told], pa.list_(pa.struct([("ploid", pa.int32()), ("into", pa.int64()), ("out", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kind, pa.int32()), told], names=[*names, "bin", "kind", "told"])


def listed(values: Sequence[list], kind: pa.ListType) -> pa.ListArray:
    """A list column of Python lists."""
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in values])))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([y for x in values for y in x], kind.value_type), type=kind)


def same_as_before(t: pa.Table, names: list[str]) -> list[bool]:
    """Whether each row has the values of the one before it."""
    same = np.zeros(t.num_rows, bool)
    same[1:] = True
    for c in names:
        codes = t.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        same[1:] &= codes[1:] == codes[:-1]
    return same.tolist()


def told_by_bins(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of kinds 1 and 2, by chrom, bin and kind: each with the ploids in which it is applied after all."""
    last, into, after = None, {}, {}
    for b in batches:
        rows, found = [], []
        columns = (b.column(c).to_pylist() for c in ("chrom", "bin", "kind", names[-1], "told"))
        for i, (chrom, bin_, kind, sure, told) in enumerate(zip(*columns, strict=True)):
            if last != (chrom, bin_):
                into = after if last == (chrom, bin_ - 1) else {}
                last, after = (chrom, bin_), {}
            hit = [x for x in told if x["into"] == ANY or into.get(x["ploid"], NONE) == x["into"]]
            if kind == 2:
                after = {x["ploid"]: x["out"] for x in hit}
            elif sure or hit:
                rows.append(i)
                found.append(sorted({*sure, *(x["ploid"] for x in hit)}))
        if rows:
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in names[:-1]), pa.array(found, b.schema.field(names[-1]).type)], names=names)


def haplotypes(windows: DataFrame, seqs: DataFrame, variants: DataFrame, ploidy: int) -> DataFrame:
    """chrom, win, ploid, start, seq, cigar, variants of every window and ploid, with the variants (ploids) put in.

    A variant counts in each window that holds it whole, so overlaps agree.
    """
    inside = overlaps(windows.select("chrom", "win", "start", "end"), variants.select("chrom", F.col("pos").alias("start"), (F.col("pos") + F.char_length("ref")).alias("end"), "ref", "alt", "ploids"))
    inside = inside.where((F.col("r_start") >= F.col("start")) & (F.col("r_end") <= F.col("end")))
    v = F.struct((F.col("r_start") - F.col("start")).cast("int").alias("off"), F.col("r_ref").alias("ref"), F.col("r_alt").alias("alt"), F.col("r_ploids").alias("ploids"))
    grouped = inside.groupBy("chrom", "win").agg(F.array_sort(F.collect_list(v)).alias("variants"))
    return spelled(stretches(windows, seqs, "start", "end", ["win"]).select("chrom", "win", "start", "piece").join(grouped, ["chrom", "win"], "left"), ploidy)


def window_haplotypes(windows: DataFrame, variants: DataFrame, ploidy: int) -> DataFrame:
    """The same from ``window_pieces`` and variants that know the window (``win``) in whose core they begin.

    A window shares bases with the one before it alone, so a variant goes to these two.
    """
    two = variants.select("chrom", F.explode(F.sequence(F.greatest(F.col("win") - 1, F.lit(0)), F.col("win"))).alias("win"), "pos", "ref", "alt", "ploids")
    grouped = two.groupBy("chrom", "win").agg(F.array_sort(F.collect_list(F.struct("pos", "ref", "alt", "ploids"))).alias("variants"))
    every = windows.select("chrom", "win", "start", "end", "piece").join(grouped, ["chrom", "win"], "left")
    whole = F.filter("variants", lambda v: (v["pos"] >= F.col("start")) & (v["pos"] + F.char_length(v["ref"]) <= F.col("end")))
    placed = F.transform(whole, lambda v: F.struct((v["pos"] - F.col("start")).cast("int").alias("off"), v["ref"].alias("ref"), v["alt"].alias("alt"), v["ploids"].alias("ploids")))
    return spelled(every.withColumn("variants", placed).drop("end"), ploidy)


def spelled(every: DataFrame, ploidy: int) -> DataFrame:
    """chrom, win, ploid, start, seq, cigar, variants of windows with ``piece`` and the variants in it."""
    none = F.array().cast("array<struct<off:int,ref:string,alt:string,ploids:array<int>>>")
    every = every.withColumn("ploid", F.explode(F.sequence(F.lit(0), F.lit(ploidy - 1))))
    mine = F.filter(F.coalesce("variants", none), lambda x: F.array_contains(x["ploids"], F.col("ploid")))
    every = every.withColumn("variants", mine)
    return every.select("chrom", "win", "ploid", "start", apply_variants(F.col("piece"), F.col("variants")).alias("seq"), haplotype_cigar(F.char_length("piece"), F.col("variants")).alias("cigar"), "variants")


READS = "win long, ploid int, k int, mate int, pos long, cigar string, seq string, qual string, flag int, mapq int, mate_pos long, tlen long"


def named_reads(made: DataFrame, prefix: str) -> DataFrame:
    name = F.concat(F.lit(prefix), *[x for c in ("chrom", "win", "ploid", "k") for x in (F.lit("-"), F.col(c).cast("string"))])
    return made.select(name.alias("name"), "mate", "chrom", "pos", "cigar", "seq", "qual", "flag", "mapq", "mate_pos", "tlen")


def sampled_reads(haps: DataFrame, model: ReadModel, gc_scalars: list[float] | None = None, tile: int = 50, prefix: str = "sim") -> DataFrame:
    """Reads of fragments drawn from haplotypes (chrom, win, ploid, start, seq, cigar): name, mate, chrom, pos, cigar, seq, qual, flag, mapq, mate_pos, tlen.

    Fragments, qualities and errors are drawn as arrays of Arrow batches (``reads``).
    """
    of = F.concat_ws(":", *[F.col(c).cast("string") for c in ("chrom", "win", "ploid")])
    rows = haps.select("chrom", "win", "ploid", of.alias("of"), F.xxhash64(F.lit(model.seed), "chrom", "win", "ploid").alias("hash"), "start", "seq", "cigar")
    kind = dict(haps.dtypes)["chrom"]
    return named_reads(rows.mapInArrow(lambda batches: reads_.sampled_batches(batches, model, gc_scalars, tile), f"chrom {kind}, {READS}"), prefix)


def read_records(frags: DataFrame, model: ReadModel, prefix: str = "sim") -> DataFrame:
    """The same of fragments that come with both ends: chrom, win, ploid, k, start, off, size, cigar, left, right."""
    swap = uniform("strand", model.seed, F.col("chrom"), F.col("win"), F.col("ploid"), F.col("k")) < 0.5
    key = F.xxhash64(F.lit(model.seed), "chrom", "win", "ploid", "k")
    rows = frags.select("chrom", F.col("win").cast("long"), F.col("ploid").cast("int"), F.col("k").cast("int"), key.alias("key"), swap.alias("swap"), "start", "off", "size", "cigar", "left", "right")
    kind = dict(frags.dtypes)["chrom"]
    return named_reads(rows.mapInArrow(lambda batches: reads_.fragment_batches(batches, model), f"chrom {kind}, {READS}"), prefix)


def simulate(
    seqs: DataFrame,
    mutations: MutationModel,
    reads: ReadModel,
    given: DataFrame | None = None,
    targets: DataFrame | None = None,
    off_target: float = 0.0,
    discard: DataFrame | None = None,
    rates: DataFrame | None = None,
    gc_scalars: list[float] | None = None,
) -> dict[str, DataFrame]:
    """windows, variants, haplotypes and reads of the sequences (chrom, seq); each is computed only if used.

    ``given`` variants (chrom, pos, ref, alt, ploids) go before random ones. With
    ``targets`` (chrom, start, end), reads with no end in one are kept with chance
    ``off_target``; if that is 0, windows that meet none aren't simulated. Reads that
    touch a ``discard`` interval are dropped. ``rates`` are local mutation rates and
    ``gc_scalars`` the coverage by GC count of a tile.
    """
    regions = seqs.select("chrom", F.lit(0).cast("long").alias("start"), F.char_length("seq").cast("long").alias("end"))
    windows = window_plan(regions, 100 * reads.span, reads.span)
    cut = window_pieces(seqs, 100 * reads.span, reads.span)
    t = None if targets is None else targets.select("chrom", "start", "end")
    if t is not None and not off_target:
        windows = overlaps(windows, t).select(windows.columns).distinct()
        cut = cut.join(windows.select("chrom", "win"), ["chrom", "win"], "left_semi")
    drawn = random_variants(cut, seqs, mutations, reads.ploidy, reads.seed, rates)
    if given is not None:
        placed = points_in_intervals(given, windows.select("chrom", "win", "start", F.col("core_end").alias("end"))).select("chrom", "win", "pos", "ref", "alt", "ploids")
        reach = lambda df: df.select("*", F.col("pos").alias("start"), (F.col("pos") + F.char_length("ref")).alias("end"))
        taken = overlaps(reach(drawn), reach(placed).select("chrom", "start", "end")).select("chrom", "pos", "ref", "alt").distinct()
        drawn = placed.unionByName(drawn.join(taken, ["chrom", "pos", "ref", "alt"], "left_anti").select(placed.columns))
    variants = without_conflicts(drawn, "ploids")
    haps = window_haplotypes(cut, variants, reads.ploidy)
    made = sampled_reads(haps, reads, gc_scalars)
    if t is not None:
        ends = made.select("name", "mate", "chrom", F.explode(F.array(F.col("pos"), F.col("pos") + reads.length)).alias("pos"))
        hit = points_in_intervals(ends, t, "left_semi").select("name", "mate").distinct().withColumn("hit", F.lit(True))
        lucky = uniform("off-target", reads.seed, F.col("name"), F.col("mate")) < off_target
        made = made.join(hit, ["name", "mate"], "left").where(F.col("hit").isNotNull() | lucky).drop("hit")
    if discard is not None:
        spans = made.select("name", "mate", "chrom", F.col("pos").alias("start"), (F.col("pos") + reads.length).alias("end"))
        touched = overlaps(spans, discard.select("chrom", "start", "end")).select("name", "mate").distinct()
        made = made.join(touched, ["name", "mate"], "left_anti")
    return {"windows": windows, "variants": variants, "haplotypes": haps, "reads": made}


def golden_vcf(variants: DataFrame, ploidy: int = 2) -> DataFrame:
    """The applied variants as VCF columns, 1-based, with allele frequency and genotype."""
    info = F.concat(F.lit("AF="), (F.size("ploids") / ploidy).cast("string"), F.lit(";WP="), wp_string(F.col("ploids"), ploidy))
    return variants.select("chrom", (F.col("pos") + 1).alias("pos1"), F.lit(".").alias("id"), "ref", "alt", F.lit(".").alias("qual"), F.lit("PASS").alias("filter"), info.alias("info"))


def fastq_records(reads: DataFrame) -> DataFrame:
    """name, seq, qual of each record, the name with its mate; reads from the reverse strand turned back."""
    back = F.col("flag").bitwiseAND(F.lit(16)) != 0
    seq = F.when(back, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    qual = F.when(back, F.reverse("qual")).otherwise(F.col("qual"))
    return reads.select(F.concat(F.lit("@"), "name", F.lit("/"), "mate").alias("name"), seq.alias("seq"), qual.alias("qual"))


def fastq_lines(reads: DataFrame) -> DataFrame:
    """value: the four lines of each record."""
    return fastq_records(reads).select(F.concat_ws("\n", "name", "seq", F.lit("+"), "qual").alias("value"))


def sam_lines(reads: DataFrame) -> DataFrame:
    """value: a SAM line of each record, 1-based."""
    nxt = F.when(F.col("mate_pos").isNull(), F.lit("*")).otherwise(F.lit("="))
    return reads.select("chrom", "pos", "flag", F.concat_ws("\t", "name", F.col("flag").cast("string"), F.col("chrom").cast("string"), (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), "cigar", nxt, (F.coalesce(F.col("mate_pos") + 1, F.lit(0))).cast("string"), F.col("tlen").cast("string"), "seq", "qual").alias("value"))


#: Ranges of draws that are counted to find where a cull begins.
CULL_RANGES = 4096


def most_drawn(rows: DataFrame, keep: int, draw_: Column, tie: str) -> DataFrame:
    """The ``keep`` rows with the greatest draws in [0, 1); of equal draws the least ``tie``.

    Ranges of draws are counted (CULL_RANGES numbers), and only the range in which the
    limit lies is put in order.
    """
    drawn = rows.withColumn("draw", draw_).withColumn("range", F.floor(F.col("draw") * CULL_RANGES))
    rest, at = keep, -1
    for r in drawn.groupBy("range").count().orderBy(F.desc("range")).collect():  # CULL_RANGES rows at most
        at = r["range"]
        if r["count"] >= rest:
            break
        rest -= r["count"]
    edge = Window.partitionBy("range").orderBy(F.desc("draw"), tie)
    tail = drawn.where(F.col("range") == at).withColumn("place", F.row_number().over(edge)).where(F.col("place") <= rest).drop("place")
    return drawn.where(F.col("range") > at).unionByName(tail).drop("draw", "range")


def population(members: int, generations: int, cull: float, seed: int, spark) -> DataFrame:  # noqa: ANN001
    """generation, member_id, parent_id of the survivors of {double, cull} rounds.

    Each round doubles the members and removes round(n * cull) of them (halves to even),
    those with the least draws.
    """
    now = spark.range(members).select(F.lit(0).alias("generation"), F.col("id").alias("member_id"), F.lit(None).cast("long").alias("parent_id"))
    n = members
    for g in range(1, generations + 1):
        doubled = now.select(F.lit(g).alias("generation"), F.explode(F.array(F.col("member_id") * 2, F.col("member_id") * 2 + 1)).alias("member_id"), F.col("member_id").alias("parent_id"))
        n = 2 * n - round(2 * n * cull)
        now = most_drawn(doubled, n, uniform("cull", seed, g, F.col("member_id")), "member_id")
    return now


# genomes of a population


def mutated(genomes: DataFrame, model: MutationModel, seed: int, span: int = 10_000) -> DataFrame:
    """Haploid sequences (chrom, seq) with random variants applied; windows of about ``span`` bases are put together again."""
    regions = genomes.select("chrom", F.lit(0).cast("long").alias("start"), F.char_length("seq").cast("long").alias("end"))
    windows = window_plan(regions, span, 0)
    variants = without_conflicts(random_variants(windows, genomes, model, 1, seed), "ploids")
    pieces = F.array_sort(F.collect_list(F.struct("start", "seq")))
    return haplotypes(windows, genomes, variants, 1).groupBy("chrom").agg(F.array_join(F.transform(pieces, lambda x: x["seq"]), "").alias("seq"))


def population_genomes(seqs: DataFrame, members: int, generations: int, cull: float, model: MutationModel, seed: int) -> DataFrame:
    """member_id, chrom, seq of the survivors of {double, mutate, cull} rounds.

    The first members are mutations of ``seqs`` (chrom, seq). Who survives a round doesn't
    hang on the genomes, so only survivors are mutated. Lineage is cut after each round.
    """
    spark = seqs.sparkSession
    kind = dict(seqs.dtypes)["chrom"]

    def round_(genomes: DataFrame, g: int) -> DataFrame:
        keyed = genomes.select(F.concat_ws(":", F.col("member_id").cast("string"), F.col("chrom").cast("string")).alias("chrom"), "seq")
        of = F.split("chrom", ":", 2)
        return mutated(keyed, model, seed + g).select(of[0].cast("long").alias("member_id"), of[1].cast(kind).alias("chrom"), "seq").checkpoint()

    now = round_(seqs.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(members - 1).cast("long"))).alias("member_id"), "chrom", "seq"), 0)
    n = members
    for g in range(1, generations + 1):
        doubled = now.select("member_id").distinct().select(F.explode(F.array(F.col("member_id") * 2, F.col("member_id") * 2 + 1)).alias("member_id"))
        n = 2 * n - round(2 * n * cull)
        kept = most_drawn(doubled, n, uniform("cull", seed, g, F.col("member_id")), "member_id").withColumn("parent", F.floor(F.col("member_id") / 2))
        born = kept.join(now.withColumnRenamed("member_id", "parent"), "parent").select("member_id", "chrom", "seq")
        now = round_(born, g)
    return now


def individual_reads(genomes: DataFrame, member: int, reads: ReadModel) -> dict[str, DataFrame]:
    """The simulator's results for one member's genome, without further mutations."""
    return simulate(genomes.where(F.col("member_id") == member).select("chrom", "seq"), MutationModel(rate=0.0), reads)


def regrouped(records: DataFrame, names: list[str]) -> DataFrame:
    """chrom, seq: records (header, place, seq) joined in order of ``place`` under the first of ``names`` that their header holds.

    Records whose header holds none of the names go.
    """
    held = F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(F.col("header"), n))
    named = records.withColumn("chrom", F.get(held, F.lit(0))).where(F.col("chrom").isNotNull())
    pieces = F.array_sort(F.collect_list(F.struct("place", "seq")))
    return named.groupBy("chrom").agg(F.array_join(F.transform(pieces, lambda x: x["seq"]), "").alias("seq"))
