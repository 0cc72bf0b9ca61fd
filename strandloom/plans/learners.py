"""Learners of the simulator's models, each a plan from records to model tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import BASES, TRINUCLEOTIDES, common_prefix, gc_count, is_trinucleotide, non_n_length, phred_to_error
from strandloom.operators.chunks import bases_at, chunked, trinucleotide_counts
from strandloom.operators.intervals import by_bins, carried, gap_clusters, points_in_intervals
from strandloom.operators.lineage import checkpointed
from strandloom.operators.statistics import median_and_deviation, normalised, quantiles

# fragment lengths


def first_of_proper_pairs(reads: DataFrame, least_mapq: int = 10) -> DataFrame:
    """Paired first mates, well mapped, with the mate on the same reference (flag, mapq, mate_ref, ref, tlen)."""
    pair = F.col("flag").bitwiseAND(F.lit(0x1 | 0x40)) == (0x1 | 0x40)
    return reads.where(pair & (F.col("mapq") > least_mapq) & ((F.col("mate_ref") == "=") | (F.col("mate_ref") == F.col("ref"))))


def fragment_lengths(reads: DataFrame, least_reads: int = 100, deviations: float = 10.0) -> DataFrame:
    """tlen, n, p: lengths in 1 .. median + ``deviations`` MADs with enough reads, normalised."""
    lengths = first_of_proper_pairs(reads).select(F.abs("tlen").alias("tlen"))
    limits = median_and_deviation(lengths, "tlen")
    counted = lengths.groupBy("tlen").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(limits))
    kept = counted.where((F.col("tlen") > 0) & (F.col("tlen") <= F.col("median") + deviations * F.col("mad")) & (F.col("n") >= least_reads))
    return normalised(kept.select("tlen", "n"), "n")


# coverage bias by GC content


#: Windows of a stretch that are named at once.
AT_ONCE = 4096


def gc_windows(seqs: DataFrame, depth: DataFrame, window: int = 50) -> DataFrame:
    """chrom, start, gc, depth of every full window without N; depth (chrom, start, end, depth) are stretches."""
    return gc_tiles(chunked(seqs, window, 0), depth, window)


def gc_tiles(pieces: DataFrame, depth: DataFrame, window: int = 50) -> DataFrame:
    """The same from pieces (chrom, start, piece) of ``window`` bases, which begin at its multiples."""
    tiles = pieces.where((F.char_length("piece") == window) & (F.instr("piece", "N") == 0))
    tiles = tiles.select("chrom", "start", gc_count(F.col("piece")).alias("gc"))
    # a stretch names the windows that it meets, some at a time, so they are found by their start
    first, last = F.greatest(F.floor(F.col("start") / window), F.lit(0)), F.floor((F.col("end") - 1) / window)
    some = depth.where((F.col("end") > F.col("start")) & (F.col("end") > 0)).select("*", F.explode(F.sequence(first, last, F.lit(AT_ONCE).cast("long"))).alias("low"))
    each = some.withColumn("tile", F.explode(F.sequence("low", F.least(F.col("low") + AT_ONCE - 1, last)))).withColumn("tile", F.col("tile") * window)
    bases = F.least(F.col("end"), F.col("tile") + window) - F.greatest(F.col("start"), F.col("tile"))
    covered = each.groupBy("chrom", F.col("tile").alias("start")).agg(F.sum(bases * F.col("depth")).alias("bases"))
    return tiles.join(covered, ["chrom", "start"], "left").select("chrom", "start", "gc", (F.coalesce("bases", F.lit(0)) / window).alias("depth"))


def gc_bias(windows: DataFrame, window: int = 50) -> DataFrame:
    """gc, n, mean_depth, scalar for 0 .. window; the scalar is the mean over all windows' mean, 0 where none."""
    by_gc = windows.groupBy("gc").agg(F.count(F.lit(1)).alias("n"), F.sum("depth").alias("total"))
    whole = by_gc.agg((F.sum("total") / F.sum("n")).alias("overall"))
    every = windows.sparkSession.range(window + 1).select(F.col("id").cast("int").alias("gc"))
    mean = F.coalesce(F.col("total") / F.col("n"), F.lit(0.0))
    joined = every.join(by_gc, "gc", "left").join(F.broadcast(whole))
    return joined.select("gc", F.coalesce("n", F.lit(0)).alias("n"), mean.alias("mean_depth"), F.when(F.col("overall") > 0, mean / F.col("overall")).otherwise(0.0).alias("scalar"))


# qualities


def conforming(reads: DataFrame, length: int) -> DataFrame:
    """Reads whose quality array ``q`` has the given length."""
    return reads.where(F.size("q") == length)


def quality_range(reads: DataFrame, low: int, high: int) -> DataFrame:
    """One row: least and most quality, and how many lie outside ``low`` .. ``high``."""
    q = reads.select(F.explode("q").alias("q"))
    return q.agg(F.min("q").alias("least"), F.max("q").alias("most"), F.count_if(~F.col("q").between(low, high)).alias("n_outside"))


def first_reads(reads: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` reads in an order: a sample that the caller sizes."""
    return reads.orderBy(order).limit(n)


def quality_marginals(reads: DataFrame) -> DataFrame:
    """pos, q, n, p: how often each quality stands at each place."""
    counted = reads.select(F.posexplode("q").alias("pos", "q")).groupBy("pos", "q").agg(F.count(F.lit(1)).alias("n"))
    return normalised(counted, "n", ["pos"])


def quality_transitions(reads: DataFrame) -> DataFrame:
    """pos, q_prev, q, n, p: qualities by the one before, at places from 1 on."""
    pairs = F.zip_with(F.slice("q", F.lit(1), F.greatest(F.size("q") - 1, F.lit(0))), F.slice("q", F.lit(2), F.greatest(F.size("q") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("q_prev"), b.alias("q")))
    rows = reads.where(F.size("q") > 1).select(F.posexplode(pairs).alias("at", "pair")).select((F.col("at") + 1).alias("pos"), "pair.*")
    counted = rows.groupBy("pos", "q_prev", "q").agg(F.count(F.lit(1)).alias("n"))
    return normalised(counted, "n", ["pos", "q_prev"])


def mean_error(reads: DataFrame) -> float:
    """The exact mean error probability of the learned chain, by forward propagation.

    The model tables are small (places x qualities squared) and are all that is collected.
    A quality that was never followed by another stays.
    """
    first = {r["q"]: r["p"] for r in quality_marginals(reads).where("pos = 0").collect()}
    moves: dict[int, list] = {}
    for r in quality_transitions(reads).collect():
        moves.setdefault(r["pos"], []).append((r["q_prev"], r["q"], r["p"]))
    states = sorted({*first, *(q for m in moves.values() for a, b, _ in m for q in (a, b))})
    at = {q: i for i, q in enumerate(states)}
    p = np.array([first.get(q, 0.0) for q in states])
    error = 10.0 ** (-np.array(states) / 10.0)
    means = [p @ error]
    for pos in sorted(moves):
        t = np.zeros((len(states), len(states)))
        for a, b, share in moves[pos]:
            t[at[a], at[b]] = share
        t[t.sum(1) == 0] = np.eye(len(states))[t.sum(1) == 0]
        p = p @ t
        means.append(p @ error)
    return float(np.mean(means))


def error_rate(reads: DataFrame) -> DataFrame:
    """pos, mean_error: mean error probability of the qualities at each place."""
    return reads.select(F.posexplode("q").alias("pos", "q")).groupBy("pos").agg(F.avg(phred_to_error(F.col("q"))).alias("mean_error"))


# mutations

#: Contigs that count as human chromosomes, with or without chr.
HUMAN = tuple([str(i) for i in range(1, 30)] + ["X", "Y", "MT"])


def human_contigs(rows: DataFrame, chrom: str = "chrom") -> DataFrame:
    return rows.where(F.regexp_replace(F.col(chrom), "^chr", "").isin(*HUMAN))


def trimmed(variants: DataFrame) -> DataFrame:
    """Records with one alternative, the alleles' common prefix cut if their lengths differ; - is an empty allele."""
    n = F.when(F.char_length("ref") != F.char_length("alt"), common_prefix(F.col("ref"), F.col("alt"))).otherwise(F.lit(0))
    cut = variants.where(~F.col("alt").contains(",")).withColumn("cut", n)
    rest = lambda c: F.coalesce(F.nullif(F.substring(c, F.col("cut") + 1, F.char_length(c)), F.lit("")), F.lit("-"))
    cut = cut.withColumns({"pos": F.col("pos") + F.col("cut"), "ref": rest(F.col("ref")), "alt": rest(F.col("alt"))}).drop("cut")
    whole = (F.col("ref") == "-") | (F.col("alt") == "-") | ((F.char_length("ref") == 1) & (F.char_length("alt") == 1))
    return cut.where(whole)


def is_snp() -> Column:
    return (F.col("ref") != "-") & (F.col("alt") != "-")


def restricted(variants: DataFrame, targets: DataFrame | None) -> DataFrame:
    """Variants inside the target intervals, each once; all of them without targets."""
    if targets is None:
        return variants
    from strandloom.operators.intervals import merge

    return points_in_intervals(variants, merge(targets).select("chrom", "start", "end"), "left_semi")


def snp_contexts(variants: DataFrame, seqs: DataFrame) -> DataFrame:
    """SNPs with tri_ref and tri_alt, both of plain bases."""
    around = bases_at(variants.where(is_snp()), seqs).withColumnRenamed("around", "tri_ref")
    tri_alt = F.concat(F.left("tri_ref", F.lit(1)), F.col("alt"), F.right("tri_ref", F.lit(1)))
    found = around.withColumn("tri_alt", tri_alt)
    return found.where(is_trinucleotide(F.col("tri_ref")) & is_trinucleotide(F.col("tri_alt")) & (F.substring("tri_ref", 2, 1) == F.col("ref")))


def transition_probabilities(contexts: DataFrame) -> DataFrame:
    """tri_ref, tri_alt, n, p: what a trinucleotide turns into, given that it mutates."""
    counted = contexts.groupBy("tri_ref", "tri_alt").agg(F.count(F.lit(1)).alias("n"))
    return normalised(counted, "n", ["tri_ref"])


def mutation_spectrum(contexts: DataFrame) -> DataFrame:
    """All 64 x 3 transitions with n and p, absent ones with 0."""
    spark = contexts.sparkSession
    every = spark.createDataFrame([(t, t[0] + b + t[2]) for t in TRINUCLEOTIDES for b in BASES if b != t[1]], "tri_ref string, tri_alt string")
    found = transition_probabilities(contexts)
    return every.join(found, ["tri_ref", "tri_alt"], "left").select("tri_ref", "tri_alt", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("p", F.lit(0.0)).alias("p"))


def mutation_probabilities(contexts: DataFrame, seqs: DataFrame | None, counts: DataFrame | None = None) -> DataFrame:
    """tri, n_ref, n_mut, p: how likely each trinucleotide mutates (0 where it never occurs).

    ``counts`` (tri, n) are those of the reference if they are known; else ``seqs`` are counted.
    """
    mutated = contexts.groupBy(F.col("tri_ref").alias("tri")).agg(F.count(F.lit(1)).alias("n_mut"))
    joined = (trinucleotide_counts(seqs) if counts is None else counts).withColumnRenamed("n", "n_ref").join(mutated, "tri", "left").fillna(0, ["n_mut"])
    return joined.select("tri", "n_ref", "n_mut", F.when(F.col("n_ref") > 0, F.col("n_mut") / F.col("n_ref")).otherwise(0.0).alias("p"))


def base_transitions(contexts: DataFrame) -> DataFrame:
    """ref, alt, n, p: the 4 x 4 substitution table, normalised by ref."""
    return normalised(contexts.groupBy("ref", "alt").agg(F.count(F.lit(1)).alias("n")), "n", ["ref"])


def indel_frequencies(variants: DataFrame) -> DataFrame:
    """size, n, p: signed lengths (insertions positive) as shares of all indels."""
    size = F.when(F.col("ref") == "-", F.char_length("alt")).otherwise(-F.char_length("ref"))
    return normalised(variants.where(~is_snp()).groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")), "n")


def rates(variants: DataFrame, seqs: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """One row: n_snp, n_indel, snp_share, mutation rate over the targets' (or non-N) length."""
    if targets is None:
        length = seqs.agg(F.sum(non_n_length(F.col("seq"))).alias("bases"))
    else:
        length = targets.agg(F.sum(F.col("end") - F.col("start") + 1).alias("bases"))
    counted = variants.agg(F.count_if(is_snp()).alias("n_snp"), F.count_if(~is_snp()).alias("n_indel"))
    total = F.col("n_snp") + F.col("n_indel")
    return counted.join(length).select("n_snp", "n_indel", F.when(total > 0, F.col("n_snp") / total).otherwise(0.0).alias("snp_share"), F.when(F.col("bases") > 0, total / F.col("bases")).otherwise(0.0).alias("rate"))


def common_variants(variants: DataFrame, freq: str = "freq", percentile: float = 0.95) -> DataFrame:
    """Variants at or above the percentile of population frequency."""
    (cut,) = quantiles(variants, freq, [percentile])
    return variants.where(F.col(freq) >= F.lit(cut))


def dense_regions(variants: DataFrame, gap: int = 2000, pad: int = 2000, snap: int = 1000, percentile: float = 0.97) -> DataFrame:
    """chrom, start, end, n, density of padded and snapped clusters of variants with a density in the top."""
    clusters = gap_clusters(variants.select("chrom", "pos"), gap)
    low = F.greatest(F.floor((F.col("first") - pad) / snap) * snap, F.lit(0))
    high = F.floor((F.col("last") + pad) / snap) * snap
    dense = checkpointed(clusters.select("chrom", low.alias("start"), high.alias("end"), "n").withColumn("density", F.col("n") / (F.col("end") - F.col("start"))))
    (cut,) = quantiles(dense, "density", [percentile])
    return dense.where(F.col("density") >= F.lit(cut))


#: Regions of a run that its rate is folded from.
FOLDED = 128


def merged_regions(regions: DataFrame) -> DataFrame:
    """Overlapping regions of a chromosome folded from the right: chrom, start, end, rate.

    Of two that overlap, the later one's end stays and the rates are averaged, so the
    result depends on the order. A fold's region begins where the next one did, so neighbours
    alone say which regions run together. A region's share of the rate halves with each one
    before it, so that of those after the first FOLDED of a run is nothing in a double.
    """
    order = [F.col(c) for c in ("start", "end", "density")]
    one = F.struct(*order)
    rows = carried(by_bins(regions.select("chrom", *order), "start"), one, "previous", order)
    rows = carried(rows, F.lit(1).cast("long"), "place", order, fold=F.sum)
    place = F.coalesce("place", F.lit(0).cast("long"))
    apart = F.col("previous").isNull() | (F.col("previous.end") < F.col("start"))
    runs = carried(rows.withColumn("place", place), F.when(apart, F.col("place")), "first", [F.col("place")], strict=False)
    near = F.when(F.col("place") - F.col("first") < FOLDED, F.struct("place", "density"))
    folded = runs.groupBy("chrom", "first").agg(F.min("start").alias("start"), F.max_by("end", "place").alias("end"), F.reverse(F.array_sort(F.collect_list(near))).alias("near"))
    densities = F.transform("near", lambda x: x["density"])
    rate = F.aggregate(F.slice(densities, F.lit(2), F.lit(FOLDED)), densities[0], lambda later, own: (own + later) / 2)
    return folded.select("chrom", "start", "end", rate.alias("rate"))


def substitution_heatmaps(contexts: DataFrame) -> DataFrame:
    """A row for each flanking pair and base: flanks, ref, and counts n_A, n_C, n_G, n_T of what it turns into."""
    flanks = F.concat(F.left("tri_ref", F.lit(1)), F.lit("_"), F.right("tri_ref", F.lit(1)))
    counts = contexts.groupBy(flanks.alias("flanks"), "ref").pivot("alt", list(BASES)).agg(F.count(F.lit(1)))
    return counts.select("flanks", "ref", *[F.coalesce(b, F.lit(0)).cast("long").alias(f"n_{b}") for b in BASES])
