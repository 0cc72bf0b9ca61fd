"""One registered query for each operator, over inputs derived from the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom import derived as d
from strandloom.functions.random import draw, normal_lengths, poisson, random_dna, uniform
from strandloom.functions.sequence import (
    carriers, cigar_compact, cigar_expand, encode_qualities, error_to_phred, gc_count, info_value, mask_low_quality, non_n_length, phred_to_error, reg2bin, reverse_complement, sam_flag, wp_string,
)
from strandloom.operators import chunks
from strandloom.operators import intervals as iv
from strandloom.operators import variants as vs
from strandloom.operators.chunks import bases_at, piece_trinucleotides, recut, trinucleotide_counts
from strandloom.operators.lineage import shared_folder
from strandloom.operators.statistics import cdf_knots, median_and_deviation, nearest_knot, weighted_median_index
from strandloom.plans import compare, learners, simulate, validate
from strandloom.sources import bam, fasta, fastq, sinks, text
from strandloom.streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
ALL: dict[str, Query] = {}
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def query(f: Query) -> Query:
    ALL[f.__name__] = f
    return f


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants with made INFO and genotype fields, some multi-allelic."""
    v = d.variants(spark, sf_dir)
    two = F.col("l_partkey") % 5 == 0
    return v.select(
        "chrom", "pos", "ref", *KEYS,
        F.when(two, F.concat("alt", F.lit(","), "ref", F.lit("A"))).otherwise(F.col("alt")).alias("alt"),
        F.when(F.col("l_returnflag") == "N", "PASS").when(F.col("l_returnflag") == "A", ".").otherwise("LowQual").alias("filter"),
        F.concat(F.lit("DP="), F.col("l_suppkey").cast("string"), F.when(F.col("l_partkey") % 3 > 0, F.concat(F.lit(";AF=0."), F.col("l_linenumber").cast("string"))).otherwise(""), F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit(";CAF=0.9,0."), (F.col("l_partkey") % 97).cast("string"))).otherwise("")).alias("info"),
        F.concat((F.col("l_partkey") % 2).cast("string"), F.when(F.col("l_suppkey") % 2 == 0, "|").otherwise("/"), F.when(F.col("l_suppkey") % 7 == 0, ".").otherwise((F.col("l_suppkey") % 2).cast("string"))).alias("gt"),
    )


def learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed variants to learn from."""
    return learners.trimmed(d.variants(spark, sf_dir))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learners.snp_contexts(learned(spark, sf_dir), d.contigs(spark, sf_dir))


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.intervals(spark, sf_dir).select("chrom", "start", "end", (F.col("o_orderkey") % 5 + 1).alias("depth"))


def hashed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-line records made of events, some of them faulty."""
    e = d.table(spark, sf_dir, "events")
    h = F.md5(F.col("event_id").cast("string").cast("binary"))
    seq = F.translate(h, "0123456789abcdef", "ACGTACGTACGTACGN")
    return e.select(
        F.concat(F.when(F.col("event_id") % 50 == 1, ">").otherwise("@"), F.lit("r"), F.col("event_id").cast("string")).alias("name"),
        F.when(F.col("event_id") % 50 == 2, F.concat(seq, F.lit("X"))).when(F.col("event_id") % 50 == 3, F.concat(F.lit("x"), F.substring(seq, 2, 31))).otherwise(seq).alias("seq"),
        F.when(F.col("event_id") % 50 == 4, "-").otherwise("+").alias("plus"),
        F.when(F.col("event_id") % 50 == 5, F.lit(None)).when(F.col("event_id") % 50 == 6, F.concat(F.substring(h, 1, 31), F.lit("z"))).otherwise(F.translate(h, "abcdef", "ABCDEF")).alias("qual"),
    )


@query
def fraglen_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learners.fragment_lengths(d.alignments(spark, sf_dir)).select("tlen", "n", F.round("p", 9).alias("p"))


@query
def tlen_median_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return median_and_deviation(learners.first_of_proper_pairs(d.alignments(spark, sf_dir)), "tlen")


@query
def trinuc_ref_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trinucleotide_counts(d.contigs(spark, sf_dir))


@query
def gc_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learners.gc_windows(d.contigs(spark, sf_dir), depth(spark, sf_dir)).groupBy("gc").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("depth"), 6).alias("total"))


@query
def gc_bias_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = learners.gc_bias(learners.gc_windows(d.contigs(spark, sf_dir), depth(spark, sf_dir)))
    return found.select("gc", "n", F.round("mean_depth", 9).alias("mean_depth"), F.round("scalar", 9).alias("scalar"))


@query
def n_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.runs_of(d.contigs(spark, sf_dir))


@query
def callable_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = d.contigs(spark, sf_dir)
    big = iv.runs_of(seqs).where(F.col("end") - F.col("start") >= 3)
    return iv.complement(big, seqs.select("chrom", "length"))


@query
def callable_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callable_regions(spark, sf_dir).groupBy("chrom").agg(F.sum(F.col("end") - F.col("start")).alias("bases"), F.count(F.lit(1)).alias("n"))


@query
def contig_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = d.contigs(spark, sf_dir)
    return s.select("chrom", "length", non_n_length(F.col("seq")).cast("long").alias("non_n"), gc_count(F.col("seq")).cast("long").alias("gc"))


@query
def reverse_complements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.contigs(spark, sf_dir).select("chrom", reverse_complement(F.col("seq")).alias("rc"))


@query
def bam_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("o_orderkey") * 1009
    return d.table(spark, sf_dir, "orders").select("o_orderkey", reg2bin(b, b + F.floor("o_totalprice").cast("long") + 1).alias("bin"))


@query
def sam_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(F.lit("paired"), F.when(F.col("l_linenumber") % 2 == 0, "first").otherwise("second"), F.when(F.col("l_suppkey") % 2 == 0, "reverse").otherwise("mate_reverse"), F.lit("paired"), F.when(F.col("l_partkey") % 3 == 0, "unmapped").otherwise("proper"))
    return d.table(spark, sf_dir, "lineitem").select(sam_flag(names).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query
def cigar_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda k: (F.col("l_partkey") % k + 1).cast("string")
    cigar = F.concat(n(20), F.lit("M"), n(3), F.lit("I"), n(7), F.lit("M"), n(4), F.lit("D"), n(11), F.lit("M"))
    rows = d.table(spark, sf_dir, "lineitem").select("l_partkey", cigar.alias("cigar")).distinct()
    entries = rows.withColumn("entries", cigar_expand(F.col("cigar")))
    return entries.select("l_partkey", "cigar", F.size("entries").alias("bases"), cigar_compact(F.col("entries")).alias("again"))


@query
def phred_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = d.qualities(spark, sf_dir)
    return learners.error_rate(q).select("pos", F.round("mean_error", 9).alias("mean_error"), error_to_phred(F.col("mean_error")).alias("q"))


@query
def quality_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.qualities(spark, sf_dir).select("read_id", encode_qualities(F.col("q")).alias("qual"), mask_low_quality(F.lit("ACGTACGTACGTACGT"), F.col("q"), 10).alias("seq"))


@query
def variant_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = d.variants(spark, sf_dir)
    wrong = v.withColumn("ref", F.when(F.col("l_partkey") % 13 == 0, F.translate("ref", "ACGT", "CGTA")).otherwise(F.col("ref"))).withColumn("alt", F.when(F.col("l_partkey") % 17 == 0, "<DEL>").otherwise(F.col("alt")))
    return vs.validity(wrong, d.contigs(spark, sf_dir)).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query
def skip_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why records took no part, counted while those that did were written."""
    r = records(spark, sf_dir)
    r = r.withColumn("ref", F.when(F.col("l_partkey") % 13 == 0, F.translate("ref", "ACGT", "CGTA")).otherwise(F.col("ref")))
    kept, screen = vs.screened(r)
    order = [*KEYS, "ref", "alt", "alt_no"]
    first, (reasons, positions) = vs.valid_first(vs.split_alternatives(kept), d.contigs(spark, sf_dir), order)
    first.write.parquet(scratch(spark))
    n = screen.get | reasons.get | positions.get
    n["duplicate"] = n["valid"] - n["positions"]
    return spark.createDataFrame(sorted(n.items()), "reason string, n long")


@query
def variant_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    kept = r.where(vs.is_variant() & vs.passed() & (F.col("pos") > 0) & vs.carried(F.col("gt")))
    return kept.groupBy("filter", "gt").agg(F.count(F.lit(1)).alias("n"))


@query
def variant_trim_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = d.variants(spark, sf_dir).withColumns({"ref": F.concat("ref", F.lit("GT")), "alt": F.concat("alt", F.lit("GT"))})
    return vs.suffix_trimmed(v).groupBy("ref", "alt").agg(F.count(F.lit(1)).alias("n"))


@query
def variant_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vs.first_at_position(d.variants(spark, sf_dir).select("chrom", "pos", "ref", "alt", *KEYS), [*KEYS, "ref", "alt"])


@query
def variant_trim_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned(spark, sf_dir).groupBy("ref", "alt").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("sum_pos"))


@query
def multiallelic_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).withColumn("afs", vs.allele_frequencies(F.col("info"), F.size(F.split("alt", ","))))
    return vs.split_alternatives(r).select("chrom", "pos", "ref", "alt", "alt_no", F.element_at("afs", F.col("alt_no") + 1).alias("af"), *KEYS)


@query
def info_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return r.select(*KEYS, vs.depth(F.col("info")).alias("depth"), vs.population_frequency(F.col("info")).alias("freq"), info_value(F.col("info"), "AF").alias("af"))


@query
def genotype_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    ploids = carriers(F.col("gt"))
    return r.select("gt", wp_string(ploids, 2).alias("wp"), F.size(ploids).alias("n_ploids")).groupBy("gt", "wp", "n_ploids").agg(F.count(F.lit(1)).alias("n"))


@query
def merged_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vs.merged_alleles(d.variants(spark, sf_dir), KEYS)


@query
def mutation_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learners.mutation_spectrum(contexts(spark, sf_dir)).withColumn("p", F.round("p", 9))


@query
def trinuc_mut_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learners.mutation_probabilities(contexts(spark, sf_dir), d.contigs(spark, sf_dir)).withColumn("p", F.round("p", 12))


@query
def base_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learners.base_transitions(contexts(spark, sf_dir)).withColumn("p", F.round("p", 9))


@query
def indel_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learners.indel_frequencies(learned(spark, sf_dir)).withColumn("p", F.round("p", 9))


@query
def avg_mut_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = learners.rates(learned(spark, sf_dir), d.contigs(spark, sf_dir))
    return found.select("n_snp", "n_indel", F.round("snp_share", 9).alias("snp_share"), F.round("rate", 12).alias("rate"))


@query
def restricted_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = learners.restricted(learned(spark, sf_dir).select("chrom", "pos", "ref", "alt", *KEYS), d.intervals(spark, sf_dir))
    return kept.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


@query
def common_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).withColumn("freq", vs.population_frequency(F.col("info")))
    return learners.common_variants(r).groupBy("freq").agg(F.count(F.lit(1)).alias("n"))


@query
def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.gap_clusters(d.variants(spark, sf_dir).select("chrom", "pos"), 100)


@query
def high_mut_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = learners.dense_regions(d.variants(spark, sf_dir), gap=100, pad=100, snap=50)
    return found.withColumn("density", F.round("density", 9))


@query
def merged_high_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = learners.merged_regions(learners.dense_regions(d.variants(spark, sf_dir), gap=100, pad=100, snap=50, percentile=0.5))
    return found.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"), F.round(F.sum("rate"), 6).alias("rates"))


@query
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.merge(d.intervals(spark, sf_dir))


@query
def points_in_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = iv.points_in_intervals(d.variants(spark, sf_dir).select("chrom", "pos"), d.intervals(spark, sf_dir))
    return hit.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query
def points_strictly_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = iv.strictly_inside(d.variants(spark, sf_dir).select("chrom", "pos"), d.intervals(spark, sf_dir))
    return hit.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query
def coverage_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of intervals, along each chromosome, whose lengths lie in one of ten ranges."""
    i = iv.numbered(d.intervals(spark, sf_dir).withColumn("bases", F.col("end") - F.col("start")), "start", [F.col("start"), F.col("o_orderkey")])
    return iv.quantised_runs(i, "bases").withColumn("level", F.round("level", 6))


@query
def gc_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G and C in windows of 100 bases; what is left at a contig's end has those of its last 100."""
    return chunks.gc_profile(d.contigs(spark, sf_dir), 100)


@query
def interval_overlap_bp(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = d.intervals(spark, sf_dir)
    a, b = i.where("o_orderkey % 2 = 0").select("chrom", "start", "end"), i.where("o_orderkey % 2 = 1").select("chrom", "start", "end")
    return iv.overlaps(a, b).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum("overlap").alias("bases"))


@query
def model_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, (golden, called) = d.intervals(spark, sf_dir), d.call_sets(spark, sf_dir)
    regions = {"a": i.where("o_orderkey % 3 > 0").select("chrom", "start", "end"), "b": i.where("o_orderkey % 3 < 2").select("chrom", "start", "end")}
    found = compare.model_overlap(regions, {"a": golden, "b": called})
    return found.select("model_a", "model_b", "shared_bp", "shared_variants", F.round("region_jaccard", 9).alias("region_jaccard"), F.round("variant_jaccard", 9).alias("variant_jaccard"))


@query
def discard_offtarget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of 30 bases at variants' places of which an end lies in a target."""
    reads = d.variants(spark, sf_dir).select("chrom", "pos").distinct()
    ends = reads.select("chrom", F.col("pos").alias("read"), F.explode(F.array(F.col("pos"), F.col("pos") + 30)).alias("pos"))
    kept = iv.points_in_intervals(ends, d.intervals(spark, sf_dir).select("chrom", "start", "end"), "left_semi")
    return kept.select("chrom", "read").distinct().groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


@query
def vcf_compare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.summary(*d.call_sets(spark, sf_dir))


@query
def vcf_fn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.missed_and_wrong(*d.call_sets(spark, sf_dir))[0]


@query
def vcf_fp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.missed_and_wrong(*d.call_sets(spark, sf_dir))[1]


@query
def fn_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    missed, _ = compare.missed_and_wrong(*d.call_sets(spark, sf_dir))
    hard = d.intervals(spark, sf_dir).where("o_orderkey % 4 = 0").select("chrom", "start", "end")
    found = compare.attribution(missed, hard, depth(spark, sf_dir), 3)
    return found.groupBy("unmappable", "low_depth", "unknown").agg(F.count(F.lit(1)).alias("n"), F.sum("depth").alias("total_depth"))


@query
def vcf_equivalent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that state a golden variant with one more base in front, beside calls that don't."""
    rest = compare.judged_rows(d.shifted_calls(spark, sf_dir), "block").where(~F.col("solved"))
    return compare.equivalents_among(compare.sided(rest), d.contigs(spark, sf_dir))


@query
def af_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.variants(spark, sf_dir).select(vs.frequency_class(F.col("l_discount") * 10 - 0.05).alias("af_class")).groupBy("af_class").agg(F.count(F.lit(1)).alias("n"))


@query
def quality_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learners.quality_marginals(d.qualities(spark, sf_dir)).withColumn("p", F.round("p", 9))


@query
def quality_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learners.quality_transitions(d.qualities(spark, sf_dir)).withColumn("p", F.round("p", 9))


@query
def mean_error_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(learners.mean_error(d.qualities(spark, sf_dir)), 6),)], "mean_error double")


@query
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_tax", "l_extendedprice", "l_linenumber")])
    return d.table(spark, sf_dir, "lineitem").select(weighted_median_index(w).alias("index")).groupBy("index").agg(F.count(F.lit(1)).alias("n"))


@query
def discrete_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.table(spark, sf_dir, "events").select("event_id", draw(uniform("draw", F.col("event_id")), [10, 20, 30], [0.25, 0.25, 0.5]).alias("value"))


@query
def poisson_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.table(spark, sf_dir, "events").select(poisson(uniform("poisson", F.col("event_id")), 2.0, 20).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query
def fragment_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, p = normal_lengths(300, 10)
    return d.table(spark, sf_dir, "events").select(draw(uniform("fragment", F.col("event_id")), values, p).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


@query
def random_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.table(spark, sf_dir, "events").select("event_id", random_dna(F.lit(12), "dna", F.col("event_id")).alias("seq"))


@query
def fragment_knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = learners.fragment_lengths(d.alignments(spark, sf_dir), least_reads=10)
    knots = sorted(r[0] for r in cdf_knots(model, "tlen", "p").collect())
    return nearest_knot(model.select("tlen"), "tlen", knots or [0]).select("tlen", "knot")


@query
def window_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = d.contigs(spark, sf_dir).select("chrom", F.lit(0).cast("long").alias("start"), F.col("length").alias("end"))
    return simulate.window_plan(regions, 1000, 100)


@query
def variant_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = window_plan(spark, sf_dir).select("chrom", "win", "start", "end")
    return iv.points_in_intervals(d.variants(spark, sf_dir).select("chrom", "pos"), w).groupBy("chrom", "win").agg(F.count(F.lit(1)).alias("n"))


@query
def coverage_moving_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("start"), F.col("o_orderkey")]
    i = iv.numbered(d.intervals(spark, sf_dir).withColumn("bases", F.col("end") - F.col("start")), "start", order)
    i = iv.carried(iv.by_bins(i, "start"), F.col("bases"), "before", order, fold=F.sum).drop("bin")
    i = iv.shifted(iv.moving_sum(i, "bases", 5, "ahead", stretch=64), "bases", 2, "shifted", stretch=64)
    return i.select("chrom", "o_orderkey", "ahead", "before", "shifted")


def plain_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.variants(spark, sf_dir).where(F.col("ref").rlike("^[ACGT]+$")).select("chrom", "pos", "ref", "alt").distinct()


@query
def conflict_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants on one or both of two ploids, and the ploids in which each is applied."""
    every = F.array(F.lit(0), F.lit(1))
    ploids = F.when(F.col("pos") % 3 == 0, every).otherwise(F.array((F.col("pos") % 2).cast("int")))
    found = simulate.without_conflicts(plain_variants(spark, sf_dir).withColumn("ploids", ploids), "ploids")
    return found.select("chrom", "pos", "ref", "alt", F.concat_ws("/", F.transform("ploids", lambda p: p.cast("string"))).alias("ploids"))


@query
def haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haplotypes by window of 1,000 bases and more, with all variants that don't meet applied ones."""
    w = window_plan(spark, sf_dir).select("chrom", "win", "start", F.col("core_end").alias("end"))
    v = simulate.without_conflicts(plain_variants(spark, sf_dir)).withColumn("ploids", F.array(F.lit(0)))
    found = simulate.haplotypes(w, d.contigs(spark, sf_dir), v, 1)
    return found.select("chrom", "win", F.md5(F.col("seq").cast("binary")).alias("digest"), F.size("variants").alias("n"))


@query
def golden_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).where(vs.carried(F.col("gt")))
    return vs.tally(vs.explode_genotype(r)).select("chrom", "pos", "ref", "alt", "af", "info")


def simulated(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    reads = simulate.ReadModel(length=50, coverage=1.0, fragment=(150, 10), seed=3)
    return simulate.simulate(d.contigs(spark, sf_dir).select("chrom", "seq"), simulate.MutationModel(rate=0.003), reads)


@query
def simulated_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.golden_vcf(simulated(spark, sf_dir)["variants"])


@query
def simulated_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulated(spark, sf_dir)["reads"]


@query
def fastq_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.fastq_lines(simulated(spark, sf_dir)["reads"])


@query
def sam_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.sam_lines(simulated(spark, sf_dir)["reads"]).select("value")


@query
def fastq_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.tally(hashed_records(spark, sf_dir))


@query
def mate_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = d.table(spark, sf_dir, "events").select(F.col("event_id").alias("record"))
    first = e.where("record % 31 > 0").select("record", F.concat(F.lit("r"), F.col("record").cast("string"), F.lit("/1")).alias("name"))
    second = e.where("record % 37 > 0").select("record", F.concat(F.when(F.col("record") % 41 == 0, "x").otherwise("r"), F.col("record").cast("string"), F.lit("/2")).alias("name"))
    return validate.mate_errors(first, second).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query
def population_cull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.population(d.table(spark, sf_dir, "customer").count(), 1, 0.25, 9, spark)


@query
def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.tumbling(d.table(spark, sf_dir, "events"), "1 hour")
    return found.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))


@query
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.sessions(d.table(spark, sf_dir, "events"), "30 minutes")
    return found.select("user_id", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "n")


@query
def phred_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = d.table(spark, sf_dir, "events").select(phred_to_error(F.col("event_id") % 41).alias("p"))
    return e.select(F.round("p", 9).alias("p"), error_to_phred(F.col("p")).alias("q")).groupBy("p", "q").agg(F.count(F.lit(1)).alias("n"))


@query
def substitution_heatmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learners.substitution_heatmaps(contexts(spark, sf_dir))


@query
def fn_depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    missed, _ = compare.missed_and_wrong(*d.call_sets(spark, sf_dir))
    none = d.intervals(spark, sf_dir).select("chrom", "start", "end").limit(0)
    return compare.attribution(missed, none, depth(spark, sf_dir)).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query
def human_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = d.contigs(spark, sf_dir).select(F.concat(F.when(F.col("chrom") % 2 == 0, "chr").otherwise(""), (F.col("chrom") % 40).cast("string")).alias("chrom"), "length")
    return learners.human_contigs(named).groupBy("chrom").agg(F.sum("length").alias("bases"))


@query
def balanced_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = d.contigs(spark, sf_dir).select("chrom", F.lit(0).cast("long").alias("start"), F.col("length").alias("end"))
    return iv.balanced_parts(regions, 7).select("chrom", "part")


@query
def conforming_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = d.qualities(spark, sf_dir).withColumn("q", F.slice("q", F.lit(1), (F.col("read_id") % 3 + 14).cast("int")))
    return learners.conforming(cut, 15).select("read_id")


@query
def trinuc_contig_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trinucleotide_counts(d.contigs(spark, sf_dir), by_contig=True)


@query
def trinuc_region_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trinucleotide_counts(d.contigs(spark, sf_dir), regions=d.intervals(spark, sf_dir).select("chrom", "start", "end"))


@query
def random_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.table(spark, sf_dir, "events").select("event_id", vs.random_heterozygous(["het", F.col("event_id")], 2).alias("gt"))


@query
def sample_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotype and depth from a sample's column, where INFO has neither."""
    r = records(spark, sf_dir)
    fmt, sample = F.lit("DP:GT:XX"), F.concat_ws(":", F.col("l_suppkey").cast("string"), "gt", F.lit("."))
    found = r.select(vs.genotype(F.lit("WP=1/1"), fmt, sample).alias("genotype"), vs.depth(F.lit("AC=3"), fmt, sample).alias("depth"))
    return found.groupBy("genotype", "depth").agg(F.count(F.lit(1)).alias("n"))


@query
def targets_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = compare.long_targets(d.intervals(spark, sf_dir).select("chrom", "start", "end"), 60)
    return learners.restricted(d.variants(spark, sf_dir), targets).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


@query
def quality_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learners.quality_range(d.qualities(spark, sf_dir), 0, 30)


@query
def first_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = learners.first_reads(d.qualities(spark, sf_dir), "read_id", 500)
    return kept.select("read_id", F.aggregate("q", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query
def moving_mean_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean number of intervals that begin at a base, over the 100 bases from each begin."""
    starts = d.intervals(spark, sf_dir).groupBy("chrom", "start").agg(F.count(F.lit(1)).alias("n"))
    return iv.moving_mean(starts, "start", "n", 100).select("chrom", "start", F.round("mean", 9).alias("mean"))


def scratch(spark: SparkSession) -> str:
    """A new folder's path below the session's checkpoint folder, which all executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def named(rows: DataFrame) -> DataFrame:
    """``rows`` whose chromosomes have names that can stand in a file."""
    return rows.withColumn("chrom", F.concat(F.lit("c"), F.col("chrom").cast("string")))


def written_fasta(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark)
    sinks.write_contigs(named(d.contigs(spark, sf_dir)).select("chrom", "seq"), path)
    return path


@query
def fasta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    seqs = text.fasta(spark, written_fasta(spark, sf_dir))
    return seqs.join(text.fasta_index(seqs), "chrom").select("chrom", F.md5(F.col("seq").cast("binary")).alias("digest"), "length")


#: Bytes of a range where a query shows that files are cut.
SHORT_RANGE = 1 << 18


def indexed_fasta(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The index of a written FASTA folder, and tasks for its bytes."""
    path = written_fasta(spark, sf_dir)
    return fasta.index(spark, path, range_bytes=SHORT_RANGE), fasta.tasks_for(path, SHORT_RANGE)


@query
def fasta_index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of a FASTA folder, made from byte ranges."""
    return indexed_fasta(spark, sf_dir)[0].select("chrom", "length", "line_bases", "uniform")


@query
def fasta_trinuc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trinucleotides of a FASTA folder, read by index in pieces of at most 32 kB."""
    contigs, tasks = indexed_fasta(spark, sf_dir)
    return piece_trinucleotides(fasta.pieces(contigs, 32_768, 2, tasks=tasks))


@query
def fasta_gc_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs, tasks = indexed_fasta(spark, sf_dir)
    windows = learners.gc_tiles(recut(fasta.pieces(contigs, 30_000, tasks=tasks), 50), named(depth(spark, sf_dir)))
    return windows.groupBy("gc").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("depth"), 6).alias("total"))


@query
def fasta_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bases of intervals, each read by its own bytes alone."""
    contigs, tasks = indexed_fasta(spark, sf_dir)
    regions = named(d.intervals(spark, sf_dir)).select("chrom", "start", "end").distinct()
    return fasta.pieces(contigs, 32_768, 0, regions, tasks).groupBy("chrom", "start", "piece").agg(F.count(F.lit(1)).alias("n"))


@query
def fasta_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.fasta_names(spark, written_fasta(spark, sf_dir))


@query
def fasta_index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_index(named(d.contigs(spark, sf_dir)).select("chrom", "seq"), path)
    return text.fai(spark, path).select("chrom", "length", "line_bases")


@query
def vcf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    r = named(records(spark, sf_dir)).select("chrom", (F.col("pos") + 1).alias("pos1"), F.lit(".").alias("id"), "ref", "alt", F.lit(".").alias("qual"), "filter", F.regexp_extract("info", "DP=[0-9]+", 0).alias("info"), F.lit("GT").alias("format"), "gt")
    sinks.write_vcf(r, path, "gt")
    found = text.vcf(spark, path).where(~F.col("malformed"))
    return found.groupBy("chrom", "pos", "ref", "alt", "filter", "info", F.col("samples")["gt"].alias("gt")).agg(F.count(F.lit(1)).alias("n"))


@query
def tsv_variants_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    named(d.variants(spark, sf_dir)).select("chrom", F.col("pos") + 1, F.lit("."), "ref", "alt").write.csv(path, sep="\t")
    return text.positional_variants(spark, path).groupBy("chrom", "pos", "ref", "alt").agg(F.count(F.lit(1)).alias("n"))


def written_bed(spark: SparkSession, sf_dir: str, name: Column) -> DataFrame:
    path = scratch(spark)
    sinks.write_bed(named(d.intervals(spark, sf_dir)).select("chrom", "start", "end", name.alias("name")), path)
    return text.bed(spark, path)


def rate_name() -> Column:
    return F.concat(F.lit("mut_rate=0."), (F.col("o_orderkey") % 7).cast("string"))


@query
def bed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_bed(spark, sf_dir, rate_name())


@query
def rates_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.mutation_rates(written_bed(spark, sf_dir, rate_name())).withColumn("rate", F.round("rate", 9))


@query
def bed_track_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = text.track_lengths(written_bed(spark, sf_dir, rate_name()))
    return lengths.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum("track_len").alias("track_len"))


@query
def mappable_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.mappable(written_bed(spark, sf_dir, (F.col("o_orderkey") % 100).cast("string")), 50)


@query
def depth_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    named(d.intervals(spark, sf_dir)).select("chrom", F.col("start") + 1, F.col("o_orderkey") % 50).write.csv(path, sep="\t")
    return text.depth(spark, path)


def aligned_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads made of events: name, mate, chrom, pos, cigar, seq, qual, flag, mapq, mate_pos, tlen."""
    e, id_ = d.table(spark, sf_dir, "events"), F.col("event_id")
    digest = lambda what: F.md5(F.concat(F.lit(what), id_.cast("string")).cast("binary"))
    mate = (id_ % 2 + 1).cast("int")
    return e.select(
        F.concat(F.lit("r"), id_.cast("string")).alias("name"), mate.alias("mate"), F.concat(F.lit("c"), (id_ % 7).cast("string")).alias("chrom"), (id_ * 13 % 5000).alias("pos"),
        F.when(id_ % 5 == 0, "4S28M").when(id_ % 5 == 1, "10M2I20M").otherwise("32M").alias("cigar"), F.translate(digest(""), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"), F.translate(digest("q"), "0123456789abcdef", "ABCDEFGHIJABCDEF").alias("qual"),
        F.when(mate == 1, 65).otherwise(129).alias("flag"), F.lit(60).alias("mapq"), (id_ * 13 % 5000 + 50).alias("mate_pos"), F.lit(82).cast("long").alias("tlen"),
    )


def written_sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_sam(aligned_reads(spark, sf_dir), path)
    return text.sam(spark, path)


SAM_FIELDS = ["name", "flag", "ref", "pos", "cigar", "seq", "qual"]


@query
def sam_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_sam(spark, sf_dir).select(SAM_FIELDS)


@query
def bam_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bam.read(spark, written_bam(spark, sf_dir)).select(SAM_FIELDS)


def written_bam(spark: SparkSession, sf_dir: str, single: bool = False) -> str:
    path = scratch(spark) + (".bam" if single else "")
    r = aligned_reads(spark, sf_dir)
    bam.write(r.select("name", "flag", F.col("chrom").alias("ref"), "pos", "mapq", "cigar", F.lit("=").alias("mate_ref"), "mate_pos", "tlen", "seq", "qual"), path, [(f"c{i}", 10_000) for i in range(7)], single)
    return path


@query
def bam_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One BAM file, put together from all tasks' blocks and read by short ranges of blocks."""
    return bam.read(spark, written_bam(spark, sf_dir, True), SHORT_RANGE).select(*SAM_FIELDS, "mapq", "mate_ref", "mate_pos", "tlen")


@query
def bam_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the BAM files of a folder, and with blocks that hold reads in another format."""
    other = scratch(spark) + ".fq.gz"
    fastq.write(aligned_reads(spark, sf_dir), other, True)
    good, bad = (bam.faults(spark, p, SHORT_RANGE) for p in (written_bam(spark, sf_dir), other))
    return good.unionByName(bad).groupBy("at", "fault").agg(F.count(F.lit(1)).alias("n"))


@query
def fastq_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTQ as text, read by short byte ranges."""
    path = scratch(spark)
    sinks.write_fastq(aligned_reads(spark, sf_dir), path, compression="none")
    return fastq.read(spark, path, SHORT_RANGE).select("name", "seq", "qual")


@query
def fastq_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTQ as one gzip file in blocks, read by short ranges of blocks."""
    path = scratch(spark) + ".fq.gz"
    sinks.write_fastq(aligned_reads(spark, sf_dir), path, single=True)
    return fastq.read(spark, path, SHORT_RANGE).select("name", "seq", "qual")


@query
def fastq_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_fastq_pairs(aligned_reads(spark, sf_dir), path)
    both = fastq.read(spark, f"{path}/1").unionByName(fastq.read(spark, f"{path}/2"))
    return both.select("name", "seq", "qual")


@query
def aligned_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = text.aligned_qualities(written_sam(spark, sf_dir))
    return q.select("name", F.size("q").alias("n"), F.aggregate("q", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query
def golden_vcf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    v = named(d.variants(spark, sf_dir)).select("chrom", "pos", "ref", "alt").distinct().withColumn("ploids", F.array(F.lit(1)))
    sinks.write_vcf(simulate.golden_vcf(v), path)
    return text.vcf(spark, path).select("chrom", "pos", "ref", "alt", info_value(F.col("info"), "AF").alias("af"))


@query
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_model({"marginals": learners.quality_marginals(d.qualities(spark, sf_dir))}, path)
    return sinks.read_model(spark, path, ["marginals"])["marginals"].select("pos", "q", "n")


@query
def trinuc_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the reference, kept in a table for the runs to come."""
    path = scratch(spark)
    return sinks.cached(spark, path, lambda: trinucleotide_counts(d.contigs(spark, sf_dir)))


@query
def callable_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    return sinks.cached(spark, path, lambda: callable_regions(spark, sf_dir))


def compared_vcf(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = scratch(spark)
    dot = F.lit(".")
    sinks.write_vcf(named(rows).select("chrom", (F.col("pos") + 1).alias("pos1"), dot.alias("id"), "ref", "alt", dot.alias("qual"), F.lit("PASS").alias("filter"), dot.alias("info")), path)
    return text.vcf(spark, path).select("chrom", "pos", "ref", "alt")


@query
def missed_vcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_vcf(spark, vcf_fn(spark, sf_dir))


@query
def wrong_vcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_vcf(spark, vcf_fp(spark, sf_dir))


def queries() -> dict[str, Query]:
    return dict(ALL)


