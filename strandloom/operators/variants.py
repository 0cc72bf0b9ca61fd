"""Variant records: filters with reasons, projections, fields, de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from strandloom.functions.random import uniform_int
from strandloom.functions.sequence import carriers, common_suffix, first_info_value, format_value, genotype_alleles, info_value, wp_string
from strandloom.operators.chunks import chunked
from strandloom.operators.statistics import first_by


def is_variant() -> Column:
    """The record has an alternative that differs from the reference."""
    return F.col("alt").isNotNull() & ~F.col("alt").isin(".", "") & (F.col("alt") != F.col("ref"))


def passed() -> Column:
    return F.col("filter").isin("PASS", ".")


def suffix_trimmed(variants: DataFrame) -> DataFrame:
    """ref and alt without the suffix they share; both keep a base."""
    n = common_suffix(F.col("ref"), F.col("alt"))
    cut = lambda c: F.left(F.col(c), F.char_length(c) - F.col("shared"))
    return variants.withColumn("shared", n).withColumns({"ref": cut("ref"), "alt": cut("alt")}).drop("shared")


def split_alternatives(variants: DataFrame) -> DataFrame:
    """A row for each of the comma-separated alternatives, with its number from 0."""
    return variants.select("*", F.posexplode(F.split("alt", ",")).alias("alt_no", "one")).drop("alt").withColumnRenamed("one", "alt")


def allele_frequencies(info: Column, n: Column) -> Column:
    """AF of each of ``n`` alternatives: the last value fills up, a point or no key is null."""
    given = F.split(info_value(info, "AF"), ",")
    at = F.sequence(F.lit(1), n)
    value = lambda i: F.try_element_at(given, F.least(i, F.size(given)))
    return F.when(given.isNotNull(), F.transform(at, lambda i: value(i).try_cast("double"))).otherwise(F.transform(at, lambda i: F.lit(None).cast("double")))


def depth(info: Column, fmt: Column | None = None, sample: Column | None = None) -> Column:
    """Read depth: DP, DPU or DPI of INFO, then of the sample."""
    keys = ("DP", "DPU", "DPI")
    found = [first_info_value(info, keys)]
    if fmt is not None:
        found += [format_value(fmt, sample, k) for k in keys]
    return F.coalesce(*found).try_cast("int")


def population_frequency(info: Column, default: float = 1e-5) -> Column:
    """The second value of CAF, else the default."""
    return F.coalesce(F.try_element_at(F.split(info_value(info, "CAF"), ","), F.lit(2)).try_cast("double"), F.lit(default))


def genotype(info: Column, fmt: Column | None = None, sample: Column | None = None) -> Column:
    """Genotype string: WP, then GT of INFO where there is no sample, else GT of the sample."""
    if fmt is None:
        return F.coalesce(info_value(info, "WP"), info_value(info, "GT"))
    return format_value(fmt, sample, "GT")


def validity(variants: DataFrame, seqs: DataFrame, size: int = 1024) -> DataFrame:
    """``variants`` with ``reason``: null if valid, else the first of ref_mismatch, n_in_ref, bad_alt."""
    longest = variants.agg(F.max(F.char_length("ref"))).first()[0] or 1  # one number; a reference allele is a short string
    pieces = chunked(seqs, size, int(longest)).withColumnsRenamed({"chrom": "s_chrom", "start": "s_start"})
    hit = (F.col("chrom") == F.col("s_chrom")) & (F.floor(F.col("pos") / size) * size == F.col("s_start"))
    there = F.substring("piece", (F.col("pos") - F.col("s_start") + 1).cast("int"), F.char_length("ref"))
    reason = F.when(F.coalesce(there, F.lit("")) != F.col("ref"), "ref_mismatch").when(F.col("ref").contains("N"), "n_in_ref").when(~F.col("alt").rlike("^[ACGT]+$"), "bad_alt")
    return variants.join(pieces, hit, "left").withColumn("reason", reason).drop("s_chrom", "s_start", "piece")


def screened(records: DataFrame, checks: dict[str, Column] | None = None) -> tuple[DataFrame, Observation]:
    """(records that pass all checks, how many fail each one first), counted as the records go by.

    The numbers are there once the records have been used, without a second pass:
    ``observation.get`` has one for each check, and ``kept``. Checks that are null fail.
    """
    checks = checks or {"no_variant": is_variant(), "filtered": passed(), "no_position": F.col("pos") > 0, "not_carried": carried(F.col("gt"))}
    reason = None
    for name, ok in checks.items():
        bad = ~F.coalesce(ok, F.lit(False))
        reason = F.when(bad, name) if reason is None else reason.when(bad, name)
    counted = Observation()
    marked = records.withColumn("failed", reason)
    marked = marked.observe(counted, F.count_if(F.col("failed").isNull()).alias("kept"), *[F.count_if(F.col("failed") == n).alias(n) for n in checks])
    return marked.where(F.col("failed").isNull()).drop("failed"), counted


def valid_first(variants: DataFrame, seqs: DataFrame, order: list[str]) -> tuple[DataFrame, list[Observation]]:
    """(the first valid variant of each position, counters of what went): reasons of ``validity``, then positions.

    A variant goes as ``duplicate`` if its position has one already; the second counter has
    the positions that stay, so their number less ``valid`` are the duplicates.
    """
    reasons, positions = Observation(), Observation()
    judged = validity(variants, seqs)
    judged = judged.observe(reasons, F.count_if(F.col("reason").isNull()).alias("valid"), *[F.count_if(F.col("reason") == n).alias(n) for n in ("ref_mismatch", "n_in_ref", "bad_alt")])
    first = first_at_position(judged.where(F.col("reason").isNull()).drop("reason"), order)
    return first.observe(positions, F.count(F.lit(1)).alias("positions")), [reasons, positions]


def first_at_position(variants: DataFrame, order: list[str]) -> DataFrame:
    """The first record of each (chrom, pos)."""
    return first_by(variants, ["chrom", "pos"], order)


def merged_alleles(variants: DataFrame, order: list[str]) -> DataFrame:
    """Distinct alternatives of a position joined by commas, that of the last record first: chrom, pos, ref, alt.

    ``order`` is the records' order in their file; an alternative counts where it stands last.
    """
    last = variants.groupBy("chrom", "pos", "ref", "alt").agg(F.max(F.struct(*order)).alias("last"))
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("last", "alt"))))
    return last.groupBy("chrom", "pos", "ref").agg(F.array_join(F.transform(ordered, lambda x: x["alt"]), ",").alias("alt"))


def random_heterozygous(key: list[Column | str | int], ploidy: int) -> Column:
    """A genotype with one ploid, drawn by ``key``, set to 1: what stands in for a missing genotype."""
    return wp_string(F.array(uniform_int(ploidy, *key).cast("int")), ploidy)


def called_genotype(records: DataFrame, ploidy: int = 2, seed: int = 0, order: list[str] | None = None) -> DataFrame:
    """``records`` (of the VCF reader) with ``gt``: the first sample's genotype, or that of INFO where there are no samples.

    Where none is given one ploid, drawn by the record's place and alleles, has the variant.
    """
    given = F.when(F.col("format").isNotNull(), format_value(F.col("format"), F.col("sample"), "GT")).otherwise(genotype(F.col("info")))
    given = F.when(~F.coalesce(given, F.lit(".")).isin(".", "", "./.", ".|."), given)
    return records.withColumn("gt", F.coalesce(given, random_heterozygous([F.lit("gt"), F.lit(seed), *[F.col(c) for c in order or ["chrom", "pos", "ref", "alt"]]], ploidy)))


def frequency_class(af: Column) -> Column:
    """Allele frequency in twentieths, 0 to 20."""
    return F.least(F.greatest(F.floor(af * 20), F.lit(0)), F.lit(20)).cast("int")


def carried(gt: Column) -> Column:
    """Whether any allele is number 1."""
    return F.exists(genotype_alleles(gt), lambda a: a == 1)


def tally(applied: DataFrame, ploidy: int = 2) -> DataFrame:
    """chrom, pos, ref, alt, ploids, af, wp of variants applied to ploids (a row for each ploid)."""
    ploids = F.array_sort(F.collect_set("ploid"))
    grouped = applied.groupBy("chrom", "pos", "ref", "alt").agg(ploids.alias("ploids"))
    return grouped.select("*", (F.size("ploids") / ploidy).alias("af"), F.concat(F.lit("WP="), wp_string(F.col("ploids"), ploidy)).alias("info"))


def explode_genotype(variants: DataFrame, gt: str = "gt") -> DataFrame:
    """A row for each ploid that carries the variant."""
    return variants.withColumn("ploid", F.explode(carriers(F.col(gt))))
