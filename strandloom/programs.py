"""Whole programs: files in, models and reports out, with checked arguments.

Each reads its inputs with Spark's readers and the sources of this library, writes
Parquet tables (and VCF lines) below ``output``, and returns them as DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequence import decode_qualities
from strandloom.operators import variants as vs
from strandloom.operators.chunks import piece_trinucleotides, recut
from strandloom.operators.intervals import merge, overlaps, points_in_intervals
from strandloom.operators.lineage import checkpointed
from strandloom.plans import compare, learners
from strandloom.sources import bam, fasta, fastq, sinks, text
from strandloom.sources.ranges import files

#: Bases of a piece that variants are looked up in.
PIECE = 256


class BadInput(ValueError):
    """An argument or a file that a program can't work with."""


# checks


def required(**values: object) -> None:
    """Raise if an argument is null or an empty text."""
    if missing := [n for n, v in values.items() if v is None or v == ""]:
        raise BadInput(f"missing: {', '.join(missing)}")


def in_range(low: float, high: float, **values: float) -> None:
    """Raise if a number lies outside ``low`` .. ``high``."""
    if bad := [f"{n} = {v}" for n, v in values.items() if not low <= v <= high]:
        raise BadInput(f"not within {low} .. {high}: {', '.join(bad)}")


def there(**paths: str | None) -> None:
    """Raise if a file or folder that is named isn't there, or an empty folder; null paths pass."""
    for name, path in paths.items():
        if path is not None:
            try:
                files(path)
            except (OSError, ValueError) as e:
                raise BadInput(f"{name}: {path} can't be read") from e


def shared_chromosomes(**tables: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(chrom that all tables have, chrom and missing_in of all others); null tables don't take part.

    Raises if they have none in common, as with names in other spellings. The names stay
    in Spark: draft assemblies have millions of contigs.
    """
    given = {n: t.select("chrom").distinct() for n, t in tables.items() if t is not None}
    every = reduce(DataFrame.unionByName, (t.withColumn("of", F.lit(n)) for n, t in given.items()))
    found = checkpointed(every.groupBy("chrom").agg(F.array_except(F.array(*map(F.lit, given)), F.collect_set("of")).alias("missing_in")))
    common = found.where(F.size("missing_in") == 0).select("chrom")
    if common.isEmpty():
        raise BadInput(f"no chromosome is in all of: {', '.join(given)}; are the names spelt alike?")
    return common, found.where(F.size("missing_in") > 0).select("chrom", F.array_join(F.array_sort("missing_in"), ",").alias("missing_in"))


def saved(tables: dict[str, DataFrame], output: str) -> dict[str, DataFrame]:
    """The tables, written and read again."""
    sinks.write_model(tables, output)
    spark = next(iter(tables.values())).sparkSession
    return sinks.read_model(spark, output, list(tables))


# learning


def learn_mutations(
    spark: SparkSession, *, reference: str | None, variants: str | None, output: str | None, regions: str | None = None, human: bool = False, skip_common: bool = False
) -> dict[str, DataFrame]:
    """The mutation model of a VCF against a FASTA reference, inside BED ``regions`` if they are given.

    Tables: transitions, trinucleotides, bases, indels, rates, left_out (chromosomes that not
    all inputs have); common and regions (of many mutations) unless ``skip_common``. ``human``
    leaves out scaffolds. Overlapping regions count once for trinucleotides.
    """
    required(reference=reference, variants=variants, output=output)
    there(reference=reference, variants=variants, regions=regions)
    contigs = checkpointed(fasta.index(spark, reference))
    calls = text.vcf(spark, variants).where(~F.col("malformed"))
    if human:
        contigs, calls = learners.human_contigs(contigs), learners.human_contigs(calls)
    targets = None if regions is None else text.bed(spark, regions)
    common, left_out = shared_chromosomes(reference=contigs, variants=calls, regions=targets)
    common = checkpointed(common)
    on_common = lambda rows: rows.join(common, "chrom", "left_semi")
    contigs, tasks = on_common(contigs), fasta.tasks_for(reference)
    inside = None if targets is None else checkpointed(merge(on_common(targets)).select("chrom", "start", "end"))
    kept = calls.select("chrom", "pos", F.upper("ref").alias("ref"), F.upper("alt").alias("alt"), vs.population_frequency(F.col("info")).alias("freq"))
    kept = checkpointed(learners.restricted(learners.trimmed(on_common(kept)), inside))
    contexts = checkpointed(learners.snp_contexts(kept, fasta.pieces(contigs, PIECE, 3, tasks=tasks)))
    counts = piece_trinucleotides(fasta.pieces(contigs, 32_768, 2, inside, tasks))
    bases = fasta.pieces(contigs, 32_768, 0, tasks=tasks).select(F.col("piece").alias("seq")) if targets is None else None
    tables = {
        "transitions": learners.mutation_spectrum(contexts),
        "trinucleotides": learners.mutation_probabilities(contexts, None, counts),
        "bases": learners.base_transitions(contexts),
        "indels": learners.indel_frequencies(kept),
        "rates": learners.rates(kept, bases, None if targets is None else on_common(targets)),
        "left_out": left_out,
    }
    if not skip_common:
        tables |= {"common": learners.common_variants(kept), "regions": learners.merged_regions(learners.dense_regions(kept))}
    return saved(tables, output)


def learn_gc(spark: SparkSession, *, coverage: str | None, reference: str | None, output: str | None, window: int = 50) -> dict[str, DataFrame]:
    """The bias of coverage by GC content. Tables: gc (a row for each count), left_out."""
    required(coverage=coverage, reference=reference, output=output)
    in_range(1, 30_000, window=window)
    there(coverage=coverage, reference=reference)
    contigs = checkpointed(fasta.index(spark, reference))
    depth = text.depth(spark, coverage)
    common, left_out = shared_chromosomes(reference=contigs, coverage=depth)
    pieces = fasta.pieces(contigs.join(common, "chrom", "left_semi"), 30_000 // window * window, tasks=fasta.tasks_for(reference))
    return saved({"gc": learners.gc_bias(learners.gc_tiles(recut(pieces, window), depth, window), window), "left_out": left_out}, output)


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """Records of a .sam or .bam file, or of a folder of either."""
    kinds = {name.rpartition(".")[2] for name, _ in files(path)}
    if kinds == {"bam"}:
        return bam.read(spark, path)
    if kinds == {"sam"}:
        return text.sam(spark, path)
    raise BadInput(f"{path}: neither .sam nor .bam alone, but {', '.join(sorted(kinds))}")


def learn_fragments(spark: SparkSession, *, reads: str | None, output: str | None, least_reads: int = 100, deviations: float = 10.0) -> dict[str, DataFrame]:
    """The lengths of fragments in a SAM or BAM file. Tables: lengths."""
    required(reads=reads, output=output)
    there(reads=reads)
    return saved({"lengths": learners.fragment_lengths(alignments(spark, reads), least_reads, deviations)}, output)


def learn_qualities(
    spark: SparkSession, *, reads: str | None, output: str | None, reads2: str | None = None, offset: int = 33, highest: int = 41, most_reads: int | None = None
) -> dict[str, DataFrame]:
    """Chains of qualities from FASTQ, SAM or BAM files, of one or both mates.

    Tables: marginals and transitions (for mate 2 marginals2 and transitions2), and error, the
    mean chance of an error over the mates. Reads of the most frequent length count; a quality
    outside 0 .. ``highest`` is an error. ``most_reads`` takes that many from the files' beginning.
    """
    required(reads=reads, output=output)
    in_range(0, 127, offset=offset, highest=highest)
    there(reads=reads, reads2=reads2)
    tables, errors = {}, []
    for suffix, path in (("", reads), ("2", reads2)):
        if path is None:
            continue
        kinds = {name.removesuffix(".gz").rpartition(".")[2] for name, _ in files(path)}
        if kinds & {"sam", "bam"}:
            rows, order = text.aligned_qualities(alignments(spark, path)).withColumn("q", F.transform("q", lambda x: x + 33 - offset)), "name"
        else:
            rows = fastq.read(spark, path).where(F.col("qual").isNotNull())
            rows = rows.select(F.struct("file", "offset").alias("at"), F.transform(decode_qualities(F.col("qual")), lambda x: x + 33 - offset).alias("q"))
            order = "at"
        rows = checkpointed((rows if most_reads is None else learners.first_reads(rows, order, most_reads)).select("q"))
        length = rows.groupBy(F.size("q").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        if length is None:
            raise BadInput(f"{path}: no reads")
        kept = learners.conforming(rows, length["n"])
        found = learners.quality_range(kept, 0, highest).first()
        if found["n_outside"]:
            raise BadInput(f"{path}: {found['n_outside']} qualities outside 0 .. {highest} ({found['least']} .. {found['most']}); is the offset {offset}?")
        tables |= {f"marginals{suffix}": learners.quality_marginals(kept), f"transitions{suffix}": learners.quality_transitions(kept)}
        errors.append(learners.mean_error(kept))
    tables["error"] = spark.createDataFrame([(sum(errors) / len(errors),)], "mean_error double")
    return saved(tables, output)


# comparing


def calls_of(spark: SparkSession, path: str, failed: bool) -> DataFrame:
    """chrom, pos, ref, alt, depth and the line of each alternative of a VCF's records (PASS alone unless ``failed``)."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0)).select("value", F.split("value", "\t").alias("c"))
    cell = lambda i: F.get("c", F.lit(i))
    rows = lines.where(F.size("c") >= 8).select(
        cell(0).alias("chrom"), (cell(1).try_cast("long") - 1).alias("pos"), F.upper(cell(3)).alias("ref"), F.upper(cell(4)).alias("alt"), cell(6).alias("filter"), vs.depth(cell(7), cell(8), cell(9)).alias("depth"), F.col("value").alias("line")
    )
    rows = rows.where(F.col("pos").isNotNull() & vs.is_variant() & (F.lit(failed) | vs.passed()))
    return vs.suffix_trimmed(vs.split_alternatives(rows)).where(vs.is_variant()).select("chrom", "pos", "ref", "alt", "depth", "line")


def compare_calls(
    spark: SparkSession, *, reference: str | None, golden: str | None, called: str | None, output: str | None, mappability: str | None = None, mappability_least: int = 0,
    targets: str | None = None, targets_least: int | None = None, least_depth: int = 15, failed: bool = False, fast: bool = False, vcf_out: bool = False,
) -> dict[str, DataFrame]:
    """A call set against the golden one, inside ``targets`` of ``targets_least`` bases or more if they are given.

    Tables: summary (one row; equivalent: wrong calls that say in other words what missed
    variants say, which count neither as wrong nor as missed, unless ``fast``; in_short: golden
    variants in targets that are too short), missed (with the reasons), wrong, left_out. With
    ``vcf_out`` the inputs' own lines of missed and wrong variants are written, in order of
    place, to ``missed_vcf`` and ``wrong_vcf``.
    """
    required(reference=reference, golden=golden, called=called, output=output)
    if (targets is None) != (targets_least is None):
        raise BadInput("targets and targets_least go together")
    in_range(0, 1 << 31, least_depth=least_depth, mappability_least=mappability_least)
    there(reference=reference, golden=golden, called=called, mappability=mappability, targets=targets)
    contigs = checkpointed(fasta.index(spark, reference))
    sides = {"golden": calls_of(spark, golden, failed), "called": calls_of(spark, called, failed)}
    common, left_out = shared_chromosomes(reference=contigs, **sides)
    common = checkpointed(common)
    sides = {n: t.join(common, "chrom", "left_semi") for n, t in sides.items()}
    in_short = spark.createDataFrame([(0,)], "in_short long")
    if targets is not None:
        regions = text.bed(spark, targets)
        long = merge(compare.long_targets(regions, targets_least)).select("chrom", "start", "end")
        short = regions.where(F.col("end") - F.col("start") < targets_least)
        in_short = points_in_intervals(sides["golden"], merge(short).select("chrom", "start", "end"), "inner").agg(F.count(F.lit(1)).alias("in_short"))
        sides = {n: points_in_intervals(t, long, "inner").drop("start", "end") for n, t in sides.items()}
    sides = {n: checkpointed(t) for n, t in sides.items()}
    alleles = {n: t.select(compare.ALLELE).distinct() for n, t in sides.items()}
    missed, wrong = map(checkpointed, compare.missed_and_wrong(alleles["golden"], alleles["called"]))
    equivalent = spark.createDataFrame([], missed.schema)
    if not fast:
        pieces = fasta.pieces(contigs.join(common, "chrom", "left_semi"), PIECE, 4 * compare.NEIGHBOURHOOD + 1, tasks=fasta.tasks_for(reference))
        equivalent = checkpointed(compare.equivalents(missed, wrong, pieces).select(compare.ALLELE))
        spoken = overlaps(
            equivalent.select("chrom", (F.col("pos") - compare.NEIGHBOURHOOD).alias("start"), (F.col("pos") + compare.NEIGHBOURHOOD + 1).alias("end")),
            missed.select(*compare.ALLELE, F.col("pos").alias("start"), (F.col("pos") + F.char_length("ref")).alias("end")),
        ).select(*[F.col(f"r_{c}").alias(c) for c in compare.ALLELE]).distinct()
        missed, wrong = missed.join(spoken, compare.ALLELE, "left_anti"), wrong.join(equivalent, compare.ALLELE, "left_anti")
    tracks = spark.createDataFrame([], "chrom string, start long, end long") if mappability is None else text.mappable(text.bed(spark, mappability), mappability_least)
    known = sides["golden"].where(F.col("depth").isNotNull()).select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "depth").distinct()
    missed, wrong = checkpointed(compare.attribution(missed, tracks, known, least_depth)), checkpointed(wrong)
    n = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    counts = [n(sides["golden"], "n_golden"), n(sides["called"], "n_called"), n(missed, "n_missed"), n(wrong, "n_wrong"), n(equivalent, "n_equivalent"), in_short]
    reasons = missed.agg(*[F.count_if(r).alias(f"n_{r}") for r in ("unmappable", "low_depth", "unknown")])
    summary = reduce(DataFrame.crossJoin, [*counts, reasons])  # rows of numbers, one each
    if vcf_out:
        for name, rows, side in (("missed_vcf", missed, "golden"), ("wrong_vcf", wrong, "called")):
            lines = sides[side].join(rows.select(compare.ALLELE), compare.ALLELE, "left_semi")
            lines.groupBy("chrom", "pos", "line").agg(F.count(F.lit(1))).orderBy("chrom", "pos", "line").select("line").write.mode("overwrite").text(f"{output}/{name}")
    return saved({"summary": summary, "missed": missed, "wrong": wrong, "left_out": left_out}, output)


PROGRAMS: dict[str, Callable] = {f.__name__: f for f in (learn_mutations, learn_gc, learn_fragments, learn_qualities, compare_calls)}
