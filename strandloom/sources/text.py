"""Readers of FASTA, VCF, BED, SAM, coverage and FASTQ files as DataFrames.

Everything goes through Spark's text sources, so plain and gzip files in any store work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fasta(spark: SparkSession, path: str, cut: str = r"[ \t|]") -> DataFrame:
    """chrom, seq: upper-cased sequences; the name ends at the first match of ``cut``."""
    rows = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    name = F.split(F.regexp_extract("value", r"^([^\r\n]*)", 1), cut, 2)[0]
    seq = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", ""))
    return rows.select(name.alias("chrom"), seq.alias("seq"))


def fasta_names(spark: SparkSession, path: str, cut: str = r"[ \t|]") -> DataFrame:
    """chrom of every sequence, from the header lines alone."""
    heads = spark.read.text(path).where(F.col("value").startswith(">"))
    return heads.select(F.split(F.substring("value", 2, 1 << 30), cut, 2)[0].alias("chrom"))


def fasta_index(seqs: DataFrame) -> DataFrame:
    """chrom, length of every sequence."""
    return seqs.select("chrom", F.char_length("seq").cast("long").alias("length"))


def fai(spark: SparkSession, path: str) -> DataFrame:
    """chrom, length, offset, line_bases of a .fai file."""
    return spark.read.csv(path, sep="\t", schema="chrom string, length long, offset long, line_bases int")


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos (0-based), id, ref, alt, qual, filter, info, format, samples (map by name), sample (the first one's fields).

    Columns are found by the #CHROM line; a record with another number of columns has
    a null chrom (``malformed``).
    """
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith("#CHROM")).first()
    names = head[0].lstrip("#").rstrip().split("\t") if head else "CHROM POS ID REF ALT QUAL FILTER INFO".split()
    cells = lines.where(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0)).select(F.split("value", "\t").alias("c"))
    at = {n: i for i, n in enumerate(names)}
    cell = lambda n: F.col("c")[at[n]] if n in at else F.lit(None).cast("string")
    samples = names[9:] if "FORMAT" in at else []
    by_name = F.create_map(*[x for s in samples for x in (F.lit(s), cell(s))]) if samples else F.lit(None).cast("map<string,string>")
    ok = F.size("c") == len(names)
    return cells.select(
        F.when(ok, cell("CHROM")).alias("chrom"),
        F.when(ok, cell("POS").try_cast("long") - 1).alias("pos"),
        *[F.when(ok, cell(n.upper())).alias(n) for n in ("id", "ref", "alt")],
        F.when(ok, cell("QUAL").try_cast("double")).alias("qual"),
        *[F.when(ok, cell(n.upper())).alias(n) for n in ("filter", "info", "format")],
        F.when(ok, by_name).alias("samples"),
        F.when(ok, F.get("c", F.lit(9))).alias("sample") if samples else F.lit(None).cast("string").alias("sample"),
        (~ok).alias("malformed"),
    )


def positional_variants(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos (0-based), id, ref, alt of a table without header, by the places of its columns."""
    rows = spark.read.csv(path, sep="\t", schema="chrom string, pos1 long, id string, ref string, alt string", comment="#")
    return rows.select("chrom", (F.col("pos1") - 1).alias("pos"), "id", "ref", "alt")


def bed(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, name (fourth column if there is one)."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track|browser|\s*$)")).select(F.split("value", "\t").alias("c"))
    return lines.select(F.col("c")[0].alias("chrom"), F.col("c")[1].cast("long").alias("start"), F.col("c")[2].cast("long").alias("end"), F.get("c", F.lit(3)).alias("name"))


def track_lengths(regions: DataFrame) -> DataFrame:
    """``regions`` with ``track_len``, which counts both ends."""
    return regions.withColumn("track_len", F.col("end") - F.col("start") + 1)


def mutation_rates(regions: DataFrame) -> DataFrame:
    """BED regions longer than a base whose name has mut_rate=, clamped to 0 .. 0.3: chrom, start, end, rate."""
    rate: Column = F.regexp_extract("name", r"mut_rate=([^;]*)", 1).try_cast("double")
    kept = regions.where((F.col("end") - F.col("start") > 1) & rate.isNotNull())
    return kept.select("chrom", "start", "end", F.greatest(F.least(rate, F.lit(0.3)), F.lit(0.0)).alias("rate"))


def mappable(regions: DataFrame, least: int) -> DataFrame:
    """Track regions whose fourth column is at least ``least``."""
    return regions.where(F.col("name").try_cast("int") >= least).select("chrom", "start", "end")


def sam(spark: SparkSession, path: str) -> DataFrame:
    """name, flag, ref, pos (0-based), mapq, cigar, mate_ref, mate_pos, tlen, seq, qual."""
    c = spark.read.text(path).where(~F.col("value").rlike("^[@#]") & F.col("value").contains("\t")).select(F.split("value", "\t").alias("c"))
    kinds = (("name", "string"), ("flag", "int"), ("ref", "string"), ("pos", "long"), ("mapq", "int"), ("cigar", "string"), ("mate_ref", "string"), ("mate_pos", "long"), ("tlen", "long"), ("seq", "string"), ("qual", "string"))
    rows = c.select(*[F.get("c", F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(kinds)])
    return rows.withColumns({"pos": F.col("pos") - 1, "mate_pos": F.col("mate_pos") - 1})


def aligned_qualities(reads: DataFrame) -> DataFrame:
    """Qualities as array ``q`` of the aligned part alone: soft-clipped ends are cut."""
    head = F.coalesce(F.regexp_extract("cigar", r"^(?:\d+H)?(\d+)S", 1).try_cast("int"), F.lit(0))
    tail = F.coalesce(F.regexp_extract("cigar", r"[MIDNP=X](\d+)S(?:\d+H)?$", 1).try_cast("int"), F.lit(0))
    from strandloom.functions.sequence import decode_qualities

    return reads.withColumn("q", decode_qualities(F.substring("qual", head + 1, F.char_length("qual") - head - tail)))


def depth(spark: SparkSession, path: str) -> DataFrame:
    """Per-base coverage (chrom, 1-based pos, depth) as stretches chrom, start, end, depth."""
    rows = spark.read.csv(path, sep="\t", schema="chrom string, pos long, depth double")
    return rows.select("chrom", (F.col("pos") - 1).alias("start"), F.col("pos").alias("end"), "depth")
