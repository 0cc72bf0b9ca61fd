"""Bases that are N: put others in their place, or leave their runs out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.random import uniform_int
from strandloom.functions.sequence import apply_variants
from strandloom.operators.intervals import complement, runs_of


def filled(seqs: DataFrame, longest: int, seed: int = 1, base: str | None = None) -> DataFrame:
    """chrom, seq with the bases of N runs of at most ``longest`` drawn at random, or all ``base``."""
    short = runs_of(seqs, "N+").where(F.col("end") - F.col("start") <= longest)
    places = short.select("chrom", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    one = F.lit(base) if base else F.substring(F.lit("ACGT"), (uniform_int(4, "N", seed, F.col("chrom"), F.col("pos")) + 1).cast("int"), F.lit(1))
    put = F.struct(F.col("pos").cast("int").alias("off"), F.lit("N").alias("ref"), one.alias("alt"))
    by_chrom = places.groupBy("chrom").agg(F.array_sort(F.collect_list(put)).alias("put"))
    return seqs.join(by_chrom, "chrom", "left").select("chrom", F.when(F.col("put").isNull(), F.col("seq")).otherwise(apply_variants(F.col("seq"), F.col("put"))).alias("seq"))


def callable_parts(seqs: DataFrame, least_run: int = 1) -> DataFrame:
    """Intervals between N runs of at least ``least_run`` bases."""
    big = runs_of(seqs, "N+").where(F.col("end") - F.col("start") >= least_run)
    return complement(big, seqs.select("chrom", F.char_length("seq").cast("long").alias("length")))
