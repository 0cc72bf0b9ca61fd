"""Validation of reads and alignments: a code for what is wrong with a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fastq_error() -> Column:
    """The first fault of a record (name, seq, plus, qual), else null."""
    return (
        F.when(F.col("name").isNull() | F.col("seq").isNull() | F.col("plus").isNull() | F.col("qual").isNull(), "missing_line")
        .when(~F.col("name").startswith("@"), "bad_header")
        .when(~F.col("plus").startswith("+"), "bad_separator")
        .when(F.char_length("seq") != F.char_length("qual"), "length_mismatch")
        .when(~F.col("seq").rlike("^[ACGTN]*$"), "bad_base")
        .when(~F.col("qual").rlike("^[!-J]*$"), "bad_quality")
    )


def mate_errors(first: DataFrame, second: DataFrame) -> DataFrame:
    """record, error of two files' records side by side (record, name): unpaired or with other names."""
    bare = lambda c: F.regexp_replace(c, "/[12]$", "")
    both = first.select("record", F.col("name").alias("a")).join(second.select("record", F.col("name").alias("b")), "record", "full")
    error = F.when(F.col("a").isNull() | F.col("b").isNull(), "unpaired").when(bare(F.col("a")) != bare(F.col("b")), "name_mismatch")
    return both.select("record", error.alias("error")).where(F.col("error").isNotNull())


def tally(records: DataFrame) -> DataFrame:
    """error, n; records without fault count as ok."""
    return records.select(F.coalesce(fastq_error(), F.lit("ok")).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))
