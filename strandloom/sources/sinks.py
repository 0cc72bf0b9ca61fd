"""Writers of FASTQ, FASTA, VCF and SAM text, and of model tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.plans.simulate import fastq_lines, fastq_records, sam_lines
from strandloom.sources import fastq
from strandloom.sources.ranges import files, located

VCF_HEADER = (
    "##fileformat=VCFv4.1\n"
    '##INFO=<ID=AF,Number=A,Type=Float,Description="Allele frequency">\n'
    '##INFO=<ID=WP,Number=A,Type=String,Description="Ploids that carry the variant">\n'
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"
)


def write_fastq(reads: DataFrame, path: str, mate: int | None = None, compression: str = "blocks", single: bool = False) -> None:
    """Reads (of one mate) as FASTQ: gzip files in blocks, which many tasks can read, or text in a codec of Spark's.

    ``single`` joins the blocks to one file, in the order of the partitions.
    """
    rows = reads if mate is None else reads.where(F.col("mate") == mate)
    if compression == "blocks":
        fastq.write(fastq_records(rows), path, single)
    else:
        fastq_lines(rows).write.text(path, compression=compression)


def write_fastq_pairs(reads: DataFrame, path: str, compression: str = "blocks") -> None:
    """Both mates of each pair at the same place of files that correspond, in folders ``1`` and ``2``."""
    ordered = reads.repartition("name").sortWithinPartitions("name")
    for mate in (1, 2):
        write_fastq(ordered, f"{path}/{mate}", mate, compression)


def write_contigs(seqs: DataFrame, path: str, width: int = 60) -> None:
    """Sequences (chrom, seq) as FASTA, in lines of ``width`` bases."""
    folded = F.regexp_replace("seq", rf"(.{{{width}}})(?=.)", "$1\n")
    seqs.select(F.concat(F.lit(">"), F.col("chrom").cast("string"), F.lit("\n"), folded).alias("value")).write.text(path)


def write_index(seqs: DataFrame, path: str, width: int = 60) -> None:
    """The .fai table of ``write_contigs``'s sequences, for a file that has them in the order of their names."""
    length = F.char_length("seq").cast("long")
    head = F.char_length("chrom") + 2  # the sign before the name and the end of its line
    size = head + length + F.ceil(length / width)
    rows = seqs.select("chrom", length.alias("length"), size.alias("size"), head.alias("head"))
    before = F.sum("size").over(Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1))  # a row for each contig
    rows.select("chrom", "length", (F.coalesce(before, F.lit(0)) + F.col("head")).alias("offset"), F.lit(width), F.lit(width + 1)).orderBy("chrom").write.csv(path, sep="\t")


def write_bed(regions: DataFrame, path: str) -> None:
    """chrom, start, end, name as BED."""
    regions.select("chrom", "start", "end", "name").write.csv(path, sep="\t")


def content_key(path: str) -> str:
    """A name for what a file or folder holds now: it changes with names, sizes and times of the files."""
    store, _ = located(path)
    found = [(name, size, store.get_file_info(located(name)[1]).mtime_ns) for name, size in files(path)]
    return hashlib.md5(repr(found).encode()).hexdigest()


def cached(spark, path: str, make: Callable[[], DataFrame], source: str | None = None) -> DataFrame:  # noqa: ANN001
    """The table at ``path``, made and written first if it isn't there; with ``source``, made again if those files change."""
    path = path if source is None else f"{path}/{content_key(source)}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.parquet(path)
        return spark.read.parquet(path)


def write_fasta(reads: DataFrame, path: str) -> None:
    reads.select(F.concat(F.lit(">"), "name", F.lit("/"), "mate", F.lit("\n"), "seq").alias("value")).write.text(path)


def write_vcf(records: DataFrame, path: str, sample: str | None = None) -> None:
    """Header first, then records by position, in files that follow each other in name order.

    ``sample`` names a column with a sample's fields; ``format`` then says what they are.
    """
    cols = ["chrom", "pos1", "id", "ref", "alt", "qual", "filter", "info", *(["format", sample] if sample else [])]
    header = VCF_HEADER + (f"\tFORMAT\t{sample}" if sample else "")
    head = records.sparkSession.createDataFrame([(0, header)], "part int, value string").select("part", F.lit("").alias("chrom"), F.lit(0).cast("long").alias("pos1"), "value")
    body = records.select(F.lit(1).alias("part"), F.col("chrom").cast("string").alias("chrom"), "pos1", F.concat_ws("\t", *[F.col(c).cast("string") for c in cols]).alias("value"))
    head.unionByName(body).orderBy("part", "chrom", "pos1", "value").select("value").write.text(path)


def write_sam(reads: DataFrame, path: str) -> None:
    """Records by coordinate, last those that have no place: unmapped, and the mate too if there is one."""
    flag = lambda bit: F.col("flag").bitwiseAND(F.lit(bit)) != 0
    late = F.col("pos").isNull() | (flag(4) & (~flag(1) | flag(8)))
    sam_lines(reads).orderBy(late, "chrom", "pos", "value").select("value").write.text(path)


def write_model(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of a model as Parquet in a folder of its own."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_model(spark, path: str, names: list[str]) -> dict[str, DataFrame]:  # noqa: ANN001
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
