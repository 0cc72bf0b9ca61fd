"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records per Arrow batch: bounds a worker's memory when single texts are long.
ARROW_RECORDS = 512
#: Bytes of the longest text that a model learns from (all texts are scored): bounds what a sample brings to the driver.
LEARN_BYTES = 65_536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark alone (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches to ARROW_RECORDS rows for this session, unless they are smaller."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_RECORDS:
        spark.conf.set(key, str(ARROW_RECORDS))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the cluster's shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset and
    Spark runs in one process (tests) a temporary folder takes its place.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; a null text counts as empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def fold(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo: the split between learning and held-out rows."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus, F.lit(0))


def hash_share(seed: int, *cols: str) -> Column:
    """A uniform number in [0, 1) that depends on the columns and the seed only."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 31)) / F.lit(float(1 << 31))


def learnable() -> Column:
    """Whether a text is short enough to learn from."""
    return F.octet_length("text") <= LEARN_BYTES


def sampled_texts(docs: DataFrame, expected: int, seed: int, where: Column | None = None) -> DataFrame:
    """The distinct texts of about ``expected`` rows, of at most LEARN_BYTES each, as column ``text``.

    Rows are chosen by a hash of id and text, so neither the input's layout nor its order
    matters; a text that many rows share is there once.
    """
    rows = id_and_text(docs).where(learnable())
    rows = rows if where is None else rows.where(where)
    n = max(1, rows.count())
    return rows.where(hash_share(seed, "doc_id", "text") < F.lit(expected / n)).groupBy(F.xxhash64("text").alias("of")).agg(F.min("text").alias("text")).select("text")


def unused(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores as no column of ``taken`` has."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def filtered(docs: DataFrame, keep: Callable[[list[str]], list[bool]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose texts (null: empty) ``keep`` says yes to."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            if b.num_rows:
                yield b.filter(pa.array(keep([t or "" for t in b.column(at).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of each non-empty Arrow batch of ``id_and_text``."""
    for b in frames:
        if b.num_rows:
            yield b.column(0), b.column(1).to_pylist()
