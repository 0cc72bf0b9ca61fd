"""Labelled documents, all or a bounded sample, with features computed on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import batches, bounded_batches, checkpointed, fold, hash_share, id_and_text, learnable

SAMPLE_SEED = 2024
#: Rows of features that are summed at once, and that a task has at least.
ROWS_AT_ONCE = 4096


def known_labels(labels: DataFrame, label: str, modulus: int, held: int) -> DataFrame:
    """doc_id and label (0 or 1; of an id's labels the largest) of the ids that may be learned from."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(modulus) != held))
    return known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def every_labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, features: Callable[[str], np.ndarray]) -> DataFrame:
    """label and features (float32, as bytes) of every row of ``docs`` that has a label and isn't held out.

    Features are computed where the texts are, so the join moves them and no text, and
    labels need not fit in a broadcast. The result is checkpointed, in partitions of like
    size, and read by tasks of ROWS_AT_ONCE rows at least, since models pass over it often.
    """
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches(frames):
            yield pa.RecordBatch.from_arrays([ids, pa.array([features(t).astype("<f4").tobytes() for t in texts], pa.binary())], names=["doc_id", "features"])

    rows = id_and_text(docs).where(F.col("doc_id").isNotNull() & (fold(modulus) != held))
    found = rows.mapInArrow(run, "doc_id long, features binary")
    known = known_labels(labels, label, modulus, held)
    kept = checkpointed(found.join(known, "doc_id").select("label", "features").hint("rebalance"))
    return kept.coalesce(max(1, -(-kept.count() // ROWS_AT_ONCE)))


def added(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, sums of their rows), ascending."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(rows[order], starts, 0) if len(keys) else rows[:0]


def totals(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals by key of what ``part`` makes of (features, labels) of ``every_labelled``'s rows.

    ``part`` returns keys and rows of ``width`` + 1 numbers. Tasks add up their own, a
    shuffle by key brings those of all tasks together; one row a key comes to the driver.
    """
    schema = "key long, sums array<double>"
    empty = np.zeros(0, np.int64), np.zeros((0, width + 1))

    def batch(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * (width + 1), pa.array(sums.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(keys), lists], names=["key", "sums"])

    def both(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return added(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))

    def parts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto, held, n = empty, [], 0
        for b in frames:
            held, n = [*held, b], n + b.num_rows
            if n >= ROWS_AT_ONCE:
                upto, held, n = both(upto, part(*arrays(held))), [], 0
        yield batch(*(both(upto, part(*arrays(held))) if n else upto))

    def merged(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto = empty
        for b in frames:
            upto = both(upto, (b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, width + 1)))
        yield batch(*upto)

    got = rows.mapInArrow(parts, schema).repartition("key").mapInArrow(merged, schema).toArrow().combine_chunks()
    sums = np.array(got.column(1).to_pylist(), np.float64).reshape(-1, width + 1)
    return added(got.column(0).to_numpy().astype(np.int64), sums)


def arrays(frames: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of batches of ``every_labelled``'s rows."""
    label = np.concatenate([b.column(0).to_numpy() for b in frames]).astype(np.int64)
    raw = b"".join(x for b in frames for x in b.column(1).to_pylist())
    return np.frombuffer(raw, "<f4").reshape(len(label), -1).astype(np.float64), label


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, each: int, features: Callable[[str], np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Features and labels of about ``each`` documents of each class, and both classes' true shares.

    Only labels whose id's crc32 modulo ``modulus`` is not ``held`` are read. A row is
    in the sample if a hash of its id is below the share that gives ``each`` rows of its
    class, so the sample doesn't depend on the input's layout and its size on no table's.
    Of rows that share an id the least text counts, texts over LEARN_BYTES don't. Without
    labels the sample is empty and the shares are equal.
    """
    bounded_batches(docs.sparkSession)
    known = known_labels(labels, label, modulus, held)
    n = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, F.lit(each / max(1, n.get(1, 0)))).otherwise(F.lit(each / max(1, n.get(0, 0))))
    sample = known.where(hash_share(SAMPLE_SEED, "doc_id") < share).withColumnRenamed("doc_id", "sample_id")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            found = [features(t).astype("<f4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["label", "features"])

    # the sample is bounded by ``each``, so it may be sent to all executors
    texts = id_and_text(docs).where(learnable()).join(F.broadcast(sample), F.col("doc_id") == F.col("sample_id"))
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("label", "text")
    rows = texts.mapInArrow(run, "label int, features binary").collect()
    rows.sort(key=lambda r: (r[0], bytes(r[1])))  # the order of tasks must not matter
    total = max(1, sum(n.values()))
    shares = np.array([n.get(0, 0) / total, n.get(1, 0) / total]) if n else np.array([0.5, 0.5])
    return [np.frombuffer(r[1], "<f4") for r in rows], np.array([r[0] for r in rows], np.int64), shares


def scored(docs: DataFrame, modulus: int, held: int, threshold: float, score: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches(frames):
            s = score(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    found = id_and_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return found.select("doc_id", (fold(modulus) == held).alias("held_out"), "score", "predicted")
