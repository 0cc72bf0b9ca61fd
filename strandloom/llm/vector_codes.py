"""Vectors compressed to codes of parts: product quantisation in whole numbers.

Each part of a vector has a codebook. In every round its entries, as a kd-tree, are
broadcast; tasks assign their parts by branch and bound and bring out sums of whole
numbers, one for each component of each entry, so the result doesn't depend on how
rows are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import checkpointed, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest whole component either way: squared distances of up to 64 components then fit in a long.
LARGEST = 1 << 27
#: Components that a task assigns at once, and entries in a leaf of a tree.
AT_ONCE, LEAF = 1 << 19, 2
#: A label with more than this part of all rows is hot; fewer than as many labels can be.
HOT = 64


class Tree:
    """A kd-tree over the entries of a codebook (entries x width whole numbers)."""

    def __init__(self, entries: np.ndarray, of: np.ndarray | None = None) -> None:
        self.of = np.arange(len(entries)) if of is None else of
        self.entries = entries
        self.sides: tuple[Tree, Tree] | None = None
        spread = entries.max(0) - entries.min(0)
        self.axis = int(spread.argmax())
        if len(entries) > LEAF and spread[self.axis] > 0:
            order = np.argsort(entries[:, self.axis], kind="stable")
            self.low, self.high = (int(entries[order[i], self.axis]) for i in (len(order) // 2 - 1, len(order) // 2))
            self.sides = tuple(Tree(entries[o], self.of[o]) for o in (order[: len(order) // 2], order[len(order) // 2 :]))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each point's nearest entry; of equally near ones the lowest index."""
        index = np.full(len(points), len(self.of), np.int64)
        best = np.full(len(points), np.iinfo(np.int64).max)
        self._visit(points, np.arange(len(points)), np.zeros(len(points), np.int64), {}, index, best)
        return index, best

    def _visit(self, points: np.ndarray, rows: np.ndarray, bound: np.ndarray, gaps: dict[int, np.ndarray], index: np.ndarray, best: np.ndarray) -> None:
        """Look at this node for ``rows``; ``bound`` is the least squared distance it can hold, made of ``gaps`` by axis."""
        if not len(rows):
            return
        if self.sides is None:
            for i, entry in zip(self.of, self.entries, strict=True):
                d = ((points[rows] - entry) ** 2).sum(1)
                nearer = (d < best[rows]) | ((d == best[rows]) & (i < index[rows]))
                index[rows[nearer]], best[rows[nearer]] = i, d[nearer]
            return
        x = points[rows, self.axis]
        first = 2 * x <= self.low + self.high
        near = [np.flatnonzero(first), np.flatnonzero(~first)]
        pick = lambda at: (rows[at], bound[at], {k: g[at] for k, g in gaps.items()})
        for side, at in zip(self.sides, near, strict=True):
            side._visit(points, *pick(at), index, best)
        for side, at, edge in ((self.sides[1], near[0], self.high), (self.sides[0], near[1], self.low)):
            gap = np.maximum(0, edge - x[at] if side is self.sides[1] else x[at] - edge) ** 2
            further = bound[at] + gap - (gaps[self.axis][at] if self.axis in gaps else 0)
            open_ = further <= best[rows[at]]  # an equal bound may hide a lower index
            at, gap, further = at[open_], gap[open_], further[open_]
            side._visit(points, rows[at], further, {k: g[at] for k, g in gaps.items()} | {self.axis: gap}, index, best)


def whole(lists: pa.Array, dims: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that stay, those of them with ``dims`` components, these as whole numbers, padded to PARTS x width)."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(lists)), size)
    kept = lists.is_valid().to_numpy(zero_copy_only=False).copy()
    kept[row[~np.isfinite(flat)]] = False
    usual = kept & (size == dims)
    with np.errstate(over="ignore"):
        numbers = np.clip(np.floor(flat[usual[row]] * SCALE), -LARGEST, LARGEST).astype(np.int64).reshape(int(usual.sum()), dims)
    padded = np.zeros((len(numbers), PARTS * width), np.int64)
    padded[:, :dims] = numbers
    return np.flatnonzero(kept), np.flatnonzero(usual), padded


def assigned(trees: list[Tree], vectors: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each part's nearest entry, vectors x parts."""
    found = [t.nearest(vectors[:, p * width : (p + 1) * width]) for p, t in enumerate(trees)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def gathered(frames: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """Batches joined to at most about AT_ONCE components."""
    held, n = [], 0
    for b in frames:
        if b.num_rows:
            held, n = [*held, b], n + b.num_rows
        if n * max(1, dims) >= AT_ONCE:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def prepared(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding"))


def learned(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, int]:
    """(codebooks as PARTS x entries x width whole numbers, number of components of a vector) of ``prepared`` vectors.

    The first entries are the vectors with the smallest ids (null ids last, equal ids by
    their components). Each round is a pass over the vectors and brings one sum and count
    for each component of each entry to the driver, however many vectors there are.
    """
    spark = vectors.sparkSession
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.col("embedding").isNotNull() & good)
    usual = kept.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    dims = usual["size"] if usual else 0
    width = max(1, -(-dims // PARTS))
    seeds = kept.where(F.size("embedding") == dims).orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").collect()
    _, _, first = whole(pa.array([s[0] for s in seeds], pa.list_(pa.float64())), dims, width)
    books = first.reshape(len(seeds), PARTS, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if seeds else 0):
        trees = spark.sparkContext.broadcast([Tree(b) for b in books])

        def sums(frames: Iterator[pa.RecordBatch], shape: tuple = books.shape, trees=trees) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            total, count = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
            for b in gathered(frames, dims):
                _, _, points = whole(b.column(0), dims, width)
                index, _ = assigned(trees.value, points, width)
                for p in range(PARTS):
                    np.add.at(total[p], index[:, p], points[:, p * width : (p + 1) * width])
                    count[p] += np.bincount(index[:, p], minlength=shape[1])
            used = np.flatnonzero(np.repeat(count.ravel(), shape[2]))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.ravel()[used]), pa.array(np.repeat(count.ravel(), shape[2])[used])], names=["place", "total", "n"])

        part = vectors.select("embedding").mapInArrow(sums, "place long, total long, n long")
        for place, total, n in part.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")), F.sum("n")).collect():
            books.reshape(-1)[place] = int(total) // n
        trees.unpersist()
    return books, dims


def encoded(vectors: DataFrame, books: np.ndarray, dims: int) -> DataFrame:
    """vec_id, label, code, error of every ``prepared`` vector without null or non-finite components."""
    width = books.shape[2]
    trees = vectors.sparkSession.sparkContext.broadcast([Tree(b) for b in books] if books.shape[1] else [])
    label = dict(vectors.dtypes)["label"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(frames, dims):
            kept, usual, points = whole(b.column("embedding"), dims, width)
            code, error = np.full(b.num_rows, None, object), np.full(b.num_rows, None, object)
            if len(usual):
                index, distance = assigned(trees.value, points, width)
                code[usual], error[usual] = [bytes(x).hex() for x in index.astype(np.uint8)], distance.sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(kept), b.column(1).take(kept), pa.array(code[kept], pa.string()), pa.array(error[kept], pa.int64())], names=["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error: the errors of all rows with the same label, nulls together.

    Labels that hold more than 1 / HOT of the rows are joined by broadcast, as fewer than
    HOT labels can be so large; no key of the other join holds more.
    """
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"), F.count(F.lit(1)).alias("n"))
    most = coded.count() // HOT
    same = F.col("label").eqNullSafe(F.col("of"))
    hot, cold = (F.broadcast(sums.where(F.col("n") > most)), sums.where(F.col("n") <= most))
    both = coded.join(hot, same).unionByName(coded.join(hot, same, "left_anti").join(cold, same), allowMissingColumns=True)
    return both.select("vec_id", "code", "error", "label_error")


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of ``vectors`` (vec_id, embedding, label).

    Rows whose vector is null or has a null or non-finite component are dropped. Components
    count as floor(4096 x), within 2^27 either way. Vectors have the most frequent length (of
    equally frequent ones the longest), filled up with zeros to equal parts; one of another
    length stays with null code and error. Fewer vectors than ``entries`` give codebooks of
    as many entries. Rows with equal ids each have their result; null ids come after all
    others. Other columns are ignored; an empty table gives an empty result.
    """
    rows = prepared(vectors)
    books, dims = learned(rows, entries, rounds)
    whole_width = books.shape[2] if dims else 0
    text = ",".join(map(str, books[:, :, :whole_width].ravel().tolist()))
    coded = checkpointed(encoded(rows, books, dims))
    return with_label_error(coded).withColumn("codebooks_sha256", F.lit(hashlib.sha256(text.encode()).hexdigest()))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _assignment(k: int) -> str:
    """CTEs of the k-th assignment and, from it, of the next codebooks."""
    return f"""
d{k} AS MATERIALIZED (SELECT r.vec_id, r.part, c.entry, list_sum(list_transform(list_zip(r.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist FROM parts r JOIN c{k} c ON c.part = r.part),
a{k} AS MATERIALIZED (SELECT vec_id, part, (arg_min(entry, dist * {ENTRIES} + entry))::BIGINT AS entry, min(dist) AS dist FROM d{k} GROUP BY ALL),
m{k} AS (SELECT a.part, a.entry, i, CAST(floor(sum(p.v[i]) / count(*)) AS BIGINT) AS x FROM a{k} a JOIN parts p ON p.vec_id = a.vec_id AND p.part = a.part, unnest(range(1, len(p.v) + 1)) t(i) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(n.v, c.v) AS v FROM c{k} c LEFT JOIN (SELECT part, entry, list(x ORDER BY i) AS v FROM m{k} GROUP BY ALL) n ON n.part = c.part AND n.entry = c.entry)"""


ORACLE_SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS v FROM kept, range({PARTS}) t(part)),
c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
{",".join(_assignment(k) for k in range(ROUNDS + 1))},
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded c JOIN kept k ON k.vec_id = c.vec_id CROSS JOIN books
"""
