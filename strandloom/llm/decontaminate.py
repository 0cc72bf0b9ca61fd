"""Benchmark decontamination by spaced seeds.

A mask keeps some token positions of a stretch and ignores the others, so a hash of the
kept ones survives substitutions at the ignored ones. Hashes of all stretches of the
test items are joined with those of the training texts; around every hit, item and
text are laid side by side and the overlap is accepted if a window of WINDOW tokens
agrees in at least AGREE of its places.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import batches, bounded_batches, filtered, id_and_text, table

#: Masks: 1 keeps a token, 0 ignores it. Each has six kept tokens.
MASKS = ("11011011", "1101001011", "11100010011")
WINDOW, AGREE = 13, 0.8
#: Items shorter than the shortest mask are looked for whole and unchanged.
WHOLE = min(map(len, MASKS))
#: Items shorter than this are looked for by masks of their own, which all substitutions that AGREE allows leave a hit.
LONG = 12
#: Bytes of benchmark text that are hashed and sent out in one pass over the documents.
PASS_BYTES = 8_000_000
DIVIDE = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))
FILTER_BITS = 20


def tokens(text: str) -> np.ndarray:
    """Hashes of the lower-cased words (runs of letters, digits and non-ASCII signs)."""
    ws = text.lower().encode().translate(DIVIDE).split()
    return np.fromiter(map(zlib.crc32, ws), np.uint64, len(ws))


def factors(n: int) -> np.ndarray:
    """Odd multipliers, one for each kept place."""
    return np.random.default_rng(99).integers(1, 1 << 62, 256, dtype=np.uint64)[:n] * np.uint64(2) + np.uint64(1)


def seeds(tok: np.ndarray, kept: list[int]) -> np.ndarray:
    """Hash of the kept places of the stretch that begins at each token."""
    n = len(tok) - kept[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for place, f in zip(kept, factors(len(kept)), strict=True):
        x = (tok[place : place + n] + np.uint64(place + 1)) * f
        out += x ^ (x >> np.uint64(29))
    return out * np.uint64(0x9E3779B97F4A7C15)


def substitutions(n: int) -> int:
    """Tokens of an item of ``n`` tokens that may differ."""
    return max(k for k in range(n + 1) if n - k >= AGREE * n) if n >= WHOLE else 0


def own_masks(n: int) -> list[list[int]]:
    """Kept places of an item of ``n`` tokens: of two parts more than tokens may differ, each choice of two that stay whole."""
    wrong = substitutions(n)
    if not wrong:
        return [list(range(n))]
    parts = np.array_split(np.arange(n), wrong + 2)
    return [np.concatenate(c).tolist() for c in combinations(parts, 2)]


def layouts(lengths: set[int]) -> list[tuple[list[int], int | None]]:
    """(kept places, length of the items they are for) of the masks (None: LONG and more tokens) and of shorter items."""
    return [([i for i, c in enumerate(m) if c == "1"], None) for m in MASKS] + [(kept, n) for n in sorted(lengths) for kept in own_masks(n)]


@dataclass
class Index:
    """Sorted seed hashes of the items of one pass, with the places they stand for."""

    items: list[tuple[int | None, np.ndarray]]
    kept: list[list[int]]
    hashes: list[np.ndarray]
    item: list[np.ndarray]
    place: list[np.ndarray]
    sieve: list[np.ndarray]

    @classmethod
    def of(cls, items: list[tuple[int | None, str]]) -> Index:
        known = [(i, tokens(t)) for i, t in items]
        plan = layouts({len(t) for _, t in known if 0 < len(t) < LONG})
        out = cls(known, [kept for kept, _ in plan], [], [], [], [])
        for kept, of in plan:
            h = [seeds(t, kept)[: 1 if of else None] if (len(t) >= LONG if of is None else len(t) == of) else np.empty(0, np.uint64) for _, t in known]
            size = np.array([len(x) for x in h], np.int64)
            hashes = np.concatenate(h) if h else np.empty(0, np.uint64)
            order = np.argsort(hashes, kind="stable")
            out.hashes.append(hashes[order])
            out.item.append(np.repeat(np.arange(len(known)), size)[order])
            out.place.append(np.concatenate([np.arange(n) for n in size])[order] if len(size) else np.empty(0, np.int64))
            sieve = np.zeros(1 << FILTER_BITS, bool)
            sieve[hashes >> np.uint64(64 - FILTER_BITS)] = True
            out.sieve.append(sieve)
        return out

    def hits(self, tok: np.ndarray) -> set[tuple[int, int]]:
        """(item, text place of its first token) of every seed in common."""
        found: set[tuple[int, int]] = set()
        for kept, hashes, item, place, sieve in zip(self.kept, self.hashes, self.item, self.place, self.sieve, strict=True):
            h = seeds(tok, kept)
            at = np.flatnonzero(sieve[h >> np.uint64(64 - FILTER_BITS)])
            lo = np.searchsorted(hashes, h[at], side="left")
            hi = np.searchsorted(hashes, h[at], side="right")
            for t, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                found.update(zip(item[a:b].tolist(), (t - place[a:b]).tolist(), strict=True))
        return found

    def overlaps(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item id, first token in the text, tokens compared, tokens that agree) of the best overlap of each item."""
        tok = tokens(text)
        best: dict[int, tuple[int, int, int]] = {}
        for k, shift in self.hits(tok):
            item = self.items[k][1]
            first, last = max(0, -shift), min(len(item), len(tok) - shift)
            same = item[first:last] == tok[first + shift : last + shift]
            width = min(WINDOW, len(item))
            if len(same) < width:
                continue
            run = np.concatenate(([0], np.cumsum(same)))
            most = int((run[width:] - run[:-width]).max())
            if most >= (AGREE * width if len(item) >= WHOLE else width):
                now = (int(run[-1]), -(first + shift), len(same))
                best[k] = max(best.get(k, now), now)
        return [(self.items[k][0], -begin, n, agree) for k, (agree, begin, n) in sorted(best.items())]


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_token, n_tokens, n_agree for each text and each test item it overlaps.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. Null and empty texts
    or items overlap nothing; items of fewer than WHOLE tokens must stand whole and
    unchanged in the text. Repeated documents and repeated items give repeated rows;
    null ids stay null; without documents or items there are no rows. Other columns are
    ignored. The distinct items go out in passes of PASS_BYTES, so any size of the
    benchmark fits; a join gives each its ids.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = keyed_items(benchmark)
    out = None
    for index in indexes(items):
        shared = spark.sparkContext.broadcast(index)

        def run(frames: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for ids, texts in batches(frames):
                found = [(doc, *o) for doc, t in zip(ids.to_pylist(), texts, strict=True) for o in shared.value.overlaps(t)]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(5)], names=["doc_id", "item", "first_token", "n_tokens", "n_agree"])

        now = id_and_text(docs).mapInArrow(run, "doc_id long, item long, first_token long, n_tokens long, n_agree long")
        out = now if out is None else out.unionByName(now)
    return out.join(items.select("item", "item_id"), "item").select("doc_id", "item_id", "first_token", "n_tokens", "n_agree")


def keyed_items(benchmark: DataFrame) -> DataFrame:
    """item_id, text and ``item``, a hash of the text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return items.withColumn("item", F.xxhash64("text"))


def indexes(items: DataFrame) -> Iterator[Index]:
    """Indexes of the distinct items (``keyed_items``), each of about PASS_BYTES of text."""
    distinct = items.groupBy("item").agg(F.min("text").alias("text"))
    passes = (distinct.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PASS_BYTES + 1
    for k in range(passes):
        part = distinct if passes == 1 else distinct.where(F.pmod("item", F.lit(passes)) == k)
        yield Index.of(sorted((r["item"], r["text"]) for r in part.collect()))  # bounded by PASS_BYTES, as no item is there twice


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose texts overlap no test item.

    Null and empty texts stay, repeated rows go or stay together, null ids and columns
    of any name stay; an empty table gives nothing, an empty benchmark takes nothing.
    """
    for index in indexes(keyed_items(benchmark)):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = filtered(docs, lambda texts, shared=shared: [not shared.value.overlaps(t) for t in texts])
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
