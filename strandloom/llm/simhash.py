"""SimHash near-duplicates by pivot distance tables.

Distinct fingerprints are dealt into blocks that keep every pair within the radius
together: of b bands of 64 bits at most ``radius`` differ, so two such fingerprints
agree on some b - radius whole bands (the block's key). In a block, the table of
Hamming distances to fixed reference fingerprints discards pairs whose largest
coordinate difference exceeds the radius, and the survivors are verified. A block
gives links that connect what belongs together, never all its pairs; crowded blocks
are split into pairs of slices that separate tasks compare.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import batches, bounded_batches, checkpointed, id_and_text, table, unused

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Reference fingerprints of the distance table.
PIVOTS = 16
#: Fingerprints of a crowded block that one slice holds.
SLICE = 4096
#: Partners by chance that a row may have before more bands are used.
CHANCE = 100
#: Tasks that one component's fingerprints are spread over when they get its least id.
SALTS = 16
#: A-Z to a-z and nothing else; the signs between words.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text: str) -> list[bytes]:
    """Words between the signs 0x20 and 0x09-0x0D, A-Z lower-cased."""
    return text.encode().translate(LOWER).split()


def shingle_hashes(ws: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words joined by a space, repeats included."""
    if not ws:
        return np.empty(0, "<u8")
    whole, one = b" ".join(ws), xxhash.xxh64_intdigest
    if len(ws) <= size:
        return np.array([one(whole, SEED)], "<u8")
    begin = np.zeros(len(ws) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1, out=begin[1:])
    spans = zip(begin[: len(ws) - size + 1].tolist(), (begin[size:] - 1).tolist(), strict=True)
    return np.fromiter((one(whole[a:b], SEED) for a, b in spans), "<u8", len(ws) - size + 1)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bytes (low byte first) of the bits that over half the hashes have; none: zero.

    ``hashes`` may have several 64-bit words a row; the result has as many.
    """
    rows = hashes.reshape(len(hashes), -1).view(np.uint8)
    total = np.zeros(rows.shape[1] * 8 or 64, np.int64)
    for at in range(0, len(rows), 1 << 16):  # long texts, in steps
        total += np.unpackbits(rows[at : at + (1 << 16)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(total * 2 > len(rows), bitorder="little")


def fingerprint(text: str, size: int = SHINGLE) -> int:
    h = shingle_hashes(words(text), size)
    return int(majority(h).view("<u8")[0]) if len(h) else 0


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (long) of every row; null and empty texts have fingerprint zero."""
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches(frames):
            fps = np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(fps)], names=["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def references(k: int = PIVOTS, seed: int = 7) -> np.ndarray:
    """The reference fingerprints: always the same for a seed."""
    return np.random.default_rng(seed).integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def distance_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each reference, one row a reference."""
    return np.bitwise_count(fps[None, :] ^ references()[:, None]).astype(np.int16)


class Forest:
    """Which members of a block are connected so far."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            r, s = self.root(i), self.root(j)
            if r != s:
                self.up[max(r, s)] = min(r, s)
                self.edges.append((i, j))

    def roots(self) -> np.ndarray:
        up = self.up
        while (up[up] != up).any():
            up = up[up]
        self.up = up
        return up


def connect(fps: np.ndarray, dist: np.ndarray, left: np.ndarray, right: np.ndarray | None, radius: int, same: Callable | None = None) -> list[tuple[int, int]]:
    """Links that connect all pairs of ``left`` with ``right`` (with itself if None) within the radius.

    ``left`` and ``right`` index ``fps``; ``dist`` is its distance table. Pairs that are
    connected already are passed over, which keeps tight crowds far from quadratic.
    ``same(i, j)`` may refuse verified pairs.
    """
    both = left if right is None else np.concatenate((left, right))
    side = np.zeros(len(both), bool) if right is None else np.arange(len(both)) >= len(left)
    forest = Forest(len(both))

    def verify(i: np.ndarray, j: np.ndarray) -> None:
        near = np.bitwise_count(fps[both[i]] ^ fps[both[j]]) <= radius
        i, j = i[near], j[near]
        if same is not None and len(i):
            ok = same(both[i], both[j])
            i, j = i[ok], j[ok]
        forest.join(i, j)

    def discard(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for row in dist:
            ok = np.abs(row[both[i]] - row[both[j]]) <= radius
            if not ok.all():
                i, j = i[ok], j[ok]
        return i, j

    n = len(both)
    if n <= 64:
        i, j = np.triu_indices(n, 1)
        if right is not None:
            cross = side[i] != side[j]
            i, j = i[cross], j[cross]
        verify(*discard(i, j))
        return [(int(both[i]), int(both[j])) for i, j in forest.edges]
    # members themselves as pivots: whatever is near one of them is connected by it
    order = np.argsort(dist[0][both], kind="stable")
    for pivot in order[np.linspace(0, n - 1, 24).astype(int)]:
        rest = np.flatnonzero((side != side[pivot]) if right is not None else np.arange(n) != pivot)
        verify(*discard(np.full(len(rest), pivot), rest))
    key = dist[0][both][order]
    step = max(1, 2_000_000 // n)
    for at in range(0, n, step):
        rows = order[at : at + step]
        end = np.searchsorted(key, key[min(n, at + step) - 1] + radius, side="right")
        others = order[at:end]
        up = forest.roots()
        open_ = up[rows][:, None] != up[others][None, :]
        if right is not None:
            open_ &= side[rows][:, None] != side[others][None, :]
        i, j = np.nonzero(open_)
        later = j > i  # others begins at the same place as rows
        verify(*discard(rows[i[later]], others[j[later]]))
    return [(int(both[i]), int(both[j])) for i, j in forest.edges]


def bands_for(n: int, radius: int = RADIUS) -> int:
    """The fewest bands, two more than the radius at least, whose blocks give a row at most CHANCE partners by chance."""
    for b in range(radius + 2, 2 * radius + 6):
        tables, bits = len(list(combinations(range(b), b - radius))), 64 * (b - radius) / b
        if tables * n / 2**bits <= CHANCE:
            break
    return b


def block_keys(bands: int, radius: int) -> list[tuple[int, int]]:
    """(table, mask) of every choice of bands that must agree."""
    cut = np.linspace(0, 64, bands + 1).astype(int)
    masks = [((1 << int(e)) - 1) ^ ((1 << int(s)) - 1) for s, e in zip(cut[:-1], cut[1:], strict=True)]
    return [(t, sum(c)) for t, c in enumerate(combinations(masks, bands - radius))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, fps: list[str], radius: int = RADIUS, check: str | None = None, most: int = 0) -> DataFrame:
    """Links (a, b) between values of ``nodes.node`` (distinct longs) within the radius in any of ``fps``.

    They connect all that belong together, but aren't all pairs. ``check`` names a binary
    column of a longer fingerprint, of which linked nodes may differ in at most ``most`` bits.
    """
    spark = nodes.sparkSession
    bands = bands_for(nodes.count(), radius)
    keys = block_keys(bands, radius)
    block = lambda t, fp, m: F.struct(F.lit(t).alias("t"), F.col(fp).bitwiseAND(F.lit(signed(m))).alias("key"))
    blocks = F.array(*[block(k * len(keys) + t, fp, m) for k, fp in enumerate(fps) for t, m in keys])
    dealt = nodes.select("node", F.explode(blocks).alias("block")).select("node", "block.*")
    crowd = dealt.groupBy("t", "key").count().where(F.col("count") > 1).select("t", "key", F.ceil(F.col("count") / SLICE).cast("int").alias("slices"))
    # only what shares a block goes on, and gets its fingerprints back
    shared = dealt.join(crowd, ["t", "key"]).join(nodes, "node")
    fp = F.element_at(F.array(*fps), F.floor(F.col("t") / len(keys)).cast("int") + 1)
    held = [check] if check else []
    # a crowded block of c slices becomes the c (c + 1) / 2 pairs of its slices
    cells = (
        shared.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("slices")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select("node", fp.alias("fp"), *held, "t", "key", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(n, "t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi")

    def cuts(t: pa.Table) -> list[int]:
        """Where a new cell begins."""
        cols = [t.column(c).to_numpy() for c in ("t", "key", "lo", "hi")]
        return (np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1).tolist()

    def compare(t: pa.Table) -> pa.RecordBatch:
        node, lo, hi, own = (t.column(c).to_numpy() for c in ("node", "lo", "hi", "own"))
        found: list[tuple[int, int]] = []
        fps = t.column("fp").to_numpy().view(np.uint64)
        dist = distance_table(fps)
        same = None
        if check:
            long = np.frombuffer(b"".join(t.column(check).to_pylist()), np.uint64).reshape(len(fps), -1)
            same = lambda i, j: np.bitwise_count(long[i] ^ long[j]).sum(1, dtype=np.int64) <= most
        edge = cuts(t)
        for s, e in zip([0, *edge], [*edge, len(fps)], strict=True):
            idx = np.arange(s, e)
            found += connect(fps, dist, idx, None, radius, same) if lo[s] == hi[s] else connect(fps, dist, idx[own[s:e] == lo[s]], idx[own[s:e] == hi[s]], radius, same)
        at = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(node[at[:, 0]]), pa.array(node[at[:, 1]])], names=["a", "b"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_back: list[pa.RecordBatch] = []
        rows = 0
        for b in frames:
            if not b.num_rows:
                continue
            held_back.append(b)
            rows += b.num_rows
            if rows >= 50_000:
                now = pa.Table.from_batches(held_back).combine_chunks()
                edge = cuts(now)
                if edge:  # the last cell may go on in the next batch
                    yield compare(now.slice(0, edge[-1]).combine_chunks())
                    rest = now.slice(edge[-1]).combine_chunks()
                    held_back, rows = rest.to_batches(), rest.num_rows
        if held_back:
            yield compare(pa.Table.from_batches(held_back).combine_chunks())

    return cells.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node of ``edges`` (a, b): label is the least node reachable.

    Alternates hooking neighbours onto the least one near and onto the least larger one,
    so the number of rounds grows with the logarithm of a chain's length; each round is
    written to the checkpoint folder.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = checkpointed(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        # every larger neighbour goes to the least of the node and its neighbours
        near = both(now).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both(now).where(F.col("b") > F.col("a")).join(near, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # every smaller neighbour, and the node, go to the least of the smaller ones
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = checkpointed(small.where(F.col("a") != F.col("b")).distinct())
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        before = state


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of ``docs``.

    component_id is the least doc_id reachable over links of at most ``radius`` bits.
    Null and empty texts have fingerprint zero and link like others. Rows with a null
    id take part and keep it; a component of such rows alone has a null component_id.
    Repeated rows give repeated results; an empty table an empty one.
    """
    fps = checkpointed(fingerprints(docs, size))
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    label = components(links(nodes.withColumn("node", F.col("fp")), ["fp"], radius))
    linked = checkpointed(label.join(nodes, F.col("node") == F.col("fp")).select("fp", "label", "least"))
    # a component may hold most fingerprints, so its least id goes to SALTS tasks; fingerprints without links need none
    least = linked.groupBy("label").agg(F.min("least").alias("found")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = linked.select("fp", "label", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt"))
    known = salted.join(least, ["label", "salt"]).select(F.col("fp").alias("of"), "found", F.lit(True).alias("is_linked"))
    of_fp = nodes.join(known, F.col("fp") == F.col("of"), "left").select("fp", F.when(F.col("is_linked"), F.col("found")).otherwise(F.col("least")).alias("component_id"))
    return fps.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Words of a shingle; two sets of shingles are near-duplicates from the likeness (Jaccard) ALIKE / 5 on.
CONFIRMING, ALIKE = 5, 4
#: 64-bit words of a wide fingerprint, and the bits above which a pair isn't looked at: at likeness 0.8 about 39 differ
#: (deviation 5.7), of unlike texts 128; of sets under SMALL (at 5 and 4 shingles 48 differ, deviation 6.2) more may.
WIDE_WORDS, LOOSE_BITS, SMALL, SMALL_LOOSE_BITS = 4, 72, 16, 88
#: Documents whose shingles tell which ones are common, and shingles that count as common; they only order the shingles.
ORDER_DOCS, ORDER_LEAST, ORDER_MOST = 5_000, 3, 200_000
#: Members of a block whose pairs are made together with those of other blocks.
FEW = 64
#: Slices of a group that are compared pair by pair; larger groups are compared block by block.
MOST_SLICES = 16
#: Words of bitmaps that are compared at a time, and bits of the longest bitmap.
STEP_WORDS, MOST_BITS = 4_000_000, 1 << 17
#: Slots of the sieve that spares most texts a shuffle; a full one only spares none.
SIEVE = 1 << 21


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """``k`` independent 64-bit hashes made of each hash."""
    out = hashes[:, None] + np.arange(1, k + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return out ^ (out >> np.uint64(31))


def shingle_set(text: str) -> np.ndarray:
    """The distinct shingles, sorted; of texts without words: zero alone."""
    ws = words(text)
    return np.unique(shingle_hashes(ws, CONFIRMING)) if ws else np.zeros(1, np.uint64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have the likeness ALIKE / 5 or more; exact."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * 5 >= (len(a) + len(b) - common) * ALIKE


def prefix(s: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones first, of which two sets with the likeness ALIKE / 5 share one.

    Such sets share at least ALIKE / 5 of each, so the first n - ceil(n ALIKE / 5) + 1 of both in any one order meet.
    """
    first = len(s) - (len(s) * ALIKE + 4) // 5 + 1
    if not len(common):
        return s[:first]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    return s[np.argsort(np.where(common[at] == s, counts[at], 0), kind="stable")[:first]]


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that many of ORDER_DOCS documents have, and their counts."""
    total = texts.count()
    part = texts if total <= ORDER_DOCS else texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(ORDER_DOCS / total * (1 << 30)))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ts in batches(frames):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_set(t) for t in ts]).view(np.int64))], names=["key"])

    counted = part.mapInArrow(run, "key long").groupBy("key").count().where(F.col("count") >= ORDER_LEAST)
    rows = counted.orderBy(F.desc("count"), "key").limit(ORDER_MOST).toPandas()
    common, counts = rows["key"].to_numpy(np.int64).view(np.uint64), rows["count"].to_numpy(np.int64)
    order = np.argsort(common)
    return common[order], counts[order]


def block_pairs(cell: np.ndarray, side: np.ndarray, label: np.ndarray, size: np.ndarray, wide: np.ndarray, every: bool, take: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Gives ``take`` the pairs of rows of one cell that may be alike, of unlike labels; rows are sorted by cell and size.

    ``side`` is -1 in cells that are compared with themselves, else pairs have unlike
    sides. ``every``: all of them, else each row with the next and with one pivot.
    """

    def look(i: np.ndarray, j: np.ndarray, dist: np.ndarray | None = None) -> None:
        lo, hi = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        ok = (lo * 5 >= hi * ALIKE) & (label[i] != label[j]) & ((side[i] < 0) | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        most = np.where(np.minimum(size[i], size[j]) < SMALL, SMALL_LOOSE_BITS, LOOSE_BITS)
        for row in () if dist is None else dist:
            ok = np.abs(row[i] - row[j]) <= most
            if not ok.all():
                i, j, most = i[ok], j[ok], most[ok]
        ok = np.bitwise_count(wide[i] ^ wide[j]).sum(1, dtype=np.int64) <= most
        if ok.any():
            take(i[ok], j[ok])

    n = len(cell)
    begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if n else np.empty(0, np.int64)
    long = np.diff(np.r_[begin, n])
    first, members = np.repeat(begin, long), np.repeat(long, long)
    few = np.flatnonzero(members <= FEW) if every else np.arange(n)
    for d in range(1, FEW if every else 2):
        i = few[few + d < n]
        i = i[cell[i] == cell[i + d]]
        if not len(i):
            break
        look(i, i + d)
    if not every:
        look(first[first != np.arange(n)], np.flatnonzero(first != np.arange(n)))
    for s, m in zip(begin[long > FEW].tolist(), long[long > FEW].tolist(), strict=True):
        rows = np.arange(s, s + m)
        if not every:  # the member nearest to what most members have
            bits = np.unpackbits(wide[rows].view(np.uint8), axis=1)
            centre = s + int((bits != (bits.mean(0) > 0.5)).sum(1).argmin())
            look(np.full(m - 1, centre), rows[rows != centre])
            continue
        # members as references of the pivot table
        dist = np.zeros((PIVOTS, n), np.int16)
        for k, pivot in enumerate(rows[np.linspace(0, m - 1, PIVOTS).astype(int)]):
            dist[k, rows] = np.bitwise_count(wide[rows] ^ wide[pivot]).sum(1, dtype=np.int16)
        end = np.searchsorted(size[rows] * ALIKE, size[rows] * 5, side="right") + s
        step = max(1, 1_000_000 // m)
        for at in range(s, s + m, step):
            to = min(s + m, at + step)
            i, j = np.nonzero(label[at:to, None] != label[None, at : end[to - 1 - s]])
            look(i[j > i] + at, j[j > i] + at, dist)


class Groups:
    """Which rows pairs connect, and which are in any pair; pairs come in arrays."""

    def __init__(self, n: int) -> None:
        self.root, self.paired = np.arange(n), np.zeros(n, bool)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        self.paired[i] = self.paired[j] = True
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sets as bitmaps of about eight bits a member: a member sets the bit that its hash names."""
    bits = 1 << min(MOST_BITS, max(1024, 8 * max(map(len, sets)))).bit_length() - 1
    out = np.zeros((len(sets), bits), bool)
    for row, s in zip(out, sets, strict=True):
        row[s >> np.uint64(64 - (bits.bit_length() - 1))] = True
    return np.packbits(out, axis=1).view(np.uint64)


def exact_links(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect all pairs of sets with the likeness ALIKE / 5 or more, of unlike labels (and sides, if not -1).

    A bit that one set has and the other hasn't stands for a member that isn't shared, so
    the bitmaps tell the most that two sets can have in common; what this leaves is
    compared member by member, unless it is connected by then.
    """
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    sets, size, label, side = [sets[i] for i in order], size[order], label[order], side[order]
    forest = Forest(len(sets))
    forest.up = np.unique(label, return_index=True)[1][np.unique(label, return_inverse=True)[1]]
    # a long set would make all bitmaps long, so sets of about one length share them
    begin = 0
    maps: list[tuple[int, np.ndarray]] = []
    while begin < len(sets):
        to = int(np.searchsorted(size, 4 * size[begin], side="right"))
        end = int(np.searchsorted(size, 4 * size[begin] * 5 / ALIKE, side="right"))
        maps.append((to, bitmaps(sets[begin:end])))
        words = maps[-1][1]
        at = begin
        while at < to:
            last = int(np.searchsorted(size * ALIKE, size[at] * 5, side="right"))
            step = max(1, STEP_WORDS // (words.shape[1] * max(1, last - at)))
            step = min(step, to - at)
            last = int(np.searchsorted(size * ALIKE, size[at + step - 1] * 5, side="right"))
            up = forest.roots()
            i, j = np.nonzero((up[at : at + step, None] != up[None, at:last]) & ((side[at : at + step, None] < 0) | (side[at : at + step, None] != side[None, at:last])))
            i, j = i[j > i] + at, j[j > i] + at
            here = words[i - begin], words[j - begin]
            common = np.minimum(size[i] - np.bitwise_count(here[0] & ~here[1]).sum(1, dtype=np.int64), size[j] - np.bitwise_count(here[1] & ~here[0]).sum(1, dtype=np.int64))
            ok = common * 5 >= (size[i] + size[j] - common) * ALIKE
            for x, y in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                if forest.root(x) != forest.root(y) and alike(sets[x], sets[y]):
                    forest.join(np.array([x]), np.array([y]))
            at += step
        begin = to
    return [(int(order[i]), int(order[j])) for i, j in forest.edges]


def whole_cells(frames: Iterator[pa.RecordBatch], keys: list[str], most: int = 64_000_000) -> Iterator[pa.Table]:
    """Tables of whole cells (rows with equal ``keys``, which come together), of about 50,000 rows or ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for b in frames:
        if not b.num_rows:
            continue
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows >= 50_000 or size >= most:
            now = pa.Table.from_batches(held).combine_chunks()
            cut = np.flatnonzero(cell_edges(now, keys))
            if len(cut):  # the last cell may go on in the next batch
                yield now.slice(0, int(cut[-1]) + 1).combine_chunks()
                now = now.slice(int(cut[-1]) + 1).combine_chunks()
            held, rows, size = now.to_batches(), now.num_rows, now.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def cell_edges(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether a new cell begins after each row but the last."""
    cols = [t.column(c).to_numpy() for c in keys]
    return np.any([c[1:] != c[:-1] for c in cols], axis=0)


def shared_blocks(nodes: DataFrame) -> DataFrame:
    """key, node, size, wide, slices of each prefix shingle that several nodes have."""
    dealt = nodes.select("node", F.explode("keys").alias("key"))
    crowd = dealt.groupBy("key").count().where(F.col("count") > 1).select("key", F.ceil(F.col("count") / SLICE).cast("int").alias("slices"))
    return dealt.join(crowd, "key").join(nodes.select("node", "size", "wide"), "node")


def compared(shared: DataFrame, label: DataFrame | None) -> DataFrame:
    """What pairs of nodes in one block may be alike.

    Without ``label`` distinct pairs (a, b), for each node a few that may connect most.
    With it all pairs of unlike labels are looked at, but only their members come out, in
    proportion to the blocks' rows: key, lo, hi, own (the cell), node, label, and
    ``root``, the same node for all that such pairs connect in the cell.
    """
    every = label is not None
    labelled = shared.withColumn("label", F.col("node"))
    if every:
        labelled = shared.join(label.select(F.col("node"), F.col("label").alias("known")), "node", "left").withColumn("label", F.coalesce("known", "node"))
    cells = (
        labelled.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("slices")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select("node", "label", "size", "wide", "key", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    )
    n = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "size", "node")
    keys = ["key", "lo", "hi"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_cells(frames, keys):
            node, label, size, lo, hi, own = (t.column(c).to_numpy() for c in ("node", "label", "size", "lo", "hi", "own"))
            wide = np.frombuffer(b"".join(t.column("wide").to_pylist()), np.uint64).reshape(len(node), -1)
            cell, side = np.r_[0, np.cumsum(cell_edges(t, keys))], np.where(lo == hi, -1, own == lo)
            if every:
                groups = Groups(len(node))
                block_pairs(cell, side, label, size.astype(np.int64), wide, True, groups.join)
                out = t.select([*keys, "own", "node", "label"]).append_column("root", pa.array(node[groups.root]))
                yield from out.filter(pa.array(groups.paired)).combine_chunks().to_batches()
                continue
            found: list[np.ndarray] = []
            block_pairs(cell, side, label, size.astype(np.int64), wide, False, lambda i, j, node=node, found=found: found.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], 1)))
            pairs = np.unique(np.concatenate([np.empty((0, 2), np.int64), *found]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    if every:
        return cells.mapInArrow(run, "key int, lo int, hi int, own int, node long, label long, root long")
    return cells.mapInArrow(run, "a long, b long").distinct()


def with_nodes(rows: DataFrame, sieve: np.ndarray | None = None) -> DataFrame:
    """doc_id, node, text of each row, or of those in the sieve."""

    def named(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches(frames):
            node = np.array([xxhash.xxh64_intdigest(shingle_set(t).tobytes(), SEED) for t in texts], np.uint64).view(np.int64)
            out = pa.RecordBatch.from_arrays([ids, pa.array(node), pa.array(texts, pa.string())], names=["doc_id", "node", "text"])
            yield out if sieve is None else out.filter(pa.array(held.value[node % SIEVE]))

    held = None if sieve is None else rows.sparkSession.sparkContext.broadcast(sieve)
    return rows.mapInArrow(named, "doc_id long, node long, text string")


def texts_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text of the distinct ``nodes``."""
    slots = nodes.select(F.pmod("node", F.lit(SIEVE)).alias("slot")).distinct().toPandas()["slot"].to_numpy(np.int64)  # bounded by SIEVE
    sieve = np.zeros(SIEVE, bool)
    sieve[slots] = True
    return checkpointed(with_nodes(id_and_text(docs), sieve).select("node", "text").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")))


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts in ``docs`` have the likeness ALIKE / 5 or more, exactly."""
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs)
    of = lambda side: texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            sets: dict[int, np.ndarray] = {}
            keep = []
            for x, y, s, t in zip(*(b.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                for node, text in ((x, s), (y, t)):
                    if node not in sets:
                        sets[node] = shingle_set(text)
                keep.append(alike(sets[x], sets[y]))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def remaining(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that connect all nodes of ``members`` (``compared`` with labels) that are alike, exactly.

    What pairs connect over all cells is a group. A group's texts go to one task, or to
    those of its pairs of slices; a group of over MOST_SLICES slices stays in its blocks.
    """
    group = checkpointed(components(members.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    large = group.groupBy("label").count().where(F.col("count") > SLICE).select(F.col("label").alias("of"), F.ceil(F.col("count") / SLICE).cast("int").alias("slices"))
    placed = group.join(large, F.col("label") == F.col("of"), "left").select("node", F.col("label").alias("unit"), F.coalesce("slices", F.lit(1)).alias("slices"))
    placed = checkpointed(placed.join(members.select("node", "label").distinct(), "node"))
    sliced = (
        placed.where(F.col("slices") <= MOST_SLICES)
        .withColumn("own", F.pmod(F.xxhash64("node", F.lit(2)), F.col("slices")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select("node", "label", "unit", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    )
    in_blocks = members.join(placed.where(F.col("slices") > MOST_SLICES).select("node"), "node", "left_semi").select("node", "label", F.xxhash64("key").alias("unit"), "own", "lo", "hi")
    texts = texts_of(placed.select("node"), docs)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = sliced.unionByName(in_blocks).join(texts, "node").repartition(n, "unit", "lo", "hi").sortWithinPartitions("unit", "lo", "hi")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_cells(frames, ["unit", "lo", "hi"]):
            node, label, lo, hi, own = (t.column(c).to_numpy() for c in ("node", "label", "lo", "hi", "own"))
            side = np.where(lo == hi, -1, own == lo)
            edge = (np.flatnonzero(cell_edges(t, ["unit", "lo", "hi"])) + 1).tolist()
            links: list[tuple[int, int]] = []
            for s, e in zip([0, *edge], [*edge, len(node)], strict=True):
                sets = [shingle_set(x) for x in t.column("text").slice(s, e - s).to_pylist()]
                links += [(int(node[s + i]), int(node[s + j])) for i, j in exact_links(sets, label[s:e], side[s:e])]
            pairs = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return cells.mapInArrow(run, "a long, b long")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any more) without near-duplicates: of each group the row with the least doc_id.

    Two texts are near-duplicates if their sets of five-word shingles have the Jaccard
    likeness 0.8 or more, exactly; groups are what links connect. Pairs are proposed by
    an exact prefix filter: sets so alike share one of their first shingles, rare ones
    first. Pairs of one block pass a pivot table and a loose limit on wide fingerprints,
    and the sets themselves decide. Some pairs of each text go first; for the others the
    texts of each group that they connect come together, so that links leave a task, but
    never all pairs. What is connected already isn't compared again. Null and empty texts are one group; a null id comes before all others; of rows with the
    kept id and group one stays, that with the least text. All columns are kept.
    """
    bounded_batches(docs.sparkSession)
    order = docs.sparkSession.sparkContext.broadcast(common_shingles(id_and_text(docs)))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches(frames):
            sets = [shingle_set(t) for t in texts]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            wide = [majority(mixed(s, WIDE_WORDS)).tobytes() for s in sets]
            # half of each hash: by chance equal ones only make pairs that are discarded
            keys = [(prefix(s, *order.value) >> np.uint64(32)).astype(np.uint32).view(np.int32) for s in sets]
            ends = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
            size = pa.array([len(s) for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([ids, pa.array(node), size, pa.array(wide, pa.binary()), keys], names=["doc_id", "node", "size", "wide", "keys"])

    fps = checkpointed(id_and_text(docs).mapInArrow(run, "doc_id long, node long, size int, wide binary, keys array<int>"))
    nodes = fps.groupBy("node", "size", "wide").agg(F.any_value("keys").alias("keys"), F.min("doc_id").alias("least"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls"))
    nodes = checkpointed(nodes)
    shared = checkpointed(shared_blocks(nodes))
    found = checkpointed(confirmed(checkpointed(compared(shared, None)), docs))
    label = components(found.unionByName(remaining(checkpointed(compared(shared, components(found))), docs)))
    grouped = checkpointed(nodes.join(label.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", F.coalesce("label", "node").alias("label"), "least", "nulls"))
    kept = grouped.groupBy("label").agg(F.when(F.sum("nulls") > 0, F.lit(None).cast("long")).otherwise(F.min("least")).alias("kept_id"))
    # ``docs`` may have any column names
    of = unused("of_id", docs.columns)
    mine = docs.join(kept.select(F.col("kept_id").alias(of)).distinct(), F.col("doc_id").eqNullSafe(F.col(of)), "left_semi")
    again = checkpointed(fps.groupBy("doc_id").count().where(F.col("count") > 1).select(F.col("doc_id").alias(of)))
    if again.isEmpty():
        return mine
    # rows that share an id: their own groups decide
    single = mine.join(again, F.col("doc_id").eqNullSafe(F.col(of)), "left_anti")
    several = docs.join(again, F.col("doc_id").eqNullSafe(F.col(of)), "left_semi").select(F.struct("*").alias("row"))
    texts = several.select(F.xxhash64("row").alias("doc_id"), F.coalesce("row.text", F.lit("")).alias("text")).distinct()
    of_row = with_nodes(texts).select(F.col("doc_id").alias("row_hash"), "node").join(grouped.select("node", "label"), "node").join(kept, "label")
    judged = several.join(of_row, F.xxhash64("row") == F.col("row_hash")).where(F.col("row.doc_id").eqNullSafe(F.col("kept_id")))
    least = judged.groupBy("label").agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row")).select("row.*")
    return single.unionByName(least)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
