"""Byte-level BPE: encoding by a global shuffle of distinct words, and decoding.

Tasks cut their texts into pre-tokens and gather them in blocks. A block keeps its
texts as sequences of word numbers, position by position, and each of its distinct
words once. The words are shuffled by their hash, so that all blocks' copies of a
word meet and it is encoded once; its ids go back to the blocks, which put them in
the words' places. A frequent word is there once a block, so no key is hot. Texts are
cut a second time for the sequences, which are then moved but once.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import bounded_batches, id_and_text, table

RANKS = "byte_bpe_50k.tiktoken"
#: Characters of text that a block gathers (a longer text is a block of its own).
BLOCK_CHARS = 8_000_000
#: Bytes of text for each bucket of words; fewest and most buckets.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 4_000_000, 16, 16_384
#: Words whose ids a bucket's task remembers before it starts afresh (they are then encoded again).
REMEMBERED = 1_000_000
#: Word numbers that are turned into ids at once, and bytes of an Arrow batch: a block's texts are one value.
AT_ONCE, BATCH_BYTES = 500_000, 32 << 20
# Unicode white space, and the rules that cut text into pre-tokens.
SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PRE_TOKENS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: The same for texts whose letters and digits are told alike by both modules: all up to U+024F but superscripts and fractions.
PLAIN = re.compile("[\\x00-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\u024f]*")
PLAIN_PRE_TOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^{SPACE}\w]|_)+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

ROWS = "bucket int, block long, part int, words binary, data binary"


class Vocabulary:
    """Ranks of a file of base64 tokens; a token's rank is its id."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.token = {r: t for t, r in self.rank.items()}

    def encode(self, word: bytes) -> list[int]:
        """Ids of a pre-token: the neighbours of lowest rank merge, the leftmost of equal ones first."""
        if word in self.rank:
            return [self.rank[word]]
        get, n = self.rank.get, len(word)
        end = list(range(1, n + 1))  # of the symbol that begins here; 0 once it is merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two has changed since
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := get(word[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(self.rank[word[i : end[i]]])
            i = end[i]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, each joined with the table of tokens."""
        return b"".join(map(self.token.__getitem__, ids.tolist()))


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """This process's vocabulary of the file."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def ragged(values: list[bytes]) -> bytes:
    """Byte strings as one: their number, lengths, and contents."""
    return struct.pack("<I", len(values)) + np.array(list(map(len, values)), "<u4").tobytes() + b"".join(values)


def unragged(data: bytes) -> list[bytes]:
    (n,) = struct.unpack_from("<I", data)
    stops = np.cumsum(np.frombuffer(data, "<u4", n, 4)).tolist()
    flat = memoryview(data)[4 + 4 * n :]
    return [bytes(flat[a:b]) for a, b in zip([0, *stops[:-1]], stops, strict=True)] if n else []


def planes(numbers: np.ndarray) -> bytes:
    """Whole numbers compressed, equal bytes of all numbers together."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unplanes(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel()


def pre_tokens(text: str, cut: regex.Pattern) -> list[str]:
    """The words of a text; most texts are plain, for which the standard module's rules say the same in less time."""
    return PLAIN_PRE_TOKENS.findall(text) if PLAIN.fullmatch(text) else cut.findall(text)


class Numbers(dict):
    """Numbers of words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Block:
    """Texts as numbers of words, and the words by number."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.places: list[np.ndarray] = []
        self.number = Numbers()
        self.chars = 0

    def add(self, doc_id: int | None, text: str, cut: regex.Pattern) -> None:
        words = pre_tokens(text, cut)
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.places.append(np.fromiter(map(self.number.__getitem__, words), np.uint32, len(words)))
        self.chars += len(text)

    def rows(self, task: int, n: int, buckets: int, texts: bool) -> Iterator[tuple]:
        """A row of ROWS with the texts (bucket -1), or one for each bucket with words.

        The block's name depends on what it holds: if other texts came when it was made
        again, the two wouldn't be taken for one.
        """
        words = [w.encode() for w in self.number]
        name = (task << 32) + n ^ zlib.crc32(b"\n".join(words)) << 31
        # words in order of bucket: their numbers become places in that order
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        ends = np.flatnonzero(np.diff(bucket[order], append=-1)) + 1
        if texts:
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            head = struct.pack("<I", len(self.ids)) + np.array([i is not None for i in self.ids], np.uint8).tobytes()
            head += np.array([i or 0 for i in self.ids], "<i8").tobytes() + np.array(self.sizes, "<u8").tobytes()
            yield -1, name, len(ends), None, struct.pack("<I", len(head)) + head + planes(place[np.concatenate(self.places)])
            return
        for part, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            yield int(bucket[order[a]]), name, part, zstandard.compress(ragged([words[i] for i in order[a:b]]), 3), None


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def in_blocks(docs: DataFrame, buckets: int, only_texts: bool) -> DataFrame:
    """ROWS of ``docs`` (doc_id, text): each block's texts, or its words by bucket."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, task, n, block = regex.compile(PRE_TOKENS), 0, 0, Block()

        def made(block: Block, n: int) -> Iterator[pa.RecordBatch]:
            if rows := list(block.rows(task, n, buckets, only_texts)):
                yield as_batch(rows, ROWS)

        for b in frames:
            for i, t, task in zip(*(c.to_pylist() for c in b.columns), strict=True):
                block.add(i, t, cut)
                if block.chars >= BLOCK_CHARS:
                    yield from made(block, n)
                    n, block = n + 1, Block()
        if block.ids:
            yield from made(block, n)

    # the number of a partition of ``docs``, whatever the stage that it is part of
    return docs.withColumn("task", F.spark_partition_id()).mapInArrow(run, ROWS)


def words_encoded(rows: DataFrame, path: str) -> DataFrame:
    """ROWS of words, sorted by bucket, with ``data`` the ids of a bucket's words."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        last = None
        for b in frames:
            out = []
            for bucket, block, part, words, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != last or len(known) > REMEMBERED:
                    known, last = {}, bucket
                ids = []
                for w in unragged(zstandard.decompress(words)):
                    if w not in known:
                        known[w] = np.array(vocabulary(path).encode(w), "<u4").tobytes()
                    ids.append(known[w])
                sizes = np.array([len(x) // 4 for x in ids], np.uint32)
                flat = np.frombuffer(b"".join(ids), "<u4")
                packed = planes(np.concatenate((sizes, flat)))
                out.append((bucket, block, part, None, struct.pack("<I", len(sizes)) + packed))
            if out:
                yield as_batch(out, ROWS)

    return rows.mapInArrow(run, ROWS)


def block_texts(parts: list[bytes], data: bytes) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids as little-endian 32-bit numbers) of a block's texts."""
    (n,) = struct.unpack_from("<I", data)
    texts, places = data[4 : 4 + n], unplanes(data[4 + n :])
    (m,) = struct.unpack_from("<I", texts)
    named = np.frombuffer(texts, np.uint8, m, 4)
    ids, sizes = np.frombuffer(texts, "<i8", m, 4 + m), np.frombuffer(texts, "<u8", m, 4 + 9 * m).astype(np.int64)
    size, flat = [np.zeros(0, np.int64)], [np.zeros(0, "<u4")]
    for p in parts:
        (k,) = struct.unpack_from("<I", p)
        numbers = unplanes(p[4:])
        size.append(numbers[:k].astype(np.int64))
        flat.append(numbers[k:])
    length, tokens = np.concatenate(size), np.concatenate(flat)
    start = np.cumsum(length) - length
    stops = np.cumsum(sizes)

    def tokens_at(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at places a to b, and where each place's ids end."""
        w = places[a:b]
        n = length[w]
        stop = np.cumsum(n)
        return tokens[np.repeat(start[w] - stop + n, n) + np.arange(stop[-1] if len(n) else 0)], stop

    at = 0
    while at < m:
        begin = int(stops[at] - sizes[at])
        to = max(at + 1, int(np.searchsorted(stops, begin + AT_ONCE, "right")))
        end = int(stops[to - 1])
        if end - begin > AT_ONCE:  # one long text
            pieces = b"".join(tokens_at(a, min(a + AT_ONCE, end))[0].astype("<u4").tobytes() for a in range(begin, end, AT_ONCE))
            yield (int(ids[at]) if named[at] else None), pieces
        else:
            got, ends = tokens_at(begin, end)
            ends = np.concatenate(([0], ends))
            data, cuts = got.astype("<u4").tobytes(), (4 * ends[stops[at:to] - begin]).tolist()
            for i, a, b in zip(range(at, to), [0, *cuts[:-1]], cuts, strict=True):
                yield (int(ids[i]) if named[i] else None), data[a:b]
        at = to


def reassembled(rows: DataFrame) -> DataFrame:
    """doc_id, ids from ROWS sorted by block and part, a block's words before its texts."""
    schema = "doc_id long, ids binary"

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        of = None
        for b in frames:
            for bucket, block, part, data in zip(*(b.column(c).to_pylist() for c in ("bucket", "block", "part", "data")), strict=True):
                if block != of:
                    parts, of = [], block
                if bucket >= 0:
                    parts.append(data)
                    continue
                if part != len(parts):
                    raise RuntimeError(f"block {block} has the words of {len(parts)} buckets, not of {part}: its rows were made anew in another order")
                out, held = [], 0
                for row in block_texts(parts, data):
                    out.append(row)
                    held += len(row[1])
                    if held > 4 * BLOCK_CHARS or len(out) == 4096:
                        yield as_batch(out, schema)
                        out, held = [], 0
                if out:
                    yield as_batch(out, schema)

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit numbers) of every row of ``docs`` (doc_id, text).

    Null and empty texts have no ids. Repeated rows and null ids each have their result, an
    empty table gives an empty one, other columns are ignored. Special strings in texts
    are ordinary text. The file of ranks is read on the executors at ``path``. ``docs``
    must give the same partitions when a task runs again, as files do.
    """
    bounded_batches(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = id_and_text(docs)
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = 1 << max(LEAST_BUCKETS, min(MOST_BUCKETS, size // BUCKET_BYTES)).bit_length() - 1
    words = in_blocks(rows, buckets, False).repartition("bucket").sortWithinPartitions("bucket", "block")
    both = words_encoded(words, path).unionByName(in_blocks(rows, buckets, True)).repartition("block")
    return reassembled(both.sortWithinPartitions("block", F.col("bucket") < 0, "part"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``decoded``: the tokens' bytes, which need not be whole characters.

    Null ids decode to null; an id that the file doesn't have raises an error.
    """
    bounded_batches(encoded.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            if b.num_rows:
                words = [None if x is None else vocabulary(path).decode(np.frombuffer(x, "<u4")) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(words, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(RANKS)
    both = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
