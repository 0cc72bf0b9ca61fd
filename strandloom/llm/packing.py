"""Packing into training sequences by vector bin packing.

Every example has a demand vector (tokens, segments, loss-bearing tokens) and every
sequence a capacity in each of the three. The open sequence takes, of all examples
that fit, the one whose demand has the largest dot product with what is left; where
none fits, the best one is cut to fill the gap. Each task packs its own rows, in
blocks of bounded size, so nothing is shuffled.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import bounded_batches, table
from strandloom.llm.token_counts import byte_symbols

TOKENIZER = "byte_bpe_50k.json"
END_ID = 1
#: Capacity of a sequence: tokens, segments, loss-bearing tokens.
CAPACITY = (2048, 256, 2048)
#: Tokens of examples that are placed together.
BLOCK_TOKENS = 4_000_000
#: White-space pieces whose ids a worker remembers before it starts afresh.
REMEMBERED = 700_000
#: Fixed by the tokenizer file: the byte-level rules that cut text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder(dict):
    """Text to ids as little-endian 32-bit bytes; maps a piece after a space to its ids.

    A single space between two other signs always begins a new word of the byte-level
    rules, so pieces cut there can be encoded alone, and remembered. Pieces go through
    the file's own vocabulary as merge ranks, which is several times faster than the
    library on short strings; a text with special strings goes through the library whole.
    """

    #: A space that begins a word, whatever surrounds the text's other white space.
    CUT = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str) -> None:
        super().__init__()
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        byte = {c: i for i, c in enumerate(byte_symbols())}
        vocab = {t: i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t not in self.specials}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items()}
        self.pieces = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def one(self, piece: str) -> bytes:
        return array("I", self.pieces.encode_ordinary(piece)).tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def batch(self, texts: list[str]) -> list[bytes]:
        cut: list[list[str] | None] = []
        for t in texts:
            if any(s in t for s in self.specials):
                cut.append(None)
            else:
                # where no white space stands beside another, every space is such a cut
                plain = " ".join(t.split()) == t.replace("\n", " ")
                cut.append(t.split(" ") if plain else self.CUT.split(t))
        rest = {p for c in cut if c for p in c[1:]}
        new = list(rest - self.keys())
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(rest)
        self.update((p, self.one(" " + p)) for p in new)
        get = self.__getitem__
        return [self.whole(t) if c is None else self.one(c[0]) + b"".join(map(get, c[1:])) for t, c in zip(texts, cut, strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


@dataclass
class Piece:
    """Tokens [start, start + length) of an example, of which the last ``loss`` bear loss."""

    example: int
    start: int
    length: int
    loss: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        """The first ``n`` tokens and the rest, each with its own loss-bearing tokens."""
        first = max(0, n - (self.length - self.loss))
        return Piece(self.example, self.start, n, first), Piece(self.example, self.start + n, self.length - n, self.loss - first)


def place(pieces: Iterable[Piece], capacity: tuple[int, int, int]) -> Iterator[list[Piece]]:
    """Sequences as lists of pieces, in order, each within the capacity.

    A piece that alone exceeds a limit is cut to it. What isn't full, because the number of
    segments or of loss-bearing tokens ended it or nothing is left, goes out as sequences
    of powers of two, which need no padding.
    """
    most = np.array(capacity, float)
    shelf: dict[tuple[int, int], list[Piece]] = {}
    for p in pieces:
        shelf.setdefault((p.length, p.loss), []).append(p)
    kinds = sorted(shelf, reverse=True)
    slot = {k: i for i, k in enumerate(kinds)}
    demand = np.array([(n, 1, loss) for n, loss in kinds], float).reshape(-1, 3)
    held = np.array([len(shelf[k]) for k in kinds], np.int64)
    left, bin_, total = most.copy(), [], int(held.sum())

    def take(i: int) -> Piece:
        nonlocal total
        held[i] -= 1
        total -= 1
        return shelf[kinds[i]].pop()

    def put_back(p: Piece) -> None:
        nonlocal demand, held, total
        k = (p.length, p.loss)
        if k not in slot:
            slot[k] = len(kinds)
            kinds.append(k)
            shelf[k] = []
            demand = np.vstack([demand, (p.length, 1, p.loss)])
            held = np.append(held, 0)
        shelf[k].append(p)
        held[slot[k]] += 1
        total += 1

    while total:
        gain = (demand / most) @ (left / most)
        there = held > 0
        fits = there & (demand <= left).all(axis=1)
        if left[1] == 1:  # the last segment should fill the sequence
            fits &= demand[:, 0] == left[0]
        if fits.any():
            p = take(int(np.where(fits, gain, -1.0).argmax()))
        else:
            i = int(np.where(there, gain, -1.0).argmax())
            p = take(i)
            n = min(p.length, int(left[0]), p.length - p.loss + int(left[2]))
            if n <= 0:  # no room for loss-bearing tokens: this sequence is complete
                put_back(p)
                yield from ladder(bin_, capacity[0])
                left, bin_ = most.copy(), []
                continue
            if n < p.length:
                p, rest = p.cut(n)
                put_back(rest)
        bin_.append(p)
        left -= (p.length, 1, p.loss)
        if left[0] <= 0 or left[1] <= 0:
            yield from ladder(bin_, capacity[0])
            left, bin_ = most.copy(), []
    yield from ladder(bin_, capacity[0])


def ladder(pieces: list[Piece], limit: int) -> Iterator[list[Piece]]:
    """The pieces as sequences whose lengths are falling powers of two (or the limit)."""
    room, out = 0, []
    rest = sum(p.length for p in pieces)
    for p in pieces:
        while p.length:
            if not room:
                room = limit if rest >= limit else 1 << (rest.bit_length() - 1)
            n = min(room, p.length)
            part, p = p.cut(n)
            out.append(part)
            room, rest = room - n, rest - n
            if not room:
                yield out
                out = []


COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack(docs: DataFrame, tokenizer_path: str, capacity: tuple[int, int, int] = CAPACITY, loss_from: str | None = None) -> DataFrame:
    """One row for each piece of each row of ``docs`` (doc_id, text), with its place.

    A row is its text's ids and then END_ID; null and empty texts are END_ID alone.
    ``loss_from`` names a column with the number of a row's first token that bears loss
    (instruction data: the answer's first one; null or no column: all tokens do).
    Repeated rows are packed again each; rows with a null id keep it; an empty table
    gives no pieces; other columns are ignored. Texts of a few tokens reach the limit on
    segments first; their sequences are cut to powers of two. A sequence_id is the task's partition
    and a number in it, so a lost task gives the same ids when it runs again.
    """
    bounded_batches(docs.sparkSession)
    limit, _, most_loss = capacity

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        serial = 0
        block: list[tuple[int | None, bytes, int]] = []
        tokens = 0
        end = np.array([END_ID], "<u4").tobytes()

        def flush() -> pa.RecordBatch:
            nonlocal serial, block, tokens
            rows: list[list] = [[] for _ in range(8)]

            def emit(sequence: list[Piece]) -> None:
                nonlocal serial
                at = 0
                for p in sequence:
                    doc, ids, _ = block[p.example]
                    values = (doc, p.start, p.length, zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]), len(ids) // 4, part + serial, at, p.loss)
                    for column, v in zip(rows, values, strict=True):
                        column.append(v)
                    at += p.length
                serial += 1

            rest = []
            for i, (_, ids, free) in enumerate(block):
                n = len(ids) // 4
                p = Piece(i, 0, n, n - min(n, max(0, free)))
                while p.length >= limit and (cut := p.cut(limit))[0].loss <= most_loss:
                    emit([cut[0]])
                    p = cut[1]
                if p.length:
                    rest.append(p)
            for sequence in place(rest, capacity):
                emit(sequence)
            block, tokens = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=[c.split()[0] for c in COLUMNS.split(", ")])

        for b in frames:
            ids, texts, frees = (b.column(c).to_pylist() for c in range(3))
            for doc, found, free in zip(ids, encoder(tokenizer_path).batch(texts), frees, strict=True):
                block.append((doc, found + end, free))
                tokens += len(found) // 4 + 1
                if tokens >= BLOCK_TOKENS:
                    yield flush()
        if block:
            yield flush()

    free = F.lit(0) if loss_from is None else F.coalesce(F.col(loss_from), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), free.cast("long").alias("free"))
    return rows.mapInArrow(run, COLUMNS)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
