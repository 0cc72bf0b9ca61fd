"""Token counts by rank-synchronous array merging.

Texts are cut at white space; the distinct pieces not met before are turned into
ragged numpy arrays of symbols, and in every round each sequence applies its own
lowest-rank pair at all its places at once, until no pair is left. What survives are
the tokens. Counts of pieces stay in a bounded per-worker memory.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from strandloom.llm.common import batches, bounded_batches, id_and_text, table

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Pieces whose counts a worker remembers before it starts afresh.
REMEMBERED = 800_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class RankMerger:
    """Vocabulary and merges of a tokenizer file as sorted arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.base = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.base_last = np.array([vocab[c + suffix] for c in byte_symbols()], np.int64)
        self.width = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made[order]

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each word (no word is empty)."""
        n = len(words)
        out = np.zeros(n, np.int64)
        if not n:
            return out
        flat = np.frombuffer(b"".join(words), np.uint8)
        length = np.fromiter(map(len, words), np.int64, n)
        last = np.cumsum(length) - 1
        sym = self.base[flat]
        sym[last] = self.base_last[flat[last]]
        seq = np.repeat(np.arange(n), length)
        none = len(self.keys)
        while len(sym):
            start = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            size = np.diff(np.append(start, len(sym)))
            key = sym * self.width
            key[:-1] += sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], none)
            rank[start + size - 1] = none  # no pair goes beyond its sequence
            best = np.minimum.reduceat(rank, start)
            done = best == none
            out[seq[start[done]]] = size[done]
            hit = np.flatnonzero((rank == np.repeat(best, size)) & (rank < none))
            if not len(hit):
                break
            # places in a row overlap (a pair of equal symbols): take every other one from the left
            head = np.concatenate(([True], hit[1:] != hit[:-1] + 1))
            first = np.maximum.accumulate(np.where(head, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            sym[hit] = self.made[at[hit]]
            keep = np.repeat(~done, size)
            keep[hit + 1] = False
            sym, seq = sym[keep], seq[keep]
        return out


class Counter:
    """Counts tokens as the library does for the file's normalisation and cutting rules."""

    #: Fixed by the tokenizer file: how normalised text is cut into words.
    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: str.split() also cuts at these, which the file's rules keep as symbols.
    CONTROL = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str) -> None:
        self.merger = RankMerger(path)
        self.special = re.compile("|".join(map(re.escape, self.merger.specials)))
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> tuple[list[str], int]:
        """White-space pieces of the normalised text and the number of special tokens in it."""
        if "<|" in text and (parts := self.special.split(text))[1:]:
            cut = [self.pieces(p)[0] for p in parts]
            return [x for p in cut for x in p], len(parts) - 1
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-cased sign by sign
        low = text.lower()
        return (regex.split(r"\s+", low) if self.CONTROL.search(low) else low.split()), 0

    def batch(self, texts: list[str]) -> list[int]:
        cut = [self.pieces(t) for t in texts]
        new = {p for pieces, _ in cut for p in pieces} - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = {p for pieces, _ in cut for p in pieces}
        if new:
            words = {p: self.WORDS.findall(p) for p in new}
            distinct = list({w for ws in words.values() for w in ws})
            n = dict(zip(distinct, self.merger.counts([w.encode() for w in distinct]).tolist(), strict=True))
            for p, ws in words.items():
                self.known[p] = sum(map(n.__getitem__, ws))
        get = self.known.__getitem__
        return [sum(map(get, pieces)) + specials for pieces, specials in cut]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """This process's counter for the file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text).

    Null texts are empty: 0 bytes, 0 tokens. Repeated rows give repeated results, an
    empty table an empty one; other columns are ignored. The tokenizer file is read
    on the executors at ``tokenizer_path``.
    """
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches(frames):
            n = counter(tokenizer_path).batch(texts)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
