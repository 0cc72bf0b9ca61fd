"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of ORDER-grams over all letters of the world's scripts (all
else is one separator), kept as sorted arrays of n-gram hashes with their discounted
probabilities and back-off weights. A text goes to the language with the lowest
cross-entropy a letter (of equal ones the first by name); a cross-entropy above what the
language's own texts show is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import batches, bounded_batches, fold, hash_share, id_and_text, learnable, table

ORDER = 4
#: Bits of a symbol: 0 begins a text, 1 is a separator, the others are letters.
SYMBOL_BITS = 16
SYMBOLS = 1 << SYMBOL_BITS
#: Letters (by code point) that have a symbol of their own; the rarer ones beyond, all outside the basic plane, share the rest.
OWN = 60_000
#: Documents of each language to learn from (expected number); fewer, but FEWEST at least, where all languages together would exceed TOTAL.
EACH, FEWEST, TOTAL = 300, 20, 60_000
#: Languages that are learned at most, the most frequent ones; letters of the piece by which a text of over LEARN_BYTES is learned from.
LANGUAGES, PIECE = 1_000, 16_384
#: Numbers that the cache of log-probabilities holds, and that one step of scoring makes.
CACHED, STEP = 1 << 22, 1 << 22
#: Share of a language's own texts that may be rejected.
REJECTED = 0.002
MODULUS, HELD = 4, 2
UNKNOWN = "und"
MIX = np.uint64(0x9E3779B97F4A7C15)
BITS = np.uint64(SYMBOL_BITS)


def hashed(grams: np.ndarray) -> np.ndarray:
    """A one-to-one mix of n-gram codes."""
    return grams * MIX


def suffix(grams: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` symbols of each n-gram."""
    return grams & np.uint64((1 << (SYMBOL_BITS * order)) - 1)


@dataclass
class Level:
    """n-grams of one order: hashes (sorted) with discounted probabilities, contexts with back-off weights."""

    gram: np.ndarray
    share: np.ndarray
    context: np.ndarray
    backoff: np.ndarray

    @classmethod
    def of(cls, grams: np.ndarray, count: np.ndarray) -> Level:
        once, twice = (count == 1).sum(), (count == 2).sum()
        d = once / (once + 2 * twice) if once and twice else 0.5
        context, at = np.unique(grams >> BITS, return_inverse=True)
        total, kinds = np.bincount(at, count), np.bincount(at)
        g, c = np.argsort(hashed(grams)), np.argsort(hashed(context))
        return cls(hashed(grams)[g], ((count - d) / total[at]).astype(np.float32)[g], hashed(context)[c], (d * kinds / total).astype(np.float32)[c])

    def shares(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h, c = hashed(grams), hashed(grams >> BITS)
        i = np.minimum(np.searchsorted(self.gram, h), len(self.gram) - 1)
        j = np.minimum(np.searchsorted(self.context, c), len(self.context) - 1)
        return np.where(self.gram[i] == h, self.share[i], 0.0), np.where(self.context[j] == c, self.backoff[j], 1.0)


@dataclass
class KneserNey:
    levels: list[Level]

    @classmethod
    def of(cls, grams: np.ndarray) -> KneserNey:
        """From all ORDER-gram codes of a language's texts."""
        levels: list[Level] = []
        kinds, count = np.unique(grams, return_counts=True)
        for order in range(ORDER, 0, -1):
            levels.insert(0, Level.of(kinds, count.astype(np.float64)))
            # lower orders count what stands before a gram, not how often it occurs
            kinds, count = np.unique(suffix(kinds, order - 1), return_counts=True)
        return cls(levels)

    def logs(self, grams: np.ndarray) -> np.ndarray:
        """Natural logarithms of the last symbols' probabilities, given those before."""
        p = np.full(len(grams), 1 / SYMBOLS)
        for order, level in enumerate(self.levels, 1):
            share, backoff = level.shares(suffix(grams, order))
            p = share + backoff * p
        return np.log(p)


@dataclass
class Identifier:
    names: list[str]
    models: list[KneserNey]
    limit: np.ndarray  # highest cross-entropy of each language that is not rejected
    held: np.ndarray | None = field(default=None, repr=False)  # n-grams that the cache has, by slot
    logs: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": None, "logs": None}

    def known_logs(self, grams: np.ndarray) -> np.ndarray:
        """Log-probabilities by language; a cache of CACHED numbers remembers n-grams, a newer one in the place of an older."""
        if self.held is None:
            bits = max(8, (CACHED // len(self.names)).bit_length() - 1)
            self.held, self.logs = np.zeros(1 << bits, np.uint64), np.zeros((1 << bits, len(self.names)), np.float32)
        slot = hashed(grams) >> np.uint64(64 - (len(self.held).bit_length() - 1))
        out = self.logs[slot]
        new = self.held[slot] != grams  # no code is 0: each ends in a letter or has one before its end
        if new.any():
            kinds, at = np.unique(grams[new], return_inverse=True)
            found = np.stack([m.logs(kinds) for m in self.models], axis=1).astype(np.float32)
            out[new] = found[at]
            of, last = np.unique((hashed(kinds) >> np.uint64(64 - (len(self.held).bit_length() - 1)))[::-1], return_index=True)
            last = len(kinds) - 1 - last
            self.held[of], self.logs[of] = kinds[last], found[last]
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy of each text by language, and its number of n-grams."""
        total, n = np.zeros((len(texts), len(self.names))), np.zeros(len(texts), np.int64)
        grams, of = text_grams(texts)
        step = max(1, STEP // max(1, len(self.names)))
        for at in range(0, len(grams), step):
            own = of[at : at + step]
            start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            total[own[start]] += np.add.reduceat(self.known_logs(grams[at : at + step]).astype(np.float64), start)
            n[own[start]] += np.diff(np.append(start, len(own)))
        return -total / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Names, scores and whether rejected; texts without a letter are UNKNOWN with score 0."""
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        names, scores, rejected = [], np.zeros(len(texts)), np.ones(len(texts), bool)
        entropy, n = self.entropies(texts)
        best = entropy.argmin(1)
        for i, k in enumerate(best.tolist()):
            names.append(self.names[k] if n[i] else UNKNOWN)
        e = np.exp(-np.minimum(n, 50)[:, None] * (entropy - entropy.min(1, keepdims=True)))
        at = np.arange(len(texts))
        rejected = (entropy[at, best] > self.limit[best]) | (n == 0)
        scores = np.where(n > 0, e[at, best] / e.sum(1) * np.where(rejected, 0.5, 1.0), 0.0)
        return names, scores, rejected


@lru_cache(1)
def symbols() -> np.ndarray:
    """Symbol of every code point."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    place = np.cumsum(letter) - 1
    shared = OWN + (place - OWN) % (SYMBOLS - 2 - OWN)
    return np.where(letter, 2 + np.where(place < OWN, place, shared), 1).astype(np.uint16)


def text_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """ORDER-gram codes that end in a letter or in the separator after one, and the texts they are of."""
    low = [t.lower() for t in texts]
    size = np.array([len(t) for t in low], np.int64)
    code = symbols()[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.uint64)
    of = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    gram = code.copy()
    for back in range(1, ORDER):
        before = np.zeros_like(code)
        before[back:] = code[:-back]
        before[place < back] = 0
        gram |= before << np.uint64(SYMBOL_BITS * back)
    before = (gram >> BITS) & np.uint64(SYMBOLS - 1)
    use = (code > 1) | (before > 1)
    return gram[use], of[use]


def train(samples: dict[str, list[str]]) -> Identifier:
    """A model of each language that has a letter in its texts; fitted on two thirds, the limits on the rest."""
    names, models, rest = [], [], []
    for name in sorted(samples):
        ts = sorted(samples[name])
        own = [t for i, t in enumerate(ts) if i % 3 or len(ts) < 6]
        grams, _ = text_grams(own)
        if len(grams):
            names.append(name)
            models.append(KneserNey.of(grams))
            rest.append([t for i, t in enumerate(ts) if i % 3 == 0] or ts)
    out = Identifier(names, models, np.full(len(names), np.inf))
    for k, ts in enumerate(rest):
        own = Identifier(names[k : k + 1], models[k : k + 1], out.limit[k : k + 1])
        entropy, n = own.entropies(ts)
        if (n > 0).any():
            out.limit[k] = np.quantile(entropy[n > 0, 0], 1 - REJECTED) * 1.1
    return out


def fit(docs: DataFrame, each: int = EACH) -> Identifier:
    """Learn every language from about ``each`` of its documents, chosen by a hash of id and text.

    Of texts of over LEARN_BYTES a piece is read, somewhere by their hash. Where there are more
    than LANGUAGES the most frequent ones are learned (ties: the first by name), so what comes
    to the driver is bounded.
    """
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(MODULUS) != HELD))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return train({})
    share = F.lit(float(max(FEWEST, min(each, TOTAL // len(sizes))))) / F.col("n")
    kept = F.broadcast(docs.sparkSession.createDataFrame(sizes, "lang string, n long"))  # LANGUAGES rows at most
    chosen = known.join(kept, "lang").where(hash_share(11, "doc_id", "text") < share)
    begin = F.pmod(F.xxhash64("text", F.lit(12)), F.greatest(F.char_length("text") - PIECE, F.lit(1))).cast("int") + 1
    chosen = chosen.withColumn("text", F.when(learnable(), F.col("text")).otherwise(F.substring(F.col("text"), begin, F.lit(PIECE))))
    samples: dict[str, list[str]] = {}
    for lang, text in chosen.groupBy("lang", F.xxhash64("text").alias("of")).agg(F.min("text").alias("text")).select("lang", "text").collect():
        samples.setdefault(lang, []).append(text)
    return train(samples)


def languages(docs: DataFrame, model: Identifier | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0, and so are all if
    nothing could be learned. Repeated rows give repeated results; rows with a null id
    aren't held out; an empty table gives nothing. lang is read to learn only, other
    columns never.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))  # a few MB a language

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches(frames):
            name, score, rejected = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays([ids, pa.array(name, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    found = id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    return found.select("doc_id", (fold(MODULUS) == HELD).alias("held_out"), "lang_pred", "score", "rejected")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))
