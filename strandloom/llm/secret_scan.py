"""Secret scans: fixed patterns, and character Markov models of random strings.

Two models of character pairs, one of random strings (keys, digests, tokens) and one of
ordinary identifiers and words, are trained from labelled samples. A long run of key
signs is a secret if the mean log-likelihood ratio of its characters says so.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandloom.llm.common import batches, bounded_batches, id_and_text, sampled_texts, table

# The base patterns and the least lengths.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KINDS = ("assign", "access", "hex", "markov")
#: A candidate for the models: a run of key signs of LEAST or more.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST = 20
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Documents (expected number) whose tokens serve as labelled samples, and the mean ratio for a secret, with a digit and without.
SAMPLE, RATIO, PLAIN_RATIO = 400, 0.35, 0.8
#: Parts of ordinary identifiers, for labelled samples.
PARTS = "get set user name file path index count value list map config error test data time line node type input output request response client server handler version build update delete create parse format".split()

Span = tuple[int, int, int]  # start, end, number of the kind


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and kind; leftmost and non-overlapping in a kind."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if max(map(len, text.split()), default=0) >= HEX_LEAST:
        out += [(*m.span(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


CODE = np.full(256, len(ALPHABET), np.int64)
CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))


@dataclass
class PairModel:
    """Log-likelihood ratios of character pairs: random strings against ordinary ones."""

    ratio: np.ndarray

    @classmethod
    def of(cls, random: Iterable[str], ordinary: Iterable[str]) -> PairModel:
        return cls(cls.logs(random) - cls.logs(ordinary))

    @staticmethod
    def logs(samples: Iterable[str]) -> np.ndarray:
        n = len(ALPHABET) + 1
        pairs = np.zeros((n, n))
        for s in samples:
            c = CODE[np.frombuffer(s.encode(), np.uint8)]
            np.add.at(pairs, (c[:-1], c[1:]), 1)
        # each row is drawn towards the signs' overall shares
        share = (pairs.sum(0) + 1) / (pairs.sum() + n)
        return np.log((pairs + 10 * share) / (pairs.sum(1, keepdims=True) + 10))

    def mean(self, s: str) -> float:
        """Mean ratio of the string's pairs; above zero speaks for a random string."""
        c = CODE[np.frombuffer(s.encode("ascii", "replace"), np.uint8)]
        return float(self.ratio[c[:-1], c[1:]].mean()) if len(c) > 1 else 0.0


def made_samples(seed: int = 17, each: int = 400) -> tuple[list[str], list[str]]:
    """Labelled samples that need no corpus: random strings in common alphabets, composed identifiers."""
    rng = np.random.default_rng(seed)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62]]
    random = ["".join(rng.choice(list(a), rng.integers(20, 64))) for a in alphabets for _ in range(each)]
    joins = [lambda p: "_".join(p), lambda p: "-".join(p), lambda p: "/".join(p), lambda p: "".join(x.title() for x in p), lambda p: "_".join(p).upper(), lambda p: "_".join(p) + "_" + str(rng.integers(1, 2100))]
    ordinary = [j(list(rng.choice(PARTS, rng.integers(3, 7)))) for j in joins for _ in range(each)]
    return random, ordinary


def train(texts: Iterable[str]) -> PairModel:
    """From the made samples and the tokens of ``texts``, labelled by the fixed patterns."""
    random, ordinary = made_samples()
    for t in texts:
        spans = base_spans(t)
        random += [x for s, e, _ in spans for x in CANDIDATE.findall(t[s:e])]
        at = 0
        for s, e in [*[(s, e) for s, e, _ in spans], (len(t), len(t))]:
            ordinary += re.findall(r"[A-Za-z]{4,}", t[at:s])
            at = max(at, e)
    return PairModel.of(random, ordinary)


def uncovered(begin: int, end: int, covers: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What ``covers`` (sorted, apart) leave of a stretch."""
    for s, e in covers[bisect_left(covers, begin, key=lambda c: c[1]) :]:
        if s >= end:
            break
        if s > begin:
            yield begin, s
        begin = max(begin, e)
    if begin < end:
        yield begin, end


def all_spans(text: str, model: PairModel) -> list[Span]:
    """Base spans and, of runs of key signs outside them, the parts of LEAST and more that the models take for secrets."""
    base = base_spans(text)
    if max(map(len, text.split()), default=0) < LEAST:
        return base
    covers: list[tuple[int, int]] = []
    for s, e, _ in base:
        if covers and s <= covers[-1][1]:
            covers[-1] = (covers[-1][0], max(e, covers[-1][1]))
        else:
            covers.append((s, e))
    more = []
    for m in CANDIDATE.finditer(text):
        for s, e in uncovered(*m.span(), covers):
            run = text[s:e]
            if e - s >= LEAST and model.mean(run) > (RATIO if any(map(str.isdigit, run)) else PLAIN_RATIO):
                more.append((s, e, 3))
    return sorted(base + more, key=lambda x: (x[0], x[2], x[1])) if more else base


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def fit(docs: DataFrame, sample: int = SAMPLE) -> PairModel:
    """Learn from the distinct texts of about ``sample`` documents, none of over LEARN_BYTES."""
    return train(sorted(r[0] for r in sampled_texts(docs, sample, 23).collect()))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each stretch that spans cover replaced by [secret]."""
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], "[secret]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, model: PairModel | None = None) -> DataFrame:
    """``docs`` (text, n_chars and any more) with secrets replaced by [secret] and n_chars to match.

    Null and empty texts stay as they are, repeated rows change alike, null ids and
    columns of any name stay; n_chars changes only where the text does; an empty table
    gives nothing.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model or fit(docs))  # a 68 x 68 table
    at = {c: docs.columns.index(c) for c in ("text", "n_chars") if c in docs.columns}

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            before = b.column(at["text"]).to_pylist()
            after = [t and redact(t, all_spans(t, shared.value)) for t in before]
            cols = list(b.columns)
            cols[at["text"]] = pa.array(after, cols[at["text"]].type)
            if "n_chars" in at:
                n = zip(b.column(at["n_chars"]).to_pylist(), before, after, strict=True)
                cols[at["n_chars"]] = pa.array([old if x == y else len(y) for old, x, y in n], cols[at["n_chars"]].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def secrets(docs: DataFrame, model: PairModel | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov of every row of ``docs``.

    Offsets are code points, ends exclusive. Null and empty texts have no spans (the
    digest is that of the empty string). Repeated rows give repeated results, null ids stay, an
    empty table gives nothing, other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))  # a 68 x 68 table

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches(frames):
            found = [all_spans(t, shared.value) for t in texts]
            base = [[s for s in spans if s[2] < 3] for spans in found]
            counts = [pa.array([sum(s[2] == k for s in spans) for spans in found], pa.int64()) for k in range(4)]
            digest = [hashlib.sha256(as_text(b).encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays(
                [ids, *counts[:3], pa.array(digest), pa.array(list(map(as_text, found))), counts[3]],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"],
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
