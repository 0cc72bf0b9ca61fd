"""Spelling variants: words that one edit separates, by a positional q-gram index.

A word has grams of three signs, filled up at its ends; one edit spoils at most three
of them. Words of some length and the longer ones by a sign are dealt to blocks by
those of their grams that come first in one order of all grams, rare ones first; as
few grams may be missing, two near words share one of the first four. In a block the
postings of the grams are merged with a heap, within the limits on length and
position; what reaches the least number of common grams is compared sign by sign.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import batches, bounded_batches, checkpointed, id_and_text, table

#: Signs of a gram, and grams that one edit can spoil.
Q = 3
#: Grams by which a word is dealt out: one more than can be missing.
FIRST = Q + 1
#: Fixed by the task: least length and number of a word, the share of spoilt runs, how much more frequent a form is.
LEAST_LENGTH, LEAST_NUMBER, SPOILT, TIMES = 5, 3, 97, 2
#: Letters that words are made of, in ISO 8859-1: a to z (A to Z fold to these) and U+00C0 to U+00FF.
LETTERS = bytes([*range(97, 123), *range(0xC0, 0x100)])
#: Each byte's fold: A to Z to a to z, letters to themselves, all else to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in LETTERS else 32 for b in range(256))
#: Number of each letter as a byte.
NUMBER = bytes(LETTERS.index(b) + 1 if b in LETTERS else 0 for b in range(256))
BASE = len(LETTERS) + 1
GRAMS = BASE**Q
#: Distinct words that a task counts before it hands them on, and words that a block's index holds at most (about).
COUNTED, INDEXED = 500_000, 50_000

#: A word in a block: guests are a sign longer than the block's own words and are looked up only.
ROWS = "gram int, nth int, size int, slice int, guest boolean, word binary, n long, before array<bigint>"


def spoilt(doc: bytes, run: bytes) -> bytes:
    """The run, without one sign if its hash says so; ``doc`` is the id as text."""
    text = run if run.isascii() else run.decode("latin-1").encode()
    h = zlib.crc32(text, zlib.crc32(doc + b":"))
    at = h % len(run)
    return run if h % SPOILT else run[:at] + run[at + 1 :]


def words_of(docs: DataFrame) -> DataFrame:
    """word, n of ``docs`` (doc_id, text): all runs of letters, folded and spoilt, and how often they are there."""
    bounded_batches(docs.sparkSession)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for ids, texts in batches(frames):
            for i, t in zip(ids.to_pylist(), texts, strict=True):
                doc = b"" if i is None else b"%d" % i
                for w, n in Counter(t.encode("latin-1", "replace").translate(FOLD).split()).items():
                    total[spoilt(doc, w)] += n
            if len(total) > COUNTED:
                yield counted()
                total = Counter()
        if total:
            yield counted()

    return id_and_text(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def grams_of(word: bytes) -> list[int]:
    """The numbers of a word's grams, from left to right."""
    x = bytes(Q - 1) + word.translate(NUMBER) + bytes(Q - 1)
    return [(a * BASE + b) * BASE + c for a, b, c in zip(x, x[1:], x[2:], strict=False)]


def gram_numbers(words: DataFrame) -> np.ndarray:
    """How often each gram is in ``words``; its length is fixed by the alphabet, not by the data."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[int] = Counter()
        for b in frames:
            for w in b.column(0).to_pylist():
                n.update(grams_of(w.encode("latin-1")))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64())], names=["gram", "n"])

    found = words.select("word").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(GRAMS, np.int64)
    out[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return out


def dealt(words: DataFrame, frequency, indexed: int) -> DataFrame:  # noqa: ANN001
    """ROWS of ``words`` (word, n); ``frequency`` is a broadcast of ``gram_numbers``.

    A gram so frequent that its blocks may hold more than ``indexed`` words has several
    slices: a block's own words lie in one of them, and are looked up in all.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequency.value.tolist()
        for b in frames:
            out: list[tuple] = []
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = word.encode("latin-1")
                grams = grams_of(w)
                if len(set(grams)) == len(grams):
                    keyed = [(often[g], g, 0) for g in grams]
                else:
                    nth: Counter[int] = Counter()
                    keyed = []
                    for g in grams:
                        keyed.append((often[g], g, nth[g]))
                        nth[g] += 1
                before: list[int] = []
                for count, g, k in sorted(keyed)[:FIRST]:
                    slices = 1 + count // indexed
                    home = zlib.crc32(w) % slices
                    for s in range(slices):
                        out.append((g, k, len(w), s, s != home, w, n, before))
                        out.append((g, k, len(w) - 1, s, True, w, n, before))
                    before = [*before, g + k * GRAMS]
            if out:
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in ROWS.split(", ")])

    return words.select("word", "n").mapInArrow(run, ROWS)


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one sign of ``a`` was inserted, deleted or replaced to give ``b``; lengths differ by one at most."""
    if len(a) == len(b):
        return sum(map(int.__ne__, a, b)) == 1
    short, long = (a, b) if len(a) < len(b) else (b, a)
    i = next((i for i, (x, y) in enumerate(zip(short, long, strict=False)) if x != y), len(short))
    return short[i:] == long[i + 1 :]


class Index:
    """Postings of the words of a block, all of one length, by gram and place."""

    def __init__(self) -> None:
        self.words: list[tuple] = []
        self.keys: list[frozenset[int]] = []
        self.at: dict[int, list[int]] = {}

    def add(self, row: tuple, keys: list[int]) -> None:
        n = len(self.words)
        for k in keys:
            if k in self.at:
                self.at[k].append(n)
            else:
                self.at[k] = [n]
        self.words.append(row)
        self.keys.append(frozenset(keys))

    def common(self, keys: list[int], longer: bool) -> Iterator[int]:
        """Numbers of the words that have enough grams in common with one whose grams and places are ``keys``.

        A word may lack Q of its grams, so a near one is in the postings of one of the Q + 1
        rarest. These are merged with a heap, and the grams in common with what comes out
        are counted. A longer word's grams stand where they do in the shorter one, or a place later.
        """
        get = self.at.get
        if longer:
            both = [(get(k), get(k - GRAMS)) for k in keys]
            if both.count((None, None)) > Q:
                return
            both.sort(key=lambda ab: len(ab[0] or ()) + len(ab[1] or ()))
            rare = [x for ab in both[: Q + 1] for x in ab if x]
            shifted = [k - GRAMS for k in keys]
        else:
            lists = [get(k, ()) for k in keys]
            if lists.count(()) > Q:
                return
            lists.sort(key=len)
            rare = [x for x in lists[: Q + 1] if x]
        own, least, last = frozenset(keys), len(keys) - Q, -1
        for word in heapq.merge(*rare) if len(rare) > 1 else rare[0] if rare else ():
            if word != last:
                last, other = word, self.keys[word]
                n = len(own & other)
                if longer:
                    n += len(other.intersection(shifted))
                if n >= least:
                    yield word


def near_pairs(rows: DataFrame) -> DataFrame:
    """word, near, near_n both ways, once for each pair, from ROWS sorted by block, its own words first."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, index = None, Index()
        for b in frames:
            out: list[tuple] = []
            for *key, guest, word, n, before in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != block:
                    block, index = key, Index()
                if guest and not index.words:
                    continue
                keys = [g + i * GRAMS for i, g in enumerate(grams_of(word))]
                longer = len(word) > key[2]
                earlier = set(before)
                for i in index.common(keys, longer):
                    other, other_n, other_before = index.words[i]
                    if guest and not longer and other <= word:
                        continue  # met with the roles the other way round, in the other's slice
                    # a pair is named in the first of the blocks in which it meets
                    if one_edit(word, other) and earlier.isdisjoint(other_before):
                        out += [(word, other, other_n), (other, word, n)]
                if not guest:
                    index.add((word, n, before), keys)
            if out:
                text = lambda xs: pa.array([x.decode("latin-1") for x in xs], pa.string())
                word, near, near_n = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([text(word), text(near), pa.array(near_n, pa.int64())], names=["word", "near", "near_n"])

    return rows.mapInArrow(run, "word string, near string, near_n long")


def rooted(forms: DataFrame) -> DataFrame:
    """word, root of ``forms`` (word, form): the end of the chain of forms.

    A form is at least twice as frequent as its word, so chains end after at most 61 steps;
    each round doubles the steps taken.
    """
    now = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = checkpointed(now.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, indexed: int = INDEXED) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of ``docs`` (doc_id, text).

    Words are the folded runs of letters of whole texts, some of which have lost a sign by
    the hash of id and run, of at least LEAST_LENGTH signs and LEAST_NUMBER occurrences. A
    form is the near word of largest n, ties the smallest in order of code points, if it is
    at least twice as frequent. Null and empty texts have no words; a null id counts as the
    empty text; repeated rows count again. An empty table gives an empty result; other
    columns are ignored. ``indexed`` bounds the words of one index and changes no result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    words = checkpointed(words_of(docs).where((F.char_length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_NUMBER)))
    frequency = spark.sparkContext.broadcast(gram_numbers(words))
    block = ["gram", "nth", "size", "slice"]
    rows = dealt(words, frequency, indexed).repartition(*block).sortWithinPartitions(*block, "guest", "word")
    best = F.min(F.struct((-F.col("near_n")).alias("least"), F.col("near").alias("form")))
    near = near_pairs(rows).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    form_n = -F.col("best.least")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form_n >= TIMES * F.col("n"), F.struct(F.col("best.form").alias("form"), form_n.alias("n"))).alias("of"))
    found = checkpointed(found.select("word", "n", "n_near", F.col("of.form").alias("form"), F.col("of.n").alias("form_n")))
    roots = rooted(found.where(F.col("form").isNotNull()).select("word", "form"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: A CTE with CRC-32's table of remainders as list ``t``, by its rule, and the sum of a binary ``b`` beside it.
CRC_TABLE = "crc AS MATERIALIZED (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) r(b))"
CRC_OF_B = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(b)), lambda i: ('0x' || hex(b)[2 * i + 1 : 2 * i + 2])::BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])))"""
ORACLE_SQL = rf"""
WITH {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
distinct_runs AS (SELECT doc_id, run, count(*) AS n, encode(concat(doc_id, ':', run)) AS b FROM runs GROUP BY doc_id, run),
hashed AS (SELECT d.*, {CRC_OF_B} AS h FROM distinct_runs d CROSS JOIN crc),
spoilt AS (SELECT CASE WHEN h % {SPOILT} = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoilt WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_NUMBER}),
lessened AS MATERIALIZED (SELECT word, n, i, word[1 : i - 1] || word[i + 1 :] AS rest FROM words, unnest(range(1, length(word) + 1)) t(i)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM lessened a JOIN lessened b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM lessened a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM lessened a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {TIMES} * w.n THEN near END AS form, CASE WHEN near_n >= {TIMES} * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (WITH RECURSIVE up(word, root, step) AS (SELECT word, form, 1 FROM forms WHERE form IS NOT NULL UNION ALL SELECT u.word, f.form, step + 1 FROM up u JOIN forms f ON f.word = u.root WHERE f.form IS NOT NULL)
    SELECT word, arg_max(root, step) AS root FROM up GROUP BY word)
SELECT f.word, f.form, coalesce(c.root, f.word) AS root, f.n, f.n_near, f.form_n FROM forms f LEFT JOIN chain c ON c.word = f.word
"""
