"""Codes of vectors, byte-level BPE and spelling variants against brute force."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from strandloom.llm import byte_bpe, spelling, vector_codes
from strandloom.llm.common import table

from .conftest import ROWS

VECTORS = "vec_id long, embedding array<float>, label int, code string"


def compressed_by_hand(rows, parts=8, entries=16, rounds=6):
    """The contract in plain Python: rows of (vec_id, embedding, label)."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    nearest = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(p, c[p])[1], []).append(c[p])
            for i, g in groups.items():
                books[p][i] = [sum(xs) // len(g) for xs in zip(*g, strict=True)]
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, by_label[label], sha) for (i, _, label), f, e in zip(kept, found, errors, strict=True)), key=str)


def rows_of(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


CODES = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def test_codes_equal_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i * 7 % 211, [rnd.gauss(0, 0.2) for _ in range(16)], rnd.choice([1, 2, 2, 2, None])) for i in range(200)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    rows += rows[:9] * 3  # repeated rows, and parts in equal distance of two entries
    rows += [(3000, None, 1), (3001, [None] + [0.0] * 15, 1), (3002, [math.nan] * 16, 1), (3003, [math.inf] + [0.0] * 15, None), (None, rows[0][1], None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], VECTORS).repartition(5)
    assert rows_of(vector_codes.compress(df), *CODES) == compressed_by_hand(rows)


def test_codes_of_few_and_odd_vectors(spark):
    few = [(1, [1.0] * 8, 1, "x"), (2, [2.0] * 8, 1, "x"), (3, [1e30, -1e30] + [0.0] * 6, None, "x"), (4, [5.0] * 3, 1, "x")]
    got = {r["vec_id"]: r for r in vector_codes.compress(spark.createDataFrame(few, VECTORS)).collect()}
    assert set(got) == {1, 2, 3, 4} and got[4]["code"] is None and got[4]["error"] is None
    assert got[1]["error"] == 0 and len(got[3]["code"]) == 16
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1, "x")], VECTORS)).count() == 0
    empty = vector_codes.compress(spark.createDataFrame([(1, [], 1, "x")], VECTORS)).collect()
    assert [(r["code"], r["error"], r["codebooks_sha256"]) for r in empty] == [("00" * 8, 0, hashlib.sha256(b"").hexdigest())]


def test_tree_finds_the_lowest_of_equal_entries():
    rng = np.random.default_rng(2)
    for width in (1, 2, 8):
        entries, points = rng.integers(-3, 4, (16, width)), rng.integers(-4, 5, (3000, width))
        d = ((points[:, None] - entries[None]) ** 2).sum(2)
        index, best = vector_codes.Tree(entries).nearest(points)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all()


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(byte_bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rnd = random.Random(8)
    signs = "ab 'stl\n\t é.,1½_ß<|>\x1c\x85\xa0 日👍🏽́"
    return ["", " ", "\n", "a" * 3000, " " * 500 + "x", "ab" * 700 + "!" * 999, "<|endoftext|>", "it's we'll I'D", "　x "] + ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 90))) for _ in range(500)]


def test_words_and_ids_equal_the_library(library):
    import regex

    v, cut = byte_bpe.Vocabulary(public_tokenizers.path(byte_bpe.RANKS)), regex.compile(byte_bpe.PRE_TOKENS)
    for t in odd_texts():
        ids = [i for w in cut.findall(t) for i in v.encode(w.encode())]
        assert ids == library.encode_ordinary(t)
        assert v.decode(np.array(ids, "<u4")) == t.encode()


def test_plain_texts_are_cut_alike():
    import regex

    rnd, cut = random.Random(3), regex.compile(byte_bpe.PRE_TOKENS)
    signs = [chr(c) for c in range(0x260)] + list("  \n's12_x")
    texts = ["".join(rnd.choice(signs) for _ in range(12)) for _ in range(20_000)]
    assert 1000 < sum(byte_bpe.PLAIN.fullmatch(t) is not None for t in texts) < 20_000
    assert all(byte_bpe.pre_tokens(t, cut) == cut.findall(t) for t in texts)


def test_white_space_is_that_of_the_library(library):
    import regex

    cut = regex.compile(byte_bpe.PRE_TOKENS)
    for c in [*range(0x21), *range(0x7F, 0xA2), 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), 0x205F, 0x2060, 0x3000, 0xFEFF]:
        t = f"a{chr(c)}{chr(c)}b {chr(c)}1"
        ids = [i for w in cut.findall(t) for i in library.encode_ordinary(w)]
        assert ids == library.encode_ordinary(t)


@pytest.mark.parametrize("chars, remembered, at_once", [(byte_bpe.BLOCK_CHARS, byte_bpe.REMEMBERED, byte_bpe.AT_ONCE), (300, 5, 20)])
def test_encoding_and_decoding_of_odd_rows(spark, odd, library, monkeypatch, chars, remembered, at_once):
    """With small blocks, memories and slices too: many blocks share words, and long texts are slices."""
    for name, value in (("BLOCK_CHARS", chars), ("REMEMBERED", remembered), ("AT_ONCE", at_once)):
        monkeypatch.setattr(byte_bpe, name, value)
    path = public_tokenizers.path(byte_bpe.RANKS)
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd_texts())], "doc_id long, text string")
    docs = odd.unionByName(more, allowMissingColumns=True)
    got = byte_bpe.decode(byte_bpe.encode(docs, path), path).collect()
    texts = [(i, t or "") for i, t, *_ in ROWS] + [(100 + i, t) for i, t in enumerate(odd_texts())]
    want = sorted(((i, np.array(library.encode_ordinary(t), "<u4").tobytes(), t.encode()) for i, t in texts), key=str)
    assert sorted(((r[0], bytes(r[1]), bytes(r[2])) for r in got), key=str) == want


def test_encoding_of_nothing(spark, nothing):
    path = public_tokenizers.path(byte_bpe.RANKS)
    assert byte_bpe.decode(byte_bpe.encode(nothing, path), path).count() == 0


def test_op12_of_the_small_tables(spark, small, library):
    want = []
    for r in table(spark, small, "documents").select("doc_id", "text").collect():
        ids = np.array(library.encode_ordinary(r[1] or ""), "<u4").tobytes()
        want.append((r[0], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert rows_of(byte_bpe.op12_byte_bpe(spark, small), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)


def spelt_by_hand(rows):
    fold = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(fold)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    signs = sorted({c for w in words for c in w})

    def near(w):
        out = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in signs} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in signs}
        return (out - {w}) & words.keys()

    found = {w: near(w) for w in words}
    form = {w: min(xs, key=lambda x: (-words[x], x)) for w, xs in found.items() if xs}
    form = {w: f for w, f in form.items() if words[f] >= 2 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), words[w], len(found[w]), words[form[w]] if w in form else None) for w in words), key=str)


SPELLING = ("word", "form", "root", "n", "n_near", "form_n")


def misspelt(n=900):
    """Texts of words over few letters, so that many are near, some of which repeat their grams."""
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abÀé") for _ in range(rnd.randint(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababababab", "abababababa", "bababababa"]
    texts = []
    for i in range(n):
        ws = []
        for _ in range(40):
            w = rnd.choice(base[: 1 + int(len(base) * rnd.random() ** 2)])
            k = rnd.randrange(len(w))
            ws.append(rnd.choice([w, w, w.upper(), w[:k] + w[k + 1 :], w[:k] + rnd.choice("abÀé") + w[k:]]))
        texts.append((i, rnd.choice([" ", ", ", "1", "\n日"]).join(ws)))
    return texts


@pytest.mark.parametrize("indexed", [spelling.INDEXED, 20])
def test_variants_equal_brute_force(spark, indexed):
    """With blocks in slices too."""
    rows = misspelt()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(spelling.variants(df, indexed), *SPELLING) == spelt_by_hand(rows)


def test_variants_of_odd_rows(spark, odd, nothing):
    rows = [(i, t) for i, t, *_ in ROWS]
    assert rows_of(spelling.variants(odd), *SPELLING) == spelt_by_hand(rows)
    assert spelling.variants(nothing).count() == 0
    long = spark.createDataFrame([(i, "x" * 5000 + " " + "xyz" * 2000 + "q" * (i % 2)) for i in range(8)], "doc_id long, text string")
    assert rows_of(spelling.variants(long), "word", "n_near") == rows_of(spark.createDataFrame([(w, k) for w, _, _, _, k, _ in spelt_by_hand([tuple(r) for r in long.collect()])], "word string, n_near long"), "word", "n_near")


def test_index_proposes_every_near_word():
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(5, 7))).encode() for _ in range(300)]
    for size in (5, 6, 7):
        index = spelling.Index()
        keys = lambda w: [g + i * spelling.GRAMS for i, g in enumerate(spelling.grams_of(w))]
        own = [w for w in words if len(w) == size]
        for w in own:
            index.add((w, 1, []), keys(w))
        for w in words:
            if len(w) in (size, size + 1):
                found = set(index.common(keys(w), len(w) > size))
                assert {i for i, x in enumerate(own) if spelling.one_edit(w, x)} <= found
