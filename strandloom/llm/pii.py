"""Personal data: fixed patterns, and a character tagger for what they miss.

Where a text has an @ or a digit (no kind is without one), overlapping windows around it
are tagged by a bidirectional LSTM with CRF transitions, trained from labelled spans.
The windows' spans are reconciled over the whole text: of all of them, the
non-overlapping set with the greatest total confidence stays.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.char_tagger import Tagger, encode
from strandloom.llm.common import batches, bounded_batches, id_and_text, sampled_texts, table

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Numbers joined by points, as many as there are: of four in a row each, the first four, and so on, are the pattern's matches.
CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: What a window is laid around.
TRIGGER = re.compile(r"[0-9@]")
#: Width of a window, and the distance from one to the next.
WIDTH, STEP = 80, 40
#: Documents with a trigger (expected number) and windows to learn from; least mean confidence of a span (on held-out
#: made windows 0.5 and 0.9 differ by 4 wrong spans in 1,005, and find 0.91 and 0.79 of the phones).
SAMPLE, WINDOWS = 1000, 600
SURE = 0.5

Span = tuple[int, int, int]  # start, end, number of the kind


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each @ (the local part is the run before it)."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > free and text[s - 1] in LOCAL:
            s -= 1
        if s < at and (m := DOMAIN.match(text, at + 1)):
            out.append((s, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Matches of the pattern of addresses whose parts are 255 at most, in one pass over the digits."""
    out = []
    for m in CHAIN.finditer(text):
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            n = sum(map(len, parts[i : i + 4])) + 3
            if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in parts[i : i + 4]):
                out.append((at, at + n))
            at += n + 1
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by kind, then start; leftmost and non-overlapping in a kind."""
    out = [(s, e, 0) for s, e in emails(text)]
    if DIGIT.search(text):
        out += [(s, e, 1) for s, e in addresses(text)]
        cards = ((m, re.sub("[ -]", "", m[0])) for m in CARD.finditer(text))
        out += [(*m.span(), 2) for m, d in cards if 16 <= len(d) <= 19 and luhn(d)]
        out += [(*m.span(), 3) for m in PHONE.finditer(text) if 8 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def doubtful(text: str) -> list[tuple[int, int]]:
    """Matches of the patterns of cards and phones that fail their check, of ten digits at least."""
    ok = {(s, e) for s, e, _ in base_spans(text)}
    found = [m.span() for p in (CARD, PHONE) for m in p.finditer(text) if len(DIGIT.findall(m[0])) >= 10]
    return [x for x in found if x not in ok]


def tags_of(spans: Iterable[Span], begin: int, width: int) -> np.ndarray:
    """0 outside; 1 + 2k begins kind k and 2 + 2k goes on with it."""
    out = np.zeros(width, np.int64)
    for s, e, k in spans:
        if e > begin and s < begin + width:
            out[max(0, s - begin) : e - begin] = 2 + 2 * k
            if s >= begin:
                out[s - begin] = 1 + 2 * k
    return out


def spans_of(tags: np.ndarray, sure: np.ndarray, length: int) -> list[tuple[int, int, int, float]]:
    """(start, end, kind, mean confidence) of every run that begins and ends inside the window."""
    out, k = [], 0
    while k < length:
        if tags[k] % 2 == 1:
            e = k + 1
            while e < length and tags[e] == tags[k] + 1:
                e += 1
            out.append((k, e, int(tags[k] - 1) // 2, float(sure[k:e].mean())))
            k = e
        else:
            k += 1
    return out


def windows(text: str) -> list[int]:
    """Starts of windows that overlap by half and cover every trigger with its neighbourhood."""
    out, covered = [], -1
    for m in TRIGGER.finditer(text):
        at = m.start()
        if at >= covered:
            begin = max(0, at - STEP)
            if out and begin - out[-1] < STEP:
                begin = out[-1] + STEP
            out.append(begin)
            covered = begin + STEP + STEP // 2
    return out


def plausible(kind: int, s: str) -> bool:
    """An exact check of what the tagger found: the kind's own signs must be there."""
    digits = len(DIGIT.findall(s))
    if kind == 0:
        return s.count("@") == 1 and not s.startswith("@") and not s.endswith("@") and len(s) >= 6
    if kind == 1:
        parts = re.split(r"[.\[\]]+", s)
        return len([p for p in parts if p.isdigit() and int(p[-4:]) <= 255]) == 4
    if kind == 2:
        return 13 <= digits <= 19 and luhn("".join(DIGIT.findall(s)))
    return 9 <= digits <= 15 and bool(re.search(r"[ ().+-]", s))


def reconcile(spans: list[tuple[int, int, int, float]]) -> list[Span]:
    """The non-overlapping spans with the greatest total confidence; ties: fewer, earlier ones."""
    spans = sorted(set(spans), key=lambda s: (s[1], s[0], s[2]))
    ends = [s[1] for s in spans]
    total = [0.0]  # the most confidence of the first so many spans
    taken: list[int] = [-1]  # with this one as the last
    for n, (s, _, _, sure) in enumerate(spans):
        here = total[bisect_right(ends, s, 0, n)] + sure
        total.append(max(here, total[-1]))
        taken.append(n if here > total[n] else taken[-1])
    out, at = [], len(spans)
    while taken[at] >= 0:
        s, e, k, _ = spans[taken[at]]
        out.append((s, e, k))
        at = bisect_right(ends, s, 0, taken[at])
    return out[::-1]


def apart(spans: list[Span], known: list[Span]) -> list[Span]:
    """Those of ``spans`` that overlap none of ``known``."""
    begin = sorted(known)
    starts, reach = [s for s, *_ in begin], list(accumulate((e for _, e, _ in begin), max))
    out = []
    for s, e, k in spans:
        before = bisect_left(starts, e)  # known spans that begin before this one ends
        if not before or reach[before - 1] <= s:
            out.append((s, e, k))
    return out


def made_windows(contexts: list[str], n: int, seed: int = 4) -> list[tuple[str, list[Span]]]:
    """Labelled windows: spans of each kind in common spellings, and look-alikes that are none, between words."""
    r = np.random.default_rng(seed)
    words = [w for c in contexts for w in c.split() if w.isalpha()][:20_000] or ["the", "of", "and"]
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    num = lambda k: "".join(map(str, r.integers(0, 10, k)))
    word = lambda: "".join(map(chr, r.integers(97, 123, int(r.integers(3, 9)))))

    def card() -> str:
        d = pick("345") + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return d if r.random() < 0.5 else pick(" -").join(d[i : i + 4] for i in range(0, 16, 4))

    kinds = [
        lambda: pick([f"{word()}.{num(2)}@mail{num(1)}.example.com", f"{word()}@{word()}.org", f"{word()}.{word()}@{word()}.net", f"{word()}_{num(2)}@{word()}.{word()}.de", f"{word()}@{word()}"]),
        lambda: ".".join(str(int(r.integers(0, 256))) for _ in range(4)),
        card,
        lambda: pick([f"+{pick('123456789')} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(7)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(11)}", f"00{num(2)} {num(3)} {num(6)}"]),
    ]
    others = [lambda: num(int(r.integers(1, 6))), lambda: f"{num(1)}.{num(1)}.", lambda: f"{num(2)}.{num(1)}.{num(2)}", lambda: f"19{num(2)}-{num(2)}-{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: "@" + word(), lambda: word() + num(3), lambda: "AKIA" + num(8), lambda: num(9) + word() + num(5)]
    out = []
    for _ in range(n):
        text, spans = " ".join(pick(words) for _ in range(int(r.integers(1, 5)))) + " ", []
        for _ in range(int(r.integers(1, 4))):
            if (u := r.random()) < 0.7:
                # one, or numbers that only a space parts, which a pattern takes for one
                for k in pick([(0,), (0,), (0,), (1,), (2,), (3,), (3,)]) if u < 0.5 else pick([(3, 1), (2, 1), (3, 2), (2, 3), (1, 3)]):
                    s = kinds[k]()
                    spans.append((len(text), len(text) + len(s), k))
                    text += s + " "
                text = text[:-1]
            else:
                text += pick(others)()
            text += pick([" ", ". ", ", ", "\n"]) + " ".join(pick(words) for _ in range(int(r.integers(1, 4)))) + " "
        cut = int(r.integers(0, max(1, len(text) - WIDTH // 2)))
        out.append((text[cut : cut + WIDTH], [(s - cut, e - cut, k) for s, e, k in spans if s >= cut and e <= cut + WIDTH]))
    return out


def train(texts: list[str], n: int = WINDOWS, rounds: int = 14) -> Tagger:
    """From windows of ``texts``, labelled by the base patterns, and as many made ones.

    Every text gives a window before any gives its second one. Windows in which a pattern
    matched and failed its check aren't learned from: who wrote them may have meant such data.
    """
    turns: list[list[tuple[str, list[Span]]]] = []
    for t in texts:
        spans = base_spans(t)
        failed = sorted(doubtful(t))
        clear = [w for w in windows(t) if not any(s < w + WIDTH and w < e for s, e in failed)] if len(failed) < 1000 else []
        for turn, w in enumerate(clear[:n]):
            if turn == len(turns):
                turns.append([])
            turns[turn].append((t[w : w + WIDTH], [(s - w, e - w, k) for s, e, k in spans if s >= w and e <= w + WIDTH]))
    real = [x for turn in turns for x in turn][:n]
    rows = real + made_windows(texts[:50], 2 * n - len(real))
    codes = np.stack([encode(t, WIDTH) for t, _ in rows])
    tags = np.stack([tags_of(s, 0, WIDTH) for _, s in rows])
    model = Tagger.new(1 + 2 * len(KINDS))
    model.fit(codes, tags, rounds, 128, 0.015)
    return model


def found_spans(texts: list[str], model: Tagger, base: list[list[Span]] | None = None) -> list[list[Span]]:
    """All spans of each text: the base ones (found here if not given), then the tagger's where no base span lies."""
    base = list(base or map(base_spans, texts))
    at = [(i, w) for i, t in enumerate(texts) for w in windows(t)]
    more: dict[int, list[tuple[int, int, int, float]]] = {}
    for k in range(0, len(at), 256):
        part = at[k : k + 256]
        tags, sure = model.decode(np.stack([encode(texts[i][w : w + WIDTH], WIDTH) for i, w in part]))
        for (i, w), tg, su in zip(part, tags, sure, strict=True):
            n = min(WIDTH, len(texts[i]) - w)
            for s, e, kind, c in spans_of(tg, su, n):
                # a span at a window's edge may be cut; a neighbouring window has it whole
                if c >= SURE and (s > 0 or w == 0) and (e < n or w + n == len(texts[i])) and plausible(kind, texts[i][w + s : w + e]):
                    more.setdefault(i, []).append((w + s, w + e, kind, c))
    for i, spans in more.items():
        known = base[i]
        base[i] = sorted(known + apart(reconcile(spans), known), key=lambda x: (x[2], x[0], x[1]))
    return base


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Tagger:
    """Learn from the distinct texts with a trigger of about ``sample`` documents, in the order of their hashes."""
    rows = sampled_texts(docs, sample, 31, F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("text", F.lit(31)).alias("place"))
    return train([r[0] for r in sorted(rows.collect(), key=lambda r: (r[1], r[0]))])


def personal_data(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_tagged of every row of ``docs``.

    Offsets are code points, ends exclusive; counts are of base spans, n_tagged of those
    the tagger adds. Null and empty texts have none (the digest is that of the empty
    string). Repeated rows give repeated results, null ids stay, an empty table gives
    nothing, other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))  # a few thousand numbers

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches(frames):
            base = list(map(base_spans, texts))
            every = found_spans(texts, shared.value, base)
            counts = [pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in range(4)]
            digest = [hashlib.sha256(as_text(b).encode()).hexdigest() for b in base]
            added = pa.array([len(a) - len(b) for a, b in zip(every, base, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *counts, pa.array(digest), pa.array(list(map(as_text, every))), added], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_tagged"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_tagged long")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
