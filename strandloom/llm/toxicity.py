"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed words and word beginnings. The model adds a weight
for each term and, for each pair, the product of two learned short vectors, so a pair
can count more (or less) than the sum of its terms.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from strandloom.llm.common import filtered, table
from strandloom.llm.labelled import labelled_features, scored

#: Hashed terms, length of a term's vector, labelled documents of each class.
SPACE, FACTORS, EACH = 1 << 18, 6, 2500
#: Bytes of a longer word's beginning, which is a term too.
STEM = 5
THRESHOLD = 0.5
#: Least documents of a term, and the share of terms chosen that may be there by chance.
LEAST, FALSE = 4, 0.2
#: Pairs: the most frequent terms looked at, least documents, and standard errors by which the classes must differ.
PAIRED, PAIR_LEAST, PAIR_TELLING = 2048, 20, 6.5
#: The margin of every text where nothing is known.
NOTHING = -30.0
MODULUS, HELD = 5, 0
#: Anything in ASCII but letters and digits divides words.
DIVIDE = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def terms(text: str) -> np.ndarray:
    """The distinct hashed terms of a text, sorted."""
    ws = text.lower().encode().translate(DIVIDE).split()
    found = {zlib.crc32(w) for w in ws}
    found.update(zlib.crc32(w[:STEM], 1) for w in ws if len(w) > STEM)
    return np.unique(np.fromiter(found, np.int64, len(found)) % SPACE)


@dataclass
class FactorizationMachine:
    bias: float
    weight: np.ndarray  # (SPACE,)
    vectors: np.ndarray  # (SPACE, FACTORS)

    def margin(self, docs: list[np.ndarray]) -> np.ndarray:
        size = np.array([len(d) for d in docs])
        out = np.full(len(docs), self.bias, np.float64)
        full = np.flatnonzero(size)
        if len(full):
            idx = np.concatenate([docs[i] for i in full])
            start = np.concatenate(([0], np.cumsum(size[full])[:-1]))
            v = self.vectors[idx]
            s = np.add.reduceat(v, start)
            out[full] += np.add.reduceat(self.weight[idx], start) + 0.5 * ((s * s).sum(1) - np.add.reduceat((v * v).sum(1), start))
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin([terms(t) for t in texts]), -30, 30)))


def log_factorials(n: int) -> np.ndarray:
    return np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1)))))


def chances(n_docs: np.ndarray, n_toxic: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Chance, if class and term were unrelated, that a term in ``n_docs`` documents is in so few or so many of class 1 (``n_toxic``).

    Twice the smaller tail of the hypergeometric law; ``n`` are the classes' numbers of documents.
    """
    f = log_factorials(int(n.sum()))
    choose = lambda a, b: f[a] - f[b] - f[a - b]
    out = np.ones(len(n_docs))
    for d in np.unique(n_docs):
        k = np.arange(max(0, d - n[0]), min(d, n[1]) + 1)
        p = np.exp(choose(n[1], k) + choose(n[0], d - k) - choose(n.sum(), d))
        both = 2 * np.minimum(np.cumsum(p), np.cumsum(p[::-1])[::-1])
        at = np.flatnonzero(n_docs == d)
        out[at] = np.minimum(1.0, both[n_toxic[at] - k[0]])
    return out


def telling_terms(docs: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Terms that the classes differ in, at a share FALSE of false ones (step-up procedure over all terms)."""
    n = np.bincount(label, minlength=2)
    seen = [np.bincount(np.concatenate([np.empty(0, np.int64), *(d for d, y in zip(docs, label, strict=True) if y == k)]), minlength=SPACE) for k in (0, 1)]
    tested = np.flatnonzero(seen[0] + seen[1] >= LEAST)
    if not len(tested):
        return tested
    p = chances((seen[0] + seen[1])[tested], seen[1][tested], n)
    order = np.argsort(p, kind="stable")
    good = np.flatnonzero(p[order] <= FALSE * np.arange(1, len(p) + 1) / len(p))
    return np.sort(tested[order[: good[-1] + 1]]) if len(good) else tested[:0]


def telling_pairs(docs: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Terms of pairs that stand together far more in one class, and tell more so than either of them alone.

    Looks at all pairs of the PAIRED most frequent terms that are in PAIR_LEAST documents of the sample.
    """
    n = np.bincount(label, minlength=2)
    seen = np.bincount(np.concatenate(docs), minlength=SPACE)
    common = np.flatnonzero(seen >= PAIR_LEAST)
    common = np.sort(common[np.argsort(-seen[common], kind="stable")[:PAIRED]])
    place = np.full(SPACE, -1)
    place[common] = np.arange(len(common))
    by_class = []
    for k in (0, 1):
        mine = [place[d] for d, y in zip(docs, label, strict=True) if y == k]
        has = np.zeros((len(mine), len(common)), np.float32)
        for row, at in zip(has, mine, strict=True):
            row[at[at >= 0]] = 1
        by_class.append(has)

    def deviation(in_clean: np.ndarray, in_toxic: np.ndarray) -> np.ndarray:
        pooled = (in_clean + in_toxic) / n.sum()
        return (in_toxic / n[1] - in_clean / n[0]) / np.sqrt(np.maximum(pooled * (1 - pooled), 1 / n.sum()) * (1 / n[0] + 1 / n[1]))

    alone = np.abs(deviation(by_class[0].sum(0), by_class[1].sum(0)))
    found = np.zeros(len(common), bool)
    for at in range(0, len(common), 128):
        together = [x[:, at : at + 128].T @ x for x in by_class]
        pair = np.abs(deviation(*together)) * (together[0] + together[1] >= PAIR_LEAST)
        i, j = np.nonzero((pair > PAIR_TELLING) & (pair > 1 + np.maximum(alone[at : at + 128, None], alone[None, :])))
        found[i + at] = found[j] = True
    return common[found]


def train(docs: list[np.ndarray], label: np.ndarray, shares: np.ndarray, rounds: int = 200, seed: int = 5) -> FactorizationMachine:
    """Fit by Adam on the logistic loss.

    Terms that neither the classes differ in nor pairs make telling keep weight 0: most
    are there by chance, and they would be learned by heart. Without labels of both
    classes nothing can be learned and every text scores 0; where no term tells
    anything, every text scores the share of class 1.
    """
    model = FactorizationMachine(0.0, np.zeros(SPACE, np.float32), np.zeros((SPACE, FACTORS), np.float32))
    if len(set(label.tolist())) < 2:
        model.bias = NOTHING
        return model
    docs = [d.astype(np.int64) for d in docs]
    tune = [i for i in range(len(docs)) if i % 5 == 0] if np.bincount(label, minlength=2).min() >= 25 else []
    held = set(tune)
    rest = [i for i in range(len(docs)) if i not in held]
    whole, docs, label = (docs, label), [docs[i] for i in rest], label[rest]
    prior = float(np.log(shares[1] / shares[0]))
    kept = np.union1d(telling_terms(docs, label), telling_pairs(docs, label))
    place = np.full(SPACE, -1)
    place[kept] = np.arange(len(kept))
    rows = [p[p >= 0] for p in (place[d] for d in docs)]
    size = np.array([len(r) for r in rows])
    if not size.any():
        model.bias = prior
        return model
    use = np.flatnonzero(size > 0)
    idx = np.concatenate([rows[i] for i in use])
    of = np.repeat(np.arange(len(use)), size[use])
    start = np.concatenate(([0], np.cumsum(size[use])[:-1]))
    y = label.astype(np.float64)
    rng = np.random.default_rng(seed)
    n = len(kept)
    # one matrix of weights and vectors, so that one pass updates both
    theta = np.concatenate([np.zeros((n, 1)), rng.normal(0, 0.05, (n, FACTORS))], axis=1)
    balance = float(np.log((y == 1).sum() / (y == 0).sum()))
    bias, m, u = balance, np.zeros_like(theta), np.zeros_like(theta)
    # weights and vectors are drawn towards zero
    damp = np.concatenate([np.full((n, 1), 1e-4), np.full((n, FACTORS), 5e-4)], axis=1)
    for t in range(1, rounds + 1):
        x = theta[idx]
        s = np.add.reduceat(x[:, 1:], start)
        z = np.full(len(y), bias)  # documents without a kept term have the bias alone
        z[use] += np.add.reduceat(x[:, 0], start) + 0.5 * ((s * s).sum(1) - np.add.reduceat((x[:, 1:] ** 2).sum(1), start))
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        each = g[use][of]
        grad = np.empty_like(theta)
        grad[:, 0] = np.bincount(idx, each, n)
        part = each[:, None] * (s[of] - x[:, 1:])
        for k in range(FACTORS):
            grad[:, k + 1] = np.bincount(idx, part[:, k], n)
        grad = grad / len(y) + damp * theta
        bias -= 0.5 * g.mean()
        m = 0.9 * m + 0.1 * grad
        u = 0.99 * u + 0.01 * grad * grad
        theta -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(u / (1 - 0.99**t)) + 1e-6)
    model.weight[kept] = theta[:, 0]
    model.vectors[kept] = theta[:, 1:]
    if tune:  # the bias that errs least on documents that the weights have not seen
        unseen = model.margin([whole[0][i] for i in tune])
        model.bias = -best_cut(unseen, whole[1][tune], shares)
    else:
        model.bias = bias + prior - balance
    return model


def best_cut(margin: np.ndarray, label: np.ndarray, shares: np.ndarray) -> float:
    """The cut between two unlike margins that errs least, the classes weighted by their true shares; of several the widest gap, then the highest."""
    value, at = np.unique(margin, return_inverse=True)
    weight = shares / np.maximum(np.bincount(label, minlength=2), 1)
    missed = np.concatenate(([0.0], np.cumsum(np.bincount(at, np.where(label == 1, weight[1], -weight[0])))))  # errors, less a constant, if all up to here are class 0
    edge = np.concatenate(([value[0] - 2], value, [value[-1] + 2]))
    least = np.flatnonzero(missed <= missed.min() + 1e-12)[::-1]
    k = least[np.argmax((edge[1:] - edge[:-1])[least])]
    return float((edge[k] + edge[k + 1]) / 2)


def fit(docs: DataFrame, labels: DataFrame, each: int = EACH) -> FactorizationMachine:
    """Learn from a bounded sample of ``each`` documents of each class."""
    return train(*labelled_features(docs, labels, "toxic", MODULUS, HELD, each, terms))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Null and empty texts have no terms: they score the bias alone. Repeated rows score
    alike; rows with a null id count as held out; an empty table gives nothing. Without
    labels of both classes nothing can be learned: every text scores 0. Columns beyond
    doc_id and text are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # SPACE x (FACTORS + 1) floats
    return scored(docs, MODULUS, HELD, threshold, lambda texts: model.value.score(texts))


def untoxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold.

    Null and empty texts are judged by the bias alone, repeated rows alike; null ids and
    columns of any name stay; an empty table gives nothing. Without labels of both
    classes all rows stay.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # SPACE x (FACTORS + 1) floats
    return filtered(docs, lambda texts: (model.value.score(texts) < threshold).tolist())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
