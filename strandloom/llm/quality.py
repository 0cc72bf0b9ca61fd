"""Quality scores by Bradley-Terry pairwise ranking.

Each pair of a better and a worse document is a match that the better one wins with
probability sigmoid(w . (x - y)); the weights come from the logistic loss on the
differences of surface features, over every pair that the labels give. The cut between
good and bad is an exact quantile of the scores of all documents learned from.

The sums over pairs take time in proportion to the documents. A pair's share in the loss
and its derivatives is a smooth function of two ranks; between ORDER points of a grid of
step STEP a polynomial says it to about 1e-9. So each class comes down to sums on the grid
(of ones and of features, shared out by that polynomial's weights), and pairs of grid
points stand for all pairs of documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandloom.llm.common import table
from strandloom.llm.labelled import added, arrays, every_labelled, scored, totals
from strandloom.operators.statistics import ranked

#: Distance of grid points, and how many of them stand for a rank.
STEP, ORDER = 0.125, 8
#: Newton steps, halved ones included: more than any input needed (the loss is strictly convex).
ROUNDS = 100
#: Pairs of grid points at once on the driver.
AT_ONCE = 1 << 22
THRESHOLD = 0.7
MODULUS, HELD = 4, 2
MARKS = np.frombuffer(bytes(b for b in range(33, 127) if not chr(b).isalnum()), np.uint8)
WORD = re.compile(rb"\S+")


def features(text: str) -> np.ndarray:
    """Shares and shapes of a text's signs, words and lines; all finite, also for empty texts."""
    raw = text.encode()
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    words = raw.split()
    w = max(1, len(words))
    length = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x]
    upper, lower = count[65:91].sum(), count[97:123].sum()
    distinct = len(set(words))
    again = sum(map(bytes.__eq__, words[1:], words))
    shares = [
        upper / n, lower / n, count[48:58].sum() / n, count[128:].sum() / n, count[32] / n, count[10] / n, count[:9].sum() / n,
        upper / max(1, upper + lower), count[MARKS].sum() / n,
        distinct / w, again / w, len(set(lines)) / max(1, len(lines)), np.sqrt(again / w),
    ]
    sizes = [
        np.log1p(n), np.log1p(w), np.log1p(len(lines)), float(length.mean()) if len(words) else 0.0, float(length.std()) if len(words) else 0.0,
        float(length.max(initial=0)) ** 0.5, distinct / w * np.log1p(w), np.log1p(distinct),
    ]
    marks = np.sqrt(count[MARKS] / n)
    return np.concatenate([shares, np.sqrt(np.maximum(shares, 0)), sizes, marks]).astype(np.float32)


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float = 0.0
    slope: float = 1.0

    def rank(self, x: np.ndarray) -> np.ndarray:
        """Ranks of rows of features; a row's doesn't depend on the rows beside it."""
        return (self.units(x) * self.weight).sum(1)

    def units(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def score(self, texts: list[str]) -> np.ndarray:
        """Rank as a number in [0, 1] that is THRESHOLD at the cut."""
        z = self.slope * (self.rank(np.array([features(t) for t in texts], np.float64)) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Sums rows by key: given a function of (features, labels) that returns (keys, rows of as many
#: numbers as features and one), its totals over all documents learned from, by ascending key.
Total = Callable[[Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]], tuple[np.ndarray, np.ndarray]]


def with_ones(x: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(x), 1)), x])


def on_grid(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first grid point, weights of it and the next ones) of ranks: Lagrange's polynomials."""
    first = np.floor(s / STEP).astype(np.int64) - (ORDER // 2 - 1)
    u, k = s / STEP - first, np.arange(ORDER)
    share = [np.prod([(u - j) / (i - j) for j in k if j != i], 0) for i in k]
    return first, np.stack(share, 1)


def grid_sums(model: Ranker) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Number and features of each class at each grid point, keyed by 2 x point + class."""

    def run(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = model.units(x)
        first, share = on_grid((z * model.weight).sum(1))
        z = with_ones(z)
        keys = 2 * first + y
        parts = [added(keys + 2 * k, z * share[:, k : k + 1]) for k in range(ORDER)]
        return added(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    return run


def curvature_sums(model: Ranker, keys: np.ndarray, bend: np.ndarray) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Products of features, weighted by ``bend`` (given at grid points) at each document's rank; keyed by row."""

    def run(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = model.units(x)
        first, share = on_grid((z * model.weight).sum(1))
        at = np.searchsorted(keys, 2 * (first[:, None] + np.arange(ORDER)) + y[:, None])
        return np.arange(z.shape[1]), (z * (bend[at] * share).sum(1)[:, None]).T @ with_ones(z)

    return run


def matches(keys: np.ndarray, sums: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(mean loss, its gradient, curvature at the grid points, mixed products of features) of all pairs."""
    points, good = (keys >> 1) * STEP, (keys & 1) == 1
    sums = np.where(good[:, None], sums / sums[good, 0].sum(), sums / sums[~good, 0].sum())
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    n, wide = sums[:, 0], sums.shape[1] - 1
    loss, grad, bend, mixed = 0.0, np.zeros(wide), np.zeros(len(keys)), np.zeros((wide, wide))
    for lo in range(0, len(a), max(1, AT_ONCE // len(b))):
        i = a[lo : lo + max(1, AT_ONCE // len(b))]
        d = points[i, None] - points[None, b]
        p = 1 / (1 + np.exp(np.clip(d, -700, 700)))  # chance that the worse one wins
        loss += float(n[i] @ np.logaddexp(0, -d) @ n[b])
        grad -= (p @ n[b]) @ sums[i, 1:] - (n[i] @ p) @ sums[b, 1:]
        v = p * (1 - p)
        bend[i] = v @ n[b]
        bend[b] += n[i] @ v
        mixed += sums[i, 1:].T @ v @ sums[b, 1:]
    return loss, grad, bend, mixed


def learned(total: Total, width: int, ridge: float = 1e-3) -> tuple[Ranker, np.ndarray]:
    """(ranker without a cut, numbers of documents of class 0 and 1): Newton steps on the mean loss of all pairs.

    Numbers are kept to single precision, below which the order of sums would show.
    Without both classes all weights are 0.
    """
    short = lambda x: x.astype(np.float32).astype(np.float64)
    flat = Ranker(np.zeros(width), np.ones(width), np.zeros(width))
    classes, sums = total(lambda x, y: added(y, with_ones(x)))
    count = np.zeros(2, np.int64)
    count[classes] = np.rint(sums[:, 0])
    if not count.all():
        return flat, count
    mean = short(sums[:, 1:].sum(0) / count.sum())
    _, sums = total(lambda x, y: added(0 * y, with_ones((x - mean) ** 2)))
    scale = short(np.sqrt(sums[0, 1:] / count.sum()) + 1e-6)
    w, step, least = np.zeros(width), np.zeros(width), np.inf
    for _ in range(ROUNDS):
        model = Ranker(mean, scale, w + step)
        keys, sums = total(grid_sums(model))
        loss, grad, bend, mixed = matches(keys, sums)
        loss += ridge / 2 * float(model.weight @ model.weight)
        if loss > least + 1e-8:  # beyond the grid's error
            step = step / 2
            continue
        w, least = model.weight, loss
        size = count[keys & 1]
        _, own = total(curvature_sums(model, keys, bend / size))
        curve = own[:, 1:] - mixed - mixed.T + (ridge + 1e-9) * np.eye(width)
        step = -np.linalg.solve(curve, grad + ridge * w)
        step *= min(1.0, 4.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-5:
            break
    model = Ranker(mean, scale, short(w + step))
    keys, sums = total(grid_sums(model))
    n, points = sums[:, 0] / count.sum(), (keys >> 1) * STEP  # the polynomials keep sums of squares
    spread = float(np.sqrt(max(0.0, n @ points**2 - (n @ points) ** 2)))
    model.slope = float(np.float32(min(4.0, 6.0 / spread))) if spread > 1e-6 else 1.0
    return model, count


def train(found: list[np.ndarray], label: np.ndarray, shares: np.ndarray, ridge: float = 1e-3) -> Ranker:
    """A ranker from arrays in memory; without both classes every text scores the cut."""
    x = np.array(found, np.float64).reshape(len(found), -1)
    model, count = learned(lambda part: added(*part(x, label)), len(features("")), ridge) if len(x) else (None, np.zeros(2, int))
    if not count.all():
        width = len(features(""))
        return Ranker(np.zeros(width), np.ones(width), np.zeros(width))
    s = model.rank(x)
    # the cut leaves the classes' shares on its two sides
    order = np.argsort(s)
    below = int((np.cumsum((shares / count)[label[order]]) <= shares[0] * (1 + 1e-9)).sum())
    model.cut = float(s[order[max(0, below - 1) : below + 1]].mean())
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Ranker:
    """Learn from every labelled document, of any length, that isn't held out.

    The features are computed once and kept in the checkpoint folder; each Newton step is
    two passes over them, which bring sums by grid point and by feature to the driver. The
    cut lies midway between the two neighbouring ranks that have as many documents below
    as class 0 has.
    """
    width = len(features(""))
    rows = every_labelled(docs, labels, "quality", MODULUS, HELD, features)
    model, count = learned(lambda part: totals(rows, part, width), width)
    if count.all():
        values = ranks(rows, model)
        low, high = (ranked(values, int(k), int(count.sum())) for k in (count[0] - 1, count[0]))
        model.cut = (low + high) / 2
    return model


def ranks(rows: DataFrame, model: Ranker) -> DataFrame:
    """The rank ``x`` of each of ``every_labelled``'s rows."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.rank(arrays([b])[0]))], names=["x"])

    return rows.mapInArrow(run, "x double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Null and empty texts have the features of an empty text. Repeated rows score alike;
    rows with a null id aren't held out; an empty table gives nothing; without labels
    every text scores the cut. Columns beyond doc_id and text are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # under a hundred numbers
    return scored(docs, MODULUS, HELD, threshold, lambda texts: model.value.score(texts))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
