"""Deterministic random numbers: functions of a seed and a key, whatever the partitions."""

from __future__ import annotations

import secrets
from math import exp, lgamma, log

from pyspark.sql import Column
from pyspark.sql import functions as F


def seed_of(seed: int | None) -> int:
    """The seed itself; without one, or for -1, a new one."""
    return secrets.randbits(31) if seed is None or seed == -1 else seed


def uniform(*key: Column | str | int) -> Column:
    """A number in [0, 1) from the md5 digest of the key's parts."""
    parts = [k if isinstance(k, Column) else F.lit(k) for k in key]
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_int(n: Column | int, *key: Column | str | int) -> Column:
    """A whole number in [0, n)."""
    return F.floor(uniform(*key) * (n if isinstance(n, Column) else F.lit(n))).cast("long")


def cumulative(weights: list[float]) -> list[float]:
    """Lower ends of the values' shares of [0, 1)."""
    total, out, at = sum(weights), [], 0.0
    for w in weights:
        out.append(at)
        at += w / total if total > 1e-12 else 0.0
    return out


def draw(u: Column, values: list, weights: list[float]) -> Column:
    """The value whose share of [0, 1) holds ``u``; all-zero weights give the first value."""
    if sum(weights) < 1e-12:
        return F.lit(values[0])
    low = F.array(*[F.lit(x) for x in cumulative(weights)])
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.size(F.filter(low, lambda c: c <= u)))


def poisson_weights(rate: float, most: int) -> list[float]:
    """Probabilities of 0 .. most events (k and weight stay aligned for any rate)."""
    if rate <= 0:
        return [1.0] + [0.0] * most
    return [exp(k * log(rate) - rate - lgamma(k + 1)) for k in range(most + 1)]


def poisson(u: Column, rate: float, most: int) -> Column:
    return draw(u, list(range(most + 1)), poisson_weights(rate, most))


def normal_lengths(mean: float, sd: float, least: int = 1) -> tuple[list[int], list[float]]:
    """Whole lengths within six standard deviations and their Gaussian weights."""
    values = [n for n in range(int(mean - 6 * sd), int(mean + 6 * sd) + 1) if n >= least]
    return values, [exp(-((n - mean) ** 2) / (2 * sd * sd)) for n in values]


def random_dna(length: Column, *key: Column | str | int) -> Column:
    """A string of uniformly drawn bases."""
    letters = F.lit("ACGT")
    places = F.when(length > 0, F.sequence(F.lit(0), (length - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, lambda i: F.substring(letters, (uniform_int(4, *key, i) + 1).cast("int"), F.lit(1))), "")
