"""Learned model tables as parameters of the simulator."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from strandloom.functions.sequence import BASES, TRINUCLEOTIDES
from strandloom.plans.simulate import MutationModel


def mutation_model(rates: DataFrame, probabilities: DataFrame, transitions: DataFrame, indels: DataFrame, homozygous: float = MutationModel.homozygous) -> MutationModel:
    """From the learner's tables, which are small: one row, 64, 192 and a row for each indel length.

    Trinucleotides that were never seen get the mean probability, those without
    transitions any other base alike. Zygosity isn't learned.
    """
    r = rates.first()
    p = {x["tri"]: x["p"] for x in probabilities.collect()}
    seen = [v for v in p.values() if v > 0]
    mean = sum(seen) / len(seen) if seen else 1.0
    moves: dict[str, list[float]] = {t: [0.0] * 4 for t in TRINUCLEOTIDES}
    for x in transitions.collect():
        moves[x["tri_ref"]][BASES.index(x["tri_alt"][1])] = x["p"]
    moves = {t: m if sum(m) > 0 else [float(b != t[1]) for b in BASES] for t, m in moves.items()}
    sizes = {x["size"]: x["p"] for x in indels.collect()}
    ins, gone = {n: w for n, w in sizes.items() if n > 0}, {-n: w for n, w in sizes.items() if n < 0}
    total = sum(sizes.values()) or 1.0
    return MutationModel(
        rate=min(0.3, r["rate"]),
        homozygous=homozygous,
        indel=1 - r["snp_share"],
        insertion=sum(ins.values()) / total,
        insertion_lengths=ins or {1: 1.0},
        deletion_lengths=gone or {1: 1.0},
        bias={t: p.get(t) or mean for t in TRINUCLEOTIDES},
        substitutions={t: tuple(m) for t, m in moves.items()},
    )


def fragment_lengths(model: DataFrame) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """Lengths and weights of the fragment model (tlen, p)."""
    rows = sorted((int(r["tlen"]), float(r["p"])) for r in model.collect())
    return tuple(n for n, _ in rows), tuple(w for _, w in rows)


def gc_scalars(model: DataFrame) -> list[float]:
    """Coverage scalars by GC count, from 0 up."""
    return [r["scalar"] for r in sorted(model.collect(), key=lambda r: r["gc"])]


def quality_chain(marginals: DataFrame, transitions: DataFrame) -> tuple[tuple[int, ...], tuple[np.ndarray, np.ndarray]]:
    """Qualities, and the chances at the first place and at each later one by the quality before.

    A quality that nothing followed stays.
    """
    first, moves = marginals.where("pos = 0").collect(), transitions.collect()
    kinds = sorted({r["q"] for r in first} | {q for r in moves for q in (r["q_prev"], r["q"])})
    at = {q: i for i, q in enumerate(kinds)}
    begin = np.zeros(len(kinds))
    for r in first:
        begin[at[r["q"]]] = r["p"]
    places = max((r["pos"] for r in moves), default=1)
    table = np.zeros((places, len(kinds), len(kinds)))
    for r in moves:
        table[r["pos"] - 1, at[r["q_prev"]], at[r["q"]]] = r["p"]
    empty = table.sum(2) == 0
    table[empty] = np.broadcast_to(np.eye(len(kinds)), table.shape)[empty]
    return tuple(kinds), (begin, table)
