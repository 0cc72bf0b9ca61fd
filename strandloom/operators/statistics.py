"""Robust statistics and discrete distributions as plans."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.lineage import checkpointed


#: Values that come to the driver to be put in order, and the sketch's accuracy: its ranks are off by 1 / ACCURACY at most.
GATHERED, ACCURACY = 20_000, 10_000


def ranked(values: DataFrame, rank: int, n: int) -> float:
    """The value of a rank (from 0) of the column ``x`` of ``values``, which has ``n`` rows.

    A sketch of bounded size names two values on either side of the rank; one count says
    between which of them it lies, and only that range is looked at further. The two are
    out of it each time, and it is usually a few thousandths of the values, so a few passes
    are enough for any number of rows; no task or driver holds the distinct values.
    """
    x = F.col("x")
    while True:
        if n <= GATHERED:
            for value, count in sorted(map(tuple, values.groupBy("x").count().collect())):
                if rank < count:
                    return value
                rank -= count
        shares = [max(0.0, (rank + 1) / n - 2 / ACCURACY), min(1.0, (rank + 1) / n + 2 / ACCURACY)]
        a, b = values.agg(F.percentile_approx("x", shares, ACCURACY)).first()[0]
        parts = [x < a, x == a, (x > a) & (x < b), (x == b) & F.lit(a < b), x > b]
        for part, value, count in zip(parts, [None, a, None, b, None], values.agg(*[F.count_if(p).alias(f"n{i}") for i, p in enumerate(parts)]).first(), strict=True):
            if rank < count:
                break
            rank -= count
        if value is not None:
            return value
        values, n = values.where(part), count


def quantiles(values: DataFrame, col: str | Column, shares: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation between neighbours; nulls and NaN don't count, null if there is none."""
    x = (F.col(col) if isinstance(col, str) else col).cast("double")
    rows = checkpointed(values.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x")))
    n = rows.count()
    known: dict[int, float] = {}
    out = []
    for share in shares:
        at = share * (n - 1)
        low, high = floor(at), ceil(at)
        for k in {low, high} - known.keys() if n else ():
            known[k] = ranked(rows, k, n)
        out.append(known[low] + (known[high] - known[low]) * (at - low) if n else None)
    return out


def median_and_deviation(values: DataFrame, col: str) -> DataFrame:
    """One row: the exact median and the median absolute deviation from it."""
    rows = checkpointed(values.select(F.col(col).cast("double").alias("x")))
    (median,) = quantiles(rows, "x", [0.5])
    (mad,) = (None,) if median is None else quantiles(rows, F.abs(F.col("x") - median), [0.5])
    return values.sparkSession.createDataFrame([(median, mad)], "median double, mad double")


def normalised(counts: DataFrame, n: str, by: list[str] | None = None, as_: str = "p") -> DataFrame:
    """Counts as shares of their group's total. The total is an aggregate of its own, not one task's window."""
    if by:
        return counts.withColumn(as_, F.col(n) / F.sum(n).over(Window.partitionBy(*by)))
    total = counts.agg(F.sum(n).alias("total"))
    return counts.join(F.broadcast(total)).withColumn(as_, F.col(n) / F.col("total")).drop("total")


def weighted_median_index(weights: Column) -> Column:
    """The first index whose running sum reaches half the total of an array of weights."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    held = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("at"))
    step = lambda s, x: F.struct(
        (s["sum"] + x["w"]).alias("sum"), F.when((s["at"] < 0) & (s["sum"] + x["w"] >= total / 2), x["i"]).otherwise(s["at"]).alias("at")
    )
    return F.aggregate(F.transform(weights, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), held, step, lambda s: s["at"])


def cdf_knots(dist: DataFrame, value: str, p: str, step: float = 0.1) -> DataFrame:
    """The values at which the running probability first passes each multiple of ``step``."""
    order = Window.orderBy(value)  # a distribution table: at most a few thousand rows
    upto = F.sum(p).over(order)
    passed = dist.select(value, F.floor((upto + 1e-12) / step).alias("level"))
    return passed.groupBy("level").agg(F.min(value).alias("knot")).where(F.col("level") > 0).select("knot").distinct()


def nearest_knot(values: DataFrame, value: str, knots: list[int]) -> DataFrame:
    """``values`` with the nearest of a few knots; ties go to the lower one."""
    each = F.array(*[F.struct(F.abs(F.col(value) - k).alias("d"), F.lit(k).alias("knot")) for k in knots])
    return values.withColumn("knot", F.array_min(each)["knot"])


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of each key the first in order, by partial aggregation (no sort of a group)."""
    every = F.struct(*rows.columns)
    return rows.groupBy(*keys).agg(F.min_by(every, F.struct(*order)).alias("row")).select("row.*")
