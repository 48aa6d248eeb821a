"""Statistics of accept/reject decisions as Column functions. Positive: slop; a decision is True for reject."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of the 95 % intervals.
Z = 1.96


def share(k: Column, n: Column) -> Column:
    """k / n as a double, 0 where n is 0."""
    return F.when(n == 0, F.lit(0.0)).otherwise(k.cast("double") / n.cast("double"))


def confusion(reject: str | Column = "reject", gt: str | Column = "gt_slop") -> list[Column]:
    """Aggregates tp, fp, fn, tn, n."""
    r, g = (F.col(x) if isinstance(x, str) else x for x in (reject, gt))
    return [F.count_if(r & g).alias("tp"), F.count_if(r & ~g).alias("fp"), F.count_if(~r & g).alias("fn"), F.count_if(~r & ~g).alias("tn"), F.count("*").alias("n")]


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return share(2 * tp, 2 * tp + fp + fn)


def phi(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Matthews correlation, 0 where a margin is empty; doubles before products, so counts can't overflow."""
    a, b, c, d = (x.cast("double") for x in (tp, fp, fn, tn))
    margins = (a + b) * (a + c) * (d + b) * (d + c)
    return F.when(margins == 0, 0.0).otherwise((a * d - b * c) / F.sqrt(margins))


def odds_ratio(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """With a half added to all cells, always."""
    return (tp + 0.5) * (tn + 0.5) / ((fp + 0.5) * (fn + 0.5))


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """(lo, hi), rounded to 3 places; (0, 0) where n is 0."""
    k, n = k.cast("double"), F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    centre, scale = p + z * z / (2 * n), 1 + z * z / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    lo, hi = (centre - half) / scale, (centre + half) / scale
    known = lambda x: F.when(n.isNull(), 0.0).otherwise(F.round(x, 3))
    return known(F.greatest(F.lit(0.0), lo)), known(F.least(F.lit(1.0), hi))


def lgamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1, by Stirling's series after a shift of 10."""
    y = x + 10.0
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3.0))) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    shift = F.lit(0.0)
    for k in range(10):
        shift = shift + F.log(x + float(k))
    return series - shift


def ln_choose(n: Column, k: Column) -> Column:
    n, k = n.cast("double"), k.cast("double")
    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
