"""Aggregates with the conventions that features, rankings and reports use.

Missing data is 0.0, never null. Spreads are population ones except in exploration. A coefficient of
variation is 0 unless the mean is positive (``positive``), or unless it is not zero (``signed``).
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def or_zero(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a over b, 0.0 where b is zero or either is null."""
    return or_zero(F.try_divide(a.cast("double"), b.cast("double")))


def summary(x: Column, prefix: str, parts: str = "mean std cv", signed: bool = False, seconds: bool = True) -> dict[str, Column]:
    """Aggregates of x by name: ``{prefix}_{part}`` with ``_s`` for all but cv and count. Nulls of x are left out."""
    mean, spread = F.avg(x), F.stddev_pop(x)
    useful = mean != 0 if signed else mean > 0
    columns = {
        "mean": or_zero(mean), "std": or_zero(spread), "median": or_zero(F.median(x)), "min": or_zero(F.min(x)), "max": or_zero(F.max(x)),
        "cv": F.when(useful, or_zero(F.try_divide(spread, mean))).otherwise(0.0), "count": F.count(x).cast("double"),
    }
    return {f"{prefix}_{p}{'_s' * (seconds and p not in ('cv', 'count'))}": columns[p] for p in parts.split()}


def effect_size(x: Column, positive: Column, sample: bool = True) -> Column:
    """Cohen's d of x between rows that are positive and the rest, 0.0 where the pooled spread is 0."""
    spread = F.stddev_samp if sample else F.stddev_pop
    sides = [F.when(positive, x), F.when(~positive, x)]
    pooled = F.sqrt(sum((F.pow(F.coalesce(spread(s), F.lit(0.0)), 2) for s in sides), F.lit(0.0)) / 2)
    return ratio(F.avg(sides[0]) - F.avg(sides[1]), F.nullif(pooled, F.lit(0.0)))


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))


def entropy(values: Column, low: Column, high: Column, by: list[str], bins: int = 8) -> tuple[Column, Column]:
    """(bin of a value, bits from the counts of bins): equal widths from low to high, the last bin closed.

    Where all values are equal they share one bin.
    """
    width = (high - low) / bins
    bin_ = F.when(high <= low, 0).otherwise(F.least(F.floor((values - low) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    return bin_.cast("int"), -(share * F.log2(share))
