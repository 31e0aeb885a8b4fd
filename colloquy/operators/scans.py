"""Running values along a long sequence, split over tasks: each bucket by itself, then what the buckets before it carry in.

A window over a whole call makes that call one task's work. Here rows are dealt by call and bucket; each bucket is summed up in one
row, the exclusive scan of those few rows is what each bucket starts with, and rows only add it to their own running value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scanned(
    rows: DataFrame, by: Sequence[str], bucket: Column, keys: Sequence[str], backwards: bool = False, own: bool = True,
    sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, greatest: dict[str, Column] | None = None,
) -> DataFrame:
    """rows with running sums, last values that are not null, and greatest values, by name.

    Order is that of keys within by, which bucket must not contradict: a later bucket's rows come after. backwards reads it from the
    end. own says if a row's value counts itself. Ties of keys are in any order, as in a window.
    """
    sums, lasts, greatest = sums or {}, lasts or {}, greatest or {}
    rows = rows.withColumn("bucket_", bucket)
    order = [F.desc(k) if backwards else F.asc(k) for k in keys]
    here = Window.partitionBy(*by, "bucket_").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if own else -1)
    local = {n: F.sum(c).over(here) for n, c in sums.items()} | {n: F.last(c, ignorenulls=True).over(here) for n, c in lasts.items()} | {n: F.max(c).over(here) for n, c in greatest.items()}
    place = F.struct(*keys)
    final = F.min_by if backwards else F.max_by
    whole = [F.sum(c).alias(n) for n, c in sums.items()] + [final(c, F.when(c.isNotNull(), place)).alias(n) for n, c in lasts.items()] + [F.max(c).alias(n) for n, c in greatest.items()]
    totals = rows.groupBy(*by, "bucket_").agg(*whole)
    before = Window.partitionBy(*by).orderBy(F.desc("bucket_") if backwards else F.asc("bucket_")).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(b).alias(f"of_{b}") for b in by], F.col("bucket_").alias("of_bucket_"),
        *[F.sum(n).over(before).alias(f"in_{n}") for n in sums], *[F.last(n, ignorenulls=True).over(before).alias(f"in_{n}") for n in lasts], *[F.max(n).over(before).alias(f"in_{n}") for n in greatest],
    )
    same = F.col("bucket_") == F.col("of_bucket_")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"of_{b}"))
    joined = rows.select("*", *[c.alias(f"at_{n}") for n, c in local.items()]).join(carried, same, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = {n: zero(F.col(f"at_{n}")) + zero(F.col(f"in_{n}")) for n in sums} | {n: F.coalesce(f"at_{n}", f"in_{n}") for n in lasts} | {n: F.greatest(f"at_{n}", f"in_{n}") for n in greatest}
    return joined.select(*[c for c in rows.columns if c != "bucket_"], *[c.alias(n) for n, c in out.items()])


def by_time(t: str, width: float) -> Column:
    """Buckets of width along t."""
    return F.floor(F.col(t) / F.lit(width))
