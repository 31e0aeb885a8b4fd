"""Interval algebra over (call_id, channel, start, end, seq): joins, unions, differences, as-of matches.

Everything is an equi-join or a window on the call, so calls spread over the cluster and no pair of rows of
different calls ever meets. Joins on overlap can be given a bucket width: rows are then dealt by call and
bucket, which splits a very long call into independent parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.scans import by_time, scanned


def channel(segments: DataFrame, number: int) -> DataFrame:
    return segments.where(F.col("channel") == number)


def named(df: DataFrame, prefix: str, by: str = "call_id") -> DataFrame:
    """All columns but by get a prefix, so that two sides of a join stay apart."""
    return df.select(by, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c != by])


def overlaps(a: str = "a_", b: str = "b_") -> Column:
    """Half-open intervals share a point; touching is not overlap."""
    return (F.col(f"{a}start") < F.col(f"{b}end")) & (F.col(f"{b}start") < F.col(f"{a}end"))


def overlap_length(a: str = "a_", b: str = "b_") -> Column:
    return F.greatest(F.least(f"{a}end", f"{b}end") - F.greatest(f"{a}start", f"{b}start"), F.lit(0))


def overlap_join(left: DataFrame, right: DataFrame, width: float | None = None, how: str = "inner") -> DataFrame:
    """Pairs of one call that overlap, columns prefixed a_ and b_; how: inner, left_semi or left_anti (unprefixed).

    width deals inner joins by bucket of time; each pair is found only in the bucket of its later start.
    """
    a, b = named(left, "a_"), named(right, "b_")
    if how != "inner":
        joined = a.join(b.withColumnRenamed("call_id", "b_call"), (F.col("call_id") == F.col("b_call")) & overlaps(), how)
        return joined.select("call_id", *[F.col(f"a_{c}").alias(c) for c in left.columns if c != "call_id"])
    if width is None:
        return a.join(b, "call_id").where(overlaps())
    bucket = lambda t: F.floor(t / F.lit(width))
    a = a.withColumn("bucket", F.explode(F.sequence(bucket(F.col("a_start")), F.greatest(bucket(F.col("a_start")), bucket(F.col("a_end"))))))
    b = b.withColumn("bucket", F.explode(F.sequence(bucket(F.col("b_start")), F.greatest(bucket(F.col("b_start")), bucket(F.col("b_end"))))))
    once = F.col("bucket") == bucket(F.greatest("a_start", "b_start"))
    return a.join(b, ["call_id", "bucket"]).where(overlaps() & once).drop("bucket")


def starts_inside(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows of points whose start lies strictly inside an interval of the same call, each once."""
    b = named(intervals, "b_").withColumnRenamed("call_id", "b_call")
    inside = (F.col("b_start") < F.col("start")) & (F.col("start") < F.col("b_end"))
    return points.join(b, (F.col("call_id") == F.col("b_call")) & inside, "left_semi")


def asof_forward(triggers: DataFrame, responders: DataFrame, at: str = "at", strict: bool = True, width: float | None = None) -> DataFrame:
    """For each trigger the earliest responder start after it (or at it, unless strict), columns prefixed r_.

    Both sides are merged in time and read backwards once, so the cost is that of a sort however many
    triggers and responders a call has. Triggers without a responder have nulls. Ties of start go to the
    lesser seq. width deals a call to buckets of time, which tasks read by themselves.
    """
    keep = [c for c in triggers.columns if c != "call_id"]
    body = F.struct(*[F.col(c) for c in responders.columns if c != "call_id"])
    left = triggers.select("call_id", F.col(at).alias("t_"), F.lit(1).alias("side_"), F.lit(None).cast("long").alias("seq_"), F.struct(*keep).alias("own_"))
    right = responders.select("call_id", F.col("start").alias("t_"), F.lit(0 if strict else 2).alias("side_"), F.col("seq").cast("long").alias("seq_"), body.alias("r_"))
    merged = left.unionByName(right, allowMissingColumns=True)
    back = Window.partitionBy("call_id").orderBy(F.col("t_").desc(), F.col("side_").desc(), F.col("seq_").desc()).rowsBetween(Window.unboundedPreceding, -1)
    if width is None:
        found = merged.withColumn("next_", F.last("r_", ignorenulls=True).over(back))
    else:
        found = scanned(merged, ["call_id"], by_time("t_", width), ["t_", "side_", "seq_"], backwards=True, lasts={"next_": F.col("r_")})
    found = found.where("side_ = 1")
    return found.select("call_id", "own_.*", *[F.col(f"next_.{c}").alias(f"r_{c}") for c in responders.columns if c != "call_id"])


def merge_close(segments: DataFrame, gap, least=None) -> DataFrame:
    """Join segments of a call and channel that begin less than gap after all before them ended; then drop short ones."""
    order = Window.partitionBy("call_id", "channel").orderBy("start", "seq")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") - before < F.lit(gap), 0).otherwise(1)).over(order)
    merged = segments.withColumn("island_", island).groupBy("call_id", "channel", "island_").agg(F.min("seq").alias("seq"), F.min("start").alias("start"), F.max("end").alias("end"))
    merged = merged.select("call_id", "seq", "channel", "start", "end")
    return merged if least is None else merged.where(F.col("end") - F.col("start") >= F.lit(least))


def union_length(segments: DataFrame) -> DataFrame:
    """(call_id, channel, length): time covered at least once. Touching segments join."""
    order = Window.partitionBy("call_id", "channel").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.col("start"))), F.lit(0))
    return segments.select("call_id", "channel", fresh.alias("fresh")).groupBy("call_id", "channel").agg(F.sum("fresh").alias("length"))


def sweep(segments: DataFrame, width: float | None = None) -> DataFrame:
    """(call_id, start, end, n0, n1): the call cut at every boundary, with how many segments of each channel cover the piece.

    Boundaries of equal time are summed before the window, so it sees each instant once. width deals a call to buckets of time.
    """
    ends = [segments.select("call_id", F.col(t).alias("t"), *[F.when(F.col("channel") == c, step).otherwise(0).alias(f"d{c}") for c in (0, 1)]) for t, step in (("start", 1), ("end", -1))]
    instants = ends[0].unionByName(ends[1]).groupBy("call_id", "t").agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    if width is not None:
        counted = scanned(instants, ["call_id"], by_time("t", width), ["t"], sums={"n0": F.col("d0"), "n1": F.col("d1")})
        ended = scanned(counted, ["call_id"], by_time("t", width), ["t"], backwards=True, own=False, lasts={"end": F.col("t")})
        return ended.where("end is not null").select("call_id", F.col("t").alias("start"), "end", "n0", "n1")
    order = Window.partitionBy("call_id").orderBy("t")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    pieces = instants.select("call_id", F.col("t").alias("start"), F.lead("t").over(order).alias("end"), F.sum("d0").over(so_far).alias("n0"), F.sum("d1").over(so_far).alias("n1"))
    return pieces.where("end is not null")


def difference(segments: DataFrame, keep: int = 1, without: int = 0, width: float | None = None) -> DataFrame:
    """(call_id, start, end): where channel keep is active and channel without is not. width: see sweep()."""
    return sweep(segments, width).where((F.col(f"n{keep}") > 0) & (F.col(f"n{without}") == 0)).select("call_id", "start", "end")


def complement(segments: DataFrame, calls: DataFrame) -> DataFrame:
    """(call_id, start, end): time of calls (call_id, duration) that segments leave free; all of it if there are none."""
    order = Window.partitionBy("call_id").orderBy("start", "seq")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    inner = segments.select("call_id", F.coalesce(before, F.lit(0)).alias("from"), F.col("start").alias("to"))
    last = segments.groupBy("call_id").agg(F.max("end").alias("last"))
    tail = calls.join(last, "call_id", "left").select("call_id", F.greatest(F.coalesce("last", F.lit(0)), F.lit(0)).alias("from"), F.col("duration").alias("to"))
    return inner.unionByName(tail).where(F.col("to") > F.col("from")).select("call_id", F.col("from").alias("start"), F.col("to").alias("end"))


def iou(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """(call_id, channel, intersection, union, iou). The intersection sums all pairs, so self-overlap counts twice."""
    a = named(predicted, "a_").withColumn("key", F.struct("call_id", F.col("a_channel").alias("channel")))
    b = named(reference, "b_").withColumn("key", F.struct("call_id", F.col("b_channel").alias("channel"))).drop("call_id")
    shared = a.join(b, "key").where(overlaps()).groupBy("key").agg(F.sum(overlap_length()).alias("intersection")).select("key.*", "intersection")
    sizes = [union_length(s).withColumnRenamed("length", n) for s, n in ((predicted, "p"), (reference, "r"))]
    both = sizes[0].join(sizes[1], ["call_id", "channel"], "full").join(shared, ["call_id", "channel"], "left").na.fill(0, ["p", "r", "intersection"])
    total = F.col("p") + F.col("r") - F.col("intersection")
    return both.select("call_id", "channel", "intersection", total.alias("union"), F.when(total > 0, F.col("intersection") / total).otherwise(0.0).alias("iou"))
