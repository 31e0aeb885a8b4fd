"""Turn ledgers: masks on a frame grid as runs, conversation metrics, masks to segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.stats import or_zero
from colloquy.operators.intervals import sweep
from colloquy.operators.scans import by_time, scanned
from colloquy.schemas import AGENT, CALLER, OVERLAP, SILENCE, SPEECH

FRAME_S = 0.032


def on_grid(segments: DataFrame, frame) -> DataFrame:
    """Segments as whole frames [start, end): any frame that a segment touches."""
    return segments.select("call_id", "seq", "channel", F.floor(F.col("start") / F.lit(frame)).alias("start"), F.ceil(F.col("end") / F.lit(frame)).alias("end")).where("end > start")


def ledger(segments: DataFrame, calls: DataFrame, frame=FRAME_S, width: int | None = None) -> DataFrame:
    """(call_id, event_idx, channel, first, last, type): frames [first, last) of speech, overlap or silence.

    calls: (call_id, duration). Runs follow from segment boundaries on the grid, so the cost is that of the
    segments and not of the frames. Overlap and silence have no channel. width deals a call to buckets of so many frames.
    """
    frames = calls.select("call_id", F.greatest(F.ceil(F.col("duration") / F.lit(frame)), F.lit(1)).alias("n"))
    grid = on_grid(segments, frame).join(frames, "call_id").select("call_id", "seq", "channel", F.greatest("start", F.lit(0)).alias("start"), F.least("end", "n").alias("end")).where("end > start")
    # a segment of no channel over the whole call makes the sweep cover it all
    whole = frames.select("call_id", F.lit(-1).alias("seq"), F.lit(-1).alias("channel"), F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))
    pieces = sweep(grid.unionByName(whole), width)
    speaker = F.when(F.col("n1") == 0, CALLER).when(F.col("n0") == 0, AGENT)
    kind = F.when((F.col("n0") > 0) & (F.col("n1") > 0), OVERLAP).when((F.col("n0") > 0) | (F.col("n1") > 0), SPEECH).otherwise(SILENCE)
    typed = pieces.select("call_id", "start", "end", kind.alias("type"), F.when(kind == SPEECH, speaker).alias("channel"))
    if width is not None:
        now, bucket = F.struct("type", "channel"), by_time("start", width)
        before = scanned(typed, ["call_id"], bucket, ["start"], own=False, lasts={"before": now})
        runs = scanned(before, ["call_id"], bucket, ["start"], sums={"run": F.when(F.col("before").eqNullSafe(now), 0).otherwise(1)})
        return _events(runs)
    order = Window.partitionBy("call_id").orderBy("start")
    same = F.lag("type").over(order).eqNullSafe(F.col("type")) & F.lag("channel").over(order).eqNullSafe(F.col("channel"))
    return _events(typed.withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(order)))


def _events(runs: DataFrame) -> DataFrame:
    return runs.groupBy("call_id", F.col("run").alias("event_idx"), "channel", "type").agg(F.min("start").alias("first"), F.max("end").alias("last")).select("call_id", (F.col("event_idx") - 1).cast("int").alias("event_idx"), "channel", "first", "last", "type")


def conversation_metrics(events: DataFrame) -> DataFrame:
    """One row a call from ledger events with start and end, read backwards once.

    The two latencies keep the names that reports use: the one called agent's is measured to the caller's
    next turn after an agent's, and the other way round.
    """
    length, order = F.col("end") - F.col("start"), Window.partitionBy("call_id").orderBy(F.desc("event_idx"))
    spoken, seen = F.col("type") == SPEECH, {}
    for side in (CALLER, AGENT):
        starts = F.when(spoken & (F.col("channel") == side), F.col("start"))
        # the next event may begin where this one ends, which is no later time; then the one after it counts
        near, far = (F.last(starts, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -n)) for n in (1, 2))
        seen[f"next_{side}"] = F.when(near > F.col("end"), near).otherwise(far)
    total = lambda kind, ch=None: or_zero(F.sum(F.when((F.col("type") == kind) & (F.lit(True) if ch is None else F.col("channel") == ch), length)))
    wait = lambda trigger, responder: or_zero(F.avg(F.when(spoken & (F.col("channel") == trigger), F.col(f"next_{responder}") - F.col("end"))))
    return events.withColumns(seen).groupBy("call_id").agg(
        total(SPEECH, CALLER).alias("caller_talk_s"), total(SPEECH, AGENT).alias("agent_talk_s"), total(OVERLAP).alias("overlap_s"), total(SILENCE).alias("silence_s"),
        F.count_if(F.col("type") == OVERLAP).alias("interruption_count"),
        wait(AGENT, CALLER).alias("mean_agent_response_latency_s"), wait(CALLER, AGENT).alias("mean_caller_response_latency_s"),
    )


def mask_segments(mask: DataFrame, frame: float, gap: float, least: float) -> DataFrame:
    """Segments of a frame mask (call_id, channel, idx, active).

    A run begins with its first active frame and ends one frame after the first inactive one, or with the
    last frame of the mask. Runs that begin less than gap after the one before ended join; what is then
    shorter than least goes.
    """
    order = Window.partitionBy("call_id", "channel").orderBy("idx")
    sized = mask.withColumn("n", F.max("idx").over(Window.partitionBy("call_id", "channel")) + 1).where("active")
    runs = sized.withColumn("run", F.col("idx") - F.row_number().over(order)).groupBy("call_id", "channel", "run").agg(F.min("idx").alias("low"), F.max("idx").alias("high"), F.first("n").alias("n"))
    end = F.when(F.col("high") + 1 >= F.col("n"), F.col("n") * F.lit(frame)).otherwise((F.col("high") + 1) * F.lit(frame) + F.lit(frame))
    runs = runs.select("call_id", "channel", F.col("low").alias("seq"), (F.col("low") * F.lit(frame)).alias("start"), end.alias("end"))
    by_start = Window.partitionBy("call_id", "channel").orderBy("start")
    apart = F.coalesce(F.col("start") - F.lag("end").over(by_start) >= F.lit(gap), F.lit(True))
    merged = runs.withColumn("island", F.sum(apart.cast("int")).over(by_start)).groupBy("call_id", "channel", "island").agg(F.min("seq").alias("seq"), F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.where(F.col("end") - F.col("start") >= F.lit(least)).select("call_id", "seq", "channel", "start", "end")


def hysteresis_segments(frames: DataFrame, frame, enter=0.5, leave=0.35, least=0.12, silence=0.28, pad=0.0) -> DataFrame:
    """Segments of frame probabilities (call_id, channel, idx, p): entered at enter or more, left below leave.

    Below leave a segment ends only if a frame below leave lies silence or more after the first such one, with none at enter or more between
    them; it ends at that first one, and one that is never left so ends with the channel. What is not longer than least goes.
    pad is added at both ends, where two segments are nearer than twice that, half of what is between them, whole frames or
    units only where frame is a whole number. frame, least, silence and pad have one unit; whole numbers do not round.
    """
    order = Window.partitionBy("call_id", "channel").orderBy("idx")
    to_here, before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    high, low = F.col("p") >= F.lit(enter), F.col("p") < F.lit(leave)
    mark = F.when(high, True).when(low, False)
    seen = frames.withColumns({
        "on": F.coalesce(F.last(mark, ignorenulls=True).over(to_here), F.lit(False)), "was": F.coalesce(F.last(mark, ignorenulls=True).over(before), F.lit(False)),
        "low_before": F.last(F.when(low, F.col("idx")), ignorenulls=True).over(before),
    })
    whole = seen.groupBy("call_id", "channel").agg((F.max("idx") + 1).alias("n"), F.max(F.when(low, F.col("idx"))).alias("last_low"))
    edges = seen.where(F.col("on") != F.col("was")).withColumn("off_before", F.last(F.when(~F.col("on"), F.col("idx")), ignorenulls=True).over(before))
    edges = edges.withColumn("off", F.lead("idx").over(order)).where("on")
    # a run opens a segment unless the pause before it was too short to end one
    ended = (F.col("low_before") - F.col("off_before")) * F.lit(frame) >= F.lit(silence)
    islands = edges.withColumn("island", F.sum(F.when(F.col("off_before").isNull() | ended, 1).otherwise(0)).over(to_here))
    found = islands.groupBy("call_id", "channel", "island").agg(F.min("idx").alias("seq"), F.max_by("off", "idx").alias("off"))
    by_island = Window.partitionBy("call_id", "channel").orderBy("island")
    found = found.withColumn("final", F.lead("island").over(by_island).isNull()).join(whole, ["call_id", "channel"])
    stays = F.col("final") & (F.col("off").isNull() | ((F.col("last_low") - F.col("off")) * F.lit(frame) < F.lit(silence)))
    found = found.select("call_id", "seq", "channel", (F.col("seq") * F.lit(frame)).alias("start"), (F.when(stays, F.col("n")).otherwise(F.col("off")) * F.lit(frame)).alias("end"), (F.col("n") * F.lit(frame)).alias("n"))
    found = found.where(F.col("end") - F.col("start") > F.lit(least))
    if not pad:
        return found.select("call_id", "seq", "channel", "start", "end")
    near = Window.partitionBy("call_id", "channel").orderBy("seq")
    half = (lambda gap: F.floor(gap / 2)) if isinstance(frame, int) else (lambda gap: gap / 2)
    gap_before, gap_after = F.col("start") - F.lag("end").over(near), F.lead("start").over(near) - F.col("end")
    more = lambda gap: F.when(gap < 2 * pad, half(gap)).otherwise(F.lit(pad))
    padded = found.select("call_id", "seq", "channel", F.greatest(F.col("start") - more(gap_before), F.lit(0)).alias("start"), F.least(F.col("end") + more(gap_after), F.col("n")).alias("end"))
    return padded


def segments_mask(segments: DataFrame, calls: DataFrame, frame: float = FRAME_S) -> DataFrame:
    """(call_id, channel, idx, active) for every frame of both channels of calls (call_id, duration): active where a segment touches it."""
    frames = calls.select("call_id", F.greatest(F.ceil(F.col("duration") / F.lit(frame)), F.lit(1)).cast("long").alias("n"))
    spans = on_grid(segments, frame).join(frames, "call_id").select("call_id", "channel", F.greatest("start", F.lit(0)).alias("low"), (F.least("end", "n") - 1).alias("high")).where("low <= high")
    # a span behind the last frame, so that what no span touches is the gap before one; frames are made where their span is, and not joined
    ends = frames.select("call_id", F.explode(F.array(F.lit(CALLER), F.lit(AGENT))).alias("channel"), F.col("n").alias("low"), (F.col("n") - 1).alias("high"))
    order = Window.partitionBy("call_id", "channel").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    after = F.coalesce(F.max("high").over(order), F.lit(-1)) + 1
    spans = spans.where(F.col("channel").isin(CALLER, AGENT)).unionByName(ends).withColumn("after", after)
    piece = lambda active, first, last: F.struct(F.lit(active).alias("active"), first.alias("first"), last.alias("last"))
    pieces = F.array(piece(False, F.col("after"), F.col("low") - 1), piece(True, F.greatest("low", "after"), F.col("high")))
    found = spans.select("call_id", "channel", F.explode(pieces).alias("piece")).where("piece.first <= piece.last")
    return found.select("call_id", "channel", F.explode(F.sequence("piece.first", "piece.last")).alias("idx"), "piece.active")


def resample_mask(mask: DataFrame, source: float, target: float, frames: DataFrame) -> DataFrame:
    """A mask on another grid: a target frame is active if a source frame that it overlaps is.

    mask: (call_id, channel, idx, active); frames: (call_id, n), the target frames of each call.
    """
    low, high = F.floor(F.col("idx") * F.lit(source) / F.lit(target)), F.ceil((F.col("idx") + 1) * F.lit(source) / F.lit(target)) - 1
    hit = mask.where("active").select("call_id", "channel", F.explode(F.sequence(low, F.greatest(low, high))).alias("idx")).distinct().withColumn("active", F.lit(True))
    grid = frames.select("call_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("idx")).join(mask.select("call_id", "channel").distinct(), "call_id")
    return grid.join(hit, ["call_id", "channel", "idx"], "left").select("call_id", "channel", "idx", F.coalesce("active", F.lit(False)).alias("active"))


def energy_mask(levels: DataFrame, floor: float = 0.12, margin: float = 14.0) -> DataFrame:
    """(call_id, channel, idx, db, active): louder by margin dB than the exact floor quantile of the call's channel."""
    bound = F.percentile("db", F.lit(floor)).over(Window.partitionBy("call_id", "channel"))
    return levels.select("call_id", "channel", "idx", "db", (F.col("db") > bound + F.lit(margin)).alias("active"))
