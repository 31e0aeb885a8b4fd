"""Who talks when: timing and recovery features of a call from its segments (call_id, seq, channel, start, end)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.stats import or_zero, ratio, summary
from colloquy.operators.intervals import channel
from colloquy.operators.scans import by_time, scanned
from colloquy.schemas import AGENT, CALLER, RECOVERY_NAMES, TIMING_NAMES


def floor_switches(segments: DataFrame, width: float | None = None) -> DataFrame:
    """(call_id, channel, gap): where the speaker changes, the time since the other's segment ended; negative if it had not. width deals a call to buckets of time."""
    if width is None:
        order = Window.partitionBy("call_id").orderBy("start", "seq")
        rows = segments.select("call_id", "channel", "start", F.lag("end").over(order).alias("ended"), F.lag("channel").over(order).alias("before"))
    else:
        last = scanned(segments, ["call_id"], by_time("start", width), ["start", "seq"], own=False, lasts={"last": F.struct("end", "channel")})
        rows = last.select("call_id", "channel", "start", F.col("last.end").alias("ended"), F.col("last.channel").alias("before"))
    return rows.where(F.col("before") != F.col("channel")).select("call_id", "channel", (F.col("start") - F.col("ended")).alias("gap"))


def with_zeros(calls: DataFrame, parts: list[DataFrame], names: tuple[str, ...], extra: tuple[str, ...] = ()) -> DataFrame:
    """One row a call with the named columns; calls that a part lacks get zeros there."""
    out = calls
    for part in parts:
        out = out.join(part, "call_id", "left")
    return out.select("call_id", *extra, *[or_zero(F.col(n)).alias(n) for n in names])


def spoken(segments: DataFrame, carried: tuple[str, ...] = (), short=1.0) -> DataFrame:
    """(call_id, carried, what timing and recovery features are made of): one exchange by call, then ordered passes over it.

    segments: (call_id, seq, channel, start, end), a row with nulls for a call that has none, and carried columns, of
    which a call's first that is not null is kept. Each segment gives two boundaries. Read in order of time they count, at any of them, how
    many segments of a channel have begun and ended, which says how many pairs overlap without a pair ever being a row; read
    backwards they give the next start.
    """
    caller, agent = F.col("channel") == CALLER, F.col("channel") == AGENT
    order = Window.partitionBy("call_id").orderBy("start", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = segments.select(
        "call_id", *carried, "channel", "start", "end", "seq", F.row_number().over(order).alias("number"),
        (F.col("start") - F.lag("end").over(order)).alias("gap"), F.lag("channel").over(order).alias("channel_before"),
    )
    # at one instant: ends, then segments of no length (caller's first, each begun and ended), then starts, the agent's first
    none = F.col("end") <= F.col("start")
    opened = F.when(none, F.when(caller, 1).otherwise(2)).when(agent, 3).otherwise(4)
    closed = F.when(none, F.when(caller, 1).otherwise(2)).otherwise(0)
    edges = F.array(F.struct(F.col("start").alias("t"), opened.alias("kind"), F.lit(True).alias("opens")), F.struct(F.col("end").alias("t"), closed.alias("kind"), F.lit(False).alias("opens")))
    events = rows.withColumn("edge", F.explode(edges)).select("*", "edge.*")
    # in both directions what opens at an instant comes after what closes there: the next start is a later one
    on = Window.partitionBy("call_id").orderBy("t", "kind", F.desc("opens"), "number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("call_id").orderBy(F.desc("t"), "opens", F.desc("number")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = lambda which: F.sum(F.when(which, 1).otherwise(0)).over(on)
    opens = F.col("opens")
    counted = events.withColumns({
        "c_begun": so_far(caller & opens), "c_ended": so_far(caller & ~opens), "a_begun": so_far(agent & opens), "a_ended": so_far(agent & ~opens),
        "reach": F.max(F.when(agent & opens, F.col("end"))).over(on), "lasts": F.lead("t").over(Window.partitionBy("call_id").orderBy("t", "kind", F.desc("opens"), "number")) - F.col("t"),
        "next": F.last(F.when(caller & opens, F.struct("start", "end")), ignorenulls=True).over(ahead),
    })
    at_open, at_close = (lambda x: F.max(F.when(opens, x))), (lambda x: F.max(F.when(~opens, x)))  # of a segment's two boundaries
    pieces = counted.groupBy("call_id", "number").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in carried], *[F.first(c).alias(c) for c in ("channel", "start", "end", "gap", "channel_before")],
        at_open(F.when(caller, F.col("a_begun") - F.col("a_ended"))).alias("met"),
        (at_close(F.when(caller, F.col("a_begun")).otherwise(F.col("c_begun"))) - at_open(F.when(caller, F.col("a_ended")).otherwise(F.col("c_ended")))).alias("pairs"),
        at_close(F.when(caller & (F.col("end") - F.col("start") < F.lit(short)) & (F.col("reach") > F.col("start")), 1)).alias("back"),
        at_close(F.when(agent, F.col("next.start") - F.col("end"))).alias("wait"), at_close(F.when(agent, F.col("next.end") - F.col("next.start"))).alias("answer"),
        F.sum(F.col("lasts") * (F.col("c_begun") - F.col("c_ended")) * (F.col("a_begun") - F.col("a_ended"))).alias("shared"),
    )
    length, sides = F.col("end") - F.col("start"), {"caller": CALLER, "agent": AGENT}
    switch = lambda ch: F.when((F.col("channel") == ch) & (F.col("channel_before") != ch), F.col("gap"))
    # an agent's segment counts once for each caller's segment that it overlaps
    paired = F.when(agent & F.col("wait").isNotNull(), F.col("pairs"))
    n, total = F.sum(paired), F.sum(paired * F.col("wait"))
    mean, spread = F.try_divide(total, n), F.sqrt(F.greatest(F.try_divide(F.sum(paired * F.pow(F.col("wait") - F.col("wait_mean"), F.lit(2))), n), F.lit(0.0)))
    # the mean first, so that the spread is taken around it
    pieces = pieces.withColumn("wait_mean", (F.try_divide(total.over(whole := Window.partitionBy("call_id")), n.over(whole))))
    named = {}
    for side, ch in sides.items():
        named |= summary(F.when(F.col("channel") == ch, length), f"{side}_utterance", "mean std median cv", signed=True)
        named |= {f"{side}_speech": or_zero(F.sum(F.when(F.col("channel") == ch, length))), f"{side}_segment_count": F.count_if(F.col("channel") == ch)}
    positive = F.when(F.col("gap") >= 0, switch(CALLER))
    for x, prefix, parts in ((switch(CALLER), "caller_response_latency", "mean std cv median min max"), (positive, "caller_response_latency_pos", "mean median min max cv"), (switch(AGENT), "agent_response_latency", "mean std cv")):
        named |= summary(x, prefix, parts, signed=True)
    named |= summary(F.col("wait"), "agent_aligned_recovery", "count mean std cv") | summary(F.col("answer"), "agent_aligned_recovery_utterance", "mean std cv")
    named |= {
        "overlap_total_s": or_zero(F.sum("shared")), "overlap_event_count": or_zero(F.sum(F.when(caller, F.col("pairs")))),
        "post_overlap_recovery_mean_s": or_zero(mean), "post_overlap_recovery_cv": F.when(mean > 0, or_zero(F.try_divide(spread, mean))).otherwise(0.0), "post_overlap_recovery_count": or_zero(n),
        "caller_barge_in_count": or_zero(F.sum("met")), "caller_backchannel_count": or_zero(F.sum("back")),
        "agent_turn_fragmentation": ratio(F.count_if(agent) * F.count_if(agent), F.sum(F.when(agent, length))),
    }
    return pieces.groupBy("call_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in carried], *[c.alias(n) for n, c in named.items()])


def with_ratios(calls: DataFrame) -> DataFrame:
    """Rows of spoken() with a duration, and the timing features that are ratios to it or between the sides."""
    d = F.greatest(F.col("duration").cast("double"), F.lit(1e-6))
    caller, agent, shared = (or_zero(F.col(c)) for c in ("caller_speech", "agent_speech", "overlap_total_s"))
    n_caller, n_agent = or_zero(F.col("caller_segment_count")), or_zero(F.col("agent_segment_count"))
    return calls.withColumns({
        "caller_talk_ratio": caller / d, "agent_talk_ratio": agent / d, "overlap_ratio": shared / d, "silence_ratio": F.greatest(F.lit(0.0), 1.0 - (caller + agent - shared) / d),
        "turn_ratio": n_caller / F.greatest(n_agent, F.lit(1.0)), "caller_vs_agent_speech": caller / F.greatest(agent, F.lit(1e-6)),
        "caller_turns_per_min": n_caller / (d / 60.0), "caller_sec_per_turn": caller / F.greatest(n_caller, F.lit(1.0)),
    })


def timing_features(segments: DataFrame, calls: DataFrame) -> DataFrame:
    """The timing layer for calls (call_id, duration), in the unit of both; names end in _s for seconds."""
    return with_zeros(with_ratios(calls.join(spoken(segments), "call_id", "left")), [], TIMING_NAMES)


def recovery_features(segments: DataFrame, calls: DataFrame, short=1.0) -> DataFrame:
    """How the caller takes the floor back after agent turns and overlaps. short: length below which an overlapping turn is a backchannel."""
    return with_zeros(calls, [spoken(segments, short=short)], RECOVERY_NAMES)


def caller_gaps(segments: DataFrame, calls: DataFrame, whole_if_silent: bool) -> DataFrame:
    """(call_id, gap): positive pauses of the caller, before, between and after segments.

    A call without caller segments has none, or with whole_if_silent one of its whole length.
    """
    caller = channel(segments, CALLER)
    order = Window.partitionBy("call_id").orderBy("start", "seq")
    inner = caller.select("call_id", (F.col("start") - F.coalesce(F.lag("end").over(order), F.lit(0))).alias("gap"))
    last = caller.groupBy("call_id").agg(F.max_by("end", F.struct("start", "seq")).alias("last"))
    tail = calls.join(last, "call_id", "left" if whole_if_silent else "inner").select("call_id", (F.col("duration") - F.coalesce("last", F.lit(0))).alias("gap"))
    return inner.unionByName(tail).where("gap > 0")
