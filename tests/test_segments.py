"""Interval algebra, ledgers, timing and recovery on hand-made calls."""

import random
import statistics

import pytest

from colloquy.operators import intervals, layers, ledger, timing
from colloquy.schemas import FEATURE_NAMES, SEGMENTS, acoustic_names, behavioural_names


def calls(spark, duration, call="c"):
    return spark.createDataFrame([(call, float(duration))], "call_id string, duration double")


def one(df):
    return df.first().asDict()


def test_feature_groups_part_the_features():
    assert len(FEATURE_NAMES) == 85 and len(acoustic_names()) == 37 and len(behavioural_names()) == 47
    assert not set(acoustic_names()) & set(behavioural_names())


def turns(seed, n=14):
    """Segments of two calls in quarters of a second; those of one channel do not overlap."""
    draw, rows = random.Random(seed), []
    for call in "ab":
        for ch in (0, 1):
            at = 0.0
            for _ in range(n):
                at += draw.randint(1, 14) / 4
                end = at + draw.randint(1, 12) / 4
                rows.append([call, 0, ch, at, end])
                at = end
    rows.sort(key=lambda r: (r[0], r[3], r[2]))
    return [tuple([call, i, *rest]) for i, (call, _, *rest) in enumerate(rows)]


def spread(values):
    values = list(values)
    return (len(values), statistics.fmean(values), statistics.pstdev(values)) if values else (0, 0.0, 0.0)


def lengths(a, b):
    return max(0.0, min(a[4], b[4]) - max(a[3], b[3]))


def test_timing_against_loops(spark):
    rows = turns(11)
    got = {r["call_id"]: r.asDict() for r in timing.timing_features(spark.createDataFrame(rows, SEGMENTS), spark.createDataFrame([("a", 90.0), ("b", 120.0)], "call_id string, duration double")).collect()}
    for call, duration in (("a", 90.0), ("b", 120.0)):
        own = [r for r in rows if r[0] == call]
        caller, agent = ([r for r in own if r[2] == ch] for ch in (0, 1))
        gaps = [(b[2], b[3] - a[4]) for a, b in zip(own, own[1:]) if a[2] != b[2]]
        mine = [g for ch, g in gaps if ch == 0]
        shared = [x for a in caller for b in agent if (x := lengths(a, b)) > 0]
        f = got[call]
        assert f["caller_response_latency_mean_s"] == pytest.approx(statistics.fmean(mine)) and f["caller_response_latency_min_s"] == pytest.approx(min(mine))
        assert f["caller_response_latency_pos_median_s"] == pytest.approx(statistics.median([g for g in mine if g >= 0] or [0]))
        assert f["overlap_total_s"] == pytest.approx(sum(shared)) and f["overlap_event_count"] == len(shared) and f["caller_segment_count"] == len(caller)
        assert f["agent_talk_ratio"] == pytest.approx(sum(r[4] - r[3] for r in agent) / duration)
        assert f["caller_turns_per_min"] == pytest.approx(len(caller) / duration * 60)


def test_recovery_against_loops(spark):
    rows = turns(12)
    got = {r["call_id"]: r.asDict() for r in timing.recovery_features(spark.createDataFrame(rows, SEGMENTS), spark.createDataFrame([("a", 90.0), ("b", 120.0)], "call_id string, duration double")).collect()}
    for call in "ab":
        caller, agent = ([r for r in rows if r[0] == call and r[2] == ch] for ch in (0, 1))
        after = lambda at: min((c[3] - at for c in caller if c[3] > at), default=None)
        waits = [w for a in agent if (w := after(a[4])) is not None]
        pairs = [(c, a) for c in caller for a in agent if lengths(c, a) > 0]
        later = [w for _, a in pairs if (w := after(a[4])) is not None]
        f = got[call]
        n, mean, std = spread(waits)
        assert (f["agent_aligned_recovery_count"], f["agent_aligned_recovery_mean_s"], f["agent_aligned_recovery_std_s"]) == (n, pytest.approx(mean), pytest.approx(std))
        assert f["post_overlap_recovery_count"] == len(later) and f["post_overlap_recovery_mean_s"] == pytest.approx(spread(later)[1])
        assert f["caller_barge_in_count"] == sum(c[3] >= a[3] for c, a in pairs)
        assert f["caller_backchannel_count"] == sum(c[4] - c[3] < 1 and any(lengths(c, a) > 0 for a in agent) for c in caller)


def quarters(rows, call, ch):
    return {t for r in rows if r[0] == call and r[2] == ch for t in range(int(r[3] * 4), int(r[4] * 4))}


def test_iou_against_sets(spark):
    predicted, reference = turns(13), turns(14)
    got = {(r["call_id"], r["channel"]): r["iou"] for r in intervals.iou(*(spark.createDataFrame(r, SEGMENTS) for r in (predicted, reference))).collect()}
    for call, ch in got:
        p, r = quarters(predicted, call, ch), quarters(reference, call, ch)
        assert got[call, ch] == pytest.approx(len(p & r) / len(p | r))
    assert len(got) == 4


def test_difference_and_complement_against_sets(spark):
    rows = turns(15)
    s = spark.createDataFrame(rows, SEGMENTS)
    cells = lambda found, call: {t for r in found if r["call_id"] == call for t in range(int(r["start"] * 4), int(r["end"] * 4))}
    alone = intervals.difference(s).collect()
    free = intervals.complement(intervals.channel(s, 0), spark.createDataFrame([("a", 200.0), ("b", 200.0)], "call_id string, duration double")).collect()
    for call in "ab":
        assert cells(alone, call) == quarters(rows, call, 1) - quarters(rows, call, 0)
        assert cells(free, call) == set(range(800)) - quarters(rows, call, 0)
    assert [(r["start"], r["end"]) for r in intervals.complement(s.where("false"), calls(spark, 7)).collect()] == [(0, 7)]


def test_conversation_metrics_against_loops(spark):
    draw, rows = random.Random(16), []
    for call in "abc":
        at = 0.0
        for i in range(40):
            kind, ch = draw.choice([("speech", 0), ("speech", 1), ("overlap", None), ("silence", None)])
            end = at + draw.randint(1, 9) / 4
            rows.append((call, i, ch, at, end, kind))
            at = end
    got = {r["call_id"]: r.asDict() for r in ledger.conversation_metrics(spark.createDataFrame(rows, "call_id string, event_idx int, channel int, start double, end double, type string")).collect()}
    for call, m in got.items():
        own = [r for r in rows if r[0] == call]
        total = lambda kind, ch=None: sum(r[4] - r[3] for r in own if r[5] == kind and (ch is None or r[2] == ch))
        assert (m["caller_talk_s"], m["agent_talk_s"], m["overlap_s"], m["silence_s"]) == (total("speech", 0), total("speech", 1), total("overlap"), total("silence"))
        assert m["interruption_count"] == sum(r[5] == "overlap" for r in own)
        for name, trigger in (("mean_agent_response_latency_s", 1), ("mean_caller_response_latency_s", 0)):
            waits = [min((r[3] - t[4] for r in own if r[5] == "speech" and r[2] == 1 - trigger and r[3] > t[4]), default=None) for t in own if t[5] == "speech" and t[2] == trigger]
            assert m[name] == pytest.approx(spread(w for w in waits if w is not None)[1])


def test_calls_without_turns_have_zeros(spark):
    none = spark.createDataFrame([], SEGMENTS)
    assert set(one(timing.timing_features(none, calls(spark, 1))).values()) == {"c", 0.0, 1.0}  # all of it is silence
    assert set(one(timing.recovery_features(none, calls(spark, 1))).values()) == {"c", 0.0}
    assert one(layers.pause_entropy(none, calls(spark, 1)))["caller_pause_entropy"] == 0
    assert timing.caller_gaps(none, calls(spark, 1), whole_if_silent=False).count() == 0


def random_calls(spark, seed, n=40):
    draw, rows = random.Random(seed), []
    for call in "ab":
        for i in range(n):
            start = draw.randint(0, 300)
            rows.append((call, i, draw.randint(0, 1), float(start), float(start + draw.randint(1, 25))))
    return rows, spark.createDataFrame(rows, SEGMENTS)


def test_joins_against_loops(spark):
    rows, s = random_calls(spark, 1)
    caller, agent = intervals.channel(s, 0), intervals.channel(s, 1)
    c, a = [r for r in rows if r[2] == 0], [r for r in rows if r[2] == 1]
    pairs = sorted((x[0], x[1], y[1]) for x in c for y in a if x[0] == y[0] and x[3] < y[4] and y[3] < x[4])
    for width in (None, 7.0, 1000.0):
        got = intervals.overlap_join(caller, agent, width).collect()
        assert sorted((r["call_id"], r["a_seq"], r["b_seq"]) for r in got) == pairs
    for strict in (True, False):
        found = intervals.asof_forward(agent.select("call_id", "seq", intervals.F.col("end").alias("at")), caller, strict=strict).collect()
        for r in found:
            after = [(x[3], x[1]) for x in c if x[0] == r["call_id"] and (x[3] > r["at"] or not strict and x[3] == r["at"])]
            assert (r["r_start"], r["r_seq"]) == (min(after) if after else (None, None))
        assert len(found) == len(a)


def test_merge_and_union_against_loops(spark):
    rows, s = random_calls(spark, 2)
    merged, covered = [], {}
    for call in "ab":
        for ch in (0, 1):
            open_ = None
            for _, _, _, start, end in sorted((r for r in rows if r[0] == call and r[2] == ch), key=lambda r: (r[3], r[1])):
                if open_ and start - open_[1] < 5:
                    open_[1] = max(open_[1], end)
                else:
                    merged.append(open_ := [start, end, call, ch])
            covered[call, ch] = len({t for r in rows if r[0] == call and r[2] == ch for t in range(int(r[3]), int(r[4]))})
    got = intervals.merge_close(s, 5.0).collect()
    assert sorted([r["start"], r["end"], r["call_id"], r["channel"]] for r in got) == sorted(merged)
    assert {(r["call_id"], r["channel"]): r["length"] for r in intervals.union_length(s).collect()} == covered


def test_ledger_against_frames(spark):
    rows, s = random_calls(spark, 3)
    frame = 4.0
    got = ledger.ledger(s, s.groupBy("call_id").agg(intervals.F.lit(330.0).alias("duration")), frame).collect()
    for call in "ab":
        n = -int(-330.0 // frame)
        on = [[any(r[0] == call and r[2] == ch and int(r[3] // frame) <= f < -int(-r[4] // frame) for r in rows) for f in range(n)] for ch in (0, 1)]
        kinds = [("overlap", None) if x and y else ("speech", 0) if x else ("speech", 1) if y else ("silence", None) for x, y in zip(*on)]
        runs = []
        for f, kind in enumerate(kinds):
            if runs and runs[-1][0] == kind:
                runs[-1][2] = f + 1
            else:
                runs.append([kind, f, f + 1])
        mine = sorted((r["event_idx"], r["type"], r["channel"], r["first"], r["last"]) for r in got if r["call_id"] == call)
        assert mine == [(i, *kind, a, b) for i, (kind, a, b) in enumerate(runs)]


def test_mask_segments_against_a_loop(spark):
    draw = random.Random(4)
    mask, want = [], []
    for call in range(8):
        active = [draw.random() < 0.5 for _ in range(120)]
        mask += [(str(call), 0, i, x) for i, x in enumerate(active)]
        runs, begin = [], None
        for i, x in enumerate([*active, False]):
            if x and begin is None:
                begin = i
            if not x and begin is not None:
                runs.append([begin * 0.1, len(active) * 0.1 if i >= len(active) else i * 0.1 + 0.1])
                begin = None
        joined = []
        for start, end in runs:
            if joined and start - joined[-1][1] < 0.15:
                joined[-1][1] = end
            else:
                joined.append([start, end])
        want += [(str(call), a, b) for a, b in joined if b - a >= 0.35]
    got = ledger.mask_segments(spark.createDataFrame(mask, "call_id string, channel int, idx long, active boolean"), 0.1, 0.15, 0.35).collect()
    assert sorted((r["call_id"], r["start"], r["end"]) for r in got) == sorted(want)
