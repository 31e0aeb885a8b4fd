"""The stage that takes a call's sound once, against the operators over tables, and its plan."""

import random
import re

import numpy as np
import pytest

from colloquy.functions import signal as dsp
from colloquy.functions import spans as sp
from colloquy.operators import intervals, layers, ledger, timing
from colloquy.plans import calls
from colloquy.schemas import FEATURE_NAMES
from colloquy.sources import audio
from tests.test_sound_and_scores import RATE, speech, wav


def drawn(seed, n=12, high=60, zero=True):
    draw = random.Random(seed)
    return sorted((s / 4, (s + draw.choice([0] * zero + [1, 2, 5, 9])) / 4) for s in (draw.randint(0, high) for _ in range(draw.randint(0, n))))


def test_spans_against_tables(spark):
    """The rules for lists of a stage are those of the operators over segments."""
    cases = {f"c{k}": (drawn(k, zero=False), drawn(k + 1000, zero=False)) for k in range(25)}
    rows = [(c, i, ch, s, e) for c, both in cases.items() for ch, spans in enumerate(both) for i, (s, e) in enumerate(spans)]
    segments = spark.createDataFrame(rows, "call_id string, seq int, channel int, start double, end double")
    whole = spark.createDataFrame([(c, 18.0) for c in cases], "call_id string, duration double")
    caller = intervals.channel(segments, 0)

    def by_call(df, *names):
        found = {c: [] for c in cases}
        for r in df.collect():
            found[r["call_id"]].append(tuple(r[n] for n in names) if len(names) > 1 else r[names[0]])
        return {c: sorted(v) for c, v in found.items()}

    assert by_call(intervals.complement(caller, whole), "start", "end") == {c: sorted(sp.free(a, 18.0)) for c, (a, _) in cases.items()}
    assert by_call(intervals.difference(segments), "start", "end") == {c: sorted(sp.alone(b, a)) for c, (a, b) in cases.items()}
    assert by_call(intervals.starts_inside(intervals.channel(segments, 1), caller), "start") == {c: sorted(sp.inside([s for s, _ in b], a)) for c, (a, b) in cases.items()}
    for silent in (False, True):
        assert by_call(timing.caller_gaps(segments, whole, silent), "gap") == {c: sorted(sp.pauses(a, 18.0, silent)) for c, (a, _) in cases.items()}
    bits = {r["call_id"]: r["caller_pause_entropy"] for r in layers.pause_entropy(segments, whole).collect()}
    for c, (a, _) in cases.items():
        assert sp.bits_of(sp.pauses(a, 18.0, True)) == pytest.approx(bits.get(c, 0.0), abs=1e-12)


def test_runs_and_floor_against_tables(spark):
    draw = np.random.default_rng(4)
    levels = {f"c{k}": draw.choice([-60.0, -58.5, -20.0, -22.0], int(draw.integers(1, 300)), p=[0.4, 0.3, 0.2, 0.1]) for k in range(12)}
    rows = [(c, 0, i, float(x)) for c, db in levels.items() for i, x in enumerate(db)]
    table = spark.createDataFrame(rows, "call_id string, channel int, idx long, db double")
    found = {}
    for r in ledger.mask_segments(ledger.energy_mask(table), 0.01, 0.05, 0.03).collect():
        found.setdefault(r["call_id"], []).append((r["seq"], r["start"], r["end"]))
    for c, db in levels.items():
        assert sp.runs(db > sp.quantile(db, 0.12) + 14.0, 0.01, 0.05, 0.03) == sorted(found.get(c, []))


def test_correlation_block_by_block():
    draw = np.random.default_rng(8)
    for n, m in ((64, 64), (100, 90), (700, 900), (1000, 300), (4096, 4096)):
        a, b = draw.standard_normal(n) + 3, draw.standard_normal(m)
        a[30 : 30 + min(n - 30, m)] += b[: min(n - 30, m)]
        x, y = a - a.mean(), b - b.mean()
        low, high = 1, min(n // 4, 20)
        wanted = max(abs(sum(x[i + lag] * y[i] for i in range(min(m, n - lag)))) for lag in range(low, high + 1)) / (np.linalg.norm(x) * np.linalg.norm(y))
        for block in (32, 64, 100, 1 << 15):
            assert dsp.lagged_peak(a, b, 1000, 1.0, 20.0, block) == pytest.approx(wanted, abs=1e-9)


@pytest.fixture(scope="module")
def recorded(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("recorded")
    for k in range(3):
        (folder / f"c{k}.wav").write_bytes(wav([speech(k), speech(k + 5)]))
    (folder / "still.wav").write_bytes(wav([np.zeros(RATE), np.zeros(RATE)]))
    (folder / "bad.wav").write_bytes(b"no sound")
    return audio.wav_files(spark, str(folder))


def test_features_are_those_of_the_layers(recorded):
    """One pass gives what each layer gives by itself, over detected and over given segments."""
    ends = layers.calls_of(recorded)
    found = layers.energy_segments(recorded)
    for given in (None, found):
        got = {r["call_id"]: r for r in calls.features(recorded, given).collect()}
        assert set(got) == {"c0", "c1", "c2", "still"} and set(got["c0"].__fields__) == {"call_id", *FEATURE_NAMES}
        parts = [timing.timing_features(found, ends), timing.recovery_features(found, ends), layers.acoustic_features(recorded, found), layers.micro_features(recorded, found), layers.interaction_features(recorded, found)]
        for part in parts:
            for r in part.collect():
                for name in r.__fields__[1:]:
                    assert got[r["call_id"]][name] == pytest.approx(r[name], abs=1e-9), name
        assert all(got["still"][n] == 0 for n in FEATURE_NAMES if n not in ("duration_s", "silence_ratio"))
    light = {r["call_id"]: r for r in calls.features(recorded, heavy=False).collect()}
    assert light["c1"]["caller_f0_std"] == 0 and light["c1"]["caller_rms_mean"] == pytest.approx(got["c1"]["caller_rms_mean"])


def test_sound_is_read_once_and_stays_where_it_is(recorded):
    plan = calls.features(recorded)._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.find("== Initial Plan ==") :] if "== Initial Plan ==" in plan else plan
    lines = plan.splitlines()
    assert sum("Scan binaryFile" in line for line in lines) == 1
    assert sum("MapInPandas" in line for line in lines) == 2  # decoding, then all that hears
    exchanges = [i for i, line in enumerate(lines) if re.search(r"\bExchange ", line)]
    heard = next(i for i, line in enumerate(lines) if "MapInPandas" in line)
    assert len(exchanges) == 1 and exchanges[0] < heard  # above the stage, which lets no sound out


def test_rows_that_lie_about_sound(recorded):
    rows = {r["call_id"]: r for r in layers.heard(recorded, layers=("micro", "acoustic")).collect()}
    assert rows["bad"]["error"] == "wav" and rows["bad"]["segments"] is None and rows["bad"]["acoustic"] is None
    assert rows["still"]["segments"] == [] and rows["c0"]["times"]["micro"] >= 0 and "interaction" not in rows["c0"].asDict()


def test_depths_have_layer_times(recorded):
    part = {"feature_names": ["caller_f0_std"], "weights": [1.0], "mean": [0.0], "std": [1.0], "bias": -1.0}
    model = {"fusion_type": "concatenated", "acoustic": part, "behavioral": part, "concatenated": part}
    rows = calls.compare_depths(recorded, model).collect()
    assert {r["call_id"] for r in rows} == {"c0", "c1", "c2", "still"}
    for r in rows:
        assert r["total_ms"] == pytest.approx(sum(r["times"])) and r["live_ms"] == pytest.approx(r["times"]["segments"] + r["times"]["acoustic"]) and r["live_ms"] < r["total_ms"]
        assert r["delta"] == pytest.approx(r["p_live"] - r["p_full"]) and r["flip"] == ((r["p_live"] >= 0.5) != (r["p_full"] >= 0.5))
    full = {r["call_id"]: r["caller_f0_std"] for r in calls.features(recorded).collect()}
    assert all(r["p_full"] == pytest.approx(1 / (1 + np.exp(1 - full[r["call_id"]]))) and r["p_live"] == pytest.approx(1 / (1 + np.e)) for r in rows)


@pytest.mark.parametrize("seed", range(3))
def test_talk_of_odd_segments_against_pairs(spark, seed):
    """Segments of no length, ties and overlaps within a channel: what counting at boundaries gives is what pairs give."""
    cases = {f"c{k}": (drawn(seed * 100 + k, 14, 24), drawn(seed * 100 + k + 50, 14, 24)) for k in range(20)}
    rows = [(c, 2 * i + ch, ch, s, e) for c, both in cases.items() for ch, spans in enumerate(both) for i, (s, e) in enumerate(spans)]
    segments = spark.createDataFrame(rows, "call_id string, seq int, channel int, start double, end double")
    whole = spark.createDataFrame([(c, 9.0) for c in cases], "call_id string, duration double")
    got = {r["call_id"]: r for r in timing.recovery_features(segments, whole, short=0.6).join(timing.timing_features(segments, whole), "call_id").collect()}
    for c, (a, b) in cases.items():
        pairs = [(x, y) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        waits = [min(s for s, _ in a if s > y[1]) - y[1] for _, y in pairs if any(s > y[1] for s, _ in a)]
        r = got[c]
        assert r["overlap_event_count"] == len(pairs) and r["overlap_total_s"] == pytest.approx(sum(max(0, min(x[1], y[1]) - max(x[0], y[0])) for x, y in pairs))
        assert r["caller_barge_in_count"] == sum(x[0] >= y[0] for x, y in pairs)
        assert r["caller_backchannel_count"] == sum(x[1] - x[0] < 0.6 and any(x[0] < y[1] and y[0] < x[1] for y in b) for x in a)
        assert r["post_overlap_recovery_count"] == len(waits) and r["post_overlap_recovery_mean_s"] == pytest.approx(np.mean(waits) if waits else 0)
        assert r["post_overlap_recovery_cv"] == pytest.approx(np.std(waits) / np.mean(waits) if waits else 0, abs=1e-9)


def test_ledger_latencies_pass_over_touching_turns(spark):
    """A turn that begins just when another ends is no later turn: the one after it answers."""
    rows = [("a", 0, 1, 0.0, 1.0, "speech"), ("a", 1, 0, 1.0, 2.0, "speech"), ("a", 2, 1, 2.0, 3.0, "speech"), ("a", 3, None, 3.0, 4.0, "silence"), ("a", 4, 0, 4.0, 5.0, "speech")]
    events = spark.createDataFrame(rows, "call_id string, event_idx int, channel int, start double, end double, type string")
    got = ledger.conversation_metrics(events).first()
    assert got["mean_agent_response_latency_s"] == pytest.approx((3.0 + 1.0) / 2) and got["mean_caller_response_latency_s"] == 0
