"""Sound layers: features of decoded audio (sources.audio), from one Python stage that takes a call's sound once.

heard() finds voice activity in a call and measures every layer that is asked for while it holds the call's samples; what leaves the stage
are segments and numbers. So audio is decoded once and never shuffled. Segments given from elsewhere are joined
to the audio once, for all layers.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import signal as dsp
from colloquy.functions import spans as sp
from colloquy.functions.stats import or_zero
from colloquy.operators import backends
from colloquy.operators.timing import caller_gaps
from colloquy.schemas import ACOUSTIC_NAMES, AGENT, CALLER, INTERACTION_NAMES, MICRO_NAMES
from colloquy.session import small_batches
from colloquy.sources.audio import signal

#: Energy detection: frame and hop in seconds, then gap joined and least length of a segment; quantile of the floor and margin over it in dB.
FRAME_S, HOP_S, JOIN_S, LEAST_S = 0.025, 0.010, 0.28, 0.12
FLOOR, MARGIN_DB = 0.12, 14.0
SEGMENT = "struct<seq: int, channel: int, start: double, end: double>"
LAYERS = {"acoustic": ACOUSTIC_NAMES, "micro": MICRO_NAMES, "interaction": INTERACTION_NAMES}


def good(audio: DataFrame) -> DataFrame:
    return audio.where(F.col("error").isNull())


def calls_of(audio: DataFrame) -> DataFrame:
    """(call_id, duration) in seconds: of the longer channel."""
    return good(audio).select("call_id", (F.greatest("n0", "n1") / F.col("sample_rate")).alias("duration"))


def energy_levels(audio: DataFrame) -> DataFrame:
    """(call_id, channel, idx, db): the level of every frame of both channels."""

    def run(batches):
        for batch in batches:
            for row in batch.itertuples():
                for ch, pcm in ((CALLER, row.pcm0), (AGENT, row.pcm1)):
                    db = dsp.energy_levels(signal(pcm), row.sample_rate, FRAME_S, HOP_S)
                    yield pd.DataFrame({"call_id": row.call_id, "channel": ch, "idx": np.arange(len(db)), "db": db.astype(np.float64)})

    return small_batches(good(audio).select("call_id", "pcm0", "pcm1", "sample_rate")).mapInPandas(run, "call_id string, channel int, idx long, db double")


def voiced(sound: np.ndarray, rate: int, least: float = LEAST_S) -> list[tuple[int, float, float]]:
    """(seq, start, end) of one channel's voice activity by energy."""
    db = dsp.energy_levels(sound, rate, FRAME_S, HOP_S).astype(np.float64)
    return sp.runs(db > sp.quantile(db, FLOOR) + MARGIN_DB, HOP_S, JOIN_S, least) if len(db) else []


def _hybrid(sound: np.ndarray, rate: int, least: float) -> list[tuple[int, float, float]]:
    """Energy, and where that finds nothing in a channel the neural detector, if one is registered."""
    return voiced(sound, rate, least) or (backends.DETECTORS["neural"](sound, rate, least) if "neural" in backends.DETECTORS else [])


backends.register("energy", voiced)
backends.register("hybrid", _hybrid)


def acoustic(caller: np.ndarray, rate: int, turns: list[sp.Span], duration: float) -> list[float]:
    """ACOUSTIC_NAMES of a call. Segments of under 8 samples have no shape."""
    shapes = []
    for start, end in turns:
        part = dsp.cut(caller, start, end, rate)
        if len(part) >= 8:
            shapes.append((float(dsp.rms(part)), dsp.zero_crossings(part), *dsp.spectrum_shape(part, rate), dsp.crest(part), end - start))
    level, crossings, centroid, flatness, high_low, crest, length = (sp.spread(np.array(x)) for x in zip(*shapes)) if shapes else ((0.0, 0.0, 0.0),) * 7
    pause = sp.spread(sp.pauses(turns, duration, whole_if_silent=False))
    return [*level, *crossings[:2], *centroid[:2], *flatness[:2], *high_low[:2], *crest, pause[0], pause[2], length[2]]


def micro(caller: np.ndarray, rate: int, turns: list[sp.Span], duration: float, corrected: bool = False) -> list[float]:
    """MICRO_NAMES of a call: frame tracks of all caller segments, in their order. corrected: see signal.formants."""
    entropy, tracks = sp.bits_of(sp.pauses(turns, duration, whole_if_silent=True)), []
    for start, end in turns:
        rows = dsp.frames(dsp.cut(caller, start, end, rate), rate, 25.0, 10.0)
        if len(rows) and rows.shape[1] >= 32:
            f0, hnr = dsp.pitches(rows, rate)
            tracks.append((f0, hnr, dsp.rms(rows), dsp.formants(rows, rate, corrected), dsp.cepstra(rows, rate)))
    if not tracks:
        return [0.0] * 11 + [entropy, 0.0]
    f0, hnr, level, resonances, cepstra = (np.concatenate(t) for t in zip(*tracks))
    f = [sp.spread(resonances[resonances[:, i] > 0, i])[1] for i in range(3)]
    twice = dsp.deltas(dsp.deltas(cepstra)) if len(cepstra) >= 3 else np.zeros(1)
    return [*f, float(np.mean(f)), dsp.wobble(f0), dsp.wobble(level), *sp.spread(f0[f0 > 0])[1:], *sp.spread(hnr[hnr > 0]), entropy, float(twice.std())]


def interaction(caller: np.ndarray, agent: np.ndarray, rate: int, turns: list[sp.Span], others: list[sp.Span], duration: float) -> list[float]:
    """INTERACTION_NAMES of a call: breath, entrainment, yielding to interruptions, echo of the agent in the caller's channel."""
    long_gaps = [(before, start) for before, (start, end) in zip([0.0, *(e for _, e in turns)], turns) if end - start >= 2.0 and start - before >= 0.03]
    talk = sum(e - s for s, e in turns)
    breaths = sum(dsp.is_breath(caller, rate, s, e) for s, e in sp.free(turns, duration))
    before_long = sum(dsp.is_breath(caller, rate, s, e) for s, e in long_gaps)
    decays = sp.spread(np.array([dsp.yield_decay_db(caller, t, rate) for t in sp.inside([s for s, _ in others], turns)]))
    bleed = sp.spread(np.array([dsp.lagged_peak(dsp.cut(caller, s, e, rate), dsp.cut(agent, s, e, rate), rate) for s, e in sp.alone(others, turns) if e - s >= 0.08]))
    n = min(len(caller), len(agent))
    together = dsp.envelope_correlation(caller, agent, rate)
    return [breaths / talk if talk > 0 else 0.0, before_long / len(long_gaps) if long_gaps else 0.0, together, *decays[:2], dsp.lagged_peak(caller[:n], agent[:n], rate), bleed[0]]


def heard(audio: DataFrame, segments: DataFrame | None = None, layers: Sequence[str] = (), least: float = LEAST_S, corrected: bool = False, backend: str = "energy") -> DataFrame:
    """(call_id, error, duration, segments, then a struct for each layer of LAYERS asked for and times) for each row of audio.

    segments (call_id, seq, channel, start, end) replaces detection by a registered backend. times has the milliseconds of each layer, and of detection as
    segments. Rows with an error have nulls.
    """
    asked = [n for n in LAYERS if n in layers]
    timed = ["segments", *asked]
    schema = f"call_id string, error string, duration double, segments array<{SEGMENT}>, " + "".join(f"{n} struct<{', '.join(f'{x}: double' for x in LAYERS[n])}>, " for n in asked)
    schema += f"times struct<{', '.join(f'{n}: double' for n in timed)}>"
    given, known = segments is not None, dict(backends.DETECTORS)

    def one(row) -> tuple:
        rate, caller, agent = int(row.sample_rate), signal(row.pcm0), signal(row.pcm1)
        duration, times, found = max(len(caller), len(agent)) / rate, [], []
        began = time.perf_counter()
        if given:
            spoken = [] if row.given is None else [(s["start"], s["seq"], s["channel"], s["end"]) for s in row.given]
        else:
            spoken = [(start, seq, ch, end) for ch, sound in ((CALLER, caller), (AGENT, agent)) for seq, start, end in known[backend](sound, rate, least)]
        spoken = sorted(spoken)
        turns, others = ([(start, end) for start, _, ch, end in spoken if ch == side] for side in (CALLER, AGENT))
        for name in timed:
            if name == "acoustic":
                found.append(acoustic(caller, rate, turns, duration))
            elif name == "micro":
                found.append(micro(caller, rate, turns, duration, corrected))
            elif name == "interaction":
                found.append(interaction(caller, agent, rate, turns, others, duration))
            times.append((time.perf_counter() - began) * 1000)
            began = time.perf_counter()
        columns = [dict(zip(LAYERS[n], x)) for n, x in zip(asked, found)]
        return row.call_id, None, duration, [dict(zip(("start", "seq", "channel", "end"), s)) for s in spoken], *columns, dict(zip(timed, times))

    def run(batches):
        backends.DETECTORS.clear()  # a worker is used again, and may know one that is no longer registered
        backends.DETECTORS.update(known)  # those of the driver
        names = ["call_id", "error", "duration", "segments", *asked, "times"]
        for batch in batches:
            for row in batch.itertuples(index=False):
                nothing = (row.call_id, row.error, *[None] * (len(names) - 2))
                yield pd.DataFrame([one(row) if row.error is None else nothing], columns=names)

    wanted = audio.select("call_id", "pcm0", "pcm1", "sample_rate", "error")
    if given:
        mine = segments.groupBy("call_id").agg(F.collect_list(F.struct(F.col("seq").cast("int").alias("seq"), "channel", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))).alias("given"))
        wanted = wanted.join(mine, "call_id", "left")
    return small_batches(wanted).mapInPandas(run, schema)


def segments_of(rows: DataFrame) -> DataFrame:
    """Segments (call_id, seq, channel, start, end) of heard()."""
    return rows.select("call_id", F.explode("segments").alias("s")).select("call_id", F.col("s.seq").cast("long").alias("seq"), "s.channel", "s.start", "s.end")


def energy_segments(audio: DataFrame, least: float = LEAST_S) -> DataFrame:
    """Voice activity by energy: segments (call_id, seq, channel, start, end) of least seconds or more."""
    return segments_of(heard(good(audio), least=least))


def hybrid_segments(audio: DataFrame, least: float = LEAST_S, fallback=None) -> DataFrame:
    """Energy segments, and for channels where there are none those of fallback(audio), a segment detector."""
    found = energy_segments(audio, least)
    return found if fallback is None else with_fallback(found, fallback(audio))


def with_fallback(found: DataFrame, others: DataFrame) -> DataFrame:
    """found, and the segments of others on channels of calls where found has none."""
    return found.unionByName(others.join(found.select("call_id", "channel").distinct(), ["call_id", "channel"], "left_anti").select(*found.columns))


def voice_activity(audio: DataFrame, backend: str = "hybrid", least: float = LEAST_S, fallback=None) -> DataFrame:
    """Segments by a backend: a registered one, or with fallback, a detector from tables to tables, neural (that alone) or hybrid (where energy finds nothing)."""
    if backend == "neural" and fallback is not None:
        return fallback(audio).where(F.col("end") - F.col("start") >= F.lit(least))
    if backend == "hybrid" and fallback is not None:
        return hybrid_segments(audio, least, fallback)
    if backend == "neural" and backend not in backends.DETECTORS:
        raise ValueError("the neural backend needs a detector as fallback, or registered by that name")
    backends.detector(backend)
    return segments_of(heard(good(audio), least=least, backend=backend))


def _layer(name: str, audio: DataFrame, segments: DataFrame, **settings) -> DataFrame:
    rows = heard(good(audio), segments, (name,), **settings)
    return rows.select("call_id", *[or_zero(F.col(f"{name}.{n}")).alias(n) for n in LAYERS[name]])


def acoustic_features(audio: DataFrame, segments: DataFrame) -> DataFrame:
    return _layer("acoustic", audio, segments)


def micro_features(audio: DataFrame, segments: DataFrame, corrected: bool = False) -> DataFrame:
    return _layer("micro", audio, segments, corrected=corrected)


def interaction_features(audio: DataFrame, segments: DataFrame) -> DataFrame:
    return _layer("interaction", audio, segments)


def pause_entropy(segments: DataFrame, calls: DataFrame) -> DataFrame:
    """(call_id, caller_pause_entropy): bits of the caller's pauses in 8 equal bins of their range."""
    from colloquy.functions.stats import entropy

    gaps = caller_gaps(segments, calls, whole_if_silent=True)
    ranged = gaps.join(gaps.groupBy("call_id").agg(F.min("gap").alias("low"), F.max("gap").alias("high")), "call_id")
    bin_, bits = entropy(F.col("gap"), F.col("low"), F.col("high"), ["call_id"])
    return ranged.groupBy("call_id", bin_.alias("bin")).agg(F.count("*").alias("n")).select("call_id", bits.alias("bits")).groupBy("call_id").agg(F.sum("bits").alias("caller_pause_entropy"))
