"""Whole plans over calls: audio and segments to features, features to verdicts."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.stats import or_zero
from colloquy.operators import backends
from colloquy.operators.evaluation import vad_benchmark
from colloquy.operators.layers import LAYERS, LEAST_S, good, heard, segments_of, voice_activity
from colloquy.operators.ledger import FRAME_S, conversation_metrics, ledger
from colloquy.operators.scoring import score, train
from colloquy.operators.timing import spoken, with_ratios
from colloquy.operators.transcripts import semantic_features
from colloquy.schemas import FEATURE_NAMES, INTERACTION_NAMES, MICRO_NAMES, RECOVERY_NAMES, TIMING_NAMES
from colloquy.session import settled
from colloquy.sources.audio import requests
from colloquy.sources.dataset import Dataset


def measured(audio: DataFrame, segments: DataFrame | None = None, heavy: bool = True, backend: str = "hybrid", least: float = LEAST_S, fallback=None) -> DataFrame:
    """features() with error and times, a row for every row of audio; those with an error have zeros.

    Sound is decoded and measured in one stage; what it yields, segments and numbers, goes through one exchange by call for
    the layers about who talks when. Only segments from elsewhere are joined to sound, once.
    """
    if segments is None and (fallback is not None or backend not in backends.DETECTORS):
        segments = voice_activity(audio, backend, least, fallback)
    layers = tuple(LAYERS) if heavy else ("acoustic",)
    rows = heard(audio, segments, layers, least, backend=backend)
    # a segment a row, the first with the call's own numbers
    own = F.struct("error", "duration", *layers, "times")
    split = rows.select("call_id", own.alias("own"), F.posexplode_outer("segments").alias("at", "s"))
    split = split.select("call_id", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("own")).alias("own"), "s.seq", "s.channel", "s.start", "s.end")
    found = with_ratios(spoken(split, ("own",)).select("*", "own.error", "own.duration", "own.times"))
    named = {"duration_s": or_zero(F.col("duration"))} | {n: or_zero(F.col(n)) for n in (*TIMING_NAMES, *RECOVERY_NAMES)}
    named |= {n: or_zero(F.col(f"own.{layer}.{n}")) if layer in layers else F.lit(0.0) for layer, names in LAYERS.items() for n in names}
    return found.select("call_id", "error", "times", *[named[n].alias(n) for n in FEATURE_NAMES])


def features(audio: DataFrame, segments: DataFrame | None = None, heavy: bool = True, backend: str = "hybrid", least: float = LEAST_S, fallback=None) -> DataFrame:
    """One row of the 85 features for each call of audio that could be read; call_ids are different.

    segments replaces voice activity detection by the named backend; least and fallback are its own. Without heavy the micro and interaction
    layers are 0 and are not computed.
    """
    return measured(good(audio), segments, heavy, backend, least, fallback).select("call_id", *FEATURE_NAMES)


def conversation(segments: DataFrame, calls: DataFrame, frame: float = FRAME_S) -> tuple[DataFrame, DataFrame]:
    """(ledger in seconds, metrics of each call)."""
    events = ledger(segments, calls, frame).select("call_id", "event_idx", "channel", (F.col("first") * F.lit(frame)).alias("start"), (F.col("last") * F.lit(frame)).alias("end"), "type")
    return events, conversation_metrics(events)


def detect(batch: DataFrame, model: dict, fallback=None) -> DataFrame:
    """(call_id, is_synthetic, confidence, views, error) for detection requests; those that can't be read say why."""
    # a request is a row, whatever others say its call_id is
    number, own = F.monotonically_increasing_id().cast("string"), F.concat(F.lit(":"), "call_id")
    found = measured(requests(batch.withColumn("call_id", F.concat(number, F.coalesce(own, F.lit(""))))), heavy=False, backend=model.get("vad_backend", "hybrid"), fallback=fallback)
    fine, at = F.col("error").isNull(), F.instr("call_id", ":")
    call_id = F.when(at > 0, F.substring("call_id", at + 1, F.length("call_id"))).alias("call_id")
    return score(found, model).select(call_id, *[F.when(fine, F.col(c)).alias(c) for c in ("is_synthetic", "confidence", "views")], "error")


def compare_depths(audio: DataFrame, model: dict) -> DataFrame:
    """(call_id, p_full, p_live, delta, flip, times, total_ms, live_ms): scores with and without the heavy layers, from one pass over the sound.

    times has the milliseconds of each sound layer of the call, null for one that was not computed; total_ms is their sum, live_ms
    that of the layers that a live answer needs.
    """
    found = measured(good(audio))
    full = score(found, model).withColumnRenamed("p", "p_full").select("call_id", "p_full", "times", *FEATURE_NAMES)
    live = score(full.withColumns({n: F.lit(0.0) for n in (*MICRO_NAMES, *INTERACTION_NAMES)}), model).withColumnRenamed("p", "p_live")
    spent = {"total_ms": ("segments", *LAYERS), "live_ms": ("segments", "acoustic")}
    sums = [sum((F.coalesce(F.col(f"times.{n}"), F.lit(0.0)) for n in names), F.lit(0.0)).alias(name) for name, names in spent.items()]
    return live.select("call_id", "p_full", "p_live", (F.col("p_live") - F.col("p_full")).alias("delta"), ((F.col("p_live") >= 0.5) != (F.col("p_full") >= 0.5)).alias("flip"), "times", *sums)


def labelled_features(data: Dataset, heavy: bool = False, backend: str = "hybrid", split: str | None = None) -> DataFrame:
    """features() of a data set's recordings with split and label of the manifest."""
    calls = data.calls(split)
    found = features(data.audio(split), heavy=heavy, backend=backend)
    return found.join(calls.select(F.col("anon_id").alias("call_id"), "split", "label"), "call_id")


def with_transcripts(rows: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Feature rows with the probe features of those calls that have a transcript."""
    return rows.join(semantic_features(transcripts), "call_id")


def train_from(data: Dataset, backend: str = "hybrid", **heads) -> dict:
    """A model document from a data set's recordings, by the light layers."""
    return train(labelled_features(data, backend=backend), **heads) | {"vad_backend": backend}


def benchmark_detectors(data: Dataset, split: str = "val", backends: Sequence[str] = ("energy", "hybrid")) -> DataFrame:
    """vad_benchmark() of a split against its turn files. A call's latency is the time that its detection took in its task."""
    audio, predicted, runs = data.audio(split), [], []
    for name in backends:
        found = settled(heard(good(audio), backend=name))  # so that segments and latencies are of one run
        predicted.append(segments_of(found).withColumn("backend", F.lit(name)))
        runs.append(found.select("call_id", F.lit(name).alias("backend"), F.col("times.segments").alias("latency_ms")))
    return vad_benchmark(functools.reduce(DataFrame.unionByName, predicted), data.turns(), functools.reduce(DataFrame.unionByName, runs))
