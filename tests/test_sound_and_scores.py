"""Signals, audio sources, transcripts, statistics, scoring and whole plans."""

import base64
import io
import json
import random
import re
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.functions import signal as dsp
from colloquy.functions.stats import effect_size
from colloquy.operators import layers, ranking, scoring, transcripts
from colloquy.plans import calls
from colloquy.schemas import FEATURE_NAMES, REQUESTS, SEGMENTS, TRANSCRIPTS
from colloquy.sources import audio, tables

RATE = 8000


def wav(channels, rate=RATE):
    with io.BytesIO() as out:
        with wave.open(out, "wb") as file:
            file.setnchannels(len(channels))
            file.setsampwidth(2)
            file.setframerate(rate)
            file.writeframes((np.stack(channels, 1) * 32767).astype("<i2").tobytes())
        return out.getvalue()


def tone(hz, seconds, level=0.3):
    return level * np.sin(2 * np.pi * hz * np.arange(int(RATE * seconds)) / RATE)


def speech(seed, seconds=4.0):
    """Bursts of a voice-like sound between near silence."""
    noise = np.random.default_rng(seed)
    t = np.arange(int(RATE * seconds)) / RATE
    on = (np.floor(t * 1.25 + seed * 0.5) % 2).astype(float)
    return on * (0.3 * np.sin(2 * np.pi * (140 + 20 * seed) * t) + 0.1 * np.sin(2 * np.pi * 900 * t)) + 0.001 * noise.standard_normal(len(t))


def test_pitch_and_spectrum():
    for lag in (25, 38, 61):  # of a sound that repeats after so many samples
        period = np.random.default_rng(lag).standard_normal(lag)
        f0, hnr = dsp.pitches(np.tile(period, 20)[None, :700], RATE)
        assert f0[0] == pytest.approx(RATE / lag) and hnr[0] > 10
    assert dsp.pitches(np.random.default_rng(0).standard_normal((1, 700)), RATE)[1][0] < 3
    x = np.random.default_rng(6).standard_normal(240)
    power = np.abs(np.array([sum(x * np.exp(-2j * np.pi * k * np.arange(240) / 240)) for k in range(121)])) ** 2
    hz = np.arange(121) * RATE / 240
    centroid, flatness, ratio = dsp.spectrum_shape(x, RATE)
    assert centroid == pytest.approx((hz * power).sum() / power.sum()) and flatness == pytest.approx(np.exp(np.log(power + 1e-12).mean()) / power.mean())
    assert ratio == pytest.approx(power[hz >= 1000].sum() / power[hz < 1000].sum())
    assert dsp.spectrum_shape(np.zeros(90), RATE) == (0.0, 0.0, 0.0)
    signs = np.sign(x)
    assert dsp.zero_crossings(x) == pytest.approx(np.mean(signs[1:] != signs[:-1])) and dsp.crest(x) == pytest.approx(np.abs(x).max() / np.sqrt(np.mean(x * x)))


def test_autocorrelation_and_prediction_against_definitions():
    x = np.random.default_rng(1).standard_normal((3, 90))
    centred = x - x.mean(axis=1, keepdims=True)
    corr = dsp.autocorrelations(x, 12)
    for row, got in zip(centred, corr):
        assert got == pytest.approx([row[: 90 - k] @ row[k:] for k in range(13)])
    for r, a in zip(corr, dsp.predictors(corr)):
        toeplitz = np.array([[r[abs(i - j)] for j in range(12)] for i in range(12)])
        assert a[1:] == pytest.approx(np.linalg.solve(toeplitz, r[1:13]))
    assert dsp.predictors(np.zeros((1, 13)))[0].tolist() == [1.0] + [0.0] * 12


def test_formants_find_a_pole_when_corrected():
    draw, y = np.random.default_rng(2), np.zeros(800)
    for i in range(2, 800):
        y[i] = 2 * 0.97 * np.cos(2 * np.pi * 1000 / RATE) * y[i - 1] - 0.97**2 * y[i - 2] + draw.standard_normal()
    assert np.abs(dsp.formants(y[None, :], RATE, corrected=True)[0] - 1000).min() < 100


def test_cepstra_and_deltas():
    rows = np.random.default_rng(3).standard_normal((5, 200))
    assert dsp.cepstra(rows, RATE).shape == (5, 12)
    assert dsp.deltas(np.array([[1.0], [3.0], [7.0]])).tolist() == [[1.0], [3.0], [2.0]]
    assert dsp.wobble(np.array([1.0, 0, 3.0])) == 1.0


def test_lagged_peak_against_its_definition():
    low, high = 40, 75  # 5 to under 9.5 ms of samples
    for seed, lag, level in ((5, None, 0), (6, 52, 0.6), (7, 71, 0.35)):
        a, b = np.random.default_rng(seed).standard_normal((2, 900))
        if lag:
            a = 0.2 * a
            a[lag:] += level * b[:-lag]
        x, y = a - a.mean(), b - b.mean()
        direct = {k: abs(x[k:] @ y[:-k]) / (np.linalg.norm(x) * np.linalg.norm(y)) for k in range(low, high + 1)}
        assert dsp.lagged_peak(a, b, RATE) == pytest.approx(max(direct.values()))
        assert not lag or max(direct, key=direct.get) == lag


@pytest.fixture(scope="module")
def recordings(spark):
    rows = [("a", wav([speech(0), speech(1)])), ("b", wav([speech(2), 0.5 * speech(1)])), ("mono", wav([tone(300, 1)])), ("rate", wav([tone(300, 1)] * 2, 44100)), ("wav", b"nothing"), ("base64", None)]
    return audio.decoded(spark.createDataFrame(rows, "call_id string, content binary")).cache()


def test_errors_are_rows(recordings):
    got = {r["call_id"]: r["error"] for r in recordings.collect()}
    assert got == {"a": None, "b": None, "mono": "stereo", "rate": "rate", "wav": "wav", "base64": "base64"}


def test_energy_segments_lie_where_sound_is(recordings):
    got = layers.energy_segments(recordings).where("call_id = 'a' and channel = 0").orderBy("start").collect()
    assert [(round(r["start"], 1), round(r["end"], 1)) for r in got] == [(0.8, 1.6), (2.4, 3.2)]
    assert layers.hybrid_segments(recordings).count() == layers.energy_segments(recordings).count()


def test_features_of_recordings(recordings):
    full = {r["call_id"]: r for r in calls.features(recordings).collect()}
    live = {r["call_id"]: r for r in calls.features(recordings, heavy=False).collect()}
    assert set(full) == {"a", "b"} and full["a"].__fields__ == ["call_id", *FEATURE_NAMES]
    for call, row in full.items():
        assert row["duration_s"] == 4.0 and all(np.isfinite(v) for n, v in row.asDict().items() if n != "call_id")
        assert row["caller_breath_event_rate"] == 0 and row["caller_rms_mean"] == pytest.approx(live[call]["caller_rms_mean"])
        assert live[call]["caller_hnr_mean"] == 0
    assert full["a"]["caller_segment_count"] == 2


def test_acoustic_layer_against_definitions(spark):
    audio_rows = audio.decoded(spark.createDataFrame([("s", wav([speech(3), 0.4 * speech(4)]))], "call_id string, content binary"))
    spans = [(0.25, 0.875), (1.0, 1.5), (1.75, 3.0), (3.5, 3.5005)]  # the last is too short
    f = layers.acoustic_features(audio_rows, spark.createDataFrame([("s", i, 0, *s) for i, s in enumerate(spans)], SEGMENTS)).first()
    sound = (speech(3) * 32767).astype("<i2") / 32768
    cut = [sound[int(s * RATE) : int(e * RATE)] for s, e in spans[:3]]
    level = np.array([np.sqrt(np.mean(c * c)) for c in cut])
    crossings = np.array([np.mean(np.sign(c[1:]) != np.sign(c[:-1])) for c in cut])
    crest = np.array([np.abs(c).max() for c in cut]) / level
    for name, x in (("rms", level), ("zcr", crossings), ("crest_factor", crest)):
        assert f[f"caller_{name}_mean"] == pytest.approx(x.mean(), rel=1e-3) and f[f"caller_{name}_std"] == pytest.approx(x.std(), rel=1e-2, abs=1e-4)
    size = np.array([e - s for s, e in spans[:3]])
    assert f["caller_segment_length_cv"] == pytest.approx(size.std() / size.mean())
    gaps = np.array([0.25, 0.125, 0.25, 0.5, 4 - 3.5005])
    assert f["caller_intra_silence_gap_mean_s"] == pytest.approx(gaps.mean())


def test_micro_and_interaction_layers_against_definitions(spark):
    t = np.arange(4 * RATE) / RATE
    ch0, ch1 = 0.3 * np.sin(2 * np.pi * 200 * t), 0.2 * np.sin(2 * np.pi * 500 * t) * (np.floor(t) % 2)
    ch0[:RATE] = 0
    rows = audio.decoded(spark.createDataFrame([("s", wav([ch0, ch1]))], "call_id string, content binary"))
    segments = spark.createDataFrame([("s", 0, 0, 1.0, 2.5), ("s", 1, 0, 2.75, 4.0), ("s", 2, 1, 1.25, 2.0), ("s", 3, 1, 2.55, 2.7)], SEGMENTS)
    micro = layers.micro_features(rows, segments).first()
    assert micro["caller_f0_std"] == pytest.approx(0, abs=1) and micro["caller_pitch_jitter"] == pytest.approx(0, abs=1e-2) 
    assert micro["caller_hnr_mean"] == pytest.approx(10 * np.log10((160 / 200) / (40 / 200)), abs=0.1)  # a lag of 40 leaves 160 of 200 samples
    inter = layers.interaction_features(rows, segments).first()
    frames = lambda x: np.array([np.sqrt(np.mean(x[i : i + 160] ** 2)) for i in range(0, len(x) - 159, 80)])
    assert inter["cross_channel_energy_correlation"] == pytest.approx(np.corrcoef(frames(ch0), frames(ch1))[0, 1], abs=0.01)
    assert inter["caller_breath_event_rate"] == 0


def test_silence_has_zeros(spark):
    still = np.zeros(int(1.5 * RATE))
    quiet = audio.decoded(spark.createDataFrame([("q", wav([still, speech(5, 1.5)]))], "call_id string, content binary"))
    f = layers.acoustic_features(quiet, spark.createDataFrame([("q", 0, 0, 0.3, 1.2)], SEGMENTS)).first()
    assert {f[n] for n in f.__fields__ if n.startswith(("caller_rms", "caller_zcr", "caller_crest"))} == {0.0}


def test_requests_to_verdicts(spark):
    good = base64.b64encode(wav([speech(0), speech(1)])).decode()
    batch = spark.createDataFrame([(good, None, "a", 8000, 2), (None, good, "alias", None, None), ("!!!", None, "bad", None, None)], REQUESTS)
    part = lambda names: {"feature_names": names, "weights": [0.5] * len(names), "bias": 0.1, "mean": [0.0] * len(names), "std": [1.0] * len(names)}
    model = {"acoustic": part(["caller_rms_cv"]), "behavioral": part(["agent_talk_ratio"]), "fusion": part(["p_acoustic", "p_behavioral"]), "fusion_type": "stacked"}
    got = {r["call_id"]: r for r in calls.detect(batch, model).collect()}
    assert got["bad"]["error"] == "base64" and got["bad"]["is_synthetic"] is None
    assert got["a"]["is_synthetic"] == got["alias"]["is_synthetic"] and 0.5 <= got["a"]["confidence"] <= 1


def test_transcripts_against_loops(spark):
    draw = random.Random(21)
    bits = ["la cuenta 40718", "la cuenta 40713", "el folio 900011", "el folio 900017", "el folio 911117", "abc 77", "eh", "mmmm este", "pues ahh", "hoy o manana?", "rojo o azul", "no puedo", "falso", "claro", "un momento", "disculpe si interrumpo", "Interrumpire", "cierto"]
    turns = [(call, i, draw.randint(0, 1), float(i), i + 0.5, " ".join(draw.choices(bits, k=draw.randint(0, 3))) or None) for call in "abcdef" for i in range(14)]
    got = {r["call_id"]: r.asDict() for r in transcripts.semantic_features(spark.createDataFrame(turns, TRANSCRIPTS)).collect()}
    for call, f in got.items():
        own = [(t[2], t[3], t[4], t[5] or "") for t in turns if t[0] == call]
        agent, caller = ([t for t in own if t[0] == ch] for ch in (1, 0))
        said = [n for t in agent for n in re.findall(r"[0-9]{4,}", t[3])]
        traps = {}
        for i, x in enumerate(said):
            for y in said[i + 1 :]:
                if len(x) == len(y) and sum(p != q for p, q in zip(x, y)) == 1:
                    traps.setdefault(frozenset((x, y)), (x, y))
        assert f["digit_trap_count"] == len(traps)
        objected = 0
        for x, y in traps.values():
            turn = next((t for t in agent if y in t[3] and x not in t[3]), None)
            reply = next((c for c in caller if turn and c[1] >= turn[2]), None)
            objected += bool(reply and re.search(r"\b(no|falso|momento)\b", reply[3]))
        assert f["digit_trap_caller_objected"] == objected
        assert f["false_dilemma_count"] == sum("?" in t[3] and " o " in t[3] for t in agent)
        assert f["announced_interrupt_count"] == sum("nterrump" in t[3] for t in agent)
        assert f["caller_filler_count"] == sum(len([w for w in t[3].split() if w in ("eh", "mmmm", "este", "pues", "ahh")]) for t in caller)


def test_rules_against_their_definitions(spark):
    draw = random.Random(22)
    near = lambda: round(draw.choice([draw.random(), 0.5 + draw.uniform(-0.15, 0.15)]), 3)
    rows = [(near(), near(), near(), draw.uniform(1.2, 2.2), draw.uniform(0.2, 0.7), draw.randint(18, 30), draw.random() < 0.5) for _ in range(400)]
    rows += [(0.5, 0.25, 0.75, 1.4, 0.1, 24, True), (0.5, 0.25, 0.75, 2.0, 0.45, 24, False)]  # ties and edges
    df = spark.createDataFrame(rows, "f double, a double, b double, w double, c double, t int, y boolean")
    side = {n: F.col(n) >= 0.5 for n in "fab"}
    off = scoring.QUIET | {"talkative_turn_min": 0}
    got = scoring.verdict(df.select("*", scoring.settle_disagreement(F.col("f"), F.col("a"), F.col("b")).alias("settled"), scoring.quiet_talker(F.col("f"), F.col("w"), F.col("c"), F.col("t"), **scoring.QUIET).alias("gated"), scoring.quiet_talker(F.col("f"), F.col("w"), F.col("c"), F.col("t"), **off).alias("off"), scoring.error_kind(F.col("y"), side["f"], side["a"], side["b"]).alias("kind")), "f").collect()
    for r in got:
        settled = r["f"]
        if (r["a"] < 0.5) != (r["b"] < 0.5) and abs(r["f"] - 0.5) < 0.1:
            settled = max((r["a"], r["b"]), key=lambda p: abs(p - 0.5))
        gated = r["f"]
        if r["f"] >= 0.5 and 1.4 <= r["w"] <= 2.0 and r["c"] < 0.45 and r["t"] >= 24:
            gated = 1 - r["f"] if r["f"] > 0.5 else 0.499
        agree = len({r[n] >= 0.5 for n in "fab"}) == 1
        kind = ("ok" if agree else "ok_disagree") if (r["f"] >= 0.5) == r["y"] else ("miss_agree" if agree else "miss_mixer")
        assert (r["settled"], r["gated"], r["off"], r["kind"]) == (settled, pytest.approx(gated), r["f"], kind)
        assert (r["is_synthetic"], r["confidence"]) == (r["f"] >= 0.5, pytest.approx(max(r["f"], 1 - r["f"])))
    assert len({r["kind"] for r in got}) == 4 and any(r["gated"] != r["f"] for r in got) and any(r["settled"] != r["f"] for r in got)


def toy(spark, seed=0, n=60):
    draw, rows = np.random.default_rng(seed), []
    for i in range(n):
        y = i % 2
        rows.append((f"c{i}", "val" if i % 5 == 0 else "train", "synthetic" if y else "human", float(draw.normal(y * 2, 1)), float(draw.normal(-y, 1)), float(draw.normal(0, 1))))
    return spark.createDataFrame(rows, "call_id string, split string, label string, u double, v double, w double")


def test_training_saving_and_scoring(spark, tmp_path):
    rows = toy(spark)
    model = scoring.train(rows, acoustic=("u",), behavioural=("v", "w"))
    assert model["metrics"]["train"]["stacked"]["auc"] > 0.85
    tables.save_model(model, str(tmp_path / "model"), spark)
    loaded = tables.load_model(str(tmp_path / "model"), spark)
    assert json.dumps(loaded, sort_keys=True) == json.dumps(json.loads(json.dumps(model)), sort_keys=True)
    data = rows.where("split = 'train'").toPandas()
    z = (data.u - data.u.mean()) / data.u.std(ddof=0)
    w = b = 0.0
    for _ in range(scoring.EPOCHS):
        miss = 1 / (1 + np.exp(-(w * z + b))) - (data.label == "synthetic")
        w, b = w - scoring.RATE * ((z * miss).mean() + scoring.PENALTY * w), b - scoring.RATE * miss.mean()
    assert model["acoustic"]["weights"][0] == pytest.approx(w) and model["acoustic"]["bias"] == pytest.approx(b)


def test_statistics(spark):
    rows = toy(spark).withColumn("y", F.col("label") == "synthetic")
    data = rows.toPandas()
    a, b = data.u[data.y], data.u[~data.y]
    assert rows.agg(effect_size(F.col("u"), F.col("y"))).first()[0] == pytest.approx((a.mean() - b.mean()) / np.sqrt((a.var() + b.var()) / 2))
    assert ranking.auc(rows, "u", F.col("y")).first()["auc"] == pytest.approx(np.mean([(x > z) + (x == z) / 2 for x in a for z in b]))
    sizes = ranking.effect_sizes(rows, ["u", "v", "w"], F.col("y"), ["split"])
    for split in ("train", "val"):
        part = data[data["split"] == split]
        d = {n: (part[n][part.y].mean() - part[n][~part.y].mean()) / np.sqrt((part[n][part.y].var() + part[n][~part.y].var()) / 2) for n in "uvw"}
        assert [r["feature"] for r in sizes.where(F.col("split") == split).orderBy("rank").collect()] == sorted(d, key=lambda n: -abs(d[n]))
    assert "u" in {r["feature"] for r in ranking.stable_features(sizes, "split", 2).collect()}
    bounds = {r["feature"]: r for r in ranking.bootstrap(rows, ["u", "w"], F.col("y"), runs=40).collect()}
    assert bounds["u"]["low"] > 0 and bounds["w"]["low"] < bounds["w"]["high"]
    tied = spark.createDataFrame([(x, x > 2) for x in (1.0, 2.0, 2.0, 3.0)], "s double, y boolean")
    assert ranking.auc(tied, "s", F.lit(True)).first()["auc"] == 0.5
    assert ranking.nearest_rank(tied.select("s"), "s", ranking.p95()).first()["s"] == 2.0


def test_files(spark, tmp_path):
    (tmp_path / "turns").mkdir()
    (tmp_path / "turns/call_1.json").write_text(json.dumps({"turns": [{"channel": 1, "start": 0, "end": 1.5}, {"channel": 0, "start": 2, "end": 3}]}))
    (tmp_path / "m.csv").write_text("anon_id,label,split,duration_s\ncall_1,human,train,61\ncall_2,synthetic,val,70\n")
    (tmp_path / "call_9.wav").write_bytes(wav([tone(300, 0.1), tone(500, 0.1)]))
    assert [tuple(r) for r in tables.turns(spark, str(tmp_path / "turns")).orderBy("seq").collect()] == [("call_1", 0, 1, 0.0, 1.5), ("call_1", 1, 0, 2.0, 3.0)]
    assert [r["anon_id"] for r in tables.manifest(spark, str(tmp_path / "m.csv"), "val").collect()] == ["call_2"]
    row = audio.wav_files(spark, str(tmp_path)).first()
    assert (row["call_id"], row["n0"], row["sample_rate"], row["error"]) == ("call_9", 800, 8000, None)
    assert tables.embedded_json({"a": "</script>"}) == '{"a": "\\u003c/script>"}' and "| a |" in tables.markdown(spark.createDataFrame([(1.5,)], "a double"))


def test_streams(spark, tmp_path):
    from colloquy.streaming.segments import sessions

    rows = [("c", 0, f"2024-01-01 00:00:0{t:.3f}") for t in (0.0, 0.1, 0.2, 1.0, 1.1)]
    spark.createDataFrame(rows, "call_id string, channel int, ts string").select("call_id", "channel", F.col("ts").cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("call_id string, channel int, ts timestamp").parquet(str(tmp_path / "in"))
    query = sessions(stream).writeStream.outputMode("complete").format("memory").queryName("found").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["frames"] for r in spark.table("found").collect()) == [2, 3]


def test_bootstrap_query_takes_all_runs(spark, monkeypatch):
    from colloquy.plans import catalogue
    from tests.conftest import SF

    taken = []
    monkeypatch.setattr(ranking, "bootstrap", lambda rows, features, positive, runs=200, **_: taken.append(runs) or rows.select("call_id"))
    monkeypatch.setattr(catalogue, "rounded", lambda df: df)
    catalogue.QUERIES["bootstrap_ci"](spark, SF)
    assert taken == [200]
