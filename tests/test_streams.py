"""Data sources and streams: WAV folders, the request spool and its answers, the live ledger."""

import base64
import datetime
import json
import os
import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy.operators import ledger as tables
from colloquy.plans import calls
from colloquy.sources import audio, spool, wav
from colloquy.streaming import live
from colloquy.streaming.segments import detections
from tests.test_sound_and_scores import RATE, speech
from tests.test_sound_and_scores import wav as wav16


def riff(tag, bits, body, channels=2, rate=RATE, extended=False, before=b"", odd=b""):
    form = struct.pack("<HHIIHH", wav.EXTENDED if extended else tag, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    form += struct.pack("<HHIH", 22, bits, 3, tag) + bytes(14) if extended else b""
    chunks = before + b"fmt " + struct.pack("<I", len(form)) + form + odd + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


ODD = b"LIST" + struct.pack("<I", 3) + b"abc\0"


def test_widths_and_formats():
    """The same sound in every width; what 16 bits can't hold is cut off."""
    draw = np.random.default_rng(3)
    whole = draw.integers(-32768, 32768, (500, 2))
    three = b"".join(int(v * 256 + 77).to_bytes(4, "little", signed=True)[:3] for v in whole.ravel())
    files = {
        "8": (riff(1, 8, (whole >> 8).ravel().astype(np.int16).__add__(128).astype(np.uint8).tobytes()), (whole >> 8) << 8),
        "16": (riff(1, 16, whole.astype("<i2").tobytes(), before=ODD, odd=ODD), whole),
        "24": (riff(1, 24, three), whole), "24 extended": (riff(1, 24, three, extended=True), whole),
        "32": (riff(1, 32, (whole * 65536 + 12345).astype("<i4").tobytes()), whole),
        "float": (riff(3, 32, (whole / 32768).astype("<f4").tobytes()), whole), "double": (riff(3, 64, (whole / 32768).astype("<f8").tobytes(), extended=True), whole),
    }
    for name, (data, wanted) in files.items():
        pcm0, pcm1, n0, n1, rate, error = wav.decode(data)
        assert error is None and rate == RATE and n0 == n1 == 500, name
        assert (np.frombuffer(pcm0, "<i2") == wanted[:, 0]).all() and (np.frombuffer(pcm1, "<i2") == wanted[:, 1]).all(), name
    loud = wav.decode(riff(3, 32, np.array([[2.0, -2.0], [np.nan, np.inf]], "<f4").tobytes()))
    assert np.frombuffer(loud[0], "<i2").tolist() == [32767, 0] and np.frombuffer(loud[1], "<i2").tolist() == [-32768, 32767]
    assert wav.decode(files["16"][0][:-3])[2] == 499  # cut short: whole samples only
    back = wav.decode(wav.encode(*wav.decode(files["16"][0])[:2], RATE))
    assert back[:2] == wav.decode(files["16"][0])[:2]
    for data, error in ((None, "base64"), (b"", "wav"), (b"RIFF", "wav"), (b"fLaC" + bytes(50), "wav"), (riff(1, 16, b"", channels=1), "stereo"), (riff(1, 16, b"", rate=44100), "rate"), (riff(7, 8, b"12"), "wav"), (b"RIFF" + bytes(4) + b"WAVEdata" + bytes(40), "wav")):
        assert wav.decode(data)[-1] == error
    assert wav.decode(riff(1, 16, b""))[2:] == (0, 0, RATE, None)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("wavs")
    for k in range(7):
        (folder / f"c{k}.wav").write_bytes(wav16([speech(k, 1.0 + k / 4), speech(k + 5, 1.0 + k / 4)]))
    (folder / "bad.wav").write_bytes(b"no sound")
    (folder / "notes.txt").write_text("no file of it")
    wav.register(spark)
    return folder


def test_wav_source_is_like_files(spark, folder):
    columns = ["call_id", "pcm0", "pcm1", "n0", "n1", "sample_rate", "error"]
    source = spark.read.format("wav_calls").option("partitionBytes", 60_000).load(str(folder))
    key = lambda rows: sorted(map(tuple, rows), key=lambda r: r[0])
    assert source.columns == columns and key(source.collect()) == key(audio.wav_files(spark, str(folder)).select(columns).collect())
    assert 1 < source.rdd.getNumPartitions() < 8
    assert spark.read.format("wav_calls").load(str(folder / "none")).collect() == []


def test_wav_source_takes_filters(spark, folder):
    """Files that a filter on call_id leaves out are not opened: one of them can't be."""
    os.symlink("/does/not/exist.wav", folder / "gone.wav") if not os.path.lexists(folder / "gone.wav") else None
    source = spark.read.format("wav_calls").load(str(folder))
    for test, wanted in (("call_id = 'c3'", ["c3"]), ("call_id in ('c1', 'c5', 'x')", ["c1", "c5"]), ("call_id like 'c%' and n0 > 12000", ["c3", "c4", "c5", "c6"]), ("call_id = 'c2' and call_id = 'c3'", [])):
        rows = source.where(test)
        assert sorted(r["call_id"] for r in rows.select("call_id").collect()) == wanted
    os.remove(folder / "gone.wav")
    reader = wav.WavReader({"path": str(folder)})
    left = list(reader.pushFilters([wav.EqualTo(("call_id",), "c4"), wav.EqualTo(("n0",), 3)]))
    assert [f.attribute for f in left] == [("n0",)] and [p.paths[0].rsplit("/", 1)[-1] for p in reader.partitions()] == ["c4.wav"]


def test_wav_sink_and_back(spark, folder, tmp_path):
    source = spark.read.format("wav_calls").load(str(folder))
    out = str(tmp_path / "copies")
    for _ in range(2):  # again in place of what is there
        source.repartition(3).write.format("wav_calls").mode("overwrite").save(out)
    copies = spark.read.format("wav_calls").load(out)
    assert sorted(map(tuple, copies.collect())) == sorted(tuple(r) for r in source.where("error is null").collect())
    assert not [n for n in os.listdir(out) if n.startswith("_")]
    assert len(calls.features(copies, heavy=False).collect()) == 7


MODEL = {"fusion_type": "concatenated", **{n: {"feature_names": ["agent_talk_ratio"], "weights": [3.0], "mean": [0.3], "std": [1.0], "bias": 0.0} for n in ("acoustic", "behavioral", "concatenated")}}


def request(k):
    sound = wav16([speech(k, 1.0), speech(k + 1, 1.0)])
    return {"audio_base64" if k % 2 else "audio_b64": base64.b64encode(sound).decode(), "call_id": f"r{k}", "more": [1]}


def append(path, *lines):
    with open(path, "a") as file:
        file.write("".join((line if isinstance(line, str) else json.dumps(line)) + "\n" for line in lines))


def test_requests_survive_a_killed_run(spark, tmp_path, monkeypatch):
    """A run that dies after it wrote a batch, and one that dies while it writes, lose and repeat nothing."""
    box, out, state = tmp_path / "spool", str(tmp_path / "answers"), str(tmp_path / "state")
    box.mkdir()
    append(box / "a.jsonl", request(0), request(1), "no json")
    answered = lambda: sorted(((r["call_id"] or "", r["error"] or "") for r in spark.read.format("call_answers").load(out).collect()))
    run = lambda: detections(spark, str(box), MODEL, out, state).awaitTermination()
    spool.register(spark)
    whole = spool.AnswerWriter.commit

    with monkeypatch.context() as patch:  # before it is committed: files are staged and no more
        patch.setattr(calls, "detect", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(Exception, match="killed"):
            run()
    assert answered() == []
    original = calls.detect

    def dies_after(batch, model, fallback=None):
        """Writes all of the batch's answers, then dies before the stream takes note."""
        columns = [c.strip().split()[0] for c in spool.CallAnswers({}).schema().split(",")]
        original(batch, model, fallback).select(*columns).write.format("call_answers").option("batch", 0).mode("append").save(out)
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(calls, "detect", dies_after)
        with pytest.raises(Exception, match="killed"):
            run()
    assert answered() == [("", "base64"), ("r0", ""), ("r1", "")]
    run()
    assert answered() == [("", "base64"), ("r0", ""), ("r1", "")]  # the batch again, in place of itself
    append(box / "a.jsonl", request(2))
    append(box / "b.jsonl", request(3), {"call_id": "r3", "audio_base64": "!!!"}, request(3))
    with open(box / "b.jsonl", "a") as file:
        file.write('{"call_id": "half')  # a line that its producer has not ended
    run()
    run()
    wanted = [("", "base64"), ("r0", ""), ("r1", ""), ("r2", ""), ("r3", ""), ("r3", ""), ("r3", "base64")]
    assert answered() == wanted and whole is spool.AnswerWriter.commit
    append(box / "b.jsonl", '", "audio_b64": ""}')
    run()
    assert answered() == sorted([*wanted, ("half", "wav")])


def test_spool_as_a_table_and_in_parts(spark, tmp_path):
    box = tmp_path / "spool"
    box.mkdir()
    lines = [{"call_id": f"x{i}", "sample_rate": i, "audio_b64": "a" * (i % 50), "channels": "two" if i == 5 else True if i == 6 else 2} for i in range(300)]
    append(box / "a.jsonl", *lines[:200])
    append(box / "b.jsonl", *lines[200:], "", "[1, 2]")
    spool.register(spark)
    for size in (10, 500, 1 << 20):
        rows = spark.read.format("call_requests").option("partitionBytes", size).load(str(box)).collect()
        assert sorted(r["sample_rate"] for r in rows if r["call_id"]) == list(range(300)) and len(rows) == 301
        assert {r["sample_rate"] for r in rows if r["channels"] is None and r["call_id"]} == {5, 6}


def test_answers_as_a_stream_sink(spark, tmp_path):
    box, out = tmp_path / "spool", str(tmp_path / "out")
    box.mkdir()
    spool.register(spark)
    for k in range(2):
        append(box / "a.jsonl", {"call_id": f"x{k}", "sample_rate": k}, {"call_id": None})
        stream = spark.readStream.format("call_requests").load(str(box)).select("call_id", F.lit(True).alias("is_synthetic"), F.col("sample_rate").cast("double").alias("confidence"), F.lit(None).cast("string").alias("error"))
        stream.writeStream.format("call_answers").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(out).awaitTermination()
    got = spark.read.format("call_answers").load(out).collect()
    assert sorted((r["call_id"] or "", r["confidence"]) for r in got if r["call_id"]) == [("x0", 0.0), ("x1", 1.0)] and len(got) == 4


def drawn_calls(seed, n=6):
    """Segments of calls in whole frames."""
    draw, rows = random.Random(seed), []
    for c in range(n):
        for ch in (0, 1):
            at = draw.randint(0, 6)
            while at < 150:
                end = at + draw.randint(1, 25)
                rows.append((f"c{c}", len(rows), ch, at, min(end, 160)))
                at = end + draw.choice([1, 3, 9, 20])
    return rows


@pytest.mark.parametrize("order", ["as they come", "mixed"])
def test_live_ledger_is_that_of_the_table(spark, tmp_path, order):
    rows = drawn_calls(11)
    segments = spark.createDataFrame([(c, s, ch, a * 0.032, b * 0.032) for c, s, ch, a, b in rows], "call_id string, seq int, channel int, start double, end double")
    whole = spark.createDataFrame([(f"c{c}", 160 * 0.032) for c in range(6)], "call_id string, duration double")
    events, metrics = calls.conversation(segments, whole)
    wanted = {(r["call_id"], r["event_idx"]): (r["channel"], round(r["start"] / 0.032), round(r["end"] / 0.032), r["type"]) for r in events.collect()}

    began, active = datetime.datetime(2024, 5, 1), {(c, ch, i) for c, _, ch, a, b in rows for i in range(a, b)}
    frames = [(f"c{c}", ch, i, (f"c{c}", ch, i) in active, began + datetime.timedelta(milliseconds=32 * i)) for i in range(160) for c in range(6) for ch in (0, 1)]
    if order == "mixed":  # by up to 40 frames, which the watermark allows for; frames that say nothing may be missing
        draw = random.Random(1)
        frames = sorted((f for f in frames if f[3] or draw.random() < 0.5 or f[2] == 159), key=lambda f: f[2] + draw.randint(0, 40))
    source = str(tmp_path / "frames")
    step = len(frames) // 3 + 1
    found = []
    for k in range(4):
        part = frames[k * step : (k + 1) * step] or [("other", 0, 0, False, began + datetime.timedelta(minutes=5))]
        spark.createDataFrame(part, live.FRAMES).coalesce(1).write.mode("append").parquet(source)
        stream = live.live_ledger(spark.readStream.schema(live.FRAMES).parquet(source))
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
        found.append(spark.read.parquet(str(tmp_path / "out")).where("call_id <> 'other'").count())
    assert found == sorted(found) and 0 < found[2] < found[3]  # runs come while calls go on
    out = spark.read.parquet(str(tmp_path / "out")).where("call_id <> 'other'")
    got = {(r["call_id"], r["event_idx"]): (r["channel"], r["first"], r["last"], r["type"]) for r in out.collect()}
    assert got == wanted and out.where("late > 0").count() == 0
    sums = {r["call_id"]: r.asDict() for r in live.live_metrics(out).collect()}
    for r in metrics.collect():
        assert sums[r["call_id"]] == {k: pytest.approx(v) if k != "call_id" else v for k, v in r.asDict().items()}


def test_frames_that_come_too_late_are_counted(spark, tmp_path):
    at = lambda i: datetime.datetime(2024, 5, 1) + datetime.timedelta(milliseconds=32 * i)
    source, parts = str(tmp_path / "frames"), [[("a", 0, i, i < 5, at(i)) for i in range(300)], [("a", 0, 300, True, at(300))], [("a", 1, 3, True, at(3)), ("a", 0, 301, True, at(301))], [("z", 0, 0, False, at(9000))]]
    for part in parts:
        spark.createDataFrame(part, live.FRAMES).coalesce(1).write.mode("append").parquet(source)
        live.live_ledger(spark.readStream.schema(live.FRAMES).parquet(source)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    rows = sorted((r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["call_id"] == "a"), key=lambda r: r["event_idx"])
    # Spark itself keeps rows behind the watermark from the state; whichever of the two sees it, the ledger stays
    assert [(r["type"], r["first"], r["last"], r["final"]) for r in rows] == [(tables.SPEECH, 0, 5, False), (tables.SILENCE, 5, 300, False), (tables.SPEECH, 300, 302, True)]


def test_state_is_asked_for_by_blocks_of_frames():
    """a call of 9,000 frames takes a few requests to its state, and not some for each frame."""
    asked, kept = [], {}

    class State:
        exists = lambda self: False
        update = lambda self, value: asked.append("ledger")

        def containsKey(self, key):
            asked.append(key)
            return key in kept

        def getValue(self, key):
            asked.append(key)
            return kept[key]

        def updateValue(self, key, value):
            asked.append(key)
            kept[key] = value

        def removeKey(self, key):
            asked.append(key)
            del kept[key]

    class Handle:
        getValueState = getMapState = lambda self, *_: State()
        listTimers = lambda self: []
        registerTimer = lambda self, at: None

    class Mark:
        getCurrentWatermarkInMs = lambda self: 1_700_000_000_000 + 8000 * live.FRAME_MS

    n, processor = 9000, live.LiveCall(5000)
    processor.init(Handle())
    rows = pd.DataFrame({"channel": [0, 1] * n, "idx": np.repeat(np.arange(n), 2), "active": [i // 3 % 5 == c for i in range(n) for c in (0, 1)]})
    rows["ts"] = pd.to_datetime(1_700_000_000_000 + rows["idx"] * live.FRAME_MS, unit="ms")
    out = pd.concat(processor.handleInputRows(("c",), iter([rows]), Mark()))
    lengths = list(zip(out["first"], out["last"], out["channel"].fillna(-1).astype(int)))
    assert lengths[:4] == [(0, 3, 0), (3, 6, 1), (6, 15, -1), (15, 18, 0)] and out["last"].max() == 7998 and not out["late"].any()
    assert len(asked) < 30 and sum(len(v[0]) for v in kept.values()) < 3000


def test_python_stages_over_sound_take_few_recordings_at_once(spark):
    """what a Python stage holds does not grow with the recordings of a task."""
    files = spark.range(0, 120, 1, 1).select(F.col("id").cast("string").alias("call_id"), F.repeat(F.lit("x"), 100_000).cast("binary").alias("content"))

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [len(batch)]})

    sound = audio.decoded(files)
    assert sound.count() == 120 and max(r["n"] for r in files.mapInPandas(run, "n long").collect()) < 60
