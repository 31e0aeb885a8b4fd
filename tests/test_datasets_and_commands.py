"""Data set folders, commands over them, reports."""

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy import cli
from colloquy.operators import evaluation, layers, ledger
from colloquy.plans import calls
from colloquy.schemas import SEGMENTS
from colloquy.sources import dataset, tables
from tests.test_sound_and_scores import speech, toy, wav


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    (root / "turns").mkdir()
    (root / "audio").mkdir()
    lines = ["anon_id,label,split,duration_s"]
    for i in range(10):
        label, split = ("human", "synthetic")[i % 2], "val" if i >= 6 else "train"
        lines.append(f"call_{i},{label},{split},4")
        (root / f"audio/call_{i}.wav").write_bytes(wav([speech(i % 4) * (1 + i % 2) / 2, speech(i % 3 + 1) * 0.7]))
        turns = [{"channel": ch, "start": s, "end": s + 0.8} for ch, s in ((0, 0.8), (1, 1.6), (0, 2.4))]
        (root / f"turns/call_{i}.json").write_text(json.dumps({"turns": turns}))
    (root / "manifest.csv").write_text("\n".join(lines) + "\n")
    return root


def test_places(spark, folder, tmp_path):
    data = dataset.resolve(spark, str(folder))
    assert data.sound == f"{folder}/audio" and data.calls("val").count() == 4 and data.audio("val").count() == 4
    with pytest.raises(dataset.DatasetError):
        dataset.resolve(spark, str(tmp_path))
    with pytest.raises(dataset.DatasetError):
        dataset.resolve(spark, base=str(tmp_path))
    (tmp_path / "dataset").mkdir()
    (tmp_path / "dataset/manifest.csv").write_text("anon_id,label,split,duration_s\n")
    (tmp_path / "dataset/turns").mkdir()
    with pytest.raises(dataset.DatasetError, match="no sound"):
        dataset.resolve(spark, base=str(tmp_path))
    (tmp_path / "audio").mkdir()
    assert dataset.resolve(spark, base=str(tmp_path)).sound == f"{tmp_path}/audio"


def test_one_call(spark, folder):
    data = dataset.resolve(spark, str(folder))
    row = data.call("call_3").first()
    assert (row["label"], row["split"], row["sample_rate"], row["n0"], len(row["turns"])) == ("synthetic", "train", 8000, 32000, 3)
    with pytest.raises(dataset.DatasetError):
        data.call("call_77")


def test_commands(spark, folder, tmp_path, capsys):
    model = str(tmp_path / "model")
    cli.main(["train", "--root", str(folder), "--model", model], spark)
    assert tables.load_model(model, spark)["vad_backend"] == "hybrid"
    cli.main(["vad-benchmark", "--root", str(folder), "--out", str(tmp_path / "vad")], spark)
    assert spark.read.json(str(tmp_path / "vad")).count() == 2
    cli.main(["inspect", "--root", str(folder), "--model", model], spark)
    assert "| split |" in capsys.readouterr().out
    request = {"audio_base64": base64.b64encode((folder / "audio/call_1.wav").read_bytes()).decode(), "call_id": "r"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.jsonl").write_text(json.dumps(request) + "\n")
    cli.main(["serve", "--requests", str(tmp_path / "in"), "--out", str(tmp_path / "answers"), "--model", model, "--once"], spark)
    assert [r["call_id"] for r in spark.read.json(str(tmp_path / "answers")).collect()] == ["r"]
    with pytest.raises(SystemExit):
        cli.main(["nothing"], spark)


def test_backends(spark, folder):
    audio = dataset.resolve(spark, str(folder)).audio("val")
    other = lambda a: a.select("call_id", F.lit(0).alias("seq"), F.lit(0).alias("channel"), F.lit(0.0).alias("start"), F.lit(0.05).alias("end"))
    assert layers.voice_activity(audio, "neural", 0.01, other).count() == 4 and layers.voice_activity(audio, "neural", 0.1, other).count() == 0
    assert layers.voice_activity(audio, "energy", least=10.0).count() == 0
    assert layers.voice_activity(audio, "hybrid", 10.0, other).count() == 4
    for bad in (("neural", 0.1, None), ("else", 0.1, None)):
        with pytest.raises(ValueError):
            layers.voice_activity(audio, *bad)


def test_masks_of_segments(spark):
    segs = [("c", 0, 0, 0.0625, 0.25), ("c", 1, 1, 0.375, 0.40), ("c", 2, 0, 0.9, 1.5)]
    got = ledger.segments_mask(spark.createDataFrame(segs, SEGMENTS), spark.createDataFrame([("c", 1.0)], "call_id string, duration double"), 0.125).collect()
    on = {(r["channel"], r["idx"]) for r in got if r["active"]}
    assert on == {(0, 0), (0, 1), (1, 3), (0, 7)} and len(got) == 16


def test_guarded_heads(spark):
    rows = toy(spark)
    part = rows.where("split = 'train'").toPandas()
    a, b = part[part.label == "synthetic"], part[part.label == "human"]
    apart = {n: abs(a[n].mean() - b[n].mean()) / np.sqrt((a[n].var() + b[n].var()) / 2) for n in "uvw"}
    assert evaluation.fit_and_score(rows, ["u", "v", "w"], 2)["features_used"] == sorted(apart, key=apart.get, reverse=True)[:2]
    assert evaluation.fit_and_score(rows.where("label = 'human'"), ["u"]) is None and evaluation.fit_and_score(rows.where("split = 'train'"), ["u"]) is None
    assert [x["status"] for x in evaluation.layer_benchmark(None, {"a": ["u"]})] == ["skipped", "skipped"]
    data = rows.toPandas()
    stats = {(r["split"], r["feature"]): r for r in evaluation.group_stats(rows, ["u"], ["split"]).collect()}
    own = data[(data.split == "train") & (data.label == "human")].u
    assert stats["train", "u"]["human_mean"] == pytest.approx(own.mean()) and stats["train", "u"]["human_std"] == pytest.approx(own.std())


def test_pages(spark):
    page = tables.html_page("a < b", {"t&": spark.createDataFrame([("</script>", 0.5)], "s string, x double")})
    assert "a &lt; b" in page and "<td>0.5000</td>" in page and page.count("</script>") == 1
    assert np.isclose(json.loads(page.split('id="data">')[1].split("</script>")[0])["t&"]["rows"][0][1], 0.5)


def test_benchmark_of_detectors(spark, folder):
    got = calls.benchmark_detectors(dataset.resolve(spark, str(folder)), "val").collect()
    assert {r["backend"] for r in got} == {"energy", "hybrid"} and all(r["num_calls"] == 4 and 0 < r["mean_overall_iou"] <= 1 for r in got)
    assert all(0 < r["mean_latency_ms"] and 0 < r["p95_latency_ms"] < 60_000 for r in got)  # each call's own time


def test_own_backend_as_plan_function_and_benchmark(spark, folder):
    """A registered detector runs in the stage for sound, as a table function of SQL, and in the benchmark."""
    from colloquy.operators import backends

    backends.register("whole", lambda sound, rate, least: [(0, 0.0, len(sound) / rate)] if len(sound) / rate >= least else [])
    data = dataset.resolve(spark, str(folder))
    audio = data.audio("val")
    wanted = sorted((f"call_{i}", 0, ch, 0.0, 4.0) for i in range(6, 10) for ch in (0, 1))
    assert sorted(map(tuple, layers.voice_activity(audio, "whole").collect())) == wanted and layers.voice_activity(audio, "whole", 5.0).count() == 0
    assert {r["caller_talk_ratio"] for r in calls.features(audio, heavy=False, backend="whole").collect()} == {1.0}
    assert backends.as_function(spark, "whole") == "detect_whole"
    audio.createOrReplaceTempView("sounds_")
    spark.read.format("binaryFile").load(f"{folder}/audio").where("path like '%call_6%' or path like '%call_7%'").selectExpr("regexp_extract(path, '(call_.)', 1) as call_id", "content").createOrReplaceTempView("files_")
    assert sorted(map(tuple, spark.sql("SELECT * FROM detect_whole(TABLE(sounds_), 0.2D)").collect())) == wanted
    assert sorted(map(tuple, spark.sql("SELECT * FROM detect_whole(TABLE(files_) PARTITION BY call_id)").collect())) == wanted[:4]
    assert spark.sql("SELECT * FROM detect_whole(TABLE(files_), 5.0D)").count() == 0
    backends.as_function(spark, "energy")
    assert sorted(map(tuple, spark.sql("SELECT * FROM detect_energy(TABLE(sounds_))").collect())) == sorted(map(tuple, layers.energy_segments(audio).collect()))
    with pytest.raises(Exception, match="needs call_id"):
        spark.sql("SELECT * FROM detect_whole(TABLE(SELECT 1 AS x))").collect()
    with pytest.raises(ValueError, match="unknown backend"):
        backends.as_function(spark, "none")
    got = {r["backend"]: r for r in calls.benchmark_detectors(data, "val", ("energy", "whole")).collect()}
    assert got["whole"]["caller_mean_iou"] == pytest.approx(0.4) and got["whole"]["agent_mean_iou"] == pytest.approx(0.2) and got["energy"]["num_calls"] == 4
    backends.DETECTORS.pop("whole")


def test_neural_detector_stands_in_where_energy_finds_nothing(spark, folder):
    from colloquy.operators import backends

    audio = dataset.resolve(spark, str(folder)).audio("val")
    backends.register("neural", lambda sound, rate, least: [(7, 1.0, 2.0)])
    try:
        assert layers.voice_activity(audio, "hybrid").count() == layers.energy_segments(audio).count()
        assert {(r["seq"], r["end"]) for r in layers.voice_activity(audio, "hybrid", 10.0).collect()} == {(7, 2.0)}
        assert layers.voice_activity(audio, "neural").count() == 8
    finally:
        backends.DETECTORS.pop("neural")


def test_detectors_of_a_stage_before_do_not_stay_in_workers(spark, folder):
    from colloquy.operators import backends

    audio = dataset.resolve(spark, str(folder)).audio("val").repartition(16)
    backends.register("neural", lambda sound, rate, least: [(7, 1.0, 2.0)])
    try:
        layers.voice_activity(audio, "neural").collect()
    finally:
        backends.DETECTORS.pop("neural")
    energy, hybrid = (sorted(map(tuple, layers.voice_activity(audio, b, 100.0).collect())) for b in ("energy", "hybrid"))
    assert hybrid == energy == []



def test_reports_say_what_they_do_not_show(spark):
    rows = spark.range(205).select(F.col("id").alias("n"))
    assert tables.markdown(rows).endswith("| 199 |\n(5 more rows are not shown)") and "more rows" not in tables.markdown(rows, 205) and tables.markdown(rows, 300).count("\n") == 206
    page = tables.html_page("t", {"a": rows, "b": rows.limit(3)}, 200)
    assert page.count("<p>5 more rows are not shown</p>") == 1 and json.loads(page.split('id="data">')[1].split("</script>")[0])["a"]["more"] == 5


def test_five_suites_with_transcripts(spark, folder, tmp_path, capsys):
    texts = tmp_path / "texts"
    texts.mkdir()
    for i in range(10):
        said = [{"channel": 1, "start": 0.0, "end": 1.0, "text": "¿sí o no?" if i % 2 else "hola"}, {"channel": 0, "start": 1.0, "end": 2.0, "text": "eh este pues" * (i % 3)}]
        said += [{"channel": 1, "start": 2.0, "end": 3.0, "text": "¿rojo o azul?"}] * (i == 3)
        (texts / f"call_{i}.json").write_text(json.dumps({"turns": said}))
    for more, status in ((["--transcripts", str(texts)], "ok"), (["--transcripts", str(tmp_path / "none")], "skipped")):
        cli.main(["benchmark", "--root", str(folder), *more], spark)
        found = {x["id"]: x for x in json.loads(capsys.readouterr().out)}
        assert list(found) == ["vad", "acoustic", "semantic", "behavioral", "tandem"] and found["semantic"]["status"] == status
        assert all(found[n]["status"] == "ok" for n in ("vad", "acoustic", "behavioral", "tandem"))
        if status == "ok":
            assert found["semantic"]["features_used"][0] == "false_dilemma_count" and found["semantic"]["num_train"] == 6


def test_pages_of_commands(spark, folder, tmp_path):
    pages = {n: tmp_path / f"{n}.html" for n in ("explore", "train", "inspect")}
    model = str(tmp_path / "model")
    cli.main(["train", "--tune", "--root", str(folder), "--model", model, "--page", str(pages["train"])], spark)
    cli.main(["inspect", "--root", str(folder), "--model", model, "--page", str(pages["inspect"])], spark)
    cli.main(["explore", "--root", str(folder), "--page", str(pages["explore"])], spark)
    held = {n: json.loads(p.read_text().split('id="data">')[1].split("</script>")[0]) for n, p in pages.items()}
    assert len(held["train"]["variants"]["rows"]) == 4 * 2 * 4 and set(held["inspect"]) == {"rates", "misses, the most confident first"}
    stats = held["explore"]["effect sizes"]
    assert len(stats["rows"]) == 2 * 85 and {"ci_low", "ci_high"} <= set(stats["columns"])
    at = {c: i for i, c in enumerate(stats["columns"])}
    # no resample of few calls may hold both labels; where some do, the interval is one
    assert all(r[at["ci_low"]] is None or r[at["ci_low"]] <= r[at["ci_high"]] for r in stats["rows"]) and any(r[at["ci_low"]] is not None for r in stats["rows"])
