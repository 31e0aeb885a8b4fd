"""Queries over sound made from embeddings, and of the reports over many calls. They join the catalogue."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import evaluation, layers
from colloquy.plans import derived
from colloquy.plans.catalogue import FEA, SEG, query, rounded, six
from colloquy.schemas import REQUESTS, SEGMENTS
from colloquy.session import settled, small_batches
from colloquy.sources import audio

#: Embeddings of a recording, and how often each of them sounds.
VECTORS, TIMES, RATE = 50, 16, 8000
#: Recordings that leave the stage at once.
TOGETHER = 20


def recordings(spark: SparkSession, sf_dir: str, count: int = VECTORS, times: int = TIMES) -> DataFrame:
    """(call_id, content): count embeddings are a WAV file of two channels, each sounding so many times; five of a channel are loud, then five quiet."""

    def wav(vectors: list) -> bytes:
        pairs = list(zip(vectors[::2], vectors[1::2]))
        sides = [np.concatenate([np.tile(np.floor(np.array(v, np.float64) * (40_000 if k // 5 % 2 == 0 else 200) + 0.5), times) for k, v in enumerate(side)]) for side in zip(*pairs)]
        with io.BytesIO() as out:
            with wave.open(out, "wb") as file:
                file.setnchannels(2)
                file.setsampwidth(2)
                file.setframerate(RATE)
                file.writeframes(np.clip(np.stack(sides, 1), -32768, 32767).astype("<i2").tobytes())
            return out.getvalue()

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):  # a recording is many times its vectors
                some = batch.iloc[at : at + TOGETHER]
                yield pd.DataFrame({"call_id": some["call_id"], "content": [wav([v["embedding"] for v in vectors]) for vectors in some["vectors"]]})

    rows = derived.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / count).cast("string").alias("call_id"), F.struct("vec_id", "embedding").alias("vector"))
    grouped = rows.groupBy("call_id").agg(F.sort_array(F.collect_list("vector")).alias("vectors"))  # count of them
    return small_batches(grouped).mapInPandas(run, "call_id string, content binary")


def sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.decoded(recordings(spark, sf_dir))


def eighths(calls: DataFrame) -> DataFrame:
    """Caller segments from an eighth to three eighths of every half second that a call holds: bounds without rounding."""
    j = F.explode(F.sequence(F.lit(0), F.floor(F.col("duration") * 2).cast("int"))).alias("seq")
    spans = calls.select("call_id", "duration", j).select("call_id", "duration", "seq", F.lit(0).alias("channel"), (F.col("seq") / 2 + 0.125).alias("start"), (F.col("seq") / 2 + 0.375).alias("end"))
    return spans.where("end <= duration").select(*[c.strip().split()[0] for c in SEGMENTS.split(",")])


PCM = f"""em AS (SELECT vec_id // {VECTORS} AS call, CAST(vec_id // {VECTORS} AS VARCHAR) AS call_id, row_number() OVER (PARTITION BY vec_id // {VECTORS} ORDER BY vec_id) - 1 AS j, count(*) OVER (PARTITION BY vec_id // {VECTORS}) AS c, embedding FROM embeddings),
va AS (SELECT call_id, j % 2 AS channel, j // 2 AS k, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM em WHERE j // 2 < c // 2),
pcm AS (SELECT call_id, channel, k * {64 * TIMES} + t * 64 + i AS n, floor(CAST(v AS DOUBLE) * CASE WHEN k // 5 % 2 = 0 THEN 40000 ELSE 200 END + 0.5) / 32768.0 AS x FROM va CROSS JOIN (SELECT unnest(generate_series(0, {TIMES - 1})) AS t) ts),
lg AS (SELECT call_id, max(n) + 1 AS n, (max(n) + 1) / {RATE}.0 AS d FROM pcm GROUP BY call_id)"""


@query(f"WITH {PCM} SELECT pcm.call_id, max(lg.n) AS n0, max(lg.n) AS n1, {RATE} AS sample_rate, CAST(NULL AS VARCHAR) AS error, {six('sum(x) FILTER (WHERE channel = 0)')} AS s0, {six('sum(x) FILTER (WHERE channel = 1)')} AS s1 FROM pcm JOIN lg ON lg.call_id = pcm.call_id GROUP BY pcm.call_id")
def wav_decode(spark, sf_dir):
    """Every sample of both channels, as it comes back from the files."""

    def run(batches):
        for batch in batches:
            for i, side in enumerate(("pcm0", "pcm1")):
                batch[f"s{i}"] = [float(audio.signal(x).sum(dtype=np.float64)) for x in batch[side]]
            yield batch.drop(columns=["pcm0", "pcm1"])

    return rounded(sounds(spark, sf_dir).mapInPandas(run, "call_id string, n0 long, n1 long, sample_rate int, error string, s0 double, s1 double"))


@query("SELECT CAST(page_id AS VARCHAR) AS call_id, CASE WHEN page_id % 3 = 0 OR url IS NULL THEN 'base64' ELSE 'wav' END AS error FROM pages")
def request_errors(spark, sf_dir):
    """Requests without sound: those of every third page are no base64 at all."""
    text = F.when(F.col("page_id") % 3 != 0, F.base64(F.col("url").cast("binary"))).otherwise(F.concat(F.lit("!"), "url"))
    rows = derived.table(spark, sf_dir, "pages").select(text.alias("audio_base64"), F.col("page_id").cast("string").alias("call_id"))
    named = {n: rows[n] if n in rows.columns else F.lit(None).cast(k) for n, k in (c.strip().split() for c in REQUESTS.split(","))}
    return audio.requests(rows.select(*[c.alias(n) for n, c in named.items()])).select("call_id", "error")


#: Frames of 200 samples, one every 80.
DB = f"""{PCM}, hp AS (SELECT call_id, unnest(generate_series(0, (n - 200) // 80)) AS idx FROM lg), sq AS (SELECT call_id, channel, n, sum(x * x) OVER (PARTITION BY call_id, channel ORDER BY n ROWS BETWEEN CURRENT ROW AND 199 FOLLOWING) / 200 AS p FROM pcm),
db AS (SELECT sq.call_id, channel, idx, 20 * log10(sqrt(p + 1e-10) + 1e-10) AS db FROM hp JOIN sq ON sq.call_id = hp.call_id AND sq.n = hp.idx * 80)"""


@query(f"WITH {DB} SELECT call_id, CAST(channel AS INTEGER) AS channel, count(*) AS frames, round(avg(db), 2) + 0.0 AS mean_db, round(max(db), 2) + 0.0 AS max_db FROM db GROUP BY call_id, channel")
def sound_levels(spark, sf_dir):
    levels = layers.energy_levels(sounds(spark, sf_dir)).groupBy("call_id", "channel")
    return levels.agg(F.count("*").alias("frames"), (F.round(F.avg("db"), 2) + 0.0).alias("mean_db"), (F.round(F.max("db"), 2) + 0.0).alias("max_db"))


@query(f"""WITH {DB}, fq AS (SELECT call_id, channel, quantile_cont(db, 0.12) AS q FROM db GROUP BY call_id, channel), ac AS (SELECT db.call_id, db.channel, idx, idx - row_number() OVER (PARTITION BY db.call_id, db.channel ORDER BY idx) AS g FROM db JOIN fq ON fq.call_id = db.call_id AND fq.channel = db.channel WHERE db > q + 14.0),
rn AS (SELECT ac.call_id, channel, min(idx) * 0.01::DOUBLE AS st, CASE WHEN max(idx) + 1 > (max(n) - 200) // 80 THEN ((max(n) - 200) // 80 + 1) * 0.01::DOUBLE ELSE (max(idx) + 2) * 0.01::DOUBLE END AS en FROM ac JOIN lg ON lg.call_id = ac.call_id GROUP BY ac.call_id, channel, g),
br AS (SELECT *, CASE WHEN st - lag(en) OVER (PARTITION BY call_id, channel ORDER BY st) < 0.28 THEN 0 ELSE 1 END AS b FROM rn), il AS (SELECT *, sum(b) OVER (PARTITION BY call_id, channel ORDER BY st) AS i FROM br)
SELECT call_id, CAST(channel AS INTEGER) AS channel, {six("min(st)")} AS "start", {six("max(en)")} AS "end" FROM il GROUP BY call_id, channel, i HAVING max(en) - min(st) >= 0.12""")
def sound_segments(spark, sf_dir):
    """Voice activity from the files' sound, both channels."""
    return rounded(layers.hybrid_segments(sounds(spark, sf_dir)).select("call_id", "channel", "start", "end"))


SPANS = f"{PCM}, sp AS (SELECT call_id, unnest(generate_series(0, CAST(floor(d * 2) AS BIGINT))) AS j, d FROM lg), sg AS (SELECT call_id, j, d FROM sp WHERE j * 0.5 + 0.375 <= d)"
_part = lambda x, name, which: ", ".join(f"round(coalesce({f}, 0), 4) + 0.0 AS caller_{name}_{k}" for k, f in (("mean", f"avg({x})"), ("std", f"stddev_pop({x})"), ("cv", f"stddev_pop({x}) / nullif(avg({x}), 0)")) if k in which.split())


@query(f"""WITH {SPANS}, nx AS (SELECT call_id, n, x, lead(x) OVER (PARTITION BY call_id ORDER BY n) AS y FROM pcm WHERE channel = 0),
sh AS (SELECT sg.call_id, j, sqrt(avg(x * x)) AS rms, avg(CASE WHEN n = j * 4000 + 2999 THEN NULL WHEN sign(x) <> sign(y) THEN 1.0 ELSE 0.0 END) AS zcr, max(abs(x)) / sqrt(avg(x * x)) AS crest FROM sg JOIN nx ON nx.call_id = sg.call_id AND n BETWEEN j * 4000 + 1000 AND j * 4000 + 2999 GROUP BY sg.call_id, j)
SELECT call_id, {_part("rms", "rms", "mean std cv")}, {_part("zcr", "zcr", "mean std")}, {_part("crest", "crest_factor", "mean std cv")} FROM sh GROUP BY call_id""")
def acoustic_layer(spark, sf_dir):
    """The columns of the layer that SQL can say; all of it is computed."""
    heard = sounds(spark, sf_dir)
    found = layers.acoustic_features(heard, eighths(layers.calls_of(heard)))
    names = ["caller_rms_mean", "caller_rms_std", "caller_rms_cv", "caller_zcr_mean", "caller_zcr_std", "caller_crest_factor_mean", "caller_crest_factor_std", "caller_crest_factor_cv"]
    return found.select("call_id", *[(F.round(n, 4) + 0.0).alias(n) for n in names])


@query(f"""WITH {PCM}, hp AS (SELECT call_id, unnest(generate_series(0, (n - 160) // 80)) AS idx FROM lg), sq AS (SELECT call_id, channel, n, sqrt(avg(x * x) OVER (PARTITION BY call_id, channel ORDER BY n ROWS BETWEEN CURRENT ROW AND 159 FOLLOWING)) AS e FROM pcm)
SELECT a.call_id, round(corr(a.e, b.e), 4) + 0.0 AS cross_channel_energy_correlation FROM hp JOIN sq a ON a.call_id = hp.call_id AND a.channel = 0 AND a.n = hp.idx * 80 JOIN sq b ON b.call_id = hp.call_id AND b.channel = 1 AND b.n = hp.idx * 80 GROUP BY a.call_id""")
def interaction_layer(spark, sf_dir):
    """How the loudness of the channels goes together; the layer's other columns are computed with it."""
    heard = sounds(spark, sf_dir)
    found = layers.interaction_features(heard, eighths(layers.calls_of(heard)))
    return found.select("call_id", (F.round("cross_channel_energy_correlation", 4) + 0.0).alias("cross_channel_energy_correlation"))


@query()
def micro_layer(spark, sf_dir):
    heard = sounds(spark, sf_dir)
    return rounded(layers.micro_features(heard, eighths(layers.calls_of(heard))))


@query()
def call_features_from_sound(spark, sf_dir):
    """All 85 features of a recording, from the file on."""
    from colloquy.plans.calls import features

    return rounded(features(sounds(spark, sf_dir)))


# reports

_runs = "rs AS (SELECT b.backend, d.call_id, (hash % 1000 + 1) / 10.0 AS latency_ms FROM (SELECT call_id, call_id * 7919 AS hash FROM calls) d CROSS JOIN (VALUES ('exact'), ('late')) b(backend))"


def _benchmark(spark, sf_dir):
    """Segments as they are, and half of them late by nine tenths of a second, held against themselves."""
    segs = derived.segments(spark, sf_dir)
    late = segs.where("seq % 2 = 0").withColumns({"start": F.col("start") + 90, "end": F.col("end") + 90})
    predicted = segs.withColumn("backend", F.lit("exact")).unionByName(late.withColumn("backend", F.lit("late")))
    runs = derived.calls(segs).select("call_id", F.explode(F.array(F.lit("exact"), F.lit("late"))).alias("backend"), ((F.col("call_id") * 7919 % 1000 + 1) / 10.0).alias("latency_ms"))
    return evaluation.vad_benchmark(predicted, segs, runs)


BENCH = f"""{SEG}, {_runs}, pr AS (SELECT 'exact' AS backend, * FROM seg UNION ALL SELECT 'late', call_id, seq, channel, "start" + 90, "end" + 90 FROM seg WHERE seq % 2 = 0),
sz AS (SELECT backend, call_id, channel, sum("end" - "start") AS p FROM pr GROUP BY ALL), rz AS (SELECT call_id, channel, sum("end" - "start") AS r FROM seg GROUP BY ALL),
ix AS (SELECT p.backend, p.call_id, p.channel, sum(least(p."end", s."end") - greatest(p."start", s."start")) AS i FROM pr p JOIN seg s ON s.call_id = p.call_id AND s.channel = p.channel AND p."start" < s."end" AND s."start" < p."end" GROUP BY ALL),
io AS (SELECT rs.backend, rs.call_id, c.channel, coalesce(coalesce(i, 0) * 1.0 / nullif(coalesce(p, 0) + coalesce(r, 0) - coalesce(i, 0), 0), 0) AS iou FROM rs CROSS JOIN (VALUES (0), (1)) c(channel) LEFT JOIN sz ON sz.backend = rs.backend AND sz.call_id = rs.call_id AND sz.channel = c.channel LEFT JOIN rz ON rz.call_id = rs.call_id AND rz.channel = c.channel LEFT JOIN ix ON ix.backend = rs.backend AND ix.call_id = rs.call_id AND ix.channel = c.channel),
la AS (SELECT backend, avg(latency_ms) AS mean_latency_ms, max(CASE WHEN k = greatest(0, CAST(floor(n * 0.95) AS BIGINT) - 1) THEN latency_ms END) AS p95_latency_ms FROM (SELECT *, row_number() OVER (PARTITION BY backend ORDER BY latency_ms) - 1 AS k, count(*) OVER (PARTITION BY backend) AS n FROM rs) q GROUP BY backend),
bm AS (SELECT io.backend, count(DISTINCT call_id) AS num_calls, avg(iou) FILTER (WHERE channel = 0) AS caller_mean_iou, median(iou) FILTER (WHERE channel = 0) AS caller_median_iou, min(iou) FILTER (WHERE channel = 0) AS caller_min_iou, avg(iou) FILTER (WHERE channel = 1) AS agent_mean_iou, median(iou) FILTER (WHERE channel = 1) AS agent_median_iou, min(iou) FILTER (WHERE channel = 1) AS agent_min_iou, any_value(mean_latency_ms) AS mean_latency_ms, any_value(p95_latency_ms) AS p95_latency_ms FROM io JOIN la ON la.backend = io.backend GROUP BY io.backend)"""
_IOUS = [f"{s}_{k}_iou" for s in ("caller", "agent") for k in ("mean", "median", "min")]


@query(f"WITH {BENCH} SELECT backend, num_calls, {', '.join(f'{six(n)} AS {n}' for n in _IOUS)}, {six('(caller_mean_iou + agent_mean_iou) / 2')} AS mean_overall_iou, {six('mean_latency_ms')} AS mean_latency_ms, {six('p95_latency_ms')} AS p95_latency_ms FROM bm")
def vad_benchmark(spark, sf_dir):
    return rounded(_benchmark(spark, sf_dir))


@query(f"WITH {BENCH} SELECT backend, {six('(caller_mean_iou + agent_mean_iou) / 2')} AS mean_overall_iou FROM bm ORDER BY caller_mean_iou + agent_mean_iou DESC, backend LIMIT 1")
def best_backend(spark, sf_dir):
    return rounded(evaluation.best_backend(_benchmark(spark, sf_dir)).select("backend", "mean_overall_iou"))


@query(f"WITH {BENCH} SELECT backend, num_calls, {six('caller_mean_iou')} AS mean_caller_iou, {six('agent_mean_iou')} AS mean_agent_iou, {six('mean_latency_ms')} AS mean_latency_ms, {six('p95_latency_ms')} AS p95_latency_ms FROM bm")
def eval_summary(spark, sf_dir):
    return rounded(evaluation.eval_summary(_benchmark(spark, sf_dir)))


def _answers(spark, sf_dir):
    p = F.when(F.col("call_id") % 9 != 0, F.col("stops") / (F.col("stops") + F.col("commas") + 1))
    return derived.feature_rows(spark, sf_dir).withColumns({"p": p, "latency_ms": F.col("chars") / 8.0, "timing_ms": F.col("spaces") / 16.0})


@query(f"""WITH {FEA}, a AS (SELECT label = 'synthetic' AS y, stops / (stops + commas + 1) AS p, chars / 8.0 AS t, spaces / 16.0 AS l FROM feat WHERE call_id % 9 <> 0), o AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS k, count(*) OVER () AS n FROM a), r AS (SELECT avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0 END) FILTER (WHERE y) AS tpr, avg(CASE WHEN p < 0.5 THEN 1.0 ELSE 0 END) FILTER (WHERE NOT y) AS tnr FROM a)
SELECT count(*) AS calls, {six("avg(CASE WHEN y = (p >= 0.5) THEN 1.0 ELSE 0 END)")} AS accuracy, {six("max(tpr)")} AS tpr_synthetic, {six("max(tnr)")} AS tnr_human, {six("max((tpr + tnr) / 2)")} AS balanced_accuracy, {six("avg(t)")} AS mean_latency_ms, {six("max(t)")} AS max_latency_ms, {six("avg(l)")} AS mean_timing_ms, {six("(SELECT max(t) FROM o WHERE k = n // 2)")} AS p50_latency_ms, {six("(SELECT avg(CASE WHEN x.p > z.p THEN 1.0 WHEN x.p = z.p THEN 0.5 ELSE 0 END) FROM a x, a z WHERE x.y AND NOT z.y)")} AS auc FROM a, r""")
def latency_summary(spark, sf_dir):
    return rounded(evaluation.latency_summary(_answers(spark, sf_dir), "p", "latency_ms", ["timing_ms"]))


_ST = f"""{FEA}, lf AS (SELECT split, label = 'synthetic' AS y, u.feature, u.value FROM feat, LATERAL (VALUES {", ".join(f"('{n}', {n})" for n in derived.FEATURES)}) u(feature, value)),
st AS (SELECT split, feature, count(*) FILTER (WHERE NOT y) AS human_n, count(*) FILTER (WHERE y) AS synthetic_n, avg(value) FILTER (WHERE NOT y) AS human_mean, avg(value) FILTER (WHERE y) AS synthetic_mean, stddev_samp(value) FILTER (WHERE NOT y) AS human_std, stddev_samp(value) FILTER (WHERE y) AS synthetic_std FROM lf GROUP BY split, feature),
ef AS (SELECT *, synthetic_mean - human_mean AS delta, (synthetic_mean - human_mean) / nullif(sqrt((human_std * human_std + synthetic_std * synthetic_std) / 2), 0) AS d FROM st)"""


@query(f"WITH {_ST} SELECT split, feature, human_n, synthetic_n, {', '.join(f'{six(f'coalesce({n}, 0)')} AS {n}' for n in ('human_mean', 'synthetic_mean', 'human_std', 'synthetic_std', 'delta'))}, {six('coalesce(d, 0)')} AS effect_size, rank() OVER (PARTITION BY split ORDER BY abs(d) DESC) AS rank FROM ef")
def explore_splits(spark, sf_dir):
    found = evaluation.group_stats(derived.feature_rows(spark, sf_dir), derived.FEATURES, ["split"])
    return rounded(found.select("split", "feature", "human_n", "synthetic_n", "human_mean", "synthetic_mean", "human_std", "synthetic_std", "delta", "effect_size", F.col("rank").cast("long").alias("rank")))


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, array_to_string(list_sort(list(DISTINCT CASE WHEN quality = 1 THEN 'synthetic' ELSE 'human' END)), ',') AS labels FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def labels_present(spark, sf_dir):
    return evaluation.labels_present(derived.feature_rows(spark, sf_dir), "split").select("split", F.array_join("labels", ",").alias("labels"))


@query(f"WITH {FEA} SELECT call_id, chars + 2 * lines + 3 * commas AS weighed, round_even(chars / 32.0, 2) AS half_even FROM feat")
def feature_vectors(spark, sf_dir):
    """A dense vector times fixed weights, and a number whose halves go to the even digit."""
    rows = derived.feature_rows(spark, sf_dir).withColumn("v", evaluation.dense_vector(["chars", "lines", "commas"]))
    weighed = F.aggregate(F.zip_with("v", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), lambda x, w: x * w), F.lit(0.0), lambda t, x: t + x)
    return rows.select("call_id", weighed.alias("weighed"), evaluation.half_even(F.col("chars") / 32.0, 2).alias("half_even"))


@query()
def explore_both(spark, sf_dir):
    found = evaluation.explore(derived.feature_rows(spark, sf_dir), derived.FEATURES, 3)
    rows = [(s, ",".join(found["stable"]), float(found["rank_correlation"]), float(m["accuracy"]), float(m["auc"])) for s, m in found["metrics"].items()]
    return rounded(spark.createDataFrame(rows, "split string, stable string, rank_correlation double, accuracy double, auc double"))


@query()
def layer_benchmark(spark, sf_dir):
    """Detectors, two guarded heads, one suite that must be skipped, and the training."""
    rows = settled(derived.feature_rows(spark, sf_dir))  # texts are read once for all of them
    suites = {"marks": derived.FEATURES, "sizes": ("chars", "spaces")}
    found = evaluation.layer_benchmark(rows, suites, _benchmark(spark, sf_dir), (("chars", "lines"), ("commas", "spaces", "stops"))) + evaluation.layer_benchmark(rows.where("split = 'val'"), {"alone": ("chars",)}, tandem=None)
    out = [(x["id"], x["status"], x.get("best") or ",".join(x.get("features_used", [])), float((x.get("val") or x.get("metrics", {}).get("val", {}).get("stacked", {})).get("accuracy", 0))) for x in found]
    return rounded(spark.createDataFrame(out, "id string, status string, chosen string, accuracy double"))


@query()
def head_tuning(spark, sf_dir):
    rows = derived.feature_rows(spark, sf_dir)
    name, _, variants = evaluation.tune_heads({"hybrid": rows, "other": rows.withColumn("commas", F.lit(0.0))}, ("chars", "lines"), ("commas", "spaces"), "stops")
    return rounded(spark.createDataFrame([(name, v["id"], float(v["metrics"]["val"]["stacked"]["accuracy"])) for v in variants], "chosen string, id string, accuracy double"))


def _misses(spark, sf_dir):
    return _answers(spark, sf_dir).where("p is not null")


@query(f"WITH {FEA}, a AS (SELECT call_id, label, stops / (stops + commas + 1) AS p FROM feat WHERE call_id % 9 <> 0) SELECT call_id, {six('p')} AS p, {six('greatest(p, 1 - p)')} AS confidence FROM a WHERE (p >= 0.5) <> (label = 'synthetic')")
def miss_list(spark, sf_dir):
    return rounded(evaluation.misses(_misses(spark, sf_dir)).select("call_id", "p", "confidence"))
