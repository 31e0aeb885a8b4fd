"""Queries of data sources, streams, calls that are split over tasks, and statistics by moments. They join the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.operators import intervals, layers, ledger, ranking, scoring, timing
from colloquy.operators.transcripts import semantic_features
from colloquy.plans import derived
from colloquy.plans.catalogue import FEA, FRAME_CS, ORACLES, SEG, query, rounded, sides, six
from colloquy.plans.evaluations import PCM, SPANS, eighths, sounds
from colloquy.schemas import REQUESTS, SEMANTIC_NAMES
from colloquy.session import scratch, small_batches
from colloquy.sources import audio, spool, wav

# calls dealt to buckets of time

#: A bucket in centiseconds; in frames of the ledger it is a hundredth.
WIDTH = 5000


@query(ORACLES["recovery_asof_strict"])
def asof_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, caller, agent = sides(spark, sf_dir)
    found = intervals.asof_forward(agent.select("call_id", "seq", F.col("end").alias("at")), caller, width=WIDTH).where("r_start is not null")
    return found.select("call_id", "seq", "at", F.col("r_start").alias("next_start"), (F.col("r_start") - F.col("at")).alias("latency"))


@query(ORACLES["agent_only_intervals"])
def difference_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.difference(derived.segments(spark, sf_dir), width=WIDTH)


@query(ORACLES["ledger_rle"])
def ledger_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = derived.segments(spark, sf_dir)
    return ledger.ledger(segs, derived.calls(segs), FRAME_CS, width=WIDTH // FRAME_CS)


@query(f"""WITH {SEG}, o AS (SELECT *, lag(channel) OVER w AS before, "start" - lag("end") OVER w AS gap FROM seg WINDOW w AS (PARTITION BY call_id ORDER BY "start", seq))
SELECT call_id, CAST(channel AS INTEGER) AS channel, count(*) AS n, CAST(sum(gap) AS BIGINT) AS total, CAST(min(gap) AS BIGINT) AS least FROM o WHERE before <> channel GROUP BY call_id, channel""")
def switches_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = timing.floor_switches(derived.segments(spark, sf_dir), width=WIDTH)
    return gaps.groupBy("call_id", "channel").agg(F.count("*").alias("n"), F.sum("gap").alias("total"), F.min("gap").alias("least"))


# segments of probabilities: a user's events in order are frames of two channels, of 32 ms each

PAD_MS = 40


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch = (F.col("event_id") % 2).cast("int")
    order = Window.partitionBy("user_id", ch).orderBy("ts", "event_id")
    return derived.table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), ch.alias("channel"), (F.row_number().over(order) - 1).cast("long").alias("idx"), F.least(F.col("value") / 100, F.lit(1.0)).alias("p"))


@query(f"""WITH f AS (SELECT user_id AS call_id, CAST(event_id % 2 AS INTEGER) AS channel, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) - 1 AS idx, least(value / 100, 1.0) AS p FROM events),
nx AS (SELECT call_id, channel, idx, p, max(idx) OVER (PARTITION BY call_id, channel) + 1 AS n, min(CASE WHEN p >= 0.5 THEN idx END) OVER (PARTITION BY call_id, channel ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS up FROM f),
lo AS (SELECT l.*, (SELECT max(h.idx) FROM f h WHERE h.call_id = l.call_id AND h.channel = l.channel AND h.idx < l.idx AND h.p >= 0.5) AS hi FROM nx l WHERE p < 0.35),
fall AS (SELECT call_id, channel, hi, min(idx) AS off, max(idx) AS last_low, any_value(up) AS up, any_value(n) AS n FROM lo WHERE hi IS NOT NULL GROUP BY call_id, channel, hi),
cut AS (SELECT *, lag(up) OVER (PARTITION BY call_id, channel ORDER BY off) AS entered FROM fall WHERE (last_low - off) * 32 >= 96),
first_up AS (SELECT call_id, channel, min(idx) AS first, any_value(n) AS n FROM nx WHERE p >= 0.5 GROUP BY call_id, channel),
seg AS (SELECT c.call_id, c.channel, coalesce(c.entered, u.first) * 32 AS s, c.off * 32 AS e, c.n * 32 AS n FROM cut c JOIN first_up u ON u.call_id = c.call_id AND u.channel = c.channel
 UNION ALL SELECT u.call_id, u.channel, coalesce(l.up, u.first) * 32, u.n * 32, u.n * 32 FROM first_up u LEFT JOIN (SELECT call_id, channel, max_by(up, off) AS up, count(*) AS k, bool_or(up IS NULL) AS over FROM cut GROUP BY call_id, channel) l ON l.call_id = u.call_id AND l.channel = u.channel WHERE NOT coalesce(l.over, false)),
long AS (SELECT *, s - lag(e) OVER w AS b, lead(s) OVER w - e AS a FROM seg WHERE e - s > 64 WINDOW w AS (PARTITION BY call_id, channel ORDER BY s))
SELECT call_id, channel, CAST(greatest(s - CASE WHEN b < {2 * PAD_MS} THEN b // 2 ELSE {PAD_MS} END, 0) AS BIGINT) AS "start", CAST(least(e + CASE WHEN a < {2 * PAD_MS} THEN a // 2 ELSE {PAD_MS} END, n) AS BIGINT) AS "end" FROM long""")
def hysteresis_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entered at a half, left below 0.35 for 96 ms; over 64 ms long; 40 ms more on both sides. Whole milliseconds."""
    found = ledger.hysteresis_segments(_probabilities(spark, sf_dir), 32, least=64, silence=96, pad=PAD_MS)
    return found.select("call_id", "channel", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


# data sources and streams


@query(f"WITH {PCM} SELECT pcm.call_id, max(lg.n) AS n0, {six('sum(x) FILTER (WHERE channel = 0)')} AS s0, {six('sum(x) FILTER (WHERE channel = 1)')} AS s1 FROM pcm JOIN lg ON lg.call_id = pcm.call_id WHERE pcm.call_id LIKE '1%' GROUP BY pcm.call_id")
def wav_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings to a folder of WAV files and back; those whose name does not begin with 1 are not opened."""
    wav.register(spark)
    folder = scratch(spark, "wav-calls")
    sounds(spark, sf_dir).write.format("wav_calls").mode("append").save(folder)

    def run(batches):
        for batch in batches:
            for i, side in enumerate(("pcm0", "pcm1")):
                batch[f"s{i}"] = [float(audio.signal(x).sum(dtype="float64")) for x in batch[side]]
            yield batch[["call_id", "n0", "s0", "s1"]]

    back = spark.read.format("wav_calls").load(folder).where(F.col("call_id").startswith("1"))
    return rounded(small_batches(back).mapInPandas(run, "call_id string, n0 long, s0 double, s1 double"))


NO_MODEL = {"fusion_type": "concatenated", **{n: {"feature_names": [], "weights": [], "mean": [], "std": [], "bias": 0.0} for n in ("acoustic", "behavioral", "concatenated")}}


@query("SELECT CAST(page_id AS VARCHAR) AS call_id, CASE WHEN page_id % 3 = 0 OR url IS NULL THEN 'base64' ELSE 'wav' END AS error FROM pages")
def request_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as requests without sound in a spool, read as a stream and answered in a store, which is read back."""
    from colloquy.streaming.segments import detections

    folder = scratch(spark, "requests")
    text = F.when(F.col("page_id") % 3 != 0, F.base64(F.col("url").cast("binary"))).otherwise(F.concat(F.lit("!"), "url"))
    rows = derived.table(spark, sf_dir, "pages").select(text.alias("audio_base64"), F.col("page_id").cast("string").alias("call_id"), F.lit(2).alias("channels"))
    rows.select(*[c for c in rows.columns if c in REQUESTS]).write.json(f"{folder}/spool")
    detections(spark, f"{folder}/spool", NO_MODEL, f"{folder}/answers", f"{folder}/state", ending=".json").awaitTermination()
    spool.register(spark)
    return spark.read.format("call_answers").load(f"{folder}/answers").select("call_id", "error")


@query(ORACLES["ledger_rle"])
def live_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same runs, closed one after the other while frames of all calls stream by."""
    from colloquy.streaming import live

    folder = scratch(spark, "live")
    segs = derived.segments(spark, sf_dir)
    mask = ledger.segments_mask(segs, derived.calls(segs), FRAME_CS)
    at = lambda idx: F.timestamp_millis(F.lit(1_700_000_000_000) + idx * live.FRAME_MS)
    frames = mask.select(F.col("call_id").cast("string").alias("call_id"), "channel", "idx", "active", at(F.col("idx")).alias("ts"))
    frames.write.parquet(f"{folder}/frames/now")
    # a frame of another call, long after: time goes on, so that calls end
    written = spark.read.parquet(f"{folder}/frames/now")
    later = written.groupBy().agg(F.max("idx").alias("n")).select(F.lit("later").alias("call_id"), F.lit(0).alias("channel"), F.lit(0).cast("long").alias("idx"), F.lit(False).alias("active"), at(F.col("n") + 100_000).alias("ts"))
    later.write.parquet(f"{folder}/frames/later")
    source = spark.readStream.schema(live.FRAMES).option("recursiveFileLookup", True).parquet(f"{folder}/frames")
    live.live_ledger(source).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/out").where("call_id <> 'later'")
    return out.select(F.col("call_id").cast(segs.schema["call_id"].dataType).alias("call_id"), "event_idx", "channel", "first", "last", "type")


@query("SELECT CAST(page_id AS VARCHAR) AS call_id, CASE page_id % 5 WHEN 0 THEN 'stereo' WHEN 1 THEN 'rate' WHEN 2 THEN 'wav' WHEN 3 THEN 'base64' END AS error, CASE page_id % 5 WHEN 4 THEN 8000 END AS sample_rate, CASE page_id % 5 WHEN 4 THEN strlen(coalesce(url, '')) // 4 ELSE 0 END AS n0 FROM pages")
def request_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls as samples of requests of every kind: one channel, a wrong rate, no WAV file, no base64, and sound."""
    url, kind = F.coalesce("url", F.lit("")).cast("binary"), F.col("page_id") % 5
    text = lambda s: F.lit(s).cast("binary")
    number = lambda column, size: F.concat(*[F.substring(F.unhex(F.lpad(F.hex(column), 8, "0")), 4 - i, 1) for i in range(size)])
    channels, rate, size = F.when(kind == 0, 1).otherwise(2), F.when(kind == 1, 44100).otherwise(8000), F.length(url)
    head = [text("RIFF"), number(36 + size, 4), text("WAVEfmt "), number(F.lit(16), 4), number(F.lit(1), 2), number(channels, 2), number(rate, 4), number(rate * 4, 4), number(F.lit(4), 2), number(F.lit(16), 2), text("data"), number(size, 4)]
    file = F.when(kind == 2, F.concat(text("RIFX"), url)).otherwise(F.concat(*head, url))
    coded = F.when(kind == 3, F.concat(F.lit("?"), F.base64(file))).otherwise(F.base64(file))
    rows = derived.table(spark, sf_dir, "pages").select(F.lit(None).cast("string").alias("audio_base64"), F.replace(coded, F.lit("\r\n"), F.lit("")).alias("audio_b64"), F.col("page_id").cast("string").alias("call_id"))
    return audio.requests(rows).select("call_id", "error", "sample_rate", "n0")


# transcripts


@query("""WITH n AS (SELECT user_id AS call_id, event_id AS e, CAST(event_id + 100000 AS VARCHAR) AS t FROM events),
p AS (SELECT a.call_id, a.t AS original, b.t AS mutated, b.e AS said, len(list_filter(generate_series(1, 6), lambda i: substr(a.t, i, 1) <> substr(b.t, i, 1))) AS h FROM n a JOIN n b ON a.call_id = b.call_id AND a.e < b.e)
SELECT c.call_id, CAST(coalesce(k, 0) AS DOUBLE) AS digit_trap_count, CAST(coalesce(o, 0) AS DOUBLE) AS digit_trap_caller_objected, CAST(d AS DOUBLE) AS false_dilemma_count, CAST(m AS DOUBLE) AS announced_interrupt_count, CAST(f AS DOUBLE) AS caller_filler_count
FROM (SELECT user_id AS call_id, count(*) FILTER (WHERE event_id % 7 = 0) AS d, count(*) FILTER (WHERE event_id % 11 = 0) AS m, 2 * count(*) FILTER (WHERE event_id % 3 = 1) AS f FROM events GROUP BY user_id) c
LEFT JOIN (SELECT call_id, count(*) AS k, count(*) FILTER (WHERE said % 3 = 0) AS o FROM p WHERE h = 1 GROUP BY call_id) q ON q.call_id = c.call_id""")
def semantic_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a turn of the agent, which says its number and sometimes asks or warns, and a reply, which sometimes objects or hesitates."""
    e = F.col("event_id")
    asks, warns = F.when(e % 7 == 0, " ¿uno o dos?").otherwise(""), F.when(e % 11 == 0, " perdone que le interrumpa").otherwise("")
    said = F.concat(F.lit("your number is "), e + 100000, asks, warns)
    reply = F.when(e % 3 == 0, "No, espera").when(e % 3 == 1, "EHHH pues vale").otherwise("vale")
    turns = F.array(F.struct(F.lit(1).alias("channel"), e.cast("double").alias("start"), said.alias("text")), F.struct(F.lit(0).alias("channel"), (e + 0.5).alias("start"), reply.alias("text")))
    rows = derived.table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), F.posexplode(turns).alias("pos", "turn"), "event_id")
    rows = rows.select("call_id", (F.col("event_id") * 2 + F.col("pos")).alias("seq"), "turn.channel", "turn.start", F.col("turn.start").alias("end"), "turn.text")
    return semantic_features(rows).select("call_id", *SEMANTIC_NAMES)


# pitch of the caller's segments


@query(f"""WITH {SPANS}, fr AS (SELECT call_id, j, k, row_number() OVER (PARTITION BY call_id ORDER BY j, k) AS pos FROM sg CROSS JOIN (SELECT unnest(generate_series(0, 22)) AS k) ks),
x AS (SELECT fr.call_id, pos, n - (j * 4000 + 1000 + k * 80) AS i, x AS v FROM fr JOIN pcm ON pcm.call_id = fr.call_id AND channel = 0 AND n BETWEEN j * 4000 + 1000 + k * 80 AND j * 4000 + 1000 + k * 80 + 199),
ce AS (SELECT call_id, pos, i, v - avg(v) OVER (PARTITION BY call_id, pos) AS v FROM x), lv AS (SELECT call_id, pos, sqrt(avg(v * v)) AS rms FROM x GROUP BY call_id, pos),
ac AS (SELECT a.call_id, a.pos, b.i - a.i AS lag, sum(a.v * b.v) AS r FROM ce a JOIN ce b ON a.call_id = b.call_id AND a.pos = b.pos AND (b.i - a.i = 0 OR b.i - a.i BETWEEN 20 AND 114) GROUP BY 1, 2, 3),
bs AS (SELECT call_id, pos, max(CASE WHEN lag = 0 THEN r END) AS e, max(CASE WHEN lag > 0 THEN r END) AS m, min_by(lag, -r) FILTER (WHERE lag > 0) AS lag FROM ac GROUP BY call_id, pos),
tr AS (SELECT bs.call_id, bs.pos, CASE WHEN e > 1e-12 THEN 8000.0 / lag ELSE 0 END AS f0, CASE WHEN e > 1e-12 AND m / e > 1e-6 AND m / e < 0.999 THEN 10 * log10((m / e) / (1 - m / e)) ELSE 0 END AS hnr, rms FROM bs JOIN lv ON lv.call_id = bs.call_id AND lv.pos = bs.pos),
fj AS (SELECT call_id, avg(abs(f0 - p)) / avg(f0) AS jitter, stddev_pop(f0) AS s, stddev_pop(f0) / avg(f0) AS c FROM (SELECT call_id, f0, lag(f0) OVER (PARTITION BY call_id ORDER BY pos) AS p FROM tr WHERE f0 > 0) q GROUP BY call_id),
sh AS (SELECT call_id, avg(abs(rms - p)) / avg(rms) AS shimmer FROM (SELECT call_id, rms, lag(rms) OVER (PARTITION BY call_id ORDER BY pos) AS p FROM tr WHERE rms > 0) q GROUP BY call_id),
hn AS (SELECT call_id, avg(hnr) AS m, stddev_pop(hnr) AS s FROM tr WHERE hnr > 0 GROUP BY call_id)
SELECT lg.call_id, round(coalesce(jitter, 0), 4) + 0.0 AS caller_pitch_jitter, round(coalesce(shimmer, 0), 4) + 0.0 AS caller_pitch_shimmer, round(coalesce(fj.s, 0), 2) + 0.0 AS caller_f0_std, round(coalesce(c, 0), 4) + 0.0 AS caller_f0_cv, round(coalesce(m, 0), 4) + 0.0 AS caller_hnr_mean, round(coalesce(hn.s, 0), 4) + 0.0 AS caller_hnr_std
FROM lg LEFT JOIN fj ON fj.call_id = lg.call_id LEFT JOIN sh ON sh.call_id = lg.call_id LEFT JOIN hn ON hn.call_id = lg.call_id""")
def micro_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pitch columns of the micro layer; all of it is computed."""
    heard = sounds(spark, sf_dir)
    found = layers.micro_features(heard, eighths(layers.calls_of(heard)))
    places = {"caller_pitch_jitter": 4, "caller_pitch_shimmer": 4, "caller_f0_std": 2, "caller_f0_cv": 4, "caller_hnr_mean": 4, "caller_hnr_std": 4}
    return found.select("call_id", *[(F.round(n, k) + 0.0).alias(n) for n, k in places.items()])


@query(f"""WITH {SPANS}, iv AS (SELECT call_id, j FROM sg WHERE j * 0.5 + 0.5 <= d),
yd AS (SELECT iv.call_id, j, sqrt(avg(x * x) FILTER (WHERE n < j * 4000 + 2300)) AS e, sqrt(avg(x * x) FILTER (WHERE n >= j * 4000 + 2900)) AS l FROM iv JOIN pcm ON pcm.call_id = iv.call_id AND channel = 0 AND n BETWEEN j * 4000 + 2000 AND j * 4000 + 3199 GROUP BY iv.call_id, j),
ym AS (SELECT call_id, avg(y) AS m, stddev_pop(y) AS s FROM (SELECT call_id, CASE WHEN e > 1e-12 THEN 20 * log10(greatest(l, 1e-12) / e) ELSE 0 END AS y FROM yd) q GROUP BY call_id),
cl AS (SELECT iv.call_id, j, channel, n - j * 4000 - 3000 AS i, x - avg(x) OVER (PARTITION BY iv.call_id, j, channel) AS x FROM iv JOIN pcm ON pcm.call_id = iv.call_id AND n BETWEEN j * 4000 + 3000 AND j * 4000 + 3999),
nr AS (SELECT call_id, j, sqrt(sum(x * x) FILTER (WHERE channel = 0)) * sqrt(sum(x * x) FILTER (WHERE channel = 1)) AS s FROM cl GROUP BY call_id, j),
cc AS (SELECT a.call_id, a.j, a.i - b.i AS lag, sum(a.x * b.x) AS r FROM cl a JOIN cl b ON a.call_id = b.call_id AND a.j = b.j AND a.channel = 0 AND b.channel = 1 AND a.i - b.i BETWEEN 40 AND 250 GROUP BY 1, 2, 3),
bl AS (SELECT call_id, avg(p) AS m FROM (SELECT cc.call_id, cc.j, CASE WHEN max(s) > 1e-12 THEN max(abs(r)) / max(s) ELSE 0 END AS p FROM cc JOIN nr ON nr.call_id = cc.call_id AND nr.j = cc.j GROUP BY cc.call_id, cc.j) q GROUP BY call_id)
SELECT lg.call_id, round(coalesce(ym.m, 0), 4) + 0.0 AS caller_yield_decay_mean_db, round(coalesce(ym.s, 0), 4) + 0.0 AS caller_yield_decay_std_db, round(coalesce(bl.m, 0), 4) + 0.0 AS caller_agent_bleed_correlation, 0.0::DOUBLE AS caller_breath_event_rate, 0.0::DOUBLE AS caller_breath_gap_ratio
FROM lg LEFT JOIN ym ON ym.call_id = lg.call_id LEFT JOIN bl ON bl.call_id = lg.call_id""")
def interaction_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the caller yields to an agent who breaks in, and what of the agent is heard in the caller's channel; breath is always 0."""
    heard = sounds(spark, sf_dir)
    caller = eighths(layers.calls_of(heard).withColumn("duration", F.col("duration") - 0.125))
    # the agent begins in the middle of each of the caller's segments and goes on for a quarter of a second
    agent = caller.select("call_id", (F.col("seq") + 1_000_000).alias("seq"), F.lit(1).alias("channel"), (F.col("start") + 0.125).alias("start"), (F.col("end") + 0.125).alias("end"))
    found = layers.interaction_features(heard, caller.unionByName(agent))
    names = ("caller_yield_decay_mean_db", "caller_yield_decay_std_db", "caller_agent_bleed_correlation", "caller_breath_event_rate", "caller_breath_gap_ratio")
    return found.select("call_id", *[(F.round(n, 4) + 0.0).alias(n) for n in names])


# statistics

#: How often row i counts in run r of bootstrap_moments.
RUNS = 20
COUNTS_SQL = "(call_id * 7919 + r * 104729) % 1009 % 4"
_FEATURES = ", ".join(f"('{n}', {n})" for n in derived.FEATURES)


@query(f"""WITH {FEA}, lf AS (SELECT call_id, label = 'synthetic' AS y, u.feature, u.value AS v FROM feat, LATERAL (VALUES {_FEATURES}) u(feature, value)),
w AS (SELECT y, feature, v, r, {COUNTS_SQL} AS w FROM lf, (SELECT unnest(generate_series(0, {RUNS - 1})) AS r) rs),
m AS (SELECT r, feature, y, sum(w) AS n, sum(w * v) / sum(w) AS m FROM w WHERE w > 0 GROUP BY r, feature, y),
s AS (SELECT m.r, m.feature, m.y, m.m, sum(w.w * (w.v - m.m) * (w.v - m.m)) / (m.n - 1) AS var FROM m JOIN w ON w.r = m.r AND w.feature = m.feature AND w.y = m.y GROUP BY m.r, m.feature, m.y, m.m, m.n),
d AS (SELECT a.r, a.feature, coalesce((a.m - b.m) / nullif(sqrt((a.var + b.var) / 2), 0), 0) AS d FROM s a JOIN s b ON a.r = b.r AND a.feature = b.feature AND a.y AND NOT b.y)
SELECT feature, {six("quantile_cont(d, 0.025)")} AS low, {six("quantile_cont(d, 0.975)")} AS high FROM d GROUP BY feature""")
def bootstrap_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intervals of twenty resamples whose counts are a rule, as SQL has it too."""
    count = F.transform(F.sequence(F.lit(0), F.lit(RUNS - 1)), lambda r: ((F.col("call_id") * 7919 + r * 104729) % 1009 % 4).cast("int"))
    rows = derived.feature_rows(spark, sf_dir).withColumn("counts", count)
    return rounded(ranking.bootstrap(rows, derived.FEATURES, scoring.is_positive(), RUNS, counts="counts"))


@query("WITH o AS (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, l_extendedprice FROM o WHERE k = greatest(0, CAST(floor(n * 0.95) AS BIGINT) - 1)")
def order_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile that was measured, of large groups, by histograms that close in on it."""
    return ranking.nearest_rank(derived.table(spark, sf_dir, "lineitem"), "l_extendedprice", ranking.p95(), ["l_returnflag"])


@query()
def distributed_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A head by gradients that tasks sum, over fifty steps."""
    rows = derived.feature_rows(spark, sf_dir).select(*derived.FEATURES, scoring.is_positive().cast("double").alias("y"))
    found = scoring.fit_spread(rows, derived.FEATURES, epochs=50)
    return rounded(spark.createDataFrame(list(zip(found["feature_names"], found["weights"])), "feature string, weight double").withColumn("bias", F.lit(found["bias"])))

