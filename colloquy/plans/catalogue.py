"""Every operator as a query over the derived inputs, with the SQL that DuckDB checks it by where SQL can say it.

Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import signal as dsp
from colloquy.functions.stats import or_zero
from colloquy.operators import intervals, layers, ledger, ranking, scoring, timing, transcripts
from colloquy.plans import derived
from colloquy.schemas import AGENT, CALLER, RECOVERY_NAMES, SEMANTIC_NAMES, TIMING_NAMES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, -0.0 to 0.0."""
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def six(sql: str) -> str:
    return f"round({sql}, 6) + 0.0"


SEG, SEC, FRM, TRN, FEA = derived.SEGMENTS_SQL, derived.SECONDS_SQL, derived.FRAMES_SQL, derived.TRANSCRIPTS_SQL, derived.FEATURES_SQL
OVER = 'c."start" < a."end" AND a."start" < c."end"'
PAIRS = f'pairs AS (SELECT c.call_id, c.seq AS c_seq, a.seq AS a_seq, c."start" AS cs, c."end" AS ce, a."start" AS "as", a."end" AS ae FROM caller c JOIN agent a ON c.call_id = a.call_id AND {OVER})'


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    segs = derived.segments(spark, sf_dir)
    return segs, intervals.channel(segs, CALLER), intervals.channel(segs, AGENT)


# scans, joins, groups


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, quality, count(*) AS n FROM labels GROUP BY CUBE (1, 2)")
def scan_split_counts(spark, sf_dir):
    split = F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train").alias("split")
    return derived.table(spark, sf_dir, "labels").select(split, "quality").cube("split", "quality").agg(F.count("*").alias("n"))


@query("SELECT lang, source, count(*) AS n, sum(quality) AS good FROM documents JOIN labels USING (doc_id) GROUP BY lang, source")
def equi_join_labels(spark, sf_dir):
    docs, labels = derived.table(spark, sf_dir, "documents"), derived.table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))


@query("SELECT page_id, octet_length(from_base64(to_base64(encode(url)))) AS n_bytes FROM pages")
def base64_round_trip(spark, sf_dir):
    """All urls to base64 and back, null ones as null; a mark before bad base64 makes it null and not an error."""
    pages = derived.table(spark, sf_dir, "pages")
    coded = pages.select("page_id", F.base64(F.encode("url", "UTF-8")).alias("b"))
    read = lambda x: F.try_to_binary(x, F.lit("base64"))
    return coded.where(read(F.concat(F.lit("!!!"), "b")).isNull()).select("page_id", F.length(read(F.replace("b", F.lit("\r\n"), F.lit("")))).cast("long").alias("n_bytes"))


# segments and ledgers


@query(f'WITH {SEG} SELECT call_id, seq, channel, "start", "end" FROM seg')
def segments_merge(spark, sf_dir):
    return derived.segments(spark, sf_dir)


FRAME_CS = 100


@query(f"""WITH {SEG}, n AS (SELECT call_id, greatest((duration + {FRAME_CS - 1}) // {FRAME_CS}, 1) AS n FROM calls),
grid AS (SELECT call_id, unnest(generate_series(0, n - 1)) AS f FROM n),
hit AS (SELECT call_id, channel, unnest(generate_series("start" // {FRAME_CS}, ("end" + {FRAME_CS - 1}) // {FRAME_CS} - 1)) AS f FROM seg),
on_ AS (SELECT call_id, f, max(CASE WHEN channel = 0 THEN 1 ELSE 0 END) AS c, max(CASE WHEN channel = 1 THEN 1 ELSE 0 END) AS a FROM hit GROUP BY call_id, f),
st AS (SELECT g.call_id, g.f, coalesce(c, 0) + 2 * coalesce(a, 0) AS s FROM grid g LEFT JOIN on_ o ON g.call_id = o.call_id AND g.f = o.f),
lagged AS (SELECT *, CASE WHEN s = lag(s) OVER (PARTITION BY call_id ORDER BY f) THEN 0 ELSE 1 END AS new FROM st),
run AS (SELECT *, sum(new) OVER (PARTITION BY call_id ORDER BY f) AS r FROM lagged)
SELECT call_id, CAST(r - 1 AS INTEGER) AS event_idx, CASE s WHEN 1 THEN 0 WHEN 2 THEN 1 END AS channel, min(f) AS first, max(f) + 1 AS last, CASE s WHEN 0 THEN 'silence' WHEN 3 THEN 'overlap' ELSE 'speech' END AS type
FROM run GROUP BY call_id, r, s""")
def ledger_rle(spark, sf_dir):
    segs = derived.segments(spark, sf_dir)
    return ledger.ledger(segs, derived.calls(segs), FRAME_CS)


LED = ORACLES["ledger_rle"].rpartition("\nSELECT call_id, CAST(r")
LEDGER_CTE = f"{LED[0]}, ev AS (SELECT call_id, CAST(r{LED[2]})"


@query(f"""{LEDGER_CTE},
sums AS (SELECT call_id, sum(CASE WHEN type = 'speech' AND channel = 0 THEN last - first ELSE 0 END) AS caller_talk_s, sum(CASE WHEN type = 'speech' AND channel = 1 THEN last - first ELSE 0 END) AS agent_talk_s,
 sum(CASE WHEN type = 'overlap' THEN last - first ELSE 0 END) AS overlap_s, sum(CASE WHEN type = 'silence' THEN last - first ELSE 0 END) AS silence_s, count(*) FILTER (WHERE type = 'overlap') AS interruption_count FROM ev GROUP BY call_id),
sp AS (SELECT * FROM ev WHERE type = 'speech'),
g1 AS (SELECT t.call_id, t.last, min(r.first) - t.last AS gap FROM sp t JOIN sp r ON t.call_id = r.call_id AND t.channel = 1 AND r.channel = 0 AND r.first > t.last GROUP BY t.call_id, t.last),
g0 AS (SELECT t.call_id, t.last, min(r.first) - t.last AS gap FROM sp t JOIN sp r ON t.call_id = r.call_id AND t.channel = 0 AND r.channel = 1 AND r.first > t.last GROUP BY t.call_id, t.last),
m1 AS (SELECT call_id, avg(gap) AS m FROM g1 GROUP BY call_id), m0 AS (SELECT call_id, avg(gap) AS m FROM g0 GROUP BY call_id)
SELECT s.call_id, CAST(caller_talk_s AS DOUBLE) AS caller_talk_s, CAST(agent_talk_s AS DOUBLE) AS agent_talk_s, CAST(overlap_s AS DOUBLE) AS overlap_s, CAST(silence_s AS DOUBLE) AS silence_s, interruption_count,
 {six("coalesce(m1.m, 0)")} AS mean_agent_response_latency_s, {six("coalesce(m0.m, 0)")} AS mean_caller_response_latency_s FROM sums s LEFT JOIN m1 ON m1.call_id = s.call_id LEFT JOIN m0 ON m0.call_id = s.call_id""")
def conversation_metrics(spark, sf_dir):
    """In frames of the ledger."""
    segs = derived.segments(spark, sf_dir)
    events = ledger.ledger(segs, derived.calls(segs), FRAME_CS).withColumnsRenamed({"first": "start", "last": "end"})
    return rounded(ledger.conversation_metrics(events))


# interval joins


@query(f'WITH {SEG}, {PAIRS} SELECT call_id, c_seq, a_seq, least(ce, ae) - greatest(cs, "as") AS length FROM pairs')
def overlap_pairs(spark, sf_dir):
    _, caller, agent = sides(spark, sf_dir)
    return intervals.overlap_join(caller, agent).select("call_id", F.col("a_seq").alias("c_seq"), F.col("b_seq").alias("a_seq"), intervals.overlap_length().alias("length"))


@query(f'WITH {SEG}, {PAIRS} SELECT call_id, count(*) AS n, sum(least(ce, ae) - greatest(cs, "as")) AS total FROM pairs GROUP BY call_id')
def overlap_by_call(spark, sf_dir):
    """By buckets of ten seconds, which give the same pairs."""
    _, caller, agent = sides(spark, sf_dir)
    return intervals.overlap_join(caller, agent, width=1000).groupBy("call_id").agg(F.count("*").alias("n"), F.sum(intervals.overlap_length()).alias("total"))


@query(f'WITH {SEG} SELECT call_id, seq, "start", "end" FROM caller c WHERE "end" - "start" < 500 AND EXISTS (SELECT 1 FROM agent a WHERE a.call_id = c.call_id AND {OVER})')
def backchannel_semi(spark, sf_dir):
    _, caller, agent = sides(spark, sf_dir)
    return intervals.overlap_join(caller.where(F.col("end") - F.col("start") < 500), agent, how="left_semi").select("call_id", "seq", "start", "end")


@query(f'WITH {SEG} SELECT call_id, seq, "start" FROM agent a WHERE EXISTS (SELECT 1 FROM caller c WHERE a.call_id = c.call_id AND c."start" < a."start" AND a."start" < c."end")')
def interrupt_semi(spark, sf_dir):
    _, caller, agent = sides(spark, sf_dir)
    return intervals.starts_inside(agent, caller).select("call_id", "seq", "start")


@query(f'WITH {SEG} SELECT call_id, seq, "start", "end" FROM caller c WHERE NOT EXISTS (SELECT 1 FROM agent a WHERE a.call_id = c.call_id AND {OVER})')
def caller_without_overlap_anti(spark, sf_dir):
    _, caller, agent = sides(spark, sf_dir)
    return intervals.overlap_join(caller, agent, how="left_anti").select("call_id", "seq", "start", "end")


@query(f'WITH {SEG} SELECT a.call_id, a.seq, a."end" AS at, min(c."start") AS next_start, min(c."start") - a."end" AS latency FROM agent a JOIN caller c ON a.call_id = c.call_id AND c."start" > a."end" GROUP BY a.call_id, a.seq, a."end"')
def recovery_asof_strict(spark, sf_dir):
    _, caller, agent = sides(spark, sf_dir)
    found = intervals.asof_forward(agent.select("call_id", "seq", F.col("end").alias("at")), caller).where("r_start is not null")
    return found.select("call_id", "seq", "at", F.col("r_start").alias("next_start"), (F.col("r_start") - F.col("at")).alias("latency"))


@query(f'WITH {SEG} SELECT a.call_id, a.seq, min_by(c."end" - c."start", c."start") AS next_length FROM agent a JOIN caller c ON a.call_id = c.call_id AND c."start" > a."end" GROUP BY a.call_id, a.seq')
def recovery_asof_row(spark, sf_dir):
    _, caller, agent = sides(spark, sf_dir)
    found = intervals.asof_forward(agent.select("call_id", "seq", F.col("end").alias("at")), caller).where("r_start is not null")
    return found.select("call_id", "seq", (F.col("r_end") - F.col("r_start")).alias("next_length"))


@query(f'WITH {TRN} SELECT a.call_id, a.seq, min(c.seq) AS reply FROM turns a LEFT JOIN turns c ON c.channel = 0 AND c.call_id = a.call_id AND c."start" >= a."end" WHERE a.channel = 1 GROUP BY a.call_id, a.seq')
def reply_asof_nonstrict(spark, sf_dir):
    turns = derived.transcripts(spark, sf_dir)
    agent = intervals.channel(turns, AGENT).select("call_id", "seq", F.col("end").alias("at"))
    return intervals.asof_forward(agent, intervals.channel(turns, CALLER), strict=False).select("call_id", "seq", F.col("r_seq").alias("reply"))


@query(f"""WITH {SEG}, b AS (SELECT call_id, "start" AS t FROM seg UNION SELECT call_id, "end" FROM seg), p AS (SELECT call_id, t AS "start", lead(t) OVER (PARTITION BY call_id ORDER BY t) AS "end" FROM b)
SELECT call_id, "start", "end" FROM p WHERE "end" IS NOT NULL AND EXISTS (SELECT 1 FROM agent a WHERE a.call_id = p.call_id AND a."start" <= p."start" AND p."start" < a."end") AND NOT EXISTS (SELECT 1 FROM caller c WHERE c.call_id = p.call_id AND c."start" <= p."start" AND p."start" < c."end")""")
def agent_only_intervals(spark, sf_dir):
    return intervals.difference(derived.segments(spark, sf_dir))


@query(f"""WITH {SEG}, r AS (SELECT call_id, "start", "end", max("end") OVER (PARTITION BY call_id ORDER BY "start", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM caller),
free AS (SELECT call_id, coalesce(b, 0) AS "start", "start" AS "end" FROM r UNION ALL SELECT k.call_id, coalesce(m, 0), duration FROM calls k LEFT JOIN (SELECT call_id, max("end") AS m FROM caller GROUP BY call_id) l ON k.call_id = l.call_id)
SELECT call_id, "start", "end" FROM free WHERE "end" > "start" """)
def non_speech_intervals(spark, sf_dir):
    segs, caller, _ = sides(spark, sf_dir)
    return intervals.complement(caller, derived.calls(segs))


@query(f"""WITH {derived.RAW_SQL}, r AS (SELECT *, max("end") OVER (PARTITION BY call_id, channel ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM raw),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR "start" > b THEN 1 ELSE 0 END) OVER (PARTITION BY call_id, channel ORDER BY "start", "end") AS k FROM r), u AS (SELECT call_id, channel, k, max("end") - min("start") AS n FROM i GROUP BY call_id, channel, k)
SELECT call_id, channel, sum(n) AS length FROM u GROUP BY call_id, channel""")
def interval_union(spark, sf_dir):
    return intervals.union_length(derived.raw_segments(spark, sf_dir))


@query(f"""WITH {SEG}, q AS (SELECT call_id, channel, "start" + 90 AS "start", "end" + 90 AS "end" FROM seg), x AS (SELECT a.call_id, a.channel, sum(least(a."end", q."end") - greatest(a."start", q."start")) AS i FROM seg a JOIN q ON a.call_id = q.call_id AND a.channel = q.channel AND a."start" < q."end" AND q."start" < a."end" GROUP BY a.call_id, a.channel),
u AS (SELECT call_id, channel, 2 * sum("end" - "start") AS n FROM seg GROUP BY call_id, channel)
SELECT u.call_id, u.channel, coalesce(i, 0) AS intersection, n - coalesce(i, 0) AS "union", {six("coalesce(i, 0) * 1.0 / (n - coalesce(i, 0))")} AS iou FROM u LEFT JOIN x ON u.call_id = x.call_id AND u.channel = x.channel""")
def iou_per_call(spark, sf_dir):
    segs = derived.segments(spark, sf_dir)
    return rounded(intervals.iou(segs.withColumns({"start": F.col("start") + 90, "end": F.col("end") + 90}), segs))


# features of a call


SWITCH = 'o AS (SELECT call_id, channel, "start" - lag("end") OVER (PARTITION BY call_id ORDER BY "start", seq) AS gap, lag(channel) OVER (PARTITION BY call_id ORDER BY "start", seq) AS b FROM {t}), sw AS (SELECT call_id, channel, gap FROM o WHERE b <> channel)'


@query(f"WITH {SEG}, {SWITCH.format(t='seg')} SELECT call_id, channel, gap FROM sw")
def floor_switch_latency(spark, sf_dir):
    return timing.floor_switches(derived.segments(spark, sf_dir))


def _summary_sql(x: str, prefix: str, parts: str, signed: bool = False) -> str:
    cv = f"CASE WHEN avg({x}) {'<>' if signed else '>'} 0 THEN stddev_pop({x}) / avg({x}) ELSE 0 END"
    found = {"mean": f"avg({x})", "std": f"stddev_pop({x})", "median": f"median({x})", "min": f"min({x})", "max": f"max({x})", "cv": cv, "count": f"CAST(count({x}) AS DOUBLE)"}
    return ", ".join(f"{found[p]} AS {prefix}_{p}{'_s' * (p not in ('cv', 'count'))}" for p in parts.split())


def _case(channel: int, x: str = '"end" - "start"') -> str:
    return f"CASE WHEN channel = {channel} THEN {x} END"


_TIMING = ", ".join([
    _summary_sql(_case(0), "caller_utterance", "mean std median cv", True), _summary_sql(_case(1), "agent_utterance", "mean std median cv", True),
    f"coalesce(sum({_case(0)}), 0) AS sc, coalesce(sum({_case(1)}), 0) AS sa, count({_case(0)}) AS nc, count({_case(1)}) AS na",
])
_GAPS = ", ".join([
    _summary_sql(_case(0, "gap"), "caller_response_latency", "mean std cv median min max", True), _summary_sql("CASE WHEN channel = 0 AND gap >= 0 THEN gap END", "caller_response_latency_pos", "mean median min max cv", True),
    _summary_sql(_case(1, "gap"), "agent_response_latency", "mean std cv", True),
])
_DERIVED = {
    "caller_talk_ratio": "sc / d", "agent_talk_ratio": "sa / d", "overlap_ratio": "coalesce(ov, 0) / d", "silence_ratio": "greatest(0, 1 - (sc + sa - coalesce(ov, 0)) / d)", "caller_segment_count": "nc", "agent_segment_count": "na",
    "overlap_event_count": "oc", "overlap_total_s": "ov", "turn_ratio": "nc * 1.0 / greatest(na, 1)", "caller_vs_agent_speech": "sc / greatest(sa, 0.000001)", "caller_turns_per_min": "nc / (d / 60.0)", "caller_sec_per_turn": "sc / greatest(nc, 1)",
}


@query(f"""WITH {SEC}, {SWITCH.format(t="s")}, t AS (SELECT call_id, {_TIMING} FROM s GROUP BY call_id), g AS (SELECT call_id, {_GAPS} FROM sw GROUP BY call_id), {PAIRS},
p AS (SELECT call_id, sum(least(ce, ae) - greatest(cs, "as")) / 100.0 AS ov, count(*) AS oc FROM pairs GROUP BY call_id)
SELECT d.call_id, {", ".join(f"{six(f'CAST(coalesce({_DERIVED.get(n, n)}, 0) AS DOUBLE)')} AS {n}" for n in TIMING_NAMES)} FROM d LEFT JOIN t ON t.call_id = d.call_id LEFT JOIN g ON g.call_id = d.call_id LEFT JOIN p ON p.call_id = d.call_id""")
def timing_features(spark, sf_dir):
    segs = derived.in_seconds(derived.segments(spark, sf_dir))
    return rounded(timing.timing_features(segs, derived.calls(segs)))


@query(f"""WITH {SEC}, {PAIRS}, ch AS (SELECT * FROM s WHERE channel = 0), ah AS (SELECT * FROM s WHERE channel = 1),
n AS (SELECT a.call_id, a.seq, a."end" AS tr, min(c."start") AS st, min_by(c."end" - c."start", c."start") AS len FROM ah a JOIN ch c ON a.call_id = c.call_id AND c."start" > a."end" GROUP BY a.call_id, a.seq, a."end"),
st AS (SELECT call_id, {_summary_sql("st - tr", "agent_aligned_recovery", "count mean std cv")}, {_summary_sql("len", "agent_aligned_recovery_utterance", "mean std cv")} FROM n GROUP BY call_id),
po AS (SELECT p.call_id, {_summary_sql("n.st - n.tr", "post_overlap_recovery", "mean cv count")} FROM pairs p LEFT JOIN n ON n.call_id = p.call_id AND n.seq = p.a_seq GROUP BY p.call_id),
bg AS (SELECT call_id, count(*) FILTER (WHERE cs >= "as") AS caller_barge_in_count, count(DISTINCT CASE WHEN ce - cs < 100 THEN c_seq END) AS caller_backchannel_count FROM pairs GROUP BY call_id),
fr AS (SELECT call_id, count(*) * count(*) / sum("end" - "start") AS agent_turn_fragmentation FROM ah GROUP BY call_id)
SELECT d.call_id, {", ".join(f"{six(f'CAST(coalesce({n}, 0) AS DOUBLE)')} AS {n}" for n in RECOVERY_NAMES)} FROM d LEFT JOIN st ON st.call_id = d.call_id LEFT JOIN po ON po.call_id = d.call_id LEFT JOIN bg ON bg.call_id = d.call_id LEFT JOIN fr ON fr.call_id = d.call_id""")
def recovery_features(spark, sf_dir):
    segs = derived.in_seconds(derived.segments(spark, sf_dir))
    return rounded(timing.recovery_features(segs, derived.calls(segs)))


@query(f"""WITH {SEC}, c AS (SELECT * FROM s WHERE channel = 0), r AS (SELECT call_id, "start" - coalesce(lag("end") OVER (PARTITION BY call_id ORDER BY "start", seq), 0) AS gap FROM c),
l AS (SELECT call_id, max_by("end", "start") AS e FROM c GROUP BY call_id),
g AS (SELECT call_id, gap FROM (SELECT call_id, gap FROM r UNION ALL SELECT d.call_id, d - coalesce(e, 0) FROM d LEFT JOIN l ON l.call_id = d.call_id) q WHERE gap > 0),
m AS (SELECT call_id, min(gap) AS lo, max(gap) AS hi, count(*) AS n FROM g GROUP BY call_id),
b AS (SELECT g.call_id, CASE WHEN hi <= lo THEN 0 ELSE least(CAST(floor((gap - lo) / ((hi - lo) / 8)) AS BIGINT), 7) END AS bin, max(n) AS n, count(*) AS k FROM g JOIN m ON m.call_id = g.call_id GROUP BY 1, 2)
SELECT call_id, {six("-sum(k * 1.0 / n * log2(k * 1.0 / n))")} AS caller_pause_entropy FROM b GROUP BY call_id""")
def pause_entropy(spark, sf_dir):
    segs = derived.in_seconds(derived.segments(spark, sf_dir))
    return rounded(layers.pause_entropy(segs, derived.calls(segs)))


# energy detection over a call's event values

LEVELS = "lv AS (SELECT user_id AS call_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, 20 * log10(value + 1e-10) AS db FROM events), fl AS (SELECT call_id, quantile_cont(db, 0.12) AS q FROM lv GROUP BY call_id), mk AS (SELECT lv.call_id, idx, db, db > q + 14.0 AS active FROM lv JOIN fl ON fl.call_id = lv.call_id)"


def _levels(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = derived.table(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("call_id"), F.lit(0).alias("channel"), (F.row_number().over(order) - 1).cast("long").alias("idx"), (20 * F.log10(F.col("value") + 1e-10)).alias("db"))


@query(f"WITH {LEVELS} SELECT call_id, idx, {six('db')} AS db, active FROM mk")
def energy_floor_mask(spark, sf_dir):
    return rounded(ledger.energy_mask(_levels(spark, sf_dir)).select("call_id", "idx", "db", "active"))


FRAME_MS = 100


@query(f"""WITH {LEVELS}, sz AS (SELECT call_id, max(idx) + 1 AS n FROM mk GROUP BY call_id), act AS (SELECT call_id, idx, idx - row_number() OVER (PARTITION BY call_id ORDER BY idx) AS g FROM mk WHERE active),
rn AS (SELECT a.call_id, min(idx) * 0.1 AS st, CASE WHEN max(idx) + 1 >= max(n) THEN max(n) * 0.1 ELSE (max(idx) + 1) * 0.1 + 0.1 END AS en FROM act a JOIN sz ON sz.call_id = a.call_id GROUP BY a.call_id, g),
br AS (SELECT *, CASE WHEN st - lag(en) OVER (PARTITION BY call_id ORDER BY st) < 0.35 THEN 0 ELSE 1 END AS b FROM rn), il AS (SELECT *, sum(b) OVER (PARTITION BY call_id ORDER BY st) AS i FROM br)
SELECT call_id, {six("min(st)")} AS "start", {six("max(en)")} AS "end" FROM il GROUP BY call_id, i HAVING max(en) - min(st) >= 0.25""")
def energy_segments(spark, sf_dir):
    """Frames of a tenth of a second, gaps of 0.35 s and segments of 0.25 s: bounds that no sum of tenths meets."""
    found = ledger.mask_segments(ledger.energy_mask(_levels(spark, sf_dir)), 0.1, 0.35, 0.25)
    return rounded(found.select("call_id", "start", "end"))


@query(f"""WITH {LEVELS}, h AS (SELECT DISTINCT call_id, unnest(generate_series(idx * 25 // 40, ((idx + 1) * 25 + 39) // 40 - 1)) AS idx FROM mk WHERE active), n AS (SELECT call_id, ((max(idx) + 1) * 25 + 39) // 40 AS n FROM mk GROUP BY call_id), g AS (SELECT call_id, unnest(generate_series(0, n - 1)) AS idx FROM n)
SELECT g.call_id, g.idx, h.idx IS NOT NULL AS active FROM g LEFT JOIN h ON h.call_id = g.call_id AND h.idx = g.idx""")
def mask_resample(spark, sf_dir):
    mask = ledger.energy_mask(_levels(spark, sf_dir))
    frames = mask.groupBy("call_id").agg(F.ceil((F.max("idx") + 1) * 25 / 40).alias("n"))
    return ledger.resample_mask(mask, 25, 40, frames).select("call_id", "idx", "active")


@query(f"""WITH {LEVELS}, loud AS (SELECT lv.call_id FROM lv JOIN fl ON fl.call_id = lv.call_id WHERE db > q + 36.0) SELECT call_id, count(*) AS n, max(src) AS source FROM (SELECT call_id, 'energy' AS src FROM loud UNION ALL SELECT call_id, 'fallback' FROM lv WHERE NOT EXISTS (SELECT 1 FROM loud WHERE loud.call_id = lv.call_id)) q GROUP BY call_id""")
def hybrid_fallback(spark, sf_dir):
    """Where a strict detector found nothing in a channel, all of another's rows stand in."""
    levels = _levels(spark, sf_dir)
    found = ledger.energy_mask(levels, margin=36.0).where("active").select("call_id", "channel", F.lit("energy").alias("source"))
    other = levels.select("call_id", "channel", F.lit("fallback").alias("source"))
    return layers.with_fallback(found, other).groupBy("call_id").agg(F.count("*").alias("n"), F.max("source").alias("source"))


# signals: embeddings as frames of 64 samples at a rate of 8000

RATE = 8000
STEP = "nx AS (SELECT call_id, idx, i, v, lead(v) OVER (PARTITION BY call_id, idx ORDER BY i) AS w FROM x)"


@query(f"""WITH {FRM}, {STEP} SELECT call_id, idx, {six("sqrt(avg(v * v))")} AS rms, {six("avg(CASE WHEN w IS NULL THEN NULL WHEN sign(v) <> sign(w) THEN 1.0 ELSE 0.0 END)")} AS zcr, {six("CASE WHEN avg(v * v) > 0 THEN max(abs(v)) / sqrt(avg(v * v)) ELSE 0 END")} AS crest FROM nx GROUP BY call_id, idx""")
def frame_rms_zcr_crest(spark, sf_dir):
    """Array functions of each frame, nothing shuffled."""
    x = F.col("x")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v)
    n = F.size(x)
    level = F.sqrt(total(F.transform(x, lambda v: v * v)) / n)
    changes = F.zip_with(F.slice(x, F.lit(1), n - 1), F.slice(x, F.lit(2), n - 1), lambda a, b: (F.signum(a) != F.signum(b)).cast("double"))
    crest = F.when(level > 0, F.array_max(F.transform(x, F.abs)) / level).otherwise(0.0)
    return rounded(derived.frames(spark, sf_dir).select("call_id", "idx", level.alias("rms"), (total(changes) / (n - 1)).alias("zcr"), crest.alias("crest")))


POWER = "pw AS (SELECT call_id, idx, k, sum(v * cos(2 * pi() * k * i / 64)) * sum(v * cos(2 * pi() * k * i / 64)) + sum(v * sin(2 * pi() * k * i / 64)) * sum(v * sin(2 * pi() * k * i / 64)) AS p FROM x CROSS JOIN (SELECT unnest(generate_series(0, 32)) AS k) ks GROUP BY call_id, idx, k)"


def _per_frame(frames: DataFrame, names: list[str], f: Callable) -> DataFrame:
    import pandas as pd

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([(c, i, *f(x)) for c, i, x in zip(batch["call_id"], batch["idx"], batch["x"])], columns=["call_id", "idx", *names])

    return frames.mapInPandas(run, "call_id long, idx long, " + ", ".join(f"{n} double" for n in names))


@query(f"""WITH {FRM}, {POWER} SELECT call_id, idx, {six("sum(k * 125.0 * p) / sum(p)")} AS centroid, {six("exp(avg(ln(p + 1e-12))) / avg(p)")} AS flatness, {six("sum(CASE WHEN k >= 8 THEN p ELSE 0 END) / sum(CASE WHEN k < 8 THEN p ELSE 0 END)")} AS hf_lf FROM pw GROUP BY call_id, idx""")
def frame_spectral(spark, sf_dir):
    return rounded(_per_frame(derived.frames(spark, sf_dir), ["centroid", "flatness", "hf_lf"], lambda x: dsp.spectrum_shape(x, RATE)))


@query(f"""WITH {FRM}, {POWER} SELECT call_id, idx, {six("regr_slope(ln(p + 1e-12), ln(k * 125.0))")} AS slope FROM pw WHERE k BETWEEN 4 AND 24 GROUP BY call_id, idx""")
def frame_pink_slope(spark, sf_dir):
    return rounded(_per_frame(derived.frames(spark, sf_dir), ["slope"], lambda x: (dsp.pink_slope(x, RATE),)))


#: Frames of a label that make one track.
TRACK = 500


@query(f"""WITH {FRM}, n AS (SELECT call_id, idx // {TRACK} AS track, i, lead(v, 1, v) OVER o AS b, lag(v, 1, v) OVER o AS a FROM x WINDOW o AS (PARTITION BY call_id, idx // {TRACK}, i ORDER BY idx)) SELECT call_id, track, i, {six("stddev_pop((b - a) / 2)")} AS delta_std, {six("sum((b - a) / 2)")} AS delta_sum FROM n GROUP BY call_id, track, i""")
def frame_delta(spark, sf_dir):
    """Of all coefficients over a track's frames in order."""
    import numpy as np
    import pandas as pd

    def one(key, rows):
        d = dsp.deltas(np.stack(rows.sort_values("idx")["x"].to_list()))
        return pd.DataFrame({"call_id": key[0], "track": key[1], "i": range(d.shape[1]), "delta_std": d.std(axis=0), "delta_sum": d.sum(axis=0)})

    tracks = derived.frames(spark, sf_dir).withColumn("track", F.floor(F.col("idx") / TRACK))
    return rounded(tracks.groupBy("call_id", "track").applyInPandas(one, "call_id long, track long, i long, delta_std double, delta_sum double"))


@query("""WITH p AS (SELECT user_id AS call_id, value AS v, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d FROM events WHERE value > 0) SELECT call_id, round(coalesce(avg(d) / avg(v), 0), 6) + 0.0 AS jitter FROM p GROUP BY call_id""")
def jitter_shimmer(spark, sf_dir):
    """Relative step between neighbours, of positive values only: jitter of a pitch track, shimmer of levels."""
    import numpy as np
    import pandas as pd

    def one(key, rows):
        return pd.DataFrame({"call_id": [key[0]], "jitter": [dsp.wobble(rows.sort_values(["ts", "event_id"])["value"].to_numpy(np.float64))]})

    tracks = derived.table(spark, sf_dir, "events").where("value > 0").select(F.col("user_id").alias("call_id"), "ts", "event_id", "value")
    return rounded(tracks.groupBy("call_id").applyInPandas(one, "call_id long, jitter double"))


ENV = "ev AS (SELECT user_id AS call_id, event_id % 2 AS ch, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) AS i, value AS v FROM events)"


@query(f"""WITH {ENV} SELECT a.call_id, round(CASE WHEN count(*) >= 3 AND stddev_pop(a.v) > 1e-12 AND stddev_pop(b.v) > 1e-12 THEN corr(a.v, b.v) ELSE 0 END, 6) + 0.0 AS correlation FROM ev a JOIN ev b ON a.call_id = b.call_id AND a.i = b.i AND a.ch = 0 AND b.ch = 1 GROUP BY a.call_id""")
def envelope_corr(spark, sf_dir):
    """Of two channels over the frames that both have."""
    ch = F.col("event_id") % 2
    order = Window.partitionBy("user_id", ch).orderBy("ts", "event_id")
    rows = derived.table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), ch.alias("ch"), F.row_number().over(order).alias("i"), "value")
    # one pass: both channels of a frame meet in a group, no self-join
    both = rows.groupBy("call_id", "i").agg(F.max(F.when(F.col("ch") == 0, F.col("value"))).alias("a"), F.max(F.when(F.col("ch") == 1, F.col("value"))).alias("b")).where("a is not null and b is not null")
    fine = (F.count("*") >= 3) & (F.stddev_pop("a") > 1e-12) & (F.stddev_pop("b") > 1e-12)
    return rounded(both.groupBy("call_id").agg(F.when(fine, F.corr("a", "b")).otherwise(0.0).alias("correlation")))


CORR = "ce AS (SELECT call_id, idx, i, v - avg(v) OVER (PARTITION BY call_id, idx) AS v FROM x), ac AS (SELECT a.call_id, a.idx, b.i - a.i AS lag, sum(a.v * b.v) AS r FROM ce a JOIN ce b ON a.call_id = b.call_id AND a.idx = b.idx AND b.i >= a.i GROUP BY a.call_id, a.idx, b.i - a.i)"


@query(f"""WITH {FRM}, {CORR}, r0 AS (SELECT call_id, idx, r AS e FROM ac WHERE lag = 0), best AS (SELECT ac.call_id, ac.idx, max(r) AS m FROM ac WHERE lag BETWEEN 20 AND 63 GROUP BY 1, 2)
SELECT b.call_id, b.idx, {six("8000.0 / min(lag)")} AS f0, {six("max(CASE WHEN m / e > 0.000001 AND m / e < 0.999 THEN 10 * log10((m / e) / (1 - m / e)) ELSE 0 END)")} AS hnr FROM best b JOIN ac ON ac.call_id = b.call_id AND ac.idx = b.idx AND ac.lag BETWEEN 20 AND 63 AND ac.r = b.m JOIN r0 ON r0.call_id = b.call_id AND r0.idx = b.idx GROUP BY b.call_id, b.idx""")
def f0_autocorr(spark, sf_dir):
    import numpy as np

    def both(x):
        f0, hnr = dsp.pitches(np.asarray(x)[None, :], RATE)
        return float(f0[0]), float(hnr[0])

    return rounded(_per_frame(derived.frames(spark, sf_dir), ["f0", "hnr"], both))


@query(f"""WITH {FRM}, p AS (SELECT a.call_id, a.idx, a.i, a.v - avg(a.v) OVER (PARTITION BY a.call_id, a.idx) AS v, b.v - avg(b.v) OVER (PARTITION BY a.call_id, a.idx) AS w FROM x a JOIN x b ON a.call_id = b.call_id AND b.idx = a.idx + 10 AND a.i = b.i),
n AS (SELECT call_id, idx, sqrt(sum(v * v)) * sqrt(sum(w * w)) AS s FROM p GROUP BY call_id, idx), c AS (SELECT a.call_id, a.idx, a.i - b.i AS lag, sum(a.v * b.w) AS r FROM p a JOIN p b ON a.call_id = b.call_id AND a.idx = b.idx AND a.i - b.i BETWEEN 4 AND 16 GROUP BY 1, 2, 3)
SELECT c.call_id, c.idx, {six("max(abs(r)) / max(s)")} AS peak FROM c JOIN n ON n.call_id = c.call_id AND n.idx = c.idx GROUP BY c.call_id, c.idx""")
def lagged_xcorr(spark, sf_dir):
    """A frame against the one ten after it, which has its label where labels repeat every ten; lags of 0.5 to 2 ms."""
    import pandas as pd

    frames = derived.frames(spark, sf_dir)
    pairs = frames.join(frames.select("call_id", (F.col("idx") - 10).alias("idx"), F.col("x").alias("y")), ["call_id", "idx"])

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([(r.call_id, r.idx, dsp.lagged_peak(r.x, r.y, RATE, 0.5, 2.0)) for r in batch.itertuples()], columns=["call_id", "idx", "peak"])

    return rounded(pairs.mapInPandas(run, "call_id long, idx long, peak double"))


# texts


@query(r"WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{4,}')) AS number FROM documents) SELECT doc_id, count(*) AS n, max(length(number)) AS longest FROM d GROUP BY doc_id")
def digit_runs(spark, sf_dir):
    turns = derived.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("call_id"), F.lit(0).alias("seq"), F.lit(AGENT).alias("channel"), F.lit(0.0).alias("start"), "text")
    return transcripts.numbers(turns).groupBy(F.col("call_id").alias("doc_id")).agg(F.count("*").alias("n"), F.max(F.length("number")).cast("long").alias("longest"))


def _digits_said(spark, sf_dir):
    """Each user's events as agent turns that say their number: neighbours differ in one digit or more."""
    events = derived.table(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("call_id"), F.col("event_id").alias("seq"), F.lit(1).alias("channel"), F.col("event_id").cast("double").alias("start"), F.col("event_id").cast("double").alias("end"), F.concat(F.lit("your number is "), F.col("event_id") + 100000).alias("text"))


@query("""WITH n AS (SELECT user_id AS call_id, event_id AS e, CAST(event_id + 100000 AS VARCHAR) AS t FROM events), p AS (SELECT a.call_id, a.t AS original, b.t AS mutated FROM n a JOIN n b ON a.call_id = b.call_id AND a.e < b.e),
h AS (SELECT *, (CASE WHEN substr(original, 1, 1) <> substr(mutated, 1, 1) THEN 1 ELSE 0 END + CASE WHEN substr(original, 2, 1) <> substr(mutated, 2, 1) THEN 1 ELSE 0 END + CASE WHEN substr(original, 3, 1) <> substr(mutated, 3, 1) THEN 1 ELSE 0 END + CASE WHEN substr(original, 4, 1) <> substr(mutated, 4, 1) THEN 1 ELSE 0 END + CASE WHEN substr(original, 5, 1) <> substr(mutated, 5, 1) THEN 1 ELSE 0 END + CASE WHEN substr(original, 6, 1) <> substr(mutated, 6, 1) THEN 1 ELSE 0 END) AS h FROM p)
SELECT call_id, original, mutated FROM h WHERE h = 1""")
def digit_trap_pairs(spark, sf_dir):
    return transcripts.digit_traps(_digits_said(spark, sf_dir))


@query("""SELECT lang, sum(CASE WHEN regexp_matches(lower(text), '(^|[^a-z])no([^a-z]|$)') THEN 1 ELSE 0 END) AS objections, sum(CASE WHEN regexp_matches(lower(text), 'inter') THEN 1 ELSE 0 END) AS interrupts, sum(length(regexp_extract_all(lower(text), 'que'))) AS fillers FROM documents GROUP BY lang""")
def regex_probes(spark, sf_dir):
    docs = derived.table(spark, sf_dir, "documents").withColumn("t", F.lower("text"))
    return docs.groupBy("lang").agg(F.count_if(F.col("t").rlike("(^|[^a-z])no([^a-z]|$)")).alias("objections"), F.count_if(F.col("t").rlike("inter")).alias("interrupts"), F.sum(F.regexp_count("t", F.lit("que"))).cast("long").alias("fillers"))


@query(f"""WITH {TRN} SELECT call_id, 0.0 + 0 AS digit_trap_count, 0.0 + 0 AS digit_trap_caller_objected, CAST(sum(CASE WHEN channel = 1 AND strpos(text, '?') > 0 AND regexp_matches(text, '(?i)\\bo\\b') THEN 1 ELSE 0 END) AS DOUBLE) AS false_dilemma_count,
CAST(sum(CASE WHEN channel = 1 AND regexp_matches(text, '(?i)interrump') THEN 1 ELSE 0 END) AS DOUBLE) AS announced_interrupt_count, CAST(sum(CASE WHEN channel = 0 THEN length(regexp_extract_all(text, '(?i)\\b(eh+|este|pues|mmm+|ah+)\\b')) ELSE 0 END) AS DOUBLE) AS caller_filler_count FROM turns GROUP BY call_id""")
def semantic_features(spark, sf_dir):
    """Conversations hold no runs of four digits, so their traps are 0; digit_trap_pairs has some."""
    return transcripts.semantic_features(derived.transcripts(spark, sf_dir)).select("call_id", *SEMANTIC_NAMES)


# statistics over labelled rows

LONG = " UNION ALL ".join(f"SELECT call_id, split, label = 'synthetic' AS y, {i} AS idx, '{n}' AS feature, {n} AS value FROM feat" for i, n in enumerate(derived.FEATURES))


def _sizes_sql(spread: str) -> str:
    return f"""WITH {FEA}, lf AS ({LONG}), e AS (SELECT split, idx, feature, (avg(value) FILTER (WHERE y) - avg(value) FILTER (WHERE NOT y)) / nullif(sqrt((power(coalesce({spread}(value) FILTER (WHERE y), 0), 2) + power(coalesce({spread}(value) FILTER (WHERE NOT y), 0), 2)) / 2), 0) AS d FROM lf GROUP BY split, idx, feature),
sz AS (SELECT split, feature, coalesce(d, 0) AS d, row_number() OVER (PARTITION BY split ORDER BY abs(coalesce(d, 0)) DESC, idx) AS rank FROM e)"""


def _sizes(spark, sf_dir, sample=True):
    return ranking.effect_sizes(derived.feature_rows(spark, sf_dir), derived.FEATURES, scoring.is_positive(), ["split"], sample)


@query(f"{_sizes_sql('stddev_samp')} SELECT split, feature, {six('d')} AS d, rank FROM sz")
def effect_sizes(spark, sf_dir):
    return rounded(_sizes(spark, sf_dir).select("split", "feature", "d", "rank"))


@query(f"{_sizes_sql('stddev_pop')} SELECT feature, {six('d')} AS d FROM sz WHERE split = 'train' AND rank <= 3")
def top_separators(spark, sf_dir):
    return rounded(_sizes(spark, sf_dir, sample=False).where("split = 'train' and rank <= 3").select("feature", "d"))


@query(f"{_sizes_sql('stddev_samp')} SELECT {six('corr(a.rank, b.rank)')} AS rank_correlation FROM sz a JOIN sz b ON a.feature = b.feature AND a.split = 'train' AND b.split = 'val'")
def rank_correlation(spark, sf_dir):
    return rounded(ranking.rank_correlation(_sizes(spark, sf_dir), "split", "train", "val"))


@query(f"{_sizes_sql('stddev_samp')} SELECT feature FROM sz WHERE rank <= 3 GROUP BY feature HAVING count(*) = 2")
def stable_features(spark, sf_dir):
    return ranking.stable_features(_sizes(spark, sf_dir), "split", 3)


@query()
def bootstrap_ci(spark, sf_dir):
    return rounded(ranking.bootstrap(derived.feature_rows(spark, sf_dir), derived.FEATURES, scoring.is_positive()))


#: Made-up heads over the derived features, to score with.
TOY = {
    "acoustic": {"feature_names": ["chars", "lines"], "weights": [0.8, -0.5], "bias": 0.1, "mean": [2000.0, 15.0], "std": [2500.0, 20.0]},
    "behavioral": {"feature_names": ["commas", "spaces"], "weights": [-0.7, 1.1], "bias": 0.3, "mean": [20.0, 300.0], "std": [25.0, 400.0]},
    "fusion": {"feature_names": ["p_acoustic", "p_behavioral"], "weights": [1.6, 2.4], "bias": 0.5, "mean": [0.5, 0.5], "std": [0.2, 0.2]},
    "fusion_type": "stacked",
    "quiet_patient": {"wait_min_s": 10.0, "wait_max_s": 30.0, "rms_cv_max": 40.0, "talkative_turn_min": 8},
}


def _logit_sql(part: dict) -> str:
    terms = " + ".join(f"{w} * ({n} - {m}) / {s}" for n, w, m, s in zip(part["feature_names"], part["weights"], part["mean"], part["std"]))
    return f"1.0 / (1.0 + exp(-greatest(-500, least(500, {terms} + {part['bias']}))))"


SCORED = f"""{FEA}, h AS (SELECT *, {_logit_sql(TOY["acoustic"])} AS p_acoustic, {_logit_sql(TOY["behavioral"])} AS p_behavioral FROM feat), f AS (SELECT *, {_logit_sql(TOY["fusion"])} AS p_f FROM h),
r AS (SELECT *, CASE WHEN (p_acoustic >= 0.5) <> (p_behavioral >= 0.5) AND abs(p_f - 0.5) < 0.1 THEN CASE WHEN abs(p_acoustic - 0.5) >= abs(p_behavioral - 0.5) THEN p_acoustic ELSE p_behavioral END ELSE p_f END AS p_r FROM f),
sc AS (SELECT *, CASE WHEN p_r >= 0.5 AND commas BETWEEN 10 AND 30 AND lines < 40 AND stops >= 8 THEN CASE WHEN 1 - p_r < 0.5 THEN 1 - p_r ELSE 0.499 END ELSE p_r END AS p FROM r)"""


def _scored(spark, sf_dir):
    """commas, lines and stops stand in for the features that the last rule looks at."""
    rows = derived.feature_rows(spark, sf_dir)
    stand_ins = {"caller_response_latency_pos_median_s": F.col("commas"), "caller_rms_cv": F.col("lines"), "caller_segment_count": F.col("stops")}
    return scoring.score(rows.withColumns(stand_ins), TOY)


@query(f"WITH {SCORED} SELECT call_id, {six('p_acoustic')} AS p_acoustic, {six('p_behavioral')} AS p_behavioral FROM sc")
def logistic_score(spark, sf_dir):
    return rounded(_scored(spark, sf_dir).select("call_id", "p_acoustic", "p_behavioral"))


@query(f"WITH {SCORED} SELECT call_id, {six('p')} AS p, p >= 0.5 AS is_synthetic, {six('CASE WHEN p >= 0.5 THEN p ELSE 1 - p END')} AS confidence FROM sc")
def fused_verdict(spark, sf_dir):
    return rounded(_scored(spark, sf_dir).select("call_id", "p", "is_synthetic", "confidence"))


_RIGHT = "(label = 'synthetic') = (p >= 0.5)"
_AGREE = "(p_acoustic >= 0.5) = (p >= 0.5) AND (p_behavioral >= 0.5) = (p >= 0.5)"


@query(f"""WITH {SCORED} SELECT split, count(*) AS n, {six(f"avg(CASE WHEN {_RIGHT} THEN 1.0 ELSE 0.0 END)")} AS accuracy, count(*) FILTER (WHERE {_RIGHT} AND {_AGREE}) AS ok, count(*) FILTER (WHERE {_RIGHT} AND NOT ({_AGREE})) AS ok_disagree,
count(*) FILTER (WHERE NOT ({_RIGHT}) AND {_AGREE}) AS miss_agree, count(*) FILTER (WHERE NOT ({_RIGHT}) AND NOT ({_AGREE})) AS miss_mixer FROM sc GROUP BY ROLLUP (split)""")
def inspect_grouping_sets(spark, sf_dir):
    found = scoring.inspection(_scored(spark, sf_dir), scoring.is_positive(), "split")
    return rounded(found.select("split", "n", "accuracy", "ok", "ok_disagree", "miss_agree", "miss_mixer"))


@query(f"""WITH {SCORED}, c AS (SELECT split, count(*) FILTER (WHERE label = 'synthetic' AND p >= 0.5) AS tp, count(*) FILTER (WHERE label <> 'synthetic' AND p >= 0.5) AS fp, count(*) FILTER (WHERE label = 'synthetic' AND p < 0.5) AS fn, count(*) FILTER (WHERE label <> 'synthetic' AND p < 0.5) AS tn FROM sc GROUP BY split)
SELECT split, tp, fp, fn, tn, {six("coalesce(tp * 1.0 / nullif(tp + fp, 0), 0)")} AS "precision", {six("coalesce(tp * 1.0 / nullif(tp + fn, 0), 0)")} AS recall, {six("coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)")} AS f1 FROM c""")
def confusion_metrics(spark, sf_dir):
    rates = ranking.confusion(scoring.is_positive(), F.col("p") >= 0.5)
    return rounded(_scored(spark, sf_dir).groupBy("split").agg(*[rates[n].alias(n) for n in ("tp", "fp", "fn", "tn", "precision", "recall", "f1")]))


@query(f"""WITH {FEA}, k AS (SELECT split, label = 'synthetic' AS y, rank() OVER (PARTITION BY split ORDER BY lines) + (count(*) OVER (PARTITION BY split, lines) - 1) / 2.0 AS r FROM feat), n AS (SELECT split, sum(r) FILTER (WHERE y) AS s, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS q FROM k GROUP BY split)
SELECT split, {six("(s - p * (p + 1) / 2.0) / (p * q)")} AS auc FROM n""")
def auc_avg_rank(spark, sf_dir):
    return rounded(ranking.auc(derived.feature_rows(spark, sf_dir), "lines", scoring.is_positive(), ["split"]))


@query(f"""WITH {SCORED}, a AS (SELECT label = 'synthetic' AS y, CASE WHEN call_id % 7 = 0 THEN NULL ELSE p >= 0.5 END AS said, p, chars / 1000.0 AS t FROM sc), k AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM a WHERE said IS NOT NULL),
u AS (SELECT (sum(r) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2.0) / (count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y)) AS auc FROM k)
SELECT count(*) AS n, count(said) AS answered, {six("count(*) FILTER (WHERE said = y) * 1.0 / count(said)")} AS accuracy, {six("count(*) FILTER (WHERE said = y) * 1.0 / count(*)")} AS accuracy_all, {six("count(*) FILTER (WHERE said AND y) * 1.0 / count(*) FILTER (WHERE said IS NOT NULL AND y)")} AS tpr,
{six("count(*) FILTER (WHERE NOT said AND NOT y) * 1.0 / count(*) FILTER (WHERE said IS NOT NULL AND NOT y)")} AS tnr, {six("avg(t)")} AS mean_latency_s, {six("max(t)")} AS max_latency_s, {six("avg(power(p - CASE WHEN y THEN 1 ELSE 0 END, 2)) FILTER (WHERE said IS NOT NULL)")} AS brier, {six("(SELECT auc FROM u)")} AS auc FROM a""")
def judge_scores(spark, sf_dir):
    said = F.when(F.col("call_id") % 7 != 0, F.col("p") >= 0.5)
    answers = _scored(spark, sf_dir).select(scoring.is_positive().alias("truth"), said.alias("said"), F.when(said.isNotNull(), F.col("confidence")).alias("confidence"), (F.col("chars") / 1000.0).alias("latency_s"))
    return rounded(ranking.judge_scores(answers))


@query("""WITH v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, max(CASE WHEN i = greatest(0, CAST(floor(n * 0.95) AS BIGINT) - 1) THEN value END) AS p95, max(CASE WHEN i = n // 2 THEN value END) AS p50 FROM v GROUP BY user_id""")
def latency_p95_nearest(spark, sf_dir):
    rows = derived.table(spark, sf_dir, "events").select("user_id", "value")
    p95 = ranking.nearest_rank(rows, "value", ranking.p95(), ["user_id"]).withColumnRenamed("value", "p95")
    p50 = ranking.nearest_rank(rows, "value", ranking.upper_median(), ["user_id"]).withColumnRenamed("value", "p50")
    return p95.join(p50, "user_id")


@query()
def logistic_fit(spark, sf_dir):
    rows = derived.feature_rows(spark, sf_dir).withColumn("y", scoring.is_positive().cast("double")).withColumn("model", F.lit("all"))
    return scoring.fit(rows, {"all": list(derived.FEATURES)}).select("model", F.explode(F.arrays_zip("feature_names", "weights", "mean", "std")).alias("z"), "bias").select("model", "z.*", "bias")


@query()
def oof_stack(spark, sf_dir):
    """The whole training: two heads, folds, fusion and what it chose."""
    model = scoring.train(derived.feature_rows(spark, sf_dir), acoustic=("chars", "lines"), behavioural=("commas", "spaces", "stops"))
    rows = [(model["fusion_type"], split, name, float(m["accuracy"]), float(m["auc"])) for split, parts in model["metrics"].items() for name, m in parts.items()]
    return spark.createDataFrame(rows, "fusion_type string, split string, part string, accuracy double, auc double")


@query(f"""WITH {SEC}, {SWITCH.format(t="s")}, w AS (SELECT call_id, median(CASE WHEN channel = 0 AND gap >= 0 THEN gap END) AS w FROM sw GROUP BY call_id), t AS (SELECT call_id, sum(CASE WHEN channel = 1 THEN "end" - "start" END) AS a FROM s GROUP BY call_id),
z AS (SELECT d.call_id, coalesce(w, 0) AS wait, coalesce(a, 0) / d AS talk, 1.0 / (1.0 + exp(-(2.36 * (coalesce(w, 0) - 2.02) / 0.98 - 1.17 * (coalesce(a, 0) / d - 0.48) / 0.08 + 1.28))) AS p FROM d LEFT JOIN w ON w.call_id = d.call_id LEFT JOIN t ON t.call_id = d.call_id)
SELECT call_id, {six("wait")} AS wait, {six("talk")} AS talk, {six("p")} AS p, p >= 0.5 AS is_synthetic FROM z""")
def call_verdicts(spark, sf_dir):
    """Segments to verdicts by the two timing features that separate best."""
    segs = derived.in_seconds(derived.segments(spark, sf_dir))
    features = timing.timing_features(segs, derived.calls(segs))
    head = {"feature_names": ["caller_response_latency_pos_median_s", "agent_talk_ratio"], "weights": [2.36, -1.17], "bias": 1.28, "mean": [2.02, 0.48], "std": [0.98, 0.08]}
    scored = scoring.verdict(features.withColumn("p", scoring.logistic(head)))
    return rounded(scored.select("call_id", F.col("caller_response_latency_pos_median_s").alias("wait"), F.col("agent_talk_ratio").alias("talk"), "p", "is_synthetic"))
