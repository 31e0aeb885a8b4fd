"""Call-shaped inputs from the star-schema tables: segments, frames, transcripts, labelled features.

The tables hold no audio. Users' events become segments in whole centiseconds, so that results do not hang
on rounding; embeddings become frames of 64 samples; documents with labels become feature rows. SQL has the
same derivations as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.operators.intervals import merge_close

GAP_CS = 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in order are turns of two channels; where they begin is 40 s of events to a centisecond."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    since = F.col("us") - F.min("us").over(Window.partitionBy("user_id"))
    start = F.floor(since / F.lit(40_000_000)).cast("long")
    length = F.lit(12) + F.floor(F.round(F.col("value") * 100).cast("long") / 10).cast("long")
    return events.select(F.col("user_id").alias("call_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 2).cast("int").alias("channel"), start.alias("start"), (start + length).alias("end"))


RAW_SQL = """since AS (SELECT user_id AS call_id, event_id AS seq, CAST(event_id % 2 AS INTEGER) AS channel, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS us, CAST(round(value * 100) AS BIGINT) AS v FROM events),
raw AS (SELECT call_id, seq, channel, us // 40000000 AS "start", us // 40000000 + 12 + v // 10 AS "end" FROM since)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw segments of a channel joined where less than GAP_CS lies between them, so none overlap."""
    return merge_close(raw_segments(spark, sf_dir), GAP_CS)


SEGMENTS_SQL = f"""{RAW_SQL},
reach AS (SELECT *, max("end") OVER (PARTITION BY call_id, channel ORDER BY "start", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM raw),
island AS (SELECT *, sum(CASE WHEN "start" - before < {GAP_CS} THEN 0 ELSE 1 END) OVER (PARTITION BY call_id, channel ORDER BY "start", seq) AS i FROM reach),
seg AS (SELECT call_id, min(seq) AS seq, channel, min("start") AS "start", max("end") AS "end" FROM island GROUP BY call_id, channel, i),
caller AS (SELECT * FROM seg WHERE channel = 0), agent AS (SELECT * FROM seg WHERE channel = 1),
calls AS (SELECT call_id, max("end") AS duration FROM seg GROUP BY call_id)"""


def calls(segs: DataFrame) -> DataFrame:
    return segs.groupBy("call_id").agg(F.max("end").alias("duration"))


def in_seconds(segs: DataFrame) -> DataFrame:
    return segs.withColumns({"start": F.col("start") / 100.0, "end": F.col("end") / 100.0})


SECONDS_SQL = f"""{SEGMENTS_SQL},
s AS (SELECT call_id, seq, channel, "start" / 100.0 AS "start", "end" / 100.0 AS "end" FROM seg),
d AS (SELECT call_id, duration / 100.0 AS d FROM calls)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, idx, x): embeddings as frames of a signal, a label's in order of their number."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("call_id"), F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("x"))


FRAMES_SQL = """frame AS (SELECT CAST(label AS BIGINT) AS call_id, vec_id AS idx, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
x AS (SELECT call_id, idx, CAST(i AS BIGINT) AS i, CAST(v AS DOUBLE) AS v FROM frame)"""


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcript turns: user 0, assistant 1, half a second each."""
    rows = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')")
    start = F.col("turn").cast("double")
    return rows.select(F.col("conv_id").alias("call_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", 0).otherwise(1).alias("channel"), start.alias("start"), (start + 0.5).alias("end"), "text")


TRANSCRIPTS_SQL = """turns AS (SELECT conv_id AS call_id, turn AS seq, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS channel, CAST(turn AS DOUBLE) AS "start", turn + 0.5 AS "end", text FROM conversations WHERE role IN ('user', 'assistant'))"""

FEATURES = ("chars", "lines", "commas", "spaces", "stops")
MARKS = {"lines": "\n", "commas": ",", "spaces": " ", "stops": "."}


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(call_id, split, label, features): labelled documents with counts of their marks; every fifth id is val."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id")
    count = lambda mark: (F.length("text") - F.length(F.replace("text", F.lit(mark), F.lit("")))).cast("double")
    return rows.select(
        F.col("doc_id").alias("call_id"), F.when(F.col("doc_id") % 5 == 0, "val").otherwise("train").alias("split"), F.when(F.col("quality") == 1, "synthetic").otherwise("human").alias("label"),
        F.length("text").cast("double").alias("chars"), *[count(m).alias(n) for n, m in MARKS.items()],
    )


_COUNTS = ", ".join(f"CAST(length(text) - length(replace(text, {'chr(10)' if m == chr(10) else repr(m)}, '')) AS DOUBLE) AS {n}" for n, m in MARKS.items())
FEATURES_SQL = f"""feat AS (SELECT doc_id AS call_id, CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, CASE WHEN quality = 1 THEN 'synthetic' ELSE 'human' END AS label, CAST(length(text) AS DOUBLE) AS chars, {_COUNTS} FROM documents JOIN labels USING (doc_id))"""
