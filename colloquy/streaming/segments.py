"""Streaming counterparts: segments and levels from event streams, with watermarks.

Session windows merge on event time plus a gap; the batch operator merges on the end of the segment before.
The two agree where events are the frames of a grid. The quantile floor of energy detection needs the whole
call and has no streaming form here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy.sources.spool import CallAnswers, register


def sessions(events: DataFrame, gap: str = "280 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(call_id, channel, start, end, frames) from active frames (call_id, channel, ts)."""
    merged = events.withWatermark("ts", late).groupBy("call_id", "channel", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("frames"), F.max("ts").alias("last"))
    return merged.select("call_id", "channel", F.col("w.start").alias("start"), F.col("last").alias("end"), "frames")


def levels(samples: DataFrame, frame: str = "25 milliseconds", hop: str = "10 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(call_id, channel, start, db) over sliding windows of samples (call_id, channel, ts, value)."""
    mean = F.avg(F.col("value") * F.col("value"))
    framed = samples.withWatermark("ts", late).groupBy("call_id", "channel", F.window("ts", frame, hop).alias("w")).agg((20 * F.log10(F.sqrt(mean + 1e-10) + 1e-10)).alias("db"))
    return framed.select("call_id", "channel", F.col("w.start").alias("start"), "db")


def detections(spark: SparkSession, spool: str, model: dict, answers: str, checkpoint: str, once: bool = True, fallback=None, **options: str) -> StreamingQuery:
    """Answer the requests of a spool: offsets are bytes of its files, and a batch's answers replace what an attempt before wrote under its number.

    What one batch holds is scored by the plan for tables, whose ordered passes a streaming plan may not have.
    """
    from colloquy.plans.calls import detect

    register(spark)
    columns = [c.strip().split()[0] for c in CallAnswers({}).schema().split(",")]

    def write(batch: DataFrame, number: int) -> None:
        detect(batch, model, fallback).select(*columns).write.format("call_answers").option("batch", number).mode("append").save(answers)

    stream = spark.readStream.format("call_requests").options(**options).load(spool).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
