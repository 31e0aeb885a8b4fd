"""Probe features of transcript turns (call_id, seq, channel, start, end, text): string matching in native functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.stats import or_zero
from colloquy.operators.intervals import asof_forward, channel
from colloquy.operators.timing import with_zeros
from colloquy.schemas import AGENT, CALLER, SEMANTIC_NAMES

#: Fixed patterns of the probes.
DIGITS = r"\d{4,}"
FILLERS = r"(?iu)\b(eh+|este|pues|mmm+|ah+)\b"
OBJECTION = r"(?iu)\b(no|incorrect[oa]|fals[oa]|espera|momento|equivocad[oa])\b"
INTERRUPT = r"(?iu)interrump"
DILEMMA = r"(?iu)\bo\b"


def hamming(a: Column, b: Column) -> Column:
    """Places that differ; -1 if the lengths do."""
    steps = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(steps, F.lit(0), lambda t, x: t + x)).otherwise(-1)


def numbers(turns: DataFrame) -> DataFrame:
    """(call_id, at, number): runs of four digits or more in the agent's turns, numbered in order."""
    agent = channel(turns, AGENT)
    found = agent.select("call_id", "start", "seq", F.posexplode(F.regexp_extract_all("text", F.lit(DIGITS), F.lit(0))).alias("pos", "number"))
    return found.select("call_id", F.row_number().over(Window.partitionBy("call_id").orderBy("start", "seq", "pos")).alias("at"), "number")


def digit_traps(turns: DataFrame) -> DataFrame:
    """(call_id, original, mutated): numbers said again later with one digit changed, each unordered pair once.

    Numbers that differ in one place agree in one of two halves, so pairs are found by equal halves and not
    by comparing all numbers of a call. Of each number its first and last mention decide what came later.
    """
    spans = numbers(turns).groupBy("call_id", "number").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    half = F.floor(F.length("number") / 2).cast("int")
    keys = F.array(F.struct(F.lit(0).alias("side"), F.substring(F.col("number"), F.lit(1), half).alias("part")), F.struct(F.lit(1).alias("side"), F.substring(F.col("number"), half + 1, F.length("number")).alias("part")))
    sided = spans.withColumn("key", F.explode(keys)).withColumn("size", F.length("number"))
    a, b = (sided.select("call_id", "key", "size", *[F.col(c).alias(f"{p}{c}") for c in ("number", "first", "last")]) for p in "ab")
    pairs = a.join(b, ["call_id", "key", "size"]).where((F.col("anumber") < F.col("bnumber")) & (hamming(F.col("anumber"), F.col("bnumber")) == 1)).drop("key").distinct()
    # the pair is met first at the least mention that the other number follows
    forward, back = F.col("afirst") < F.col("blast"), F.col("bfirst") < F.col("alast")
    a_first = forward & (~back | (F.col("afirst") < F.col("bfirst")))
    return pairs.select("call_id", F.when(a_first, F.col("anumber")).otherwise(F.col("bnumber")).alias("original"), F.when(a_first, F.col("bnumber")).otherwise(F.col("anumber")).alias("mutated"))


def objections(turns: DataFrame, traps: DataFrame) -> DataFrame:
    """(call_id, objected): traps whose mutated number's first turn without the original met an objection."""
    agent, caller = channel(turns, AGENT), channel(turns, CALLER)
    said = traps.join(agent.select("call_id", "seq", "start", "end", "text"), "call_id").where(F.col("text").contains(F.col("mutated")) & ~F.col("text").contains(F.col("original")))
    first = said.groupBy("call_id", "original", "mutated").agg(F.min_by("end", F.struct("start", "seq")).alias("at"))
    replies = asof_forward(first.select("call_id", "at"), caller.select("call_id", "seq", "start", "text"), strict=False)
    return replies.groupBy("call_id").agg(F.count_if(F.col("r_text").rlike(OBJECTION)).alias("objected"))


def semantic_features(turns: DataFrame) -> DataFrame:
    """One row a call of the five probe features; calls without a match have zeros."""
    text = F.coalesce("text", F.lit(""))
    rows = turns.withColumn("text", text)
    calls = rows.select("call_id").distinct()
    traps = digit_traps(rows)
    on_agent = F.col("channel") == AGENT
    said = rows.groupBy("call_id").agg(
        F.count_if(on_agent & F.col("text").contains("?") & F.col("text").rlike(DILEMMA)).alias("false_dilemma_count"),
        F.count_if(on_agent & F.col("text").rlike(INTERRUPT)).alias("announced_interrupt_count"),
        # spaces part the turns, so no match spans two of them
        or_zero(F.sum(F.when(F.col("channel") == CALLER, F.regexp_count("text", F.lit(FILLERS))))).alias("caller_filler_count"),
    )
    count = traps.groupBy("call_id").agg(F.count("*").alias("digit_trap_count"))
    objected = objections(rows, traps).withColumnRenamed("objected", "digit_trap_caller_objected")
    return with_zeros(calls, [count, objected, said], SEMANTIC_NAMES)
