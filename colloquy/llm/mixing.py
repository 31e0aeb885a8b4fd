"""Mixing sources to target weights by fitting word budgets as subset sums.

Documents are counted by source and exact length. A source whose budget holds its documents r times over
takes each of them r times; what remains of the budget is fitted from its length counts alone: a
proportional share of every length first, then a bounded-knapsack dynamic programme over the counts left
for the last words. Which documents of a length are taken is a seeded draw. The programme sees one row for
each length of a source, never the documents, so its cost follows the number of different lengths.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import map_rows, same, settle, texts_of, typed

WEIGHTS = (5.0, 2.0, 1.0)
#: No document is taken more often than this, so no target is above so many times its source's size.
MOST_REPEATS = 3
SEED = 20
#: Words of budget that the dynamic programme fits exactly after the proportional share; bounds its table.
FITTED = 1 << 16
#: Documents of one source and length ranked together; larger groups are split by their draw.
RANKED = 20_000


def word_sizes(docs: DataFrame, keep: bool = False, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, draw): size counts runs of anything but ASCII white space. keep: also row, all of docs' columns.

    The seeded draw (63 bits) is that of a row's doc_id and text: rows that share it may stand in for each other.
    """
    columns = [F.col(f"`{n}`").cast(kind).alias(n) for n, kind in (("doc_id", "long"), ("source", "string"), ("text", "string"))]
    rows = docs.select(*columns, *([F.struct("*").alias("row")] if keep else [])).withColumn("draw", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 1))

    def count(columns):
        return {n: c for n, c in columns.items() if n != "text"} | {"size": [len(t.split()) for t in texts_of(columns["text"])]}

    schema = "doc_id long, source string, draw long, size long" + (f", row {rows.schema['row'].dataType.simpleString()}" if keep else "")
    return map_rows(rows, schema, count)


def target_sizes(sizes: Sequence[int], weights: Sequence[float], repeats: int = MOST_REPEATS) -> list[float]:
    """Share the sum of sizes by weight; targets stop at repeats times their size, the excess is reshared."""
    targets, free, budget = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        unit = budget / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * unit >= repeats * sizes[i]]
        for i in full or free:
            targets[i] = float(repeats * sizes[i]) if full else weights[i] * unit
        if not full:
            break
        gone = set(full)
        budget -= sum(repeats * sizes[i] for i in full)
        free = [i for i in free if i not in gone]
    return targets


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest to budget from below.

    Proportional shares leave a rest; whole documents in seeded order bring it under FITTED; then a
    subset-sum table over the counts that are left fits that rest as far as any choice of those can.
    """
    words = int((lengths * counts).sum())
    if budget >= words:
        return counts.copy()
    taken = np.array([int(n) * budget // words for n in counts], np.int64)
    rest = budget - int((taken * lengths).sum())
    order = np.random.default_rng(seed).permutation(len(lengths))
    for i in order:
        size = int(lengths[i])
        if size and rest > FITTED:
            more = min(int(counts[i] - taken[i]), -(-(rest - FITTED) // size), rest // size)
            taken[i] += more
            rest -= more * size
    items = []
    for i in order:
        left, block = int(counts[i] - taken[i]), 1
        while left and 0 < block * int(lengths[i]) <= rest:
            block = min(block, left)
            items.append((i, block))
            left -= block
            block *= 2
    table = min(rest, sum(int(lengths[i]) * k for i, k in items))
    reached, by = np.zeros(table + 1, bool), np.full(table + 1, -1, np.int32)
    reached[0] = True
    for number, (i, k) in enumerate(items):
        step = int(lengths[i]) * k
        if step > table:
            continue
        new = reached[:-step] & ~reached[step:]
        by[step:][new] = number
        reached[step:] |= new
        if reached[table] and table == rest:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, k = items[by[at]]
        taken[i] += k
        at -= int(lengths[i]) * k
    return taken


def plan_of(sizes: DataFrame, weights: Sequence[float], repeats: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """For sizes (source, size, draw): what a document of each length takes, and each source's size and target.

    The first has (source, size, whole, cut, extra, ties): a document is taken whole times and once more if its draw is
    below cut; of the ties documents with just that draw, extra are. The second has (source, source_size, target).
    """
    spark = sizes.sparkSession
    counted = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    sums = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    # one row a source: names and totals, not documents
    per_source = sorted(sums.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    weighed = [weights[i % len(weights)] for i in range(len(per_source))]
    targets = target_sizes([r["source_size"] for r in per_source], weighed, repeats)
    aims = spark.createDataFrame([(r["source"], r["source_size"], t) for r, t in zip(per_source, targets)], "source string, source_size long, target double")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        total, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        whole = min(repeats, int(target // total)) if total else 0
        rows = rows.sort_values("size", ignore_index=True)
        rest = max(0, round(target) - whole * total) if whole < repeats else 0
        return rows.assign(whole=whole, chosen=fit_budget(rows["size"].to_numpy(), rows["n"].to_numpy(), rest, seed)).drop(columns=["source_size", "target"])

    # Spark broadcasts the sources where they are few; a million of them are shuffled
    joined = counted.join(aims, same(counted["source"], aims["source"])).select(counted["source"], "size", "n", "source_size", "target")
    plan = settle(joined.groupBy("source").applyInPandas(choose, "source string, size long, n long, whole int, chosen long"))

    # the draw of the last document that is taken of each length, where it is not all or none
    open_ = plan.where("0 < chosen and chosen < n").select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "n", "chosen")
    draws = sizes.groupBy("source", "size", "draw").agg(F.count("*").alias("ties"))
    draws = draws.join(open_, same(draws["source"], open_["p_source"]) & (draws["size"] == open_["p_size"])).select("source", "size", "draw", "ties", "n", "chosen")
    draws = settle(draws.withColumn("slot", slot(F.col("draw"), F.ceil(F.col("n") / RANKED))))
    ahead = Window.partitionBy("source", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = draws.groupBy("source", "size", "slot").agg(F.sum("ties").alias("m"), F.first("chosen").alias("chosen")).withColumn("before", F.coalesce(F.sum("m").over(ahead), F.lit(0)))
    # only the slot in which the last one lies is put in order
    slots = slots.where("before < chosen and chosen <= before + m").select(F.col("source").alias("s_source"), F.col("size").alias("s_size"), F.col("slot").alias("s_slot"), "before")
    last = draws.join(slots, same(draws["source"], slots["s_source"]) & (draws["size"] == slots["s_size"]) & (draws["slot"] == slots["s_slot"]))
    upto = F.col("before") + F.sum("ties").over(Window.partitionBy("source", "size").orderBy("draw"))
    last = last.select("source", "size", "draw", "ties", (F.col("chosen") - (upto - F.col("ties"))).alias("extra")).where("0 < extra and extra <= ties")
    last = last.select(F.col("source").alias("l_source"), F.col("size").alias("l_size"), F.col("draw").alias("cut"), "extra", "ties")
    plan = plan.join(last, same(plan["source"], last["l_source"]) & (plan["size"] == last["l_size"]), "left")
    cut = F.when(F.col("chosen") >= F.col("n"), F.lit((1 << 63) - 1)).otherwise(F.coalesce("cut", F.lit(-1)))
    plan = plan.select("source", "size", "whole", cut.alias("cut"), F.coalesce("extra", F.lit(0)).alias("extra"), F.coalesce("ties", F.lit(0)).alias("ties"))
    return settle(plan).withColumnsRenamed({"source": "p_source", "size": "p_size"}), aims


def times_taken(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds times to rows with (source, size, draw): how often the plan takes each.

    Rows that share the last draw of their length are told apart by number, counted by partition: there is more than
    one only where a row is repeated.
    """
    both = sizes.join(plan, same(sizes["source"], plan["p_source"]) & (sizes["size"] == plan["p_size"]))
    tied = (F.col("draw") == F.col("cut")) & (F.col("extra") < F.col("ties"))
    more = (F.col("draw") < F.col("cut")) | ((F.col("draw") == F.col("cut")) & (F.col("extra") > 0))
    plain = both.where(~tied).withColumn("times", F.col("whole") + more.cast("int"))
    if plan.where("extra < ties").isEmpty():
        return plain.select(*sizes.columns, "times")
    ties = settle(both.where(tied).withColumn("part", F.spark_partition_id()))
    key = ["source", "size", "part"]
    ahead = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ties.groupBy(*key).agg(F.count("*").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(ahead), F.lit(0)))
    parts = parts.select(*[F.col(k).alias(f"n_{k}") for k in key], "before")
    number = F.row_number().over(Window.partitionBy(*key).orderBy("draw")) + F.col("before")
    told = ties.join(parts, same(ties["source"], parts["n_source"]) & (ties["size"] == parts["n_size"]) & (ties["part"] == parts["n_part"]))
    told = told.withColumn("times", F.col("whole") + (number <= F.col("extra")).cast("int"))
    return plain.select(*sizes.columns, "times").unionByName(told.select(*sizes.columns, "times"))


def taken_words(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs (doc_id, source, text).

    Sources in code point order, null last, weigh as weights repeat. Null and empty texts have size 0 and
    take 0; a null doc_id takes part; repeated rows are documents of their own; an empty table gives no
    rows. Other columns are ignored.
    """
    sizes = settle(word_sizes(docs, seed=seed))
    plan, aims = plan_of(sizes, weights, repeats, seed)
    taken = times_taken(sizes, plan)
    out = taken.join(aims.withColumnRenamed("source", "a_source"), same(taken["source"], F.col("a_source")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def slot(draw: Column, slots: Column) -> Column:
    """Which of so many equal ranges of the draw (63 bits) it falls in."""
    return F.floor(F.shiftright(draw, 31).cast("double") / F.lit(float(1 << 32)) * slots)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """The mixed documents themselves: docs' columns, a row for each time that a document is taken.

    Each row goes by its own source, size and draw, so that sources get what taken_words() grants them, whatever
    doc_ids are repeated or null. Documents of size 0 hold no words and are kept once, as the mix neither gains nor
    loses by them. Other columns, whatever their names, stay as they are. An empty table stays empty. A text is only
    shuffled where Spark finds the plan, a row for each length of a source, too large to broadcast.
    """
    plan, _ = plan_of(settle(word_sizes(docs, seed=seed)), weights, repeats, seed)
    rows = times_taken(word_sizes(docs, keep=True, seed=seed), plan)
    times = F.when(F.col("size") > 0, F.col("times")).otherwise(1)
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).select("row.*")
