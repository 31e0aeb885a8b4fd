"""What splits one call, one model or one group over tasks, against what does it in one."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators import intervals, ledger, ranking, scans, scoring, timing
from colloquy.session import scratch


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("backwards", [False, True])
@pytest.mark.parametrize("own", [False, True])
def test_scans_are_windows(spark, backwards, own):
    draw = random.Random(5)
    rows = [(draw.choice("ab"), draw.randint(-30, 30), i, draw.choice([None, 1, 5, -2]), draw.choice([None, "x", "y", "z"])) for i in range(400)]
    table = spark.createDataFrame(rows, "k string, t int, seq int, n int, s string")
    order = Window.partitionBy("k").orderBy(*[(F.desc if backwards else F.asc)(c) for c in ("t", "seq")]).rowsBetween(Window.unboundedPreceding, Window.currentRow if own else -1)
    wanted = table.select("*", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("total"), F.last("s", ignorenulls=True).over(order).alias("last"), F.max("n").over(order).alias("most"))
    for width in (1, 7, 1000):
        got = scans.scanned(table, ["k"], scans.by_time("t", width), ["t", "seq"], backwards, own, sums={"total": F.col("n")}, lasts={"last": F.col("s")}, greatest={"most": F.col("n")})
        assert got.columns == wanted.columns and sorted_rows(got) == sorted_rows(wanted)


def test_one_long_call_is_many_tasks_work(spark):
    """Every operator that takes a width gives what it gives without; no task holds the call."""
    draw, at, rows = random.Random(2), 0, []
    for i in range(3000):
        at += draw.choice([0, 1, 1, 4, 30])
        rows.append(("long", i, draw.randint(0, 1), at, at + draw.choice([0, 1, 3, 12])))
    segments = spark.createDataFrame(rows, "call_id string, seq int, channel int, start long, end long")
    calls = spark.createDataFrame([("long", at + 20)], "call_id string, duration long")
    caller, ends = intervals.channel(segments, 0), intervals.channel(segments, 1).select("call_id", "seq", F.col("end").alias("at"))
    cases = [(lambda w: intervals.sweep(segments, w)), (lambda w: intervals.difference(segments, width=w)), (lambda w: timing.floor_switches(segments, w)), (lambda w: ledger.ledger(segments, calls, 2, w))]
    cases += [lambda w, strict=strict: intervals.asof_forward(ends, caller, strict=strict, width=w).select("seq", "at", "r_seq", "r_start") for strict in (True, False)]
    for case in cases:
        assert sorted_rows(case(None)) == sorted_rows(case(500))
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        held = [len(set(intervals.sweep(segments, w).select(F.spark_partition_id()).toPandas().iloc[:, 0])) for w in (None, 500)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert held[0] == 1 < held[1]


def loop_hysteresis(p, frame, enter, leave, least, silence, pad):
    """The rule frame by frame."""
    out, start, left = [], None, None
    for i, x in enumerate(p):
        if x >= enter:
            left = None
            start = i if start is None else start
        elif x < leave and start is not None:
            left = i if left is None else left
            if (i - left) * frame >= silence:
                out.append([start * frame, left * frame])
                start = left = None
    n = len(p) * frame
    if start is not None:
        out.append([start * frame, n])
    out = [s for s in out if s[1] - s[0] > least]
    padded = [list(s) for s in out]
    for i, s in enumerate(out):
        before = s[0] - out[i - 1][1] if i else None
        after = out[i + 1][0] - s[1] if i + 1 < len(out) else None
        padded[i][0] = max(0, s[0] - (pad if before is None or before >= 2 * pad else before // 2))
        padded[i][1] = min(n, s[1] + (pad if after is None or after >= 2 * pad else after // 2))
    return padded


@pytest.mark.parametrize("settings", [(32, 0.5, 0.35, 120, 280, 0), (32, 0.5, 0.35, 0, 64, 100), (10, 0.6, 0.2, 30, 0, 7)])
def test_hysteresis_against_a_loop(spark, settings):
    frame, enter, leave, least, silence, pad = settings
    draw = np.random.default_rng(7)
    cases = {f"c{k}": np.clip(0.45 + np.cumsum(draw.normal(0, 0.12, int(draw.integers(1, 220)))) % 0.6 - 0.3 * draw.integers(0, 2), 0, 1) for k in range(25)}
    cases |= {"high": np.ones(9), "low": np.zeros(9), "edge": np.array([0.5, 0.35, 0.5, 0.3499, 0.4, 0.3499, 0.5])}
    rows = [(c, 0, i, float(x)) for c, p in cases.items() for i, x in enumerate(p)]
    found = {c: [] for c in cases}
    for r in ledger.hysteresis_segments(spark.createDataFrame(rows, "call_id string, channel int, idx long, p double"), frame, enter, leave, least, silence, pad).collect():
        found[r["call_id"]].append([r["start"], r["end"]])
    assert {c: sorted(v) for c, v in found.items()} == {c: loop_hysteresis(p, *settings) for c, p in cases.items()}


def labelled(spark, n=300, parts=5):
    draw = np.random.default_rng(3)
    rows = [(i, float(draw.normal(2.0 if i % 3 else 1.0)) if i % 50 else None, float(draw.normal(1000.0, 0.5)), bool(i % 3)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "call_id long, a double, b double, y boolean").repartition(parts)


def effect(x, y, w):
    """Weighted by counts, of what is not null."""
    side = []
    for c in (False, True):
        v = np.repeat([x[i] for i in range(len(x)) if y[i] == c and x[i] is not None], [w[i] for i in range(len(x)) if y[i] == c and x[i] is not None])
        side.append((np.mean(v), np.var(v, ddof=1) if len(v) > 1 else 0.0))
    pooled = np.sqrt((side[0][1] + side[1][1]) / 2)
    return (side[1][0] - side[0][0]) / pooled if pooled else 0.0


def test_moments_against_repeated_rows(spark):
    rows, table = labelled(spark)
    counts = np.random.default_rng(1).poisson(1.0, (len(rows), 12))
    with_counts = table.join(spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(counts)], "call_id long, counts array<int>"), "call_id")
    got = {r["feature"]: r for r in ranking.bootstrap(with_counts, ["a", "b"], F.col("y"), 12, counts="counts").collect()}
    for at, name in ((1, "a"), (2, "b")):
        d = [effect([r[at] for r in rows], [r[3] for r in rows], counts[:, run]) for run in range(12)]
        assert got[name]["low"] == pytest.approx(np.quantile(d, 0.025), rel=1e-9) and got[name]["high"] == pytest.approx(np.quantile(d, 0.975), rel=1e-9)


def test_resamples_draw_as_many_rows_as_there_are(spark):
    rows, table = labelled(spark)
    found = ranking.resampled_moments(table, ["b"], F.col("y"), 60, 9).groupBy("run").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("positive"), F.col("n"))).alias("p")).collect()
    assert len(found) == 60 and {r["n"] for r in found} == {300.0}
    share = np.array([r["p"] for r in found]) / 300
    assert share.mean() == pytest.approx(2 / 3, abs=0.02) and 0.015 < share.std() < 0.045  # sqrt(2/9/300) is 0.027
    again = ranking.bootstrap(table, ["a", "b"], F.col("y"), 60, 9)
    bounds = {r["feature"]: r for r in again.collect()}
    draw, d = np.random.default_rng(0), []
    for _ in range(400):
        d.append(effect([r[1] for r in rows], [r[3] for r in rows], np.bincount(draw.integers(0, 300, 300), minlength=300)))
    assert bounds["a"]["low"] == pytest.approx(np.quantile(d, 0.025), abs=0.12) and bounds["a"]["high"] == pytest.approx(np.quantile(d, 0.975), abs=0.12)
    one = ranking.bootstrap(table.where("y"), ["a"], F.col("y"), 5)
    assert one.collect() == [] and ranking.bootstrap(table.limit(0), ["a"], F.col("y"), 5).collect() == []


def test_order_statistics_by_histograms(spark):
    draw = random.Random(4)
    groups = {"many": [draw.lognormvariate(0, 3) for _ in range(900)], "same": [2.0] * 50, "few": [3.0, -1.0], "near": [1.0 + i * 1e-13 for i in range(300)], None: [5.0, 5.0, 7.0]}
    rows = [(k, v) for k, values in groups.items() for v in values] + [("empty", None), ("few", None)]
    table = spark.createDataFrame(rows, "k string, v double")
    for position, of in ((ranking.p95(), lambda n: max(0, int(n * 0.95) - 1)), (ranking.upper_median(), lambda n: n // 2), (F.lit(1), lambda n: 1)):
        for bins in (2, 256):
            got = {r["k"]: r["v"] for r in ranking.nearest_rank(table, "v", position, ["k"], bins).collect()}
            assert got == {k: sorted(v)[of(len(v))] for k, v in groups.items()}
    assert ranking.nearest_rank(table.where("k = 'many'"), "v", F.lit(0)).collect()[0]["v"] == min(groups["many"])
    assert ranking.nearest_rank(table.limit(0), "v", F.lit(0)).collect() == []


def test_gradients_over_tasks_find_the_same_weights(spark):
    rows, table = labelled(spark)
    x = np.array([[r[1] or 0.0, r[2], 7.0] for r in rows])
    wanted = scoring.descend(x, np.array([float(r[3]) for r in rows]), 40)
    got = scoring.fit_spread(table.withColumn("c", F.lit(7.0)).withColumn("y", F.col("y").cast("double")), ["a", "b", "c"], 40)
    for name in ("weights", "mean", "std"):
        assert np.allclose(got[name], wanted[name], atol=1e-9)
    assert got["bias"] == pytest.approx(wanted["bias"], abs=1e-9)


def test_large_trainings_are_spread(spark, monkeypatch):
    """Above a size each model, folds and fusion too, is fitted by all tasks, from its own rows; the document is the same."""
    _, table = labelled(spark, 120)
    rows = table.select("call_id", "a", "b", F.when(F.col("y"), "synthetic").otherwise("human").alias("label"), F.when(F.col("call_id") % 4 == 0, "val").otherwise("train").alias("split"))
    one, seen = scoring.train(rows, acoustic=["a"], behavioural=["b"]), []

    def spread(examples, features):
        seen.append((tuple(features), examples.count()))
        return scoring.parts(scoring.fit(examples, {m["model"].split("#")[0]: features for m in examples.select("model").distinct().collect()})).popitem()[1]

    monkeypatch.setattr(scoring, "TOGETHER", 10)
    monkeypatch.setattr(scoring, "fit_spread", spread)
    two = scoring.train(rows, acoustic=["a"], behavioural=["b"])
    for part in ("acoustic", "behavioral", "concatenated", "fusion"):
        assert two[part]["bias"] == pytest.approx(one[part]["bias"], abs=1e-9) and two[part]["weights"] == pytest.approx(one[part]["weights"], abs=1e-9)
    assert len(seen) == 3 + 2 * 5 + 1 and sorted({n for _, n in seen}) == [72, 90]


def test_folds_are_dealt_in_turn(spark):
    rows = spark.range(1000).select(F.col("id").alias("call_id"), (F.col("id") % 3 == 0).cast("double").alias("y"))
    dealt = scoring.folded(rows)
    order = Window.partitionBy("y").orderBy(F.xxhash64(F.lit(0), "call_id"), "call_id")
    wanted = rows.withColumn("fold", ((F.row_number().over(order) - 1) % 5).cast("int"))
    assert sorted_rows(dealt.select("call_id", "y", "fold")) == sorted_rows(wanted)


def test_scratch_folders_are_shared(spark):
    assert scratch(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir")) and scratch(spark, "x") != scratch(spark, "x")


def test_ranges_of_few_groups_go_to_the_rows(spark, monkeypatch):
    """the rows of a large group are not shuffled to one task to meet its range."""
    plans, settle = [], ranking.settled
    monkeypatch.setattr(ranking, "settled", lambda rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or settle(rows))
    rows = spark.range(2000).select((F.col("id") % 2).alias("g"), (F.col("id") * 37 % 1999).cast("double").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table whose groups Spark can't tell to be few
    try:
        found = {r["g"]: r["v"] for r in ranking.nearest_rank(rows, "v", ranking.p95(), ["g"]).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == {g: sorted(i * 37 % 1999 for i in range(g, 2000, 2))[949] for g in (0, 1)}
    joined = [p for p in plans if "Join" in p]
    assert joined and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in joined)


def test_judged_answers_are_made_once(spark):
    """what answers are made of is read once, and not for each score."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    rows = spark.range(100).select((F.col("id") % 3 == 0).alias("truth"), (F.col("id") % 2 == 0).alias("said"), (F.col("id") / 200 + 0.5).alias("confidence"), F.lit(1.0).alias("latency_s"))
    found = ranking.judge_scores(rows.mapInPandas(run, rows.schema)).first()
    assert found["n"] == 100 and found["accuracy"] == 0.5 and made.value == 100
