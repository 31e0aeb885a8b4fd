"""Feature statistics over calls: effect sizes, ranks, stability, bootstrap intervals, rank metrics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.stats import effect_size, or_zero, ratio
from colloquy.session import settled


def long_form(rows: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, idx, feature, value): idx keeps the order of features, for ties."""
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for i, n in enumerate(features)]))
    return rows.select(*keys, pairs.alias("pair")).select(*keys, "pair.*")


def effect_sizes(rows: DataFrame, features: Sequence[str], positive: Column, by: Sequence[str] = (), sample: bool = True) -> DataFrame:
    """(by, feature, d, rank) for each feature: one aggregate over the long form. Rank is by size of d, then order."""
    marked = rows.withColumn("positive_", positive)
    sizes = long_form(marked, features, [*by, "positive_"]).groupBy(*by, "idx", "feature").agg(effect_size(F.col("value"), F.col("positive_"), sample).alias("d"))
    return sizes.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.abs("d").desc(), "idx")))


def stable_features(sizes: DataFrame, by: str, k: int) -> DataFrame:
    """(feature): among the first k in every group of by."""
    groups = sizes.select(by).distinct().count()
    return sizes.where(F.col("rank") <= k).groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") == groups).select("feature")


def rank_correlation(sizes: DataFrame, by: str, a, b) -> DataFrame:
    """(rank_correlation): Pearson correlation of the ranks of shared features in groups a and b; 0 if undefined."""
    x, y = (sizes.where(F.col(by) == v).select("feature", F.col("rank").alias(n)) for v, n in ((a, "x"), (b, "y")))
    fine = (F.count("*") >= 2) & (F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0)
    return x.join(y, "feature").agg(F.when(fine, or_zero(F.corr("x", "y"))).otherwise(0.0).alias("rank_correlation"))


MOMENTS = "run int, idx int, positive boolean, n double, s double, q double"


def resampled_moments(rows: DataFrame, features: Sequence[str], positive: Column, runs: int, seed: int, counts: str | None = None) -> DataFrame:
    """(run, idx, positive, n, s, q): count, sum and sum of squares of each feature and class in each resample, as far as a partition has its rows.

    A resample draws as many rows as there are, with replacement: how many of them fall to a partition is a multinomial draw that every task
    makes alike from (seed, run), and how many to a batch of its rows and then to each row follows by conditional binomials from
    (seed, run, partition). So no row has a number, no table of draws exists, and what leaves a task does not grow with its rows.
    counts, an array column of a number for each run, replaces the draw. Sums are of distances from the feature's mean.
    """
    values = F.array(*[F.col(n).cast("double") for n in features])
    base = settled(rows.select(F.coalesce(positive, F.lit(False)).alias("positive"), values.alias("x"), *([counts] if counts else [])))
    sizes = {r["part"]: r["n"] for r in base.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()}  # a number a partition
    means = base.agg(*[F.avg(F.col("x")[i]) for i in range(len(features))]).first()
    centre, total = np.array([m or 0.0 for m in means]), sum(sizes.values())
    parts = sorted(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        if part not in sizes:
            return
        left, draws, dice = sizes[part], np.zeros(runs, np.int64), []
        if not counts:
            shares = np.array([sizes[p] for p in parts]) / total
            draws = np.array([np.random.default_rng([seed, r]).multinomial(total, shares)[parts.index(part)] for r in range(runs)])
            dice = [np.random.default_rng([seed, r, part + 1]) for r in range(runs)]
        sums = np.zeros((3, 2, runs, len(features)))
        for batch in batches:
            k, classes = batch.num_rows, np.array(batch.column("positive").to_pylist())
            if not k:
                continue
            x = np.array(batch.column("x").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(k, len(features)) - centre
            if counts:
                drawn = np.array(batch.column(counts).to_pylist(), np.float64).T[:runs]
            else:
                drawn = np.empty((runs, k))
                for r in range(runs):
                    here = int(dice[r].binomial(draws[r], min(1.0, k / left)))
                    draws[r] -= here
                    drawn[r] = dice[r].multinomial(here, np.full(k, 1.0 / k))
                left -= k
            known = ~np.isnan(x)
            x = np.where(known, x, 0.0)
            for c, own in enumerate((~classes, classes)):
                for which, part_ in enumerate((known[own].astype(np.float64), x[own], x[own] ** 2)):
                    sums[which, c] += drawn[:, own] @ part_
        c, r, i = (a.ravel() for a in np.indices(sums.shape[1:]))
        columns = [pa.array(r, pa.int32()), pa.array(i, pa.int32()), pa.array(c == 1), *(pa.array(s.ravel()) for s in sums)]
        yield pa.record_batch(columns, names=["run", "idx", "positive", "n", "s", "q"])

    return base.mapInArrow(run, MOMENTS)


def bootstrap(rows: DataFrame, features: Sequence[str], positive: Column, runs: int = 200, seed: int = 42, low: float = 0.025, high: float = 0.975, counts: str | None = None) -> DataFrame:
    """(feature, low, high) of the effect size over resamples with replacement; samples of one class are skipped.

    All features share the resamples. See resampled_moments(): sums of moments by run and feature, begun in each task.
    """
    side = lambda positive, x: F.sum(F.when(F.col("positive") == F.lit(positive), F.col(x)).otherwise(0.0))
    sums = [side(c == 1, x).alias(f"{x}{c}") for c in (0, 1) for x in "nsq"]
    found = resampled_moments(rows, features, positive, runs, seed, counts).groupBy("run", "idx").agg(*sums).where("n0 > 0 and n1 > 0")
    mean = lambda c: F.col(f"s{c}") / F.col(f"n{c}")
    spread = lambda c: F.coalesce(F.try_divide(F.greatest(F.col(f"q{c}") - F.col(f"s{c}") * mean(c), F.lit(0.0)), F.col(f"n{c}") - 1), F.lit(0.0))
    sizes = found.select("idx", ratio(mean(1) - mean(0), F.nullif(F.sqrt((spread(0) + spread(1)) / 2), F.lit(0.0))).alias("d"))
    names = F.array(*[F.lit(n) for n in features])
    bounds = sizes.groupBy("idx").agg(F.percentile("d", F.lit(low)).alias("low"), F.percentile("d", F.lit(high)).alias("high"))
    return bounds.select(names[F.col("idx")].alias("feature"), "low", "high")


def below_which(cuts: list[float], x: Column) -> Column:
    """How many of the rising cuts lie below x, by bisection."""
    if not cuts:
        return F.lit(0)
    middle = len(cuts) // 2
    return F.when(x > F.lit(cuts[middle]), below_which(cuts[middle + 1 :], x) + F.lit(middle + 1)).otherwise(below_which(cuts[:middle], x))


def auc(rows: DataFrame, score: str, positive: Column, by: Sequence[str] = (), undefined: float | None = 0.5, ranges: int = 32) -> DataFrame:
    """(by, auc): how often a positive row scores above a negative one, half for ties; undefined where one class is missing.

    Rows are counted by score before anything is put in order, and scores are dealt to ranges, each in order by
    itself, so that no task sees all of them.
    """
    counted = rows.select(*by, F.col(score).alias("score_"), positive.alias("positive_")).groupBy(*by, "score_").agg(F.count_if("positive_").alias("p"), F.count_if(~F.col("positive_")).alias("n"))
    cuts = sorted(set(rows.select(F.col(score).cast("double").alias("score_")).approxQuantile("score_", [i / ranges for i in range(1, ranges)], 0.2 / ranges)))  # at most so many
    range_ = below_which(cuts, F.col("score_"))
    counted = counted.withColumn("range_", range_)
    so_far = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = counted.groupBy(*by, "range_").agg(F.sum("n").alias("m"))
    totals = totals.select(*[F.col(c).alias(f"t_{c}") for c in by], F.col("range_").alias("t_range"), F.coalesce(F.sum("m").over(so_far.partitionBy(*by).orderBy("range_")), F.lit(0)).alias("ahead"))
    same = F.col("range_") == F.col("t_range")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"t_{c}"))
    below = F.coalesce(F.sum("n").over(so_far.partitionBy(*by, "range_").orderBy("score_")), F.lit(0)) + F.col("ahead")
    wins = counted.join(totals, same).select(*by, "p", "n", (F.col("p") * (below + F.col("n") / 2)).alias("wins"))
    p, n = F.sum("p"), F.sum("n")
    return wins.groupBy(*by).agg(F.when((p > 0) & (n > 0), F.sum("wins") / (p * n)).otherwise(F.lit(undefined)).alias("auc"))


def confusion(truth: Column, said: Column) -> dict[str, Column]:
    """Aggregates: counts and guarded rates of a yes-no decision."""
    tp, fp = F.count_if(truth & said), F.count_if(~truth & said)
    fn, tn = F.count_if(truth & ~said), F.count_if(~truth & ~said)
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "tp": tp, "fp": fp, "fn": fn, "tn": tn, "accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": precision, "recall": recall,
        "f1": ratio(2 * precision * recall, precision + recall), "tpr": recall, "tnr": ratio(tn, tn + fp), "balanced_accuracy": (recall + ratio(tn, tn + fp)) / 2,
    }


#: Groups whose ranges are small enough to be sent to every task.
FEW_GROUPS = 100_000


def nearest_rank(rows: DataFrame, value: str, position: Column, by: Sequence[str] = (), bins: int = 256) -> DataFrame:
    """(by, value): the value at a 0-based position among the sorted, position being a function of n.

    Found by histograms: values of each group are counted in bins of their range, the bin that holds the position becomes the range, and
    so on until its values are equal. Each step is a sum that tasks begin by themselves; no group is ever put in order. Up to FEW_GROUPS
    groups' ranges go to every task, so that rows stay where they are and a large group is not one task's.
    """
    keys = list(by) or ["group_"]
    plain = rows.where(F.col(value).isNotNull()).select(*(by or [F.lit(0).alias("group_")]), F.col(value).cast("double").alias("v_"))
    plain = settled(plain)
    state = plain.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v_").alias("low_"), F.max("v_").alias("high_"))
    state = settled(state.withColumn("left_", position.cast("long")).where((F.col("left_") >= 0) & (F.col("left_") < F.col("n"))))
    done = state.where("low_ = high_")
    open_ = state.where("low_ < high_")
    while count := open_.count():
        of = open_.select(*[F.col(k).alias(f"of_{k}") for k in keys], "n", "low_", "high_", "left_")
        same = (F.col("v_") >= F.col("low_")) & (F.col("v_") <= F.col("high_"))
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"of_{k}"))
        of = F.broadcast(of) if count <= FEW_GROUPS else of
        bin_ = F.least(F.floor((F.col("v_") - F.col("low_")) / (F.col("high_") - F.col("low_")) * bins), F.lit(bins - 1)).alias("bin_")
        counted = plain.join(of, same).groupBy(*keys, "n", "left_", bin_).agg(F.count("*").alias("c_"), F.min("v_").alias("low_"), F.max("v_").alias("high_"))
        upto = F.sum("c_").over(Window.partitionBy(*keys).orderBy("bin_"))  # of bins many rows
        held = counted.withColumn("upto_", upto).where((F.col("left_") < F.col("upto_")) & (F.col("left_") >= F.col("upto_") - F.col("c_")))
        state = settled(held.select(*keys, "n", "low_", "high_", (F.col("left_") - F.col("upto_") + F.col("c_")).alias("left_")))
        done, open_ = done.unionByName(state.where("low_ = high_")), state.where("low_ < high_")
    return done.select(*by, F.col("low_").cast(rows.schema[value].dataType).alias(value))


def p95(n: str = "n") -> Column:
    return F.greatest(F.lit(0), F.floor(F.col(n) * 0.95) - 1)


def upper_median(n: str = "n") -> Column:
    return F.floor(F.col(n) / 2)


def judge_scores(answers: DataFrame) -> DataFrame:
    """One row from answers (truth, said, confidence, latency_s); said is null where there was no answer.

    Accuracy is over answers; accuracy_all counts what was not answered as wrong. Brier score and AUC need a
    confidence, read as the probability of what was said, with every answer.
    """
    answers = settled(answers.select("truth", "said", "confidence", "latency_s"))  # scores, ranges and ranks each read them
    answered = F.col("said").isNotNull()
    p = F.when(F.col("said"), F.col("confidence")).otherwise(1 - F.col("confidence"))
    complete = F.count_if(answered & F.col("confidence").isNull()) == 0
    scores = answers.agg(
        F.count("*").alias("n"), F.count_if(answered).alias("answered"), ratio(F.count_if(answered & (F.col("said") == F.col("truth"))), F.count_if(answered)).alias("accuracy"),
        ratio(F.count_if(answered & (F.col("said") == F.col("truth"))), F.count("*")).alias("accuracy_all"),
        ratio(F.count_if(F.col("said") & F.col("truth")), F.count_if(answered & F.col("truth"))).alias("tpr"), ratio(F.count_if(~F.col("said") & ~F.col("truth")), F.count_if(answered & ~F.col("truth"))).alias("tnr"),
        F.avg("latency_s").alias("mean_latency_s"), F.max("latency_s").alias("max_latency_s"), F.when(complete, F.avg(F.when(answered, F.pow(p - F.col("truth").cast("int"), 2)))).alias("brier"), complete.alias("complete"),
    )
    ranked = auc(answers.where(answered & F.col("confidence").isNotNull()).withColumn("p_", p), "p_", F.col("truth"), undefined=None)
    return scores.withColumn("auc", F.when(F.col("complete"), ranked.scalar())).drop("complete")
