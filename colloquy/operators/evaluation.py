"""Reports over many calls: detector benchmarks, latency, exploration of features, guarded heads, head tuning.

Whatever is counted over calls is an aggregate; only reports, a row for each detector, feature or part, are collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.stats import or_zero, ratio
from colloquy.operators.intervals import iou
from colloquy.operators.ranking import auc, bootstrap, effect_sizes, long_form, nearest_rank, p95, rank_correlation, upper_median
from colloquy.operators.scoring import ACOUSTIC_HEAD, BEHAVIOURAL_HEAD, evaluate, fit, is_positive, logistic, parts, train
from colloquy.schemas import AGENT, CALLER

#: Features of a guarded head; the least rows it is fitted on and scored on; the accuracy that a head may lose for a feature less.
TOP, LEAST_TRAIN, LEAST_VAL, HOLD = 5, 4, 2, 0.03
#: Resamples of an interval.
RUNS = 200
LOUDNESS = "caller_rms_mean"


def half_even(x: Column, places: int = 4) -> Column:
    """Rounded as reports are: a half goes to the even digit."""
    return F.bround(x, places)


def dense_vector(names: Sequence[str]) -> Column:
    """The named features in order as an array; what is missing is 0."""
    return F.array(*[or_zero(F.col(n)) for n in names])


def labels_present(rows: DataFrame, *by: str, label: str = "label") -> DataFrame:
    """(by, labels): the different labels of each group, sorted. There are as many as kinds of label."""
    return rows.groupBy(*by).agg(F.sort_array(F.collect_set(label)).alias("labels"))


def call_ious(predicted: DataFrame, reference: DataFrame, runs: DataFrame) -> DataFrame:
    """(backend, call_id, channel, iou) for both channels of each (backend, call_id) of runs; 0 where nothing is found or wanted."""
    whose = F.struct("backend", "call_id").alias("call_id")
    pairs = runs.select("backend", "call_id").distinct()
    found = iou(predicted.select(whose, "seq", "channel", "start", "end"), reference.join(pairs, "call_id").select(whose, "seq", "channel", "start", "end"))
    cells = pairs.select("backend", "call_id", F.explode(F.array(F.lit(CALLER), F.lit(AGENT))).alias("channel"))
    return cells.join(found.select("call_id.*", "channel", "iou"), ["backend", "call_id", "channel"], "left").na.fill(0.0, ["iou"])


def latency_stats(runs: DataFrame, by: str = "backend", value: str = "latency_ms") -> DataFrame:
    """(by, mean_latency_ms, p95_latency_ms): the 95th percentile is a latency that was measured."""
    mean = runs.groupBy(by).agg(F.avg(value).alias("mean_latency_ms"))
    return mean.join(nearest_rank(runs, value, p95(), [by]).select(by, F.col(value).alias("p95_latency_ms")), by)


def vad_benchmark(predicted: DataFrame, reference: DataFrame, runs: DataFrame) -> DataFrame:
    """A row for each backend: calls, mean, median and least IoU of each channel, their mean, latencies.

    predicted: (backend, call_id, seq, channel, start, end). reference: segments of the same calls. runs: (backend,
    call_id, latency_ms), a row for each call that a backend was run on.
    """
    sides = {"caller": CALLER, "agent": AGENT}
    of = lambda ch: F.when(F.col("channel") == ch, F.col("iou"))
    kinds = {"mean": F.avg, "median": F.median, "min": F.min}
    scored = call_ious(predicted, reference, runs).groupBy("backend").agg(F.countDistinct("call_id").alias("num_calls"), *[or_zero(f(of(ch))).alias(f"{side}_{kind}_iou") for side, ch in sides.items() for kind, f in kinds.items()])
    scored = scored.withColumn("mean_overall_iou", (F.col("caller_mean_iou") + F.col("agent_mean_iou")) / 2)
    return scored.join(latency_stats(runs), "backend")


def best_backend(results: DataFrame) -> DataFrame:
    """The row of vad_benchmark() with the greatest mean IoU; of equal ones the first by name."""
    return results.orderBy(F.desc("mean_overall_iou"), "backend").limit(1)


def eval_summary(results: DataFrame) -> DataFrame:
    """What a foundation report says of each backend."""
    return results.select("backend", "num_calls", F.col("caller_mean_iou").alias("mean_caller_iou"), F.col("agent_mean_iou").alias("mean_agent_iou"), "mean_latency_ms", "p95_latency_ms")


def latency_summary(rows: DataFrame, p: str, latency: str, layers: Sequence[str] = (), label: str = "label") -> DataFrame:
    """One row: rates of verdicts, and latencies with each layer's mean, over rows with a score p. Undefined figures are null."""
    answered = rows.where(F.col(p).isNotNull()).withColumns({"said_": F.col(p) >= 0.5, "truth_": is_positive(label)})
    truth, said = F.col("truth_"), F.col("said_")
    share = lambda a, b: F.try_divide(F.count_if(a).cast("double"), F.count_if(b).cast("double"))
    tpr, tnr = share(truth & said, truth), share(~truth & ~said, ~truth)
    one = answered.agg(
        F.count("*").alias("calls"), share(truth == said, F.lit(True)).alias("accuracy"), tpr.alias("tpr_synthetic"), tnr.alias("tnr_human"), ((tpr + tnr) / 2).alias("balanced_accuracy"),
        F.avg(latency).alias("mean_latency_ms"), F.max(latency).alias("max_latency_ms"), *[F.avg(n).alias(f"mean_{n}") for n in layers],
    )
    middle = nearest_rank(answered.select(latency), latency, upper_median()).scalar()
    return one.withColumns({"p50_latency_ms": middle, "auc": auc(answered, p, F.col("truth_")).scalar()})


def group_stats(rows: DataFrame, features: Sequence[str], by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """(by, feature, n, mean and sample spread of each label, delta, effect_size, rank): one aggregate over the long form."""
    positive = F.col("positive_")
    value = {"human": F.when(~positive, F.col("value")), "synthetic": F.when(positive, F.col("value"))}
    marked = long_form(rows.withColumn("positive_", is_positive(label)), features, [*by, "positive_"])
    kinds = {"n": F.count, "mean": lambda x: or_zero(F.avg(x)), "std": lambda x: or_zero(F.stddev_samp(x))}
    stats = marked.groupBy(*by, "idx", "feature").agg(*[f(x).alias(f"{side}_{kind}") for side, x in value.items() for kind, f in kinds.items()])
    pooled = F.sqrt((F.pow("human_std", F.lit(2)) + F.pow("synthetic_std", F.lit(2))) / 2)
    stats = stats.withColumn("delta", F.col("synthetic_mean") - F.col("human_mean")).withColumn("effect_size", ratio(F.col("delta"), F.nullif(pooled, F.lit(0.0))))
    return stats.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.abs("effect_size").desc(), "idx"))).drop("idx")


def fit_one(rows: DataFrame, features: Sequence[str], label: str = "label") -> dict:
    """A head of the named features, fitted on all rows."""
    examples = rows.select(*features, is_positive(label).cast("double").alias("y"), F.lit("head").alias("model"))
    return parts(fit(examples, {"head": features}))["head"]


def with_intervals(stats: DataFrame, rows: DataFrame, features: Sequence[str], runs: int, seed: int = 42) -> DataFrame:
    """stats by split and feature with ci_low and ci_high, the bootstrap interval of effect_size; null where no resample has both labels."""
    bounds = None
    for split in ("train", "val"):
        own = bootstrap(rows.where(F.col("split") == split), features, is_positive(), runs, seed)
        own = own.select(F.lit(split).alias("split"), "feature", F.col("low").alias("ci_low"), F.col("high").alias("ci_high"))
        bounds = own if bounds is None else bounds.unionByName(own)
    return stats.join(bounds, ["split", "feature"], "left")


def explore(rows: DataFrame, features: Sequence[str], top: int = TOP, runs: int = RUNS) -> dict:
    """Both splits compared: stats by split and feature with bootstrap intervals, features that separate in both, rank correlation, a head of those.

    runs 0 leaves out the intervals. Without a feature among the first of both splits the head takes the first of train.
    """
    stats = group_stats(rows, features, ["split"])
    ranks = {r["feature"]: r for r in stats.groupBy("feature").pivot("split", ["train", "val"]).agg(F.first("rank")).collect()}  # one row a feature
    first = sorted((n for n, r in ranks.items() if r["train"]), key=lambda n: ranks[n]["train"])[:top]
    stable = [n for n in first if ranks[n]["val"] and ranks[n]["val"] <= top] or first
    head = fit_one(rows.where("split = 'train'"), stable)
    metrics = {s: evaluate(rows.where(F.col("split") == s).withColumn("p", logistic(head)), "p", is_positive()) for s in ("train", "val")}
    return {"stats": with_intervals(stats, rows, features, runs) if runs else stats, "stable": stable, "rank_correlation": rank_correlation(stats, "split", "train", "val").first()[0], "head": head, "metrics": metrics}


def large_enough(rows: DataFrame) -> tuple[int, int] | None:
    """(rows of train, of val) where both splits have enough rows and both labels; else None."""
    seen = {r["split"]: r for r in rows.groupBy("split").agg(F.count("*").alias("n"), F.count_if(is_positive()).alias("p")).collect()}
    for split, least in (("train", LEAST_TRAIN), ("val", LEAST_VAL)):
        if split not in seen or seen[split]["n"] < least or not 0 < seen[split]["p"] < seen[split]["n"]:
            return None
    return seen["train"]["n"], seen["val"]["n"]


def fit_and_score(rows: DataFrame, candidates: Sequence[str], k: int = TOP) -> dict | None:
    """A head of the k features that separate train most, scored on val; None where a split is too small or lacks a label.

    The choice of features does not look at val.
    """
    sizes = large_enough(rows)
    if sizes is None:
        return None
    effects = effect_sizes(rows.where("split = 'train'"), candidates, is_positive()).select("idx", "feature", half_even(F.col("d")).alias("effect_size"))
    chosen = effects.orderBy(F.abs("effect_size").desc(), "idx").limit(min(k, len(candidates))).collect()
    names = [r["feature"] for r in chosen]
    head = fit_one(rows.where("split = 'train'"), names)
    scores = {s: {n: round(float(x), 4) for n, x in evaluate(rows.where(F.col("split") == s).withColumn("p", logistic(head)), "p", is_positive()).items()} for s in ("train", "val")}
    return {"features_used": names, "top_separators": [{"feature": r["feature"], "effect_size": r["effect_size"]} for r in chosen], **scores, "num_train": sizes[0], "num_val": sizes[1]}


def layer_benchmark(rows: DataFrame | None, suites: dict[str, Sequence[str] | tuple[DataFrame | None, Sequence[str]]], vad: DataFrame | None = None, tandem: tuple[Sequence[str], Sequence[str]] | None = (ACOUSTIC_HEAD, BEHAVIOURAL_HEAD)) -> list[dict]:
    """A report for each layer: detectors, a guarded head for each suite of features, and the whole training.

    A suite may have rows of its own, as (rows, features). One that lacks its rows is skipped and says so.
    """
    skipped = lambda name, why: {"id": name, "status": "skipped", "reason": why}
    out = []
    if vad is not None:
        table = [r.asDict() for r in vad.orderBy("backend").collect()]  # one row a backend
        best = max(table, key=lambda r: r["mean_overall_iou"], default=None)  # the first by name of equal ones
        out.append({"id": "vad", "status": "ok", "best": best["backend"], "table": table} if best else skipped("vad", "no calls"))
    for name, suite in suites.items():
        own, features = suite if len(suite) == 2 and not isinstance(suite[1], str) else (rows, suite)
        found = None if own is None else fit_and_score(own, features)
        out.append({"id": name, "status": "ok", **found} if found else skipped(name, "not enough labelled calls"))
    if tandem is not None:
        if rows is not None and large_enough(rows):
            model = train(rows, acoustic=tandem[0], behavioural=tandem[1])
            out.append({"id": "tandem", "status": "ok", "metrics": model["metrics"], "fusion_type": model["fusion_type"]})
        else:
            out.append(skipped("tandem", "not enough labelled calls"))
    return out


def tune_heads(rows_by_backend: dict[str, DataFrame], acoustic: Sequence[str] = ACOUSTIC_HEAD, behavioural: Sequence[str] = BEHAVIOURAL_HEAD, extra: str = LOUDNESS, hold: float = HOLD) -> tuple[str, dict, list[dict]]:
    """(id, model, variants) of the best training over detectors and with or without one more sound feature.

    The first detector is the default. The feature goes unless the default loses more than hold of val accuracy
    without it; another detector is taken where it beats the default's behavioural head, or else its fusion.
    """
    default, *others = rows_by_backend
    models = {(b, more): train(rows, acoustic=[*acoustic, extra] if more else acoustic, behavioural=behavioural) | {"vad_backend": b} for b, rows in rows_by_backend.items() for more in (False, True)}
    accuracy = lambda b, more, part: models[b, more]["metrics"]["val"][part]["accuracy"]
    more = accuracy(default, False, "stacked") < accuracy(default, True, "stacked") - hold
    chosen = default
    for other in others:
        if any(accuracy(other, more, part) > accuracy(chosen, more, part) for part in ("behavioral", "stacked")):
            chosen = other
    name = lambda b, more: f"{b}-{'with' if more else 'no'}-{extra.removeprefix('caller_').replace('_', '-')}"
    return name(chosen, more), models[chosen, more], [{"id": name(*k), "metrics": m["metrics"]} for k, m in models.items()]


def misses(scored: DataFrame, limit: int | None = None, label: str = "label") -> DataFrame:
    """Wrong verdicts of scored rows, the most confident first; limit: a top-k."""
    wrong = scored.where((F.col("p") >= 0.5) != is_positive(label)).withColumn("confidence", F.greatest(F.col("p"), 1 - F.col("p"))).orderBy(F.desc("confidence"), "call_id")
    return wrong if limit is None else wrong.limit(limit)
