"""Logistic heads, their fusion and the rules after it: scoring as expressions, fitting as one grouped stage.

A model document holds feature_names, weights, bias, mean and std for each part. Scores are sums of
literals and columns, so a plan that scores has no join and no Python.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.stats import or_zero, sigmoid
from colloquy.operators.ranking import auc, confusion
from colloquy.operators.scans import scanned
from colloquy.session import settled

POSITIVE = "synthetic"
#: Fixed values of training: step, steps, penalty on weights; folds; the AUC that stacking may lose by.
RATE, EPOCHS, PENALTY, FOLDS, MARGIN = 0.05, 2500, 0.01, 5, 0.01
#: Fixed values of the rules after fusion.
UNSURE = 0.10
QUIET = {"wait_min_s": 1.4, "wait_max_s": 2.0, "rms_cv_max": 0.45, "talkative_turn_min": 24}
#: Examples of a model, at most, that one task fits.
TOGETHER = 500_000
ACOUSTIC_HEAD = ("caller_rms_cv", "caller_zcr_std", "caller_crest_factor_cv", "caller_spectral_flatness_std", "caller_spectral_centroid_std")
BEHAVIOURAL_HEAD = ("caller_response_latency_pos_median_s", "agent_talk_ratio", "agent_aligned_recovery_cv")
FUSION_HEAD = ("p_acoustic", "p_behavioral")


def is_positive(label: str = "label") -> Column:
    """Anything but the positive label, null too, is negative."""
    return F.coalesce(F.col(label) == POSITIVE, F.lit(False))


def logistic(part: dict, columns: dict[str, Column] | None = None) -> Column:
    terms = [F.lit(float(w)) * (or_zero((columns or {}).get(n, F.col(n))) - F.lit(float(m))) / F.lit(float(s)) for n, w, m, s in zip(part["feature_names"], part["weights"], part["mean"], part["std"])]
    return sigmoid(sum(terms, F.lit(0.0)) + F.lit(float(part["bias"])))


def settle_disagreement(fused: Column, acoustic: Column, behavioural: Column, unsure: float = UNSURE) -> Column:
    """Where the heads take different sides and fusion is unsure, the sharper head decides, the acoustic one on a tie."""
    split = (acoustic >= 0.5) != (behavioural >= 0.5)
    sharper = F.when(F.abs(acoustic - 0.5) >= F.abs(behavioural - 0.5), acoustic).otherwise(behavioural)
    return F.when(split & (F.abs(fused - 0.5) < unsure), sharper).otherwise(fused)


def quiet_talker(p: Column, wait: Column, rms_cv: Column, turns: Column, wait_min_s: float, wait_max_s: float, rms_cv_max: float, talkative_turn_min: int) -> Column:
    """A positive call with even loudness, waits of a certain length and many caller turns counts as negative."""
    if talkative_turn_min <= 0:
        return p
    fits = (p >= 0.5) & wait.between(wait_min_s, wait_max_s) & (rms_cv < rms_cv_max) & (turns >= talkative_turn_min)
    return F.when(fits, F.when(1 - p < 0.5, 1 - p).otherwise(0.499)).otherwise(p)


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def score(features: DataFrame, model: dict) -> DataFrame:
    """features with p_acoustic, p_behavioral, p, is_synthetic, confidence and views.

    The heads are bound once for all rules; without that the expression would double with every rule.
    """
    stacked = model.get("fusion_type", "stacked") == "stacked" and model.get("fusion")
    if not stacked and not model.get("concatenated"):
        raise ValueError("the model has neither a fusion nor a concatenated part")
    gate = QUIET | model.get("quiet_patient", {})
    seen = [or_zero(F.col(n)) for n in ("caller_response_latency_pos_median_s", "caller_rms_cv", "caller_segment_count")]

    def fused(a: Column, b: Column) -> Column:
        if not stacked:
            return logistic(model["concatenated"])
        return let(logistic(model["fusion"], dict(zip(FUSION_HEAD, (a, b)))), lambda p: settle_disagreement(p, a, b, model.get("disagree_unsure", UNSURE)))

    both = lambda h: let(fused(h["p_acoustic"], h["p_behavioral"]), lambda p: F.struct(h["p_acoustic"].alias("p_acoustic"), h["p_behavioral"].alias("p_behavioral"), quiet_talker(p, *seen, **gate).alias("p")))
    heads = F.struct(logistic(model["acoustic"]).alias("p_acoustic"), logistic(model["behavioral"]).alias("p_behavioral"))
    scored = features.withColumn("scored_", let(heads, both)).select(*features.columns, "scored_.*")
    return verdict(scored).withColumn("views", F.create_map(F.lit("acoustic"), F.col("p_acoustic"), F.lit("behavioral"), F.col("p_behavioral")))


def verdict(scored: DataFrame, p: str = "p") -> DataFrame:
    return scored.withColumns({"is_synthetic": F.col(p) >= 0.5, "confidence": F.when(F.col(p) >= 0.5, F.col(p)).otherwise(1 - F.col(p))})


def error_kind(truth: Column, fused: Column, acoustic: Column, behavioural: Column) -> Column:
    """From verdicts: right or wrong, and if the heads and the fusion agreed."""
    right = F.when((acoustic == fused) & (behavioural == fused), "ok").otherwise("ok_disagree")
    wrong = F.when((acoustic == fused) & (behavioural == fused), "miss_agree").otherwise("miss_mixer")
    return F.when(fused == truth, right).otherwise(wrong)


def inspection(scored: DataFrame, truth: Column, *by: str) -> DataFrame:
    """Rates and error kinds by group and over all, in one pass of grouping sets; all has nulls for by."""
    marked = scored.select(*by, truth.alias("truth"), (F.col("p") >= 0.5).alias("said"), error_kind(truth, F.col("p") >= 0.5, F.col("p_acoustic") >= 0.5, F.col("p_behavioral") >= 0.5).alias("kind"))
    rates = confusion(F.col("truth"), F.col("said"))
    kinds = {k: F.count_if(F.col("kind") == k) for k in ("ok", "ok_disagree", "miss_agree", "miss_mixer")}
    return marked.rollup(*by).agg(F.count("*").alias("n"), *[c.alias(n) for n, c in (rates | kinds).items()])


def descend(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> dict:
    """Full-batch gradient descent on standardised features from zero; the bias has no penalty."""
    mean, std = x.mean(axis=0), x.std(axis=0)
    std = np.where(std == 0, 1.0, std)
    z, w, b = (x - mean) / std, np.zeros(x.shape[1]), 0.0
    for _ in range(epochs):
        miss = 1.0 / (1.0 + np.exp(-np.clip(z @ w + b, -500, 500))) - y
        w, b = w - RATE * (z.T @ miss / len(y) + PENALTY * w), b - RATE * miss.mean()
    return {"weights": w, "bias": float(b), "mean": mean, "std": std}


MODEL = "model string, feature_names array<string>, weights array<double>, bias double, mean array<double>, std array<double>"


def fit(examples: DataFrame, features: dict[str, Sequence[str]]) -> DataFrame:
    """Models from examples (model, y and features), one group a model and all models at once.

    features names each model's columns; a name with ``#`` takes those before it. One task holds a model's rows: see fitted().
    """

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names = list(features[key[0].split("#")[0]])
        found = descend(rows[names].fillna(0.0).to_numpy(np.float64), rows["y"].to_numpy(np.float64))
        return pd.DataFrame([{"model": key[0], "feature_names": names, **found}])

    return examples.groupBy("model").applyInPandas(one, MODEL)


def fit_spread(examples: DataFrame, features: Sequence[str], epochs: int = EPOCHS) -> dict:
    """The model part that descend() finds, for more examples (y and features) than a task can hold.

    Examples are settled once as standardised blocks of a matrix. In each step a task sums the gradients of its blocks, and a vector a
    task comes to the driver, which holds the weights and nothing else.
    """
    values = F.array(*[or_zero(F.col(n)) for n in features])
    base = settled(examples.select(values.alias("x"), F.col("y").cast("double").alias("y")))
    each = range(len(features))
    facts = base.agg(F.count("*").alias("n"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in each], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in each]).first()
    n, mean, std = facts["n"], np.array([facts[f"m{i}"] or 0.0 for i in each]), np.array([facts[f"s{i}"] or 1.0 for i in each])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(mean))
                yield pa.record_batch([pa.array([((x - mean) / std).tobytes()]), pa.array([batch.column("y").to_numpy(zero_copy_only=False).tobytes()])], names=["z", "y"])

    blocks = settled(base.mapInArrow(pack, "z binary, y binary"))
    weights, bias = np.zeros(len(mean)), 0.0
    for _ in range(epochs if n else 0):

        def gradient(batches: Iterator[pa.RecordBatch], w=weights, b=bias) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(w) + 1)
            for batch in batches:
                for z, y in zip(batch.column("z").to_pylist(), batch.column("y").to_pylist()):
                    rows, truth = np.frombuffer(z).reshape(-1, len(w)), np.frombuffer(y)
                    miss = 1.0 / (1.0 + np.exp(-np.clip(rows @ w + b, -500, 500))) - truth
                    total[:-1] += rows.T @ miss
                    total[-1] += miss.sum()
            yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["g"])

        step = np.sum([r["g"] for r in blocks.mapInArrow(gradient, "g array<double>").collect()], axis=0) / n  # a vector a task
        weights, bias = weights - RATE * (step[:-1] + PENALTY * weights), bias - RATE * step[-1]
    return {"feature_names": list(features), "weights": weights.tolist(), "bias": float(bias), "mean": mean.tolist(), "std": std.tolist()}


def fitted(examples: DataFrame, features: dict[str, Sequence[str]], rows: int) -> dict[str, dict]:
    """Model parts from examples of about so many rows a model: side by side in a task each, or where that is too many one after the other over all tasks."""
    if rows <= TOGETHER:
        return parts(fit(examples, features))
    models = [r["model"] for r in examples.select("model").distinct().collect()]  # heads and folds
    return {m: fit_spread(examples.where(F.col("model") == m), features[m.split("#")[0]]) for m in models}


def parts(models: DataFrame) -> dict[str, dict]:
    """Fitted models as document parts; a few rows."""
    return {r["model"]: {k: list(v) if isinstance(v, (list, tuple)) else v for k, v in r.asDict().items() if k != "model"} for r in models.collect()}


def folded(rows: DataFrame, key: str = "call_id", seed: int = 0) -> DataFrame:
    """rows with fold: those of a label in a seeded order, dealt in turn; at least 2 folds, at most FOLDS."""
    sizes = rows.agg(F.count_if(F.col("y") == 0.0).alias("no"), F.count_if(F.col("y") == 1.0).alias("yes")).first()
    n = max(2, min(FOLDS, sizes["no"], sizes["yes"]))
    # a label's rows are counted in 256 ranges of the hash by themselves
    hashed = rows.withColumn("hash_", F.xxhash64(F.lit(seed), key))
    numbered = scanned(hashed, ["y"], F.shiftright("hash_", 56), ["hash_", key], sums={"at_": F.lit(1)})
    return numbered.withColumn("fold", ((F.col("at_") - 1) % n).cast("int")).drop("hash_", "at_")


def evaluate(scored: DataFrame, p: str, truth: Column) -> dict[str, float]:
    rates = confusion(truth, F.col(p) >= 0.5)
    found = scored.agg(*[rates[n].alias(n) for n in ("accuracy", "precision", "recall", "f1")]).first().asDict()
    return found | {"auc": auc(scored, p, truth).first()["auc"]}


def evaluate_all(scored: DataFrame, scores: Sequence[str], truth: Column) -> dict[str, dict[str, dict[str, float]]]:
    """evaluate() of several scores p_<part> of both splits at once: by split and part, from one aggregate over the long form and one AUC."""
    pairs = F.explode(F.array(*[F.struct(F.lit(p.removeprefix("p_")).alias("part"), F.col(p).alias("p")) for p in scores]))
    long = scored.where("split in ('train', 'val')").select("split", truth.alias("truth"), pairs.alias("s")).select("split", "truth", "s.*")
    rates = confusion(F.col("truth"), F.col("p") >= 0.5)
    names = ("accuracy", "precision", "recall", "f1")
    found = long.groupBy("split", "part").agg(*[rates[n].alias(n) for n in names]).join(auc(long, "p", F.col("truth"), ["split", "part"]), ["split", "part"]).collect()
    nothing = dict.fromkeys(names, 0.0) | {"auc": 0.5}
    out = {s: {p.removeprefix("p_"): dict(nothing) for p in scores} for s in ("train", "val")}
    for r in found:
        out[r["split"]][r["part"]] = {n: r[n] for n in (*names, "auc")}
    return out


def train(rows: DataFrame, key: str = "call_id", acoustic: Sequence[str] = ACOUSTIC_HEAD, behavioural: Sequence[str] = BEHAVIOURAL_HEAD) -> dict:
    """A model document from feature rows with split and label.

    Two heads, a fusion of their out-of-fold probabilities, and one model of all features; the fusion is
    taken unless its AUC on the val split is lower by more than MARGIN. val chooses and reports, so its
    figures are not those of unseen calls.
    """
    features = {"acoustic": acoustic, "behavioral": behavioural, "concatenated": [*acoustic, *[n for n in behavioural if n not in acoustic]], "fusion": FUSION_HEAD}
    # the columns of the heads alone, read many times from here on
    rows = rows.select(key, "split", *features["concatenated"], is_positive().cast("double").alias("y")).persist()
    dealt = folded(rows.where("split = 'train'"), key)
    k = dealt.agg(F.max("fold")).first()[0] + 1
    whole = F.explode(F.array(*[F.lit(n) for n in ("acoustic", "behavioral", "concatenated")]))
    held = [dealt.where(F.col("fold") != f).withColumn("model", F.lit(f"{head}#{f}")) for f in range(k) for head in ("acoustic", "behavioral")]
    examples = dealt.withColumn("model", whole)
    for part in held:
        examples = examples.unionByName(part)
    size = dealt.count()
    found = fitted(examples, features, size)
    by_fold = lambda head: F.coalesce(*[F.when(F.col("fold") == f, logistic(found[f"{head}#{f}"])) for f in range(k)], F.lit(0.5))
    stacked = dealt.select("y", by_fold("acoustic").alias("p_acoustic"), by_fold("behavioral").alias("p_behavioral"), F.lit("fusion").alias("model"))
    model = {n: found[n] for n in ("acoustic", "behavioral", "concatenated")} | {"fusion": fitted(stacked, features, size)["fusion"]}
    model |= {"fusion_type": "stacked", "vad_backend": "hybrid", "disagree_unsure": UNSURE, "quiet_patient": QUIET}
    heads = rows.withColumns({n: logistic(model[h]) for n, h in zip(FUSION_HEAD, ("acoustic", "behavioral"))})
    heads = heads.withColumns({"p_stacked": logistic(model["fusion"]), "p_concatenated": logistic(model["concatenated"])})
    metrics = evaluate_all(heads, (*FUSION_HEAD, "p_stacked", "p_concatenated"), F.col("y") == 1.0)
    if metrics["val"]["stacked"]["auc"] < metrics["val"]["concatenated"]["auc"] - MARGIN:
        model["fusion_type"] = "concatenated"
    rows.unpersist()
    return model | {"metrics": metrics}
