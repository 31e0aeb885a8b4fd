"""Quality selection by importance resampling over hashed n-gram models.

Two generative models over SLOTS hashed word unigrams and bigrams: one of target text (documents labelled
good), one of the raw corpus, all of it. A document's log importance weight is the log ratio of its n-grams
under the two, taken by length: a sum of n log ratios is held against the mean of good text and divided by
(n + FEW)^POWER, so that one limit judges short and long documents alike. Adding seeded Gumbel noise and taking
the k largest draws k documents without replacement in proportion to their weights. k is how many documents
weigh at least as much as all but a small share of the labelled good ones that the models were not fitted on.

A third model, of text labelled toxic, is scored where it peaks: by the words of a document that tell most for
toxic against good text, not by a sum over all. A document weighs what the worse of the two scores says.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import forget, map_rows, settle, sliced, texts_of, typed
from colloquy.llm.runs import hash_words, word_grams

SLOTS = 1 << 13
#: At most so many labelled documents of each kind, the least by hash, fit and calibrate the models.
LABELLED = 20_000
#: Share of the raw model in the target model: what target text never shows is that much less likely there, no less.
SMOOTHING = 0.25
#: Share of held-out good documents that may score less than the limit.
LOST = 0.005
#: A sum of n log ratios is divided by (n + FEW)^POWER: between a mean (1), by which the shortest good text would go, and a deviation (1/2).
FEW, POWER = 20, 0.75
#: Log weight of one standard deviation of good text: the noise of the draw moves a document by a fraction of one.
STEEP = 10.0
#: Slots of words in the toxic model, and how many documents are added to each of its counts.
WORD_SLOTS, ADDED = 1 << 18, 0.5
#: A document's toxic peaks are the sums of its so many most telling words: a short one may hold just one.
PEAKS = (1, 2, 3)
#: Punctuation, which does not make another word.
GAPS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SEED = 7
#: Salts of partial sums, so that a sum never meets one row of every task.
SALTS = 64


def slots(text: bytes) -> np.ndarray:
    """Slots of a text's lower-cased words and of its word pairs, repeats included."""
    words = hash_words(b" ".join(text.lower().split()))[2]
    return np.concatenate([words, word_grams(words, 2)]) % np.uint64(SLOTS) if len(words) else words


def word_slots(text: bytes) -> np.ndarray:
    """Slots of a text's distinct lower-cased words without punctuation."""
    return np.unique(hash_words(b" ".join(text.lower().translate(GAPS).split()))[2] % np.uint64(WORD_SLOTS)).astype(np.int64)


def slot_counts(docs: DataFrame) -> np.ndarray:
    """How often each slot occurs in docs (text): one vector a task, summed in two steps."""

    def run(batches):
        forget()
        total = np.zeros(SLOTS, np.int64)
        for batch in sliced(batches):
            for text in texts_of(batch.column("text")):
                total += np.bincount(slots(text).astype(np.int64), minlength=SLOTS)
        if total.any():
            salt = int(np.random.default_rng(int(total.sum())).integers(SALTS))
            yield pa.record_batch({"salt": pa.array([salt], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"counts": [sum(np.frombuffer(c, np.int64) for c in rows["counts"]).tobytes()]})

    parts = docs.select(F.col("text").cast("string")).mapInArrow(run, "salt int, counts binary").groupBy("salt").applyInPandas(add, "counts binary")
    return sum((np.frombuffer(r["counts"], np.int64) for r in parts.collect()), np.zeros(SLOTS, np.int64))  # at most SALTS vectors


@dataclass(frozen=True)
class Model:
    """ratios: log of target over raw probability by slot. mean: that of good text. toxic: log of toxic over good share of documents by slot of a word, at least 0.

    least, spread: the least scores that count as good, and deviations of good ones. limit: the least log weight.
    """

    ratios: np.ndarray
    mean: float = 0.0
    toxic: np.ndarray | None = None
    least: tuple[float, ...] = (0.0,) * (1 + len(PEAKS))
    spread: tuple[float, ...] = (1.0,) * (1 + len(PEAKS))
    limit: float = -np.inf

    def scores(self, text: bytes) -> list[float]:
        """How far the text's log ratios are above those of good text, by length; then its toxic peaks, less than 0."""
        found = self.ratios[slots(text).astype(np.int64)]
        score = float((found.sum(dtype=np.float64) - self.mean * len(found)) / (len(found) + FEW) ** POWER)
        if self.toxic is None:
            return [score] + [0.0] * len(PEAKS)
        telling = self.toxic[word_slots(text)].astype(np.float64)
        telling = np.sort(telling[telling > 0])[::-1]
        return [score, *(-float(telling[:k].sum()) for k in PEAKS)]

    def weigh(self, text: bytes) -> float:
        return STEEP * min((x - low) / unit for x, low, unit in zip(self.scores(text), self.least, self.spread))


def least_score(good: np.ndarray, bad: np.ndarray) -> float:
    """What all but the share LOST of good scores reach; midway to the bad ones where these stay below."""
    low = float(np.quantile(good, LOST))
    high = float(np.quantile(bad, 1 - LOST)) if len(bad) else low
    return (low + high) / 2 if high < low else low


def chosen_labels(labels: DataFrame, labelled: int, **kinds: str) -> DataFrame:
    """(l, h, a flag for each of kinds) of at most so many labelled documents of each kind, the least by hash; a condition that is null does not hold."""
    flags = labels.select(F.col("doc_id").cast("long").alias("l"), *[F.coalesce(F.expr(c), F.lit(False)).alias(k) for k, c in kinds.items()]).where("l is not null")
    flags = flags.groupBy("l").agg(*[F.max(k).alias(k) for k in kinds]).withColumn("h", F.xxhash64(F.lit(SEED), "l"))
    parts = [flags.where(k).orderBy("h", "l").limit(labelled) for k in kinds]
    return functools.reduce(DataFrame.union, parts).distinct()


def toxic_ratios(known: DataFrame) -> np.ndarray | None:
    """Log ratios of toxic over good documents by slot of a word, from known (text, good, toxic); what tells for good is 0."""

    def run(batches):
        counts = np.zeros((2, WORD_SLOTS), np.int64)
        for batch in batches:
            for text, toxic in zip(batch["text"].fillna(""), batch["toxic"]):
                counts[int(toxic), word_slots(text.encode("utf-8"))] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pd.DataFrame({"slot": at, "clean": counts[0, at], "toxic": counts[1, at]})

    told = known.where("good <> toxic").select("text", "toxic")
    sizes = told.agg(F.count_if(~F.col("toxic")).alias("clean"), F.count_if("toxic").alias("toxic")).first()
    if not sizes["clean"] or not sizes["toxic"]:
        return None
    counts = told.mapInPandas(run, "slot long, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("toxic > 0").toArrow()
    slot, clean, toxic = (counts[n].to_numpy() for n in ("slot", "clean", "toxic"))  # at most WORD_SLOTS rows
    out = np.zeros(WORD_SLOTS, np.float32)
    out[slot] = np.maximum(0.0, np.log((toxic + ADDED) / (sizes["toxic"] + 2 * ADDED)) - np.log((clean + ADDED) / (sizes["clean"] + 2 * ADDED)))
    return out


def fit(docs: DataFrame, labels: DataFrame, good: str = "quality = 1 and toxic = 0", bad: str = "quality = 0", toxic: str = "toxic = 1", labelled: int = LABELLED) -> Model:
    """Models from docs (doc_id, text) and labels (doc_id and what good, bad and toxic name; a condition that is null does not hold).

    Half of the labelled documents, by hash, fit the target and the toxic model; the other half set the
    limits. With no labelled good document there is no target: all ratios are 0 and everything is good.
    """
    chosen = chosen_labels(labels, labelled, good=good, bad=bad, toxic=toxic)
    rows = typed(docs, doc_id="long", text="string")
    known = settle(rows.join(F.broadcast(chosen), rows["doc_id"] == F.col("l")).select("text", "good", "bad", "toxic", (F.col("h") % 2 == 0).alias("held")))
    target, raw = slot_counts(known.where("good and not held")), slot_counts(rows)
    if not target.any():
        return Model(np.zeros(SLOTS, np.float32))
    share = (raw + 1.0 / SLOTS) / (raw.sum() + 1.0)
    aimed = (1 - SMOOTHING) * target / target.sum() + SMOOTHING * share
    ratios = np.log(aimed) - np.log(share)
    # counts of little target text make its log probabilities too low on average: held-out good text shows by how much
    held = slot_counts(known.where("good and held"))
    mean = float(held @ ratios) / held.sum() if held.any() else 0.0
    return calibrated(Model(ratios.astype(np.float32), mean, toxic_ratios(known.where("not held"))), known.where("held"))


def calibrated(model: Model, held: DataFrame) -> Model:
    """The model with limits from held (text, good, bad, toxic), which it was not fitted on."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    def measure(columns):
        return {n: columns[n] for n in ("good", "bad", "toxic")} | {"scores": [shared.value.scores(t) for t in texts_of(columns["text"])]}

    found = map_rows(held.select("text", "good", "bad", "toxic"), "good boolean, bad boolean, toxic boolean, scores array<double>", measure).toArrow()  # at most LABELLED of each kind
    good, bad, toxic = (found[n].to_numpy() for n in ("good", "bad", "toxic"))
    if not good.any():
        return model
    scores = np.array(found["scores"].to_pylist())
    against = [bad] + [toxic] * len(PEAKS)
    least = [least_score(x[good], x[rejected]) for x, rejected in zip(scores.T, against)]
    least = [min(0.0, least[0])] + [low if model.toxic is not None else -1.0 for low in least[1:]]
    return replace(model, least=tuple(least), spread=tuple(max(float(x), 1e-6) for x in scores[good].std(axis=0)), limit=0.0)


def weighed(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """(doc_id, log_weight, key) of docs (doc_id, text); key has the noise. keep: also row, all of docs' columns."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)  # SLOTS numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.struct("*").alias("row")] if keep else []))

    def weigh(columns):
        found = [shared.value.weigh(t) for t in texts_of(columns["text"])]
        return {n: c for n, c in columns.items() if n != "text"} | {"log_weight": found}

    schema = "doc_id long, " + (f"row {rows.schema['row'].dataType.simpleString()}, " if keep else "") + "log_weight double"
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "log_weight"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return map_rows(rows, schema, weigh).withColumn("key", F.col("log_weight") - F.log(-F.log(uniform)))


def kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> float:
    """A bound that k of the column key reach, or as few more as lie within rounding of the k-th.

    Each round counts the keys by equal steps of the range that holds the k-th, which shrinks bins-fold.
    """
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None or k <= 0:
        return np.inf
    for _ in range(4):
        step = (high - low) / bins
        if step <= abs(low) * 1e-14:
            break
        at = F.least(F.floor((F.col("key") - low) / step), F.lit(bins - 1))
        counts = {r["at"]: r["n"] for r in keys.where(F.col("key").between(low, high)).groupBy(at.alias("at")).agg(F.count("*").alias("n")).collect()}
        above = keys.where(F.col("key") > high).count()
        for b in sorted(counts, reverse=True):
            above += counts[b]
            if above >= k:
                low, high = low + b * step, low + (b + 1) * step
                break
        if above == k:
            break
    return low


def selected(docs: DataFrame, labels: DataFrame, **options) -> tuple[Model, float]:
    """The fitted model and the least key among the drawn documents."""
    model = fit(docs, labels, **options)
    scores = settle(weighed(typed(docs, doc_id="long", text="string"), model))
    good = scores.where(F.col("log_weight") >= F.lit(model.limit)).count()
    return model, kth_largest(scores, good)


def resample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, log_weight, key) of the documents drawn from docs.

    A document without words, null text included, is as good as the mean of good text. Repeated rows draw the same noise, so they
    stay or go together; rows of equal keys at the bound all stay. Null doc_ids take part. An empty table
    gives no rows.
    """
    model, bound = selected(docs, labels, **options)
    return weighed(typed(docs, doc_id="long", text="string"), model).where(F.col("key") >= F.lit(bound))


def keep_drawn(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that resample() draws, with all their columns, whatever their names.

    Null and empty texts, null doc_ids, repeated rows and ties go as they do there; an empty table stays empty.
    """
    model, bound = selected(docs, labels, **options)
    return weighed(docs, model, keep=True).where(F.col("key") >= F.lit(bound)).select("row.*")
