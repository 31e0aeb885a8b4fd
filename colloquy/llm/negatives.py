"""Hard negatives by bit-sliced integer products.

Components are whole numbers, kept as bit-planes: plane k of a row is a bit for each component. A product with
an anchor is a sum over planes of popcounts of ANDs with the anchor's own planes. Planes are taken from the most significant on; what
the planes to come can still add lies between (2^k - 1) times the anchor's negative and positive sums, so each plane halves the interval
that a score must lie in. A row is dropped as soon as its interval cannot qualify any more: below the k-th best lower bound that is
certain, or outside the band that negatives must lie in. Rows that stay to the last plane have exact scores.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.blocks import CHUNK, against, best, finite, matrix, numbered, widened
from colloquy.llm.common import settle

#: A component is floor(SCALE * x); one of this many bits or more could make sums of products inexact.
SCALE, BITS = 256, 21
#: Anchors are rows whose vec_id is divisible by this; positives and negatives of each.
EVERY, POSITIVES, NEGATIVES = 100, 5, 10
#: A negative's score lies between so many hundredths of its positive's.
LOW, HIGH = 30, 90
FOUND = "anchor long, band long, row long, vec_id long, score long"


class Planes:
    """Rows of whole numbers as bit-planes in two's complement, the least significant first, 64 components a word."""

    def __init__(self, values: np.ndarray):
        values = values.astype(np.int64)
        magnitude = int(np.maximum(values, ~values).max()) if values.size else 0
        self.count = 1 + magnitude.bit_length()
        words = max(1, -(-values.shape[1] // 64))
        bits = widened(values, words * 64)
        self.planes = [np.packbits(((bits >> k) & 1).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for k in range(self.count)]
        #: What a bit of each plane is worth; the last one is the sign.
        self.worth = [(-1.0 if k == self.count - 1 else 1.0) * 2.0**k for k in range(self.count)]


class Anchor:
    """An anchor's components: its planes, and the least and the most that a plane of ones can add."""

    def __init__(self, values: np.ndarray):
        own = Planes(values[None, :])
        self.planes = np.concatenate(own.planes, axis=0)[:, None, :]
        self.worth = np.array(own.worth)
        self.least, self.most = float(np.minimum(values, 0).sum()), float(np.maximum(values, 0).sum())

    def times(self, plane: np.ndarray) -> np.ndarray:
        """Products with rows of zeros and ones."""
        words = min(plane.shape[1], self.planes.shape[2])
        return self.worth @ np.bitwise_count(plane[None, :, :words] & self.planes[:, :, :words]).sum(axis=2, dtype=np.float64)


def narrowed(rows: Planes, anchor: Anchor, places: np.ndarray, may: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(places, exact scores) of the rows at places that may(lower, upper bounds) ruled out at no plane."""
    scores = np.zeros(len(places))
    for k in range(rows.count - 1, -1, -1):
        if not len(places):
            break
        scores = scores + rows.worth[k] * anchor.times(rows.planes[k][places])
        left = 2.0**k - 1
        stay = may(scores + left * anchor.least, scores + left * anchor.most)
        if not stay.all():
            places, scores = places[stay], scores[stay]
    return places, scores.astype(np.int64)


def kth(values: np.ndarray, k: int, otherwise: float) -> float:
    """The k-th greatest, or otherwise where there are fewer or that is greater."""
    return otherwise if len(values) < k else max(otherwise, float(np.partition(values, len(values) - k)[len(values) - k]))


class Kept:
    """The best k (score, vec_id, row) of a query over the blocks of a task."""

    def __init__(self, k: int):
        self.k, self.rows, self.bound = k, [], -np.inf

    def add(self, scores: np.ndarray, ids: list, rows: np.ndarray) -> None:
        if len(scores):
            # a null vec_id comes after all others of its score
            self.rows = sorted([*self.rows, *((-int(s), i is None, i or 0, int(r)) for s, i, r in zip(scores, ids, rows))])[: self.k]
            if len(self.rows) == self.k:
                self.bound = float(-self.rows[-1][0])


class Miner:
    """What one task finds for a part of the anchors. With bands: negatives of each, else positives."""

    def __init__(self, anchors: pa.Table):
        self.labels, self.own = anchors["label"].to_pylist(), anchors["rid"].to_pylist()
        self.anchors = [Anchor(v) for v in matrix(anchors["components"], np.int64)] if anchors.num_rows else []
        self.bands = anchors["bands"].to_pylist() if "bands" in anchors.column_names else None
        wanted = [[None]] * len(self.own) if self.bands is None else self.bands
        self.kept = [[Kept(POSITIVES if band is None else NEGATIVES) for band in bands] for bands in wanted]

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows or not self.anchors:
            return
        labels, rids = np.array(batch.column("label").to_pylist()), np.array(batch.column("rid").to_pylist())
        ids, rows = batch.column("vec_id").to_pylist(), Planes(matrix(batch.column("components"), np.int64))
        places = {label: np.flatnonzero(labels == label) for label in np.unique(labels)}
        others = {label: np.flatnonzero(labels != label) for label in set(self.labels)} if self.bands is not None else {}
        for i, anchor in enumerate(self.anchors):
            if self.bands is None:
                here = places.get(self.labels[i], np.zeros(0, np.int64))
                kept = self.kept[i][0]
                found, scores = narrowed(rows, anchor, here[rids[here] != self.own[i]], lambda low, up, kept=kept: up >= kth(low, kept.k, kept.bound))
                kept.add(scores, [ids[p] for p in found], rids[found])
            else:
                self.mine(i, anchor, rows, others[self.labels[i]], ids, rids)

    def mine(self, i: int, anchor: Anchor, rows: Planes, places: np.ndarray, ids: list, rids: np.ndarray) -> None:
        edges = [(-(-LOW * p // 100), HIGH * p // 100) for p in self.bands[i]]

        def may(low: np.ndarray, up: np.ndarray) -> np.ndarray:
            stay = np.zeros(len(low), bool)
            for (first, last), kept in zip(edges, self.kept[i]):
                bound = kth(low[(low >= first) & (up <= last)], kept.k, kept.bound)
                stay |= (up >= max(first, bound)) & (low <= last)
            return stay

        found, scores = narrowed(rows, anchor, places, may)
        for (first, last), kept in zip(edges, self.kept[i]):
            inside = np.flatnonzero((scores >= max(first, kept.bound)) & (scores <= last))
            kept.add(scores[inside], [ids[p] for p in found[inside]], rids[found[inside]])

    def results(self) -> dict[str, list]:
        out: dict[str, list] = {"anchor": [], "band": [], "row": [], "vec_id": [], "score": []}
        for own, bands, every in zip(self.own, self.bands or [[None]] * len(self.own), self.kept):
            for band, kept in zip(bands, every):
                for score, missing, vec_id, row in kept.rows:
                    for name, value in zip(out, (own, band, row, None if missing else vec_id, -score)):
                        out[name].append(value)
        return out


def components(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, components, rid) of the rows that take part: a label, and a vector of finite components."""
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(vec_id.alias("vec_id"), F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), vector.alias("vector")).where(F.col("label").isNotNull() & finite(F.col("vector")))
    whole = lambda x: F.when(F.abs(x * SCALE) < 2.0 ** (BITS - 1), F.floor(x * SCALE)).otherwise(F.raise_error(F.lit(f"a component of {BITS} bits or more"))).cast("int")
    return numbered(rows.select("vec_id", "label", F.transform("vector", whole).alias("components")))


def hard_negatives(embeddings: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from embeddings (vec_id, embedding, label; others are ignored).

    Rows with a null label, a null vector, or a null or non-finite component take no part; a null vec_id is no anchor and
    comes last among equal scores. Repeated rows are rows of their own: an anchor is not its own positive, its copies can be.
    Shorter vectors count as filled up with zeros, an empty one as all zeros. A positive score below zero has
    no negatives, as 30 hundredths of it are more than 90. Components of 21 bits or more (|x| from 4096) stop the run with an error:
    scores would not be exact. An empty table gives no rows.
    """
    rows = components(embeddings)
    anchors = rows.where(F.col("vec_id") % EVERY == 0)
    near = settle(best(against(rows, anchors, Miner, FOUND, chunk), ["anchor"], POSITIVES).select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    bands = near.where("positive_score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("bands"))  # at most POSITIVES
    ready = settle(anchors.join(bands, anchors["rid"] == bands["anchor"]).select("rid", "vec_id", "label", "components", "bands"))
    found = best(against(rows, ready, Miner, FOUND, chunk), ["anchor", "band"], NEGATIVES)
    found = found.select(F.col("anchor").alias("of"), "band", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.join(anchors.select("rid", F.col("vec_id").alias("anchor_id")), near["anchor"] == F.col("rid"))
    out = named.join(found, (named["anchor"] == found["of"]) & (named["positive_score"] == found["band"]))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def oracle_sql() -> str:
    """The same rows as DuckDB SQL, for different vec_ids."""
    return f"""
WITH good AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM good a JOIN good b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}),
neg AS (SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank
    FROM pos JOIN pairs USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= {NEGATIVES}"""
