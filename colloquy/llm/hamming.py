"""Approximate nearest neighbours by multi-index hashing.

A vector's code is the signs of a learned rotation of it (iterative quantisation on a sample). Largest inner products are nearest directions
once each vector has one more component that fills it up to the greatest length, so codes serve inner products, not cosines only.
A code's bytes are its substrings; a block of rows is indexed by each of them, a bitmap of rows for
each value. Codes within Hamming radius r of a query agree with it in some substring up to r // 8 bits, or r // 8 - 1 bits in those after
the first r % 8 + 1 (pigeonhole), so the values within that distance lead to every one of them. What is within the radius is scored by its floats.

A query's radius follows from its score with the sample: its 20th best there is no better than its 20th best of all rows, and
pairs of the sample show how many bits differ at such a score in all but MISSED of cases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.blocks import CHUNK, against, best, finite, matrix, numbered, widened
from colloquy.llm.common import arrow_schema, forget, settle, sliced

CODE, SUBSTRINGS = 64, 8
#: Queries are rows whose vec_id is divisible by this; neighbours returned of each.
EVERY, NEAREST = 20, 20
#: Rows, at most, that codes and radii are learned from, and those of them whose pairs calibrate radii.
SAMPLE, PILOTS = 20_000, 500
ROUNDS, SEED = 20, 13
MISSED, CELLS = 0.05, 40
FOUND = "query long, row long, vec_id long, score double"
#: All bytes, those with fewer bits first, and how many have up to so many.
BALL = np.argsort(np.bitwise_count(np.arange(256, dtype=np.uint8)), kind="stable").astype(np.uint8)
INSIDE = np.cumsum(np.bincount(np.bitwise_count(np.arange(256, dtype=np.uint8)), minlength=9))


class Codes:
    """A learned rotation to signs, and the radius for a score."""

    def __init__(self, sample: np.ndarray, length: float):
        """sample: rows of vectors; length: the greatest of all vectors of the table."""
        self.length, self.width = length, sample.shape[1]
        filled, draw = self.filled(sample), np.random.default_rng(SEED)
        _, axes = np.linalg.eigh(filled.T @ filled)
        axes = axes[:, ::-1][:, :CODE]
        while axes.shape[1] < CODE:  # fewer components than bits: more bases, turned at random
            axes = np.concatenate([axes, np.linalg.qr(draw.standard_normal((filled.shape[1],) * 2))[0][:, : CODE - axes.shape[1]]], axis=1)
        turn = np.linalg.qr(draw.standard_normal((CODE, CODE)))[0]
        flat = filled @ axes
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        self.turn = axes @ turn
        self.radii = self.calibrated(sample, draw)

    def filled(self, rows: np.ndarray) -> np.ndarray:
        """Rows with the component that makes all of them equally long; for queries it is 0."""
        return np.concatenate([rows, np.sqrt(np.maximum(self.length**2 - (rows**2).sum(axis=1, keepdims=True), 0.0))], axis=1)

    def of(self, rows: np.ndarray, queries: bool = False) -> np.ndarray:
        rows = widened(rows, self.width)
        turned = rows @ self.turn[:-1] if queries else self.filled(rows) @ self.turn
        return np.packbits(turned >= 0, axis=1, bitorder="little").view(np.uint64)[:, 0]

    def cell(self, cosine: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((cosine + 1) / 2 * CELLS), 0, CELLS - 1).astype(np.int64)

    def calibrated(self, sample: np.ndarray, draw: np.random.Generator) -> np.ndarray:
        """For each cell of cosines from -1 to 1, the bits that all but MISSED of the pairs there differ by; by the law of random planes where there are few."""
        pilots = np.sort(draw.permutation(len(sample))[:PILOTS])
        lengths = np.linalg.norm(sample[pilots], axis=1) * self.length
        cosine = sample[pilots] @ sample.T / lengths[:, None]
        bits = np.bitwise_count(self.of(sample[pilots], queries=True)[:, None] ^ self.of(sample)[None, :])
        cosine[np.arange(len(pilots)), pilots] = np.nan
        known = np.isfinite(cosine)
        cell, bits = self.cell(cosine[known]), bits[known]
        angle = np.arccos((np.arange(CELLS)) / CELLS * 2 - 1) / np.pi  # the worse end of a cell
        radii = np.ceil(CODE * angle + 1.65 * np.sqrt(CODE * angle * (1 - angle)))
        for c in np.flatnonzero(np.bincount(cell, minlength=CELLS) >= 50):
            radii[c] = np.quantile(bits[cell == c], 1 - MISSED, method="higher")
        return np.minimum(np.maximum.accumulate(radii[::-1])[::-1], CODE).astype(np.int64)


class Index:
    """A block of rows by the substrings of their codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        parts = codes[:, None].view(np.uint8)
        values = np.arange(256, dtype=np.uint8)[:, None]
        self.maps = [np.packbits(values == parts[:, j][None, :], axis=1, bitorder="little") for j in range(SUBSTRINGS)]

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Places of all codes that differ from code in at most radius bits."""
        near, more = divmod(radius, SUBSTRINGS)
        if near >= 8:
            return np.arange(len(self.codes))
        hit = np.zeros(self.maps[0].shape[1], np.uint8)
        for j, own in enumerate(np.array([code]).view(np.uint8)):
            bits = near if j <= more else near - 1
            if bits >= 0:
                hit |= np.bitwise_or.reduce(self.maps[j][own ^ BALL[: INSIDE[bits]]], axis=0)
        places = np.flatnonzero(np.unpackbits(hit, bitorder="little", count=len(self.codes)))
        return places[np.bitwise_count(self.codes[places] ^ code) <= radius]


class Searcher:
    """The nearest rows that one task finds for a part of the queries."""

    def __init__(self, queries: pa.Table):
        self.own, self.codes = queries["rid"].to_numpy(), queries["code"].to_numpy().view(np.uint64)
        self.radii, self.vectors = queries["radius"].to_numpy(), matrix(queries["vector"], np.float64)
        self.kept: list[list] = [[] for _ in self.own]

    def add(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows or not len(self.own):
            return
        width = self.vectors.shape[1]
        rows = widened(matrix(batch.column("vector"), np.float64), width)
        index = Index(batch.column("code").to_numpy(zero_copy_only=False).view(np.uint64))
        ids, rids = batch.column("vec_id").to_pylist(), batch.column("rid").to_numpy(zero_copy_only=False)
        for i, kept in enumerate(self.kept):
            places = index.within(self.codes[i], self.radii[i])
            places = places[rids[places] != self.own[i]]
            # sums of each row by itself, so that equal rows have equal scores
            scores = (rows[places, :width] * self.vectors[i]).sum(axis=1)
            bound = -kept[-1][0] if len(kept) == NEAREST else -np.inf
            if len(scores) > NEAREST:
                bound = max(bound, np.partition(scores, len(scores) - NEAREST)[len(scores) - NEAREST])
            good = np.flatnonzero(scores >= bound)
            if len(good):
                fresh = ((-float(scores[g]), ids[places[g]] is None, ids[places[g]] or 0, int(rids[places[g]])) for g in good)
                self.kept[i] = sorted([*kept, *fresh])[:NEAREST]

    def results(self) -> dict[str, list]:
        out: dict[str, list] = {"query": [], "row": [], "vec_id": [], "score": []}
        for own, kept in zip(self.own, self.kept):
            for score, missing, vec_id, row in kept:
                for name, value in zip(out, (own, row, None if missing else vec_id, -score)):
                    out[name].append(value)
        return out


def coded(rows: DataFrame, codes) -> DataFrame:
    """rows (vec_id, vector) with their codes."""
    schema = "vec_id long, vector array<double>, code long"
    kinds = arrow_schema(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in sliced(batches):
            found = codes.value.of(matrix(batch.column("vector"), np.float64))
            yield pa.record_batch([batch.column("vec_id"), batch.column("vector").cast(kinds.field("vector").type), pa.array(found.view(np.int64))], schema=kinds)

    return rows.select("vec_id", "vector").mapInArrow(run, schema)


def aimed(queries: DataFrame, codes, sample) -> DataFrame:
    """queries (rid, vec_id, vector) with code and radius. sample: (vec_ids, vectors)."""
    schema = "rid long, vec_id long, vector array<double>, code long, radius long"
    kinds = arrow_schema(queries.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        ids, vectors = sample.value
        for batch in sliced(batches, 256):
            own, learned = widened(matrix(batch.column("vector"), np.float64), codes.value.width), codes.value
            scores = own @ widened(vectors, own.shape[1]).T
            scores[np.array(batch.column("vec_id").to_pylist())[:, None] == ids[None, :]] = -np.inf  # the query itself
            if scores.shape[1] >= NEAREST:
                last = np.partition(scores, scores.shape[1] - NEAREST, axis=1)[:, scores.shape[1] - NEAREST]
                cosine = last / (np.linalg.norm(own, axis=1) * learned.length)
                radius = np.where(np.isfinite(last), learned.radii[learned.cell(np.where(np.isfinite(cosine), cosine, -1.0))], CODE)
            else:
                radius = np.full(len(own), CODE)
            yield pa.record_batch([batch.column("rid"), batch.column("vec_id"), batch.column("vector").cast(kinds.field("vector").type), pa.array(learned.of(own, queries=True).view(np.int64)), pa.array(radius, pa.int64())], schema=kinds)

    return queries.select("rid", "vec_id", "vector").mapInArrow(run, schema)


def nearest(embeddings: DataFrame, chunk: int = CHUNK, sample_rows: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of embeddings (vec_id, embedding; others are ignored) whose vec_id is divisible by EVERY, the NEAREST rows of largest inner product that were found.

    Every row is indexed; codes and radii are learned from at most sample_rows rows, drawn by a hash of the vec_id. A query
    for which fewer than NEAREST are within its radius is searched again among all rows. Vectors null, zero or with null or
    non-finite components take no part; shorter ones count as filled up with zeros. A null vec_id is no query and comes
    last among equal scores. Repeated rows are rows of their own: a query's copies are its candidates. An empty table gives no rows.
    """
    context, vector = embeddings.sparkSession.sparkContext, F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(finite(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    squares = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x)
    facts = rows.agg(F.max(squares).alias("longest"), F.count("*").alias("n")).first()
    if not facts["n"]:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow()
    ids, vectors = drawn["vec_id"].to_pandas().to_numpy(), matrix(drawn["vector"], np.float64)
    codes = context.broadcast(Codes(vectors, float(np.sqrt(facts["longest"]))))
    table = numbered(coded(rows, codes))
    queries = settle(aimed(table.where(F.col("vec_id") % EVERY == 0), codes, context.broadcast((ids, vectors))))
    found = settle(best(against(table, queries, Searcher, FOUND, chunk), ["query"], NEAREST))
    enough = found.where(F.col("rank") == min(NEAREST, facts["n"] - 1)).select(F.col("query").alias("done"))
    short = settle(queries.join(enough, queries["rid"] == enough["done"], "left_anti").withColumn("radius", F.lit(CODE).cast("long")))
    if facts["n"] > 1 and not short.isEmpty():
        again = best(against(table, short, Searcher, FOUND, chunk), ["query"], NEAREST)
        found = found.join(enough, found["query"] == enough["done"], "left_semi").unionByName(again)
    named = found.join(queries.select("rid", F.col("vec_id").alias("query_id")), found["query"] == F.col("rid"))
    return named.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
