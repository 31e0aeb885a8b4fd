"""Exact removal of long word sequences that an earlier document has, by super-k-mer partitioning.

Every window of WINDOW words has a minimiser: the least hash among its word SEED-grams. Consecutive windows
with one minimiser travel as one packed string, a super-k-mer, to the minimiser's bucket; there all windows
are sorted by their words, numbered in the bucket, so that windows share a place in the order if and only if they
are equal word for word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import arrow_schema, map_rows, partitions, texts_of, typed
from colloquy.llm.runs import FOUND, HOT, find_repeats, hash_words, least, once_a_text, run_digests, word_grams

WINDOW = 50
SEED = 10
#: Windows of one super-k-mer at most; a longer run goes as several.
LONGEST = 256
#: Bytes and texts that are cut at a time: the arrays of a cut fit in a processor's cache.
CHUNK, TEXTS = 1 << 17, 1 << 12
#: Bytes of whole buckets that are sorted together, about; a bucket has at most HOT strings of LONGEST windows.
TOGETHER = 1 << 21


class Cut:
    """Super-k-mers of a few texts: for each its text's number, minimiser, first word, windows, digest and bytes."""

    def __init__(self, texts: list[bytes], window: int):
        self.words = [t.split() for t in texts]
        self.counts = np.array([len(w) for w in self.words], np.int64)
        self.firsts = np.concatenate([[0], np.cumsum(self.counts)])  # of each text, counting words of all
        self.plain = b" ".join([w for words in self.words for w in words])
        self.window = window
        n = int(self.firsts[-1])
        self.doc = self.key = self.start = self.n = np.zeros(0, np.int64)
        if n < window:
            self.starts = self.ends = np.zeros(0, np.int64)
            return
        self.starts, self.ends, word = hash_words(self.plain)
        seed = min(SEED, window)
        key = least(word_grams(word, seed), window - seed + 1)
        doc = np.repeat(np.arange(len(texts)), self.counts)
        inside = doc[: n - window + 1] == doc[window - 1 :]
        at = np.flatnonzero(inside)
        if not len(at):
            return
        key = key[at]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (np.diff(at) != 1) | (doc[at[1:]] != doc[at[:-1]])])
        first = np.flatnonzero(new)
        sizes = np.diff(np.concatenate([first, [len(at)]]))
        parts = -(-sizes // LONGEST)
        if (parts > 1).any():
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first = np.repeat(first, parts) + LONGEST * nth
            sizes = np.minimum(np.repeat(sizes, parts) - LONGEST * nth, LONGEST)
        self.start, self.n, self.key = at[first], sizes, key[first].view(np.int64)
        self.doc = doc[self.start]
        self.froms, self.tos = self.starts[self.start].tolist(), self.ends[self.start + sizes + window - 2].tolist()

    def run_digests(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.int64)
        return run_digests(self.plain, self.froms, self.tos)

    def packed(self, i: int) -> bytes:
        return self.plain[self.froms[i] : self.tos[i]]


def chunks(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts that together have about so many bytes, with the number of the first."""
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and end < at + TEXTS and (end == at or total + len(texts[end]) <= size):
            total += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def window_bytes(packed: bytes, window: int) -> list[bytes]:
    words = packed.split()
    return [b" ".join(words[i : i + window]) for i in range(len(words) - window + 1)]


def window_order(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the texts: its text's number, its first word, and its place among all different windows in order.

    Words are numbered, then pairs of neighbours are sorted to number spans of two words, of four, and so on.
    """
    numbers: dict[bytes, int] = {}
    words = [[numbers.setdefault(w, len(numbers)) for w in text.split()] for text in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    place = np.fromiter(chain.from_iterable(words), np.int64, int(sizes.sum()))
    have = 1
    while have < window and len(place):
        step = min(have, window - have)
        place = np.unique(place[:-step] * np.int64(len(place) + len(numbers)) + place[step:], return_inverse=True)[1]
        have += step
    counts = np.maximum(sizes - window + 1, 0)  # spans over the end of a text are none of its windows
    text = np.repeat(np.arange(len(texts)), counts)
    first = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return text, first, place[np.repeat(np.cumsum(sizes) - sizes, counts) + first]


def late_windows(rows: list[tuple[int, int, bytes]], window: int) -> Iterator[tuple[int, int, list[int]]]:
    """(dk, run, windows) for rows (dk, run, packed) of whole buckets with windows that a row of a smaller dk has too."""
    text, first, place = window_order([packed for _, _, packed in rows], window)
    if not len(text):
        return
    dks = np.array([dk for dk, _, _ in rows], np.int64)[text]
    order = np.lexsort((dks, place))
    begins = np.flatnonzero(np.diff(place[order], prepend=-1))
    least = np.repeat(dks[order][begins], np.diff(np.append(begins, len(order))))
    late = np.sort(order[dks[order] > least])
    for r, at in zip(*split_by(text[late], first[late])):
        yield rows[r][0], rows[r][1], at.tolist()


def split_by(owners: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The different owners, which rise, and the values of each."""
    who, begins = np.unique(owners, return_index=True)
    return who.tolist(), np.split(values, begins[1:])


def earlier_windows(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(dk, found) for (dk, text): see runs.find_repeats. A window counts if a smaller dk has it."""
    spark = docs.sparkSession

    def occur(columns):
        keys, runs, dks = [], [], []
        ids = np.array(columns["dk"])
        for base, texts in chunks(texts_of(columns["text"])):
            cut = Cut(texts, window)
            if len(cut.start):
                digests = cut.run_digests()
                one, _ = once_a_text(cut.doc, digests)
                keys.append(cut.key[one])
                runs.append(digests[one])
                dks.append(ids[base + cut.doc[one]])
        if not keys:
            return None
        return {"key": np.concatenate(keys), "run": np.concatenate(runs), "dk": np.concatenate(dks), "n": np.ones(sum(map(len, keys)), np.int64)}

    def pack(columns):
        out = {n: [] for n in ("key", "run", "dk", "total", "hot", "packed")}
        ids, wanted = columns["dk"].to_pylist(), columns["wanted"].to_pylist()
        for base, texts in chunks(texts_of(columns["text"])):
            cut, left = Cut(texts, window), {}
            for i, (doc, run) in enumerate(zip(cut.doc.tolist(), cut.run_digests().tolist())):
                if doc not in left:
                    left[doc] = {w["run"]: w for w in wanted[base + doc]}
                if w := left[doc].pop(run, None):
                    for name, value in zip(out, (int(cut.key[i]), run, ids[base + doc], w["total"], w["hot"], cut.packed(i))):
                        out[name].append(value)
        return out

    kinds = arrow_schema(spark, FOUND)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(n).to_pylist() for n in ("key", "dk", "run", "packed")))

        def judged(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            if out := list(late_windows(held, window)):
                yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

        held, size = [], 0
        for _, group in groupby(rows(), key=lambda r: r[0]):
            for row in group:
                held.append(row[1:])
                size += len(row[3])
            if size >= TOGETHER:  # equal windows have one key, so buckets can be sorted together
                yield from judged(held)
                held, size = [], 0
        yield from judged(held)

    def singly(columns):
        out = {n: [] for n in ("w1", "w2", "dk", "run", "total", "at")}
        for dk, run, packed in zip(*(columns[n].to_pylist() for n in ("dk", "run", "packed"))):
            for i, w in enumerate(window_bytes(packed, window)):
                d = hashlib.blake2b(w, digest_size=16).digest()
                for name, value in zip(out, (int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), dk, run, 2, i)):
                    out[name].append(value)
        return out

    later = lambda first, total: F.col("dk") > first
    return find_repeats(
        docs,
        lambda d: map_rows(d, "key long, run long, dk long, n long", occur),
        later,
        lambda d: map_rows(d, "key long, run long, dk long, total long, hot boolean, packed binary", pack),
        lambda p: p.repartition(partitions(spark), "key").sortWithinPartitions("key", "dk").mapInArrow(buckets, FOUND),
        lambda p: map_rows(p, "w1 long, w2 long, dk long, run long, total long, at int", singly),
        later,
        hot,
    )


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def drop_repeats(docs: DataFrame, window: int = WINDOW, hot: int = HOT, texts: bool = False) -> DataFrame:
    """Remove each word in a window of words that also starts in a document with a smaller doc_id (RESULT).

    Words are runs of anything but ASCII white space. A row for each row of docs (doc_id, text; other
    columns are ignored); texts: also kept, the words that stay. Null and empty texts have no words; texts
    of fewer words than a window keep them all. Rows that repeat a doc_id are one document to each other,
    so copies under one doc_id stay; a null doc_id is neither smaller nor larger than any, so such rows
    stay as they are and affect none.
    """
    rows = typed(docs, doc_id="long", text="string")
    # the same exchange of texts serves both joins
    named = rows.where("doc_id is not null").select(F.col("doc_id").alias("dk"), "text")
    found = earlier_windows(named, window, hot).withColumnRenamed("dk", "f")
    joined = named.join(found, named["dk"] == F.col("f"), "left").select(F.col("dk").alias("doc_id"), "text", "found")
    nameless = rows.where("doc_id is null").withColumn("found", F.lit(None).cast(joined.schema["found"].dataType))

    def apply(columns):
        counts, removed, kept = [], [], []
        founds = columns["found"].to_pylist()
        for base, some in chunks(texts_of(columns["text"])):
            if not any(founds[base : base + len(some)]):
                for text in some:
                    words = text.split()
                    counts.append(len(words))
                    removed.append(0)
                    kept.append(b" ".join(words))
                continue
            cut = Cut(some, window)
            ends = np.zeros(int(cut.firsts[-1]) + 1, np.int64)
            marks = [{f["run"]: f["at"] for f in sorted(founds[base + d] or [], key=lambda f: f["at"] is None)} for d in range(len(some))]
            for doc, run, start, n in zip(cut.doc.tolist(), cut.run_digests().tolist(), cut.start.tolist(), cut.n.tolist()):
                if run in marks[doc]:
                    at = marks[doc][run]
                    if at is None:
                        ends[start] += 1
                        ends[start + n + window - 1] -= 1
                    else:
                        for i in at:
                            ends[start + i] += 1
                            ends[start + i + window] -= 1
            gone = np.cumsum(ends[:-1]) > 0
            for d, words in enumerate(cut.words):
                mask = gone[cut.firsts[d] : cut.firsts[d + 1]]
                counts.append(len(words))
                removed.append(int(mask.sum()))
                kept.append(b" ".join(words if not removed[-1] else [w for w, m in zip(words, mask.tolist()) if not m]))
        out = {"doc_id": columns["doc_id"], "n_words": counts, "n_removed": removed, "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}
        return out | ({"kept": [k.decode() for k in kept]} if texts else {})

    return map_rows(joined.unionByName(nameless), RESULT + ", kept string" * texts, apply)


def oracle_sql(window: int = WINDOW) -> str:
    """DuckDB SQL for drop_repeats() of documents: all windows as strings, each with the least doc_id that has it."""
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + {window - 1}], ' ') AS h FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {window - 1})) AS i FROM w)),
f AS (SELECT h, min(doc_id) AS d FROM k GROUP BY h),
g AS (SELECT DISTINCT doc_id, i + o AS p FROM (SELECT k.doc_id, i FROM k JOIN f ON f.h = k.h AND f.d < k.doc_id) CROSS JOIN (SELECT unnest(generate_series(0, {window - 1})) AS o)),
x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
s AS (SELECT x.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE g.p IS NULL) AS kept FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.p = x.p GROUP BY x.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s ON s.doc_id = w.doc_id"""
