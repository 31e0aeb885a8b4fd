"""Phrases that occur more often together than apart, with a count-min sketch before the exact count.

First pass: each task adds the phrases of one to three words to two rows of hashed cells; cells only ever count too much, and stop at 255, and
so do the sums of all tasks' sketches. Second pass: a phrase of which every cell reaches LEAST, and whose shorter parts passed
too, is counted exactly, as text; nothing that is frequent can be lost. What is frequent is then scored against its parts, and what mostly
occurs inside a longer phrase goes.

The sketch has a cell for every 8 to 16 bytes of text, up to MOST_CELLS. What is broadcast is a bit for each cell, 32 MB at most. For
more than some 2 GB of text the sketch lets more rare phrases pass to the exact count; results do not change.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from colloquy.llm.common import arrow_schema, forget, partitions, settle, sliced, texts_of, typed
from colloquy.llm.runs import word_grams

LONGEST, LEAST, FIRST = 3, 10, 2000
#: A phrase goes if a longer one has so many hundredths of its occurrences.
INSIDE = 50
SCALE = 1_000_000
ROWS, FEWEST_CELLS, MOST_CELLS, BYTES_A_CELL = 2, 1 << 16, 1 << 27, 16
#: Cells of a row of a sketch that travel together, sketches that one group adds up, and tasks that sketch where there is little text.
SLICE, TOGETHER, TASKS = 1 << 18, 16, 8
#: Bytes of text that are cut at a time; so words have fewer than 2^21 numbers, and three numbers fit in 63 bits.
CHUNK, NUMBER = 1 << 22, 21
NO_LANG = "und"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
BREAKS, GAPS = ".,;:!?\n\x0b\x0c\r", " \t"
#: 2 for what ends a piece, 1 for what parts words, 0 for letters.
GAP = re.compile(f"[{re.escape(BREAKS + GAPS)}]".encode())
KINDS = np.array([2 if chr(b) in BREAKS else 1 if chr(b) in GAPS else 0 for b in range(256)], np.uint8)


def portions(texts: list[bytes]) -> Iterator[tuple[bytes, int]]:
    """(text of about CHUNK bytes at most, words at its start that were counted before); texts are parted by line feeds.

    A longer text is cut between words; its next portion begins with the last LONGEST - 1 words of the one before.
    """
    held, size = [], 0
    for text in texts:
        if size and size + len(text) > CHUNK:
            yield b"\n".join(held), 0
            held, size = [], 0
        if len(text) <= CHUNK:
            held.append(text)
            size += len(text) + 1
            continue
        at = again = end = 0
        while end < len(text):
            done, end = end, min(end + CHUNK, len(text))
            if end < len(text):
                gaps = np.flatnonzero(KINDS[np.frombuffer(text[done:end], np.uint8)])
                # a word that is longer than a portion goes on to its end
                end = done + int(gaps[-1]) + 1 if len(gaps) else found.end() if (found := GAP.search(text, end)) else len(text)
            yield text[at:end], again
            kinds = np.concatenate([[1], KINDS[np.frombuffer(text[at:end], np.uint8)]])
            starts = np.flatnonzero((kinds[1:] == 0) & (kinds[:-1] != 0))
            again = min(LONGEST - 1, len(starts))
            at = at + int(starts[-again]) if again else end
    if held:
        yield b"\n".join(held), 0


def words_of(text: bytes) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(the words, lower-cased, as numbers of a dictionary; the piece of each)."""
    letters = np.frombuffer(text.translate(LOWERED), np.uint8)
    kinds = KINDS[letters]
    inside = np.concatenate([[0], (kinds == 0).view(np.int8), [0]])
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters[kinds == 0])])
    return words.dictionary_encode(), np.cumsum(kinds == 2, dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)


class Cut:
    """A portion of a language's text: its phrases as places, numbers and hashes."""

    def __init__(self, lang: str, text: bytes, again: int):
        words, self.pieces = words_of(text)
        self.again, self.words = again, words.dictionary.to_pylist()
        self.numbers = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        seed = xxh3_64_intdigest(lang)
        self.hashes = np.array([xxh3_64_intdigest(w, seed) for w in self.words], np.uint64)[self.numbers] if self.words else np.zeros(0, np.uint64)

    def places(self, size: int) -> np.ndarray:
        """Where phrases of size words begin that end in a word not counted before."""
        last = np.arange(max(size - 1, self.again), len(self.numbers))
        first = last - (size - 1)
        return first[self.pieces[first] == self.pieces[last]]

    def grams(self, size: int) -> np.ndarray:
        return word_grams(self.hashes, size)

    def keys(self, places: np.ndarray, size: int) -> np.ndarray:
        key = np.zeros(len(places), np.int64)
        for j in range(size):
            key = (key << NUMBER) | self.numbers[places + j]
        return key

    def phrase(self, key: int, size: int) -> bytes:
        return b" ".join(self.words[(key >> (NUMBER * j)) & ((1 << NUMBER) - 1)] for j in range(size - 1, -1, -1))


def cuts(batch: pa.RecordBatch) -> Iterator[tuple[str, Cut]]:
    by_lang: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch.column("text"))):
        by_lang.setdefault(lang, []).append(text)
    for lang, texts in by_lang.items():
        for text, again in portions(texts):
            yield lang, Cut(lang, text, again)


def cells_of(hashes: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each hash in either row of a sketch."""
    mask = np.uint64(cells - 1)
    return (hashes & mask).astype(np.uint32), ((hashes >> np.uint64(32)) & mask).astype(np.uint32)


def sketch(docs: DataFrame, cells: int, tasks: int) -> np.ndarray:
    """ROWS x cells bits: which cells of all documents' phrases reach LEAST."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        counts = np.zeros((ROWS, cells), np.uint8)
        for batch in sliced(batches):
            for _, cut in cuts(batch):
                hashes = np.concatenate([cut.grams(size)[cut.places(size)] for size in range(1, LONGEST + 1)])
                for row, own in zip(counts, cells_of(hashes, cells)):
                    at, n = np.unique(own, return_counts=True)
                    row[at] = np.minimum(row[at] + n, 255)
        task = TaskContext.get().partitionId()
        for at, part in enumerate(counts.reshape(-1, min(SLICE, cells))):
            if part.any():
                yield pa.record_batch({"slice": pa.array([at], pa.int32()), "salt": pa.array([task], pa.int32()), "counts": pa.array([part.tobytes()], pa.binary())})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(min(SLICE, cells), np.int64)
        for own in rows["counts"]:
            total += np.frombuffer(own, np.uint8)
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "salt": rows["salt"].iloc[:1] // TOGETHER, "counts": [np.minimum(total, 255).astype(np.uint8).tobytes()]})

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"slice": batch["slice"], "bits": [np.packbits(np.frombuffer(c, np.uint8) >= LEAST, bitorder="little").tobytes() for c in batch["counts"]]})

    schema, left = "slice int, salt int, counts binary", tasks
    parts = docs.coalesce(tasks).mapInArrow(count, schema)
    while left > 1:
        parts = parts.groupBy("slice", F.floor(F.col("salt") / TOGETHER)).applyInPandas(add, schema)
        left = -(-left // TOGETHER)
    full = np.zeros((ROWS * cells // min(SLICE, cells), min(SLICE, cells) // 8), np.uint8)
    for row in parts.select("slice", "counts").mapInPandas(bits, "slice int, bits binary").collect():  # of bounded size
        full[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return full.reshape(ROWS, cells // 8)


def survivors(docs: DataFrame, full, cells: int) -> DataFrame:
    """(lang, size, phrase, f): how often each phrase occurs in a portion, of those that the sketch lets pass; size 0 has all words."""
    schema = "lang string, size int, phrase string, f long"
    kinds = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        rows = full.value
        for batch in sliced(batches):
            for lang, cut in cuts(batch):
                found: list[tuple[int, bytes, int]] = [(0, b"", max(0, len(cut.numbers) - cut.again))]
                passed = np.ones(len(cut.numbers) + 1, bool)  # phrases of one word less, by where they begin
                for size in range(1, LONGEST + 1):
                    places = cut.places(size)
                    if size > 1:
                        # of those that are counted here; one that begins in words counted before is not pruned
                        places = places[passed[places] & passed[places + 1]]
                    hashes = cut.grams(size)[places]
                    good = np.ones(len(places), bool)
                    for row, own in zip(rows, cells_of(hashes, cells)):
                        good &= (row[own >> np.uint32(3)] >> (own & np.uint32(7)).astype(np.uint8)) & 1 == 1
                    places = places[good]
                    passed = np.zeros(len(cut.numbers) + 1, bool)
                    passed[places] = True
                    passed[: cut.again] = True
                    keys, n = np.unique(cut.keys(places, size), return_counts=True)
                    found += [(size, cut.phrase(k, size), c) for k, c in zip(keys.tolist(), n.tolist())]
                sizes, phrases, f = zip(*found)
                yield pa.record_batch([pa.array([lang] * len(found)), pa.array(sizes, pa.int32()), pc.cast(pa.array(phrases, pa.binary()), pa.string()), pa.array(f, pa.int64())], schema=kinds)

    return docs.mapInArrow(run, schema)


def frequent(docs: DataFrame) -> DataFrame:
    """(lang, size, phrase, f): exact counts of phrases of up to LONGEST words that reach LEAST; size 0 has all words of a language."""
    rows = typed(docs, text="string", lang="string").withColumn("lang", F.coalesce("lang", F.lit(NO_LANG)))
    length = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = min(MOST_CELLS, max(FEWEST_CELLS, 1 << (length // BYTES_A_CELL).bit_length()))
    tasks = max(TASKS, -(-length // (ROWS * cells)))
    full = rows.sparkSession.sparkContext.broadcast(sketch(rows, cells, tasks))
    counted = survivors(rows, full, cells).groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    return settle(counted.where((F.col("f") >= LEAST) | (F.col("size") == 0)))


def collocations(docs: DataFrame, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of two to LONGEST words of each language of docs (text, lang; others are ignored).

    a, l and r are the occurrences of the phrase and of the two parts of its weakest cut, n all words of the language,
    score the whole part of SCALE * a * a / (l * r). A null lang is und, a null or empty text has no words; repeated documents count
    each time; equal scores go by a, then by the phrase's bytes. A text of any length is cut portion by portion. An empty table gives
    no rows, as does a language in which nothing is frequent.
    """
    grams = frequent(docs)
    phrases = grams.where("size > 1").withColumnRenamed("f", "a")
    part = lambda f: grams.where("size > 0").select(F.col("lang").alias("of_lang"), F.col("phrase").alias("of_phrase"), F.col("f").alias(f))
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).withColumns({"head": F.expr("substring_index(phrase, ' ', k)"), "tail": F.expr("substring_index(phrase, ' ', k - size)")})
    for name, f in (("head", "l"), ("tail", "r")):
        cut = cut.join(part(f), (F.col("lang") == F.col("of_lang")) & (F.col(name) == F.col("of_phrase"))).drop("of_lang", "of_phrase")
    # decimals of no fraction: exact to 38 digits
    score = F.expr(f"(cast({SCALE} as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    weakest = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("w"))
    shorter = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(m, size), i -> substring_index(substring_index(phrase, ' ', i), ' ', -m))))")
    longer = phrases.where("size > 2").select(F.col("lang").alias("in_lang"), F.explode(shorter).alias("part"), "a").groupBy("in_lang", "part").agg(F.max("a").alias("inside"))
    kept = weakest.join(longer, (weakest["lang"] == longer["in_lang"]) & (weakest["phrase"] == longer["part"]), "left").where(f"inside is null or 100 * inside < {INSIDE} * a")
    kept = kept.select("lang", "phrase", "a", "w.l", "w.r", "w.score", F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession))).alias("salt"))
    # the first of each share of a language's phrases, then the first of those: no task orders all of a language
    order = [F.desc("score"), F.desc("a"), "phrase"]
    shares = kept.withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("at") <= first)
    ranked = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    totals = grams.where("size = 0").select(F.col("lang").alias("of"), F.col("f").alias("n"))
    return ranked.join(totals, ranked["lang"] == totals["of"]).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql() -> str:
    """The same rows as DuckDB SQL."""
    breaks = "[.,;:!?\\x0A-\\x0D]"
    return f"""
WITH p AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{breaks}')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS words FROM p),
t AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) AS phrase FROM w, (VALUES {', '.join(f'({n})' for n in range(1, LONGEST + 1))}) s(size) WHERE len(words) >= size),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM f WHERE size > 1),
s AS (SELECT c.lang, c.size, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST({SCALE}::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM c
    JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[k + 1:], ' ')),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(list_slice(string_split(phrase, ' '), j, j + 1), ' ') AS part, max(f) AS inside FROM f, (VALUES (1), (2)) q(j) WHERE size = 3 GROUP BY ALL),
o AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m LEFT JOIN i ON i.lang = m.lang AND i.part = m.phrase WHERE inside IS NULL OR 100 * inside < {INSIDE} * a)
SELECT o.lang, rank, phrase, a, l, r, t.n, score FROM o JOIN t ON t.lang = o.lang WHERE rank <= {FIRST}"""
