"""What the two exact substring operators share: finding windows that repeat without moving them all.

A text is cut into runs of consecutive windows that share a key taken from their content, so equal windows
have equal keys wherever they are. Three facts keep the work small and free of hot tasks:

* A run that occurs again as a whole needs no window compared: its occurrences are counted by digest, with
  partial sums before the shuffle.
* Of runs that share a key but differ, one representative each is sent, packed, to the key's bucket.
* Keys with over HOT runs are not gathered: their windows are counted by digest, in sums that
  every task begins on its own and joins that can be split.

What comes back for a document is a list of (run digest, windows in it, null for all); whoever applies it
cuts the text again and matches runs by digest.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from colloquy.llm.common import settle

#: More runs of one key than this are never gathered in one task.
HOT = 20_000
#: Fixed odd multipliers of the mixers below.
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
FOUND = "dk long, run long, at array<int>"
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every width consecutive values, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


LETTERS = mixed(np.arange(1, 257, dtype=np.uint64))


class Powers:
    """Powers of a number modulo 2**64, as many as were asked for so far."""

    def __init__(self, base: np.uint64):
        self.base, self.known = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            self.known = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 2 * len(self.known)), self.base))])
        return self.known[:n]


POWERS, INVERSES = Powers(BASE), Powers(INVERSE)


def hash_words(plain: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of a text in which single spaces part them, and nothing else does."""
    if not plain:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    letters = np.frombuffer(plain, np.uint8)
    gaps = np.flatnonzero(letters == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(letters)]])
    sums = np.concatenate([[np.uint64(0)], np.cumsum(LETTERS[letters] * POWERS.upto(len(letters)))])
    return starts, ends, mixed((sums[ends] - sums[starts]) * INVERSES.upto(len(letters) + 1)[starts])


def word_grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive word hashes."""
    size = max(0, len(words) - n + 1)
    grams = np.zeros(size, np.uint64)
    for j in range(n):
        grams = grams * BASE + words[j : size + j]
    return mixed(grams)


def run_digests(data: bytes, starts: list[int], ends: list[int], salts: list[int] | None = None) -> np.ndarray:
    """48 bits of a hash of each run. With the 64 bits of its key, which hash other bytes of it, they name it."""
    salts = salts or [0] * len(starts)
    found = np.array([xxh3_64_intdigest(data[a:b], s) for a, b, s in zip(starts, ends, salts)], np.uint64)
    return (found >> np.uint64(16)).view(np.int64)


def once_a_text(doc: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different run of each of at most 65,536 texts, and how often it occurs there."""
    return np.unique((doc.astype(np.uint64) << np.uint64(48)) | runs.view(np.uint64), return_index=True, return_counts=True)[1:]


def find_repeats(
    docs: DataFrame,
    occurrences: Callable[[DataFrame], DataFrame],
    again: Callable[[Column, Column], Column],
    send: Callable[[DataFrame], DataFrame],
    compare: Callable[[DataFrame], DataFrame],
    explode: Callable[[DataFrame], DataFrame],
    twice: Callable[[Column, Column], Column],
    hot: int = HOT,
) -> DataFrame:
    """(dk, found): for documents with repeats, an array of (run, at).

    docs: (dk, text), dk not null. occurrences(docs): (key, run, dk, n), once for each different run of a
    document, n times there. again(first dk, total): if a run counts as repeated, for its occurrence in dk.
    send(docs with wanted runs): (key, run, dk, total, packed). compare(packed of whole buckets) and
    explode(packed) -> (w1, w2, dk, run, total, at) are the two ways to judge windows; twice(first dk,
    total) says if a window counts, as again() does for runs.
    """
    seen = settle(occurrences(docs))  # narrow rows, and texts are cut once for the three questions asked of them
    stats = seen.groupBy("key", "run").agg(F.min("dk").alias("first"), F.sum("n").alias("total"))
    keys = seen.groupBy(F.col("key").alias("k")).agg(F.min("run").alias("low"), F.max("run").alias("high"), F.sum("n").alias("n"))
    keys = keys.where("n > 1").select("k", (F.col("low") != F.col("high")).alias("differ"), (F.col("n") > hot).alias("hot"))
    # of all runs only those that can share a window with another place
    shared = settle(stats.join(keys, stats["key"] == F.col("k")).where(F.col("differ") | (F.col("total") > 1)).drop("k"))
    repeated = shared.where("total > 1").select(F.col("key").alias("k"), F.col("run").alias("r"), "first", "total")
    whole = seen.join(repeated, (seen["key"] == F.col("k")) & (seen["run"] == F.col("r"))).where(again(F.col("first"), F.col("total")))
    whole = whole.select("dk", "run", F.lit(None).cast("array<int>").alias("at"))

    wanted = shared.where("differ").select(F.col("first").alias("w"), F.struct("run", "total", "hot").alias("run"))
    wanted = wanted.groupBy("w").agg(F.collect_list("run").alias("wanted"))  # as many as the document has runs
    # with all its columns, so that the exchange of texts can serve the caller's last join too
    packed = send(docs.join(wanted, docs["dk"] == F.col("w")).select(*docs.columns, "wanted"))
    cold = compare(packed.where("not hot"))
    windows = explode(packed.where("hot"))
    counts = windows.groupBy("w1", "w2").agg(F.min("dk").alias("first"), F.sum("total").alias("all")).where("all > 1")
    counts = counts.select(F.col("w1").alias("x1"), F.col("w2").alias("x2"), "first", "all")
    warm = windows.join(counts, (windows["w1"] == F.col("x1")) & (windows["w2"] == F.col("x2"))).where(twice(F.col("first"), F.col("all")))
    warm = warm.groupBy("dk", "run").agg(F.collect_list("at").alias("at"))  # as many as the run has windows
    return whole.unionByName(cold).unionByName(warm).groupBy("dk").agg(F.collect_list(F.struct("run", "at")).alias("found"))
