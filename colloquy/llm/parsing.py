"""Exact removal of repeated byte strings, by prefix-free parsing and combined suffix orders.

A rolling hash triggers where the least value among its neighbours lies; triggers cut a text into phrases.
A window of WINDOW bytes belongs to the first trigger it selects, so equal windows, wherever they are, have
the same bytes before and after equal triggers: the end of a phrase (a dictionary suffix) and the start of
the parse that follows it. All places of one trigger string meet in a bucket. There two orders are built,
of dictionary suffixes (read back from the trigger) and of parse suffixes (read on from it), with the
common lengths of neighbours. Together they are the order of the bucket's part of the corpus: two windows
that begin a bytes before their triggers are equal if and only if they fall in one class of the first order
at depth a and in one class of the second at depth WINDOW - a. Triggers include TRIGGER bytes of what
follows, so no dictionary suffix is the start of another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import arrow_schema, map_rows, partitions, texts_of, typed
from colloquy.llm.runs import FOUND, HOT, LETTERS, POWERS, find_repeats, least, mixed, once_a_text, run_digests
from colloquy.llm.superkmers import chunks

WINDOW = 200
TRIGGER = 32
#: Bytes of text that are cut at a time: the arrays of a cut fit in a processor's cache.
CHUNK = 1 << 17
#: A longer text is cut in stretches; windows do not depend on where these end.
STRETCH = 1 << 23
#: Records of whole buckets that are ordered together, about.
TOGETHER = 20_000


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of every width consecutive bytes, built by doubling: hash(xy) = hash(x)·b^|y| + hash(y), mixed at the end."""
    parts, out, at, size = LETTERS[data], None, 0, 1
    while True:
        if width & size:
            n = len(data) - at - size + 1
            out = parts.copy() if out is None else out[:n] * power(size) + parts[at : at + n]
            at += size
        if 2 * size > width:
            return mixed(out)
        parts = parts[:-size] * power(size) + parts[size:]
        size *= 2


def power(n: int) -> np.uint64:
    return POWERS.upto(n + 1)[n]


class Parse:
    """Phrases of a few texts. For each trigger that a window selects: text, its key, where it is, first and last such window."""

    def __init__(self, texts: list[bytes], window: int, trigger: int):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.firsts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.data, self.window = b"".join(texts), window
        self.doc = self.key = self.at = self.low = self.high = np.zeros(0, np.int64)
        n = len(self.data)
        if n >= window:
            parts = [self.cut(a, min(n, a + STRETCH + window - 1), min(trigger, window)) for a in range(0, n - window + 1, STRETCH)]
            self.doc, self.key, self.at, self.low, self.high = (np.concatenate(x) for x in zip(*parts))

    def cut(self, start: int, end: int, trigger: int) -> tuple[np.ndarray, ...]:
        """The triggers of the windows in bytes start to end. Places fit in 24 bits there."""
        hashes = rolling(np.frombuffer(self.data, np.uint8, end - start, start), trigger)
        # the place breaks ties of the hash's upper 40 bits, the leftmost wins
        ranked = hashes & np.uint64(0xFFFFFFFFFF000000)
        ranked |= np.arange(len(hashes), dtype=np.uint64)
        chosen = least(ranked, self.window - trigger + 1)
        # windows where the trigger changes, and the first of each text; those over a text's end are none
        begin = np.flatnonzero(chosen[1:] != chosen[:-1]) + 1
        begin = np.unique(np.concatenate([[0], begin, self.firsts[(self.firsts > start) & (self.firsts < start + len(chosen))] - start]))
        doc = np.searchsorted(self.firsts, start + begin, "right") - 1
        last = np.append(begin[1:], len(chosen)) - 1
        last = np.minimum(last, self.firsts[doc + 1] - self.window - start)
        good = last >= begin
        begin, doc, last = begin[good], doc[good], last[good]
        at = (chosen[begin] & np.uint64(0xFFFFFF)).astype(np.int64)
        return doc, hashes[at].view(np.int64), start + at, start + begin, start + last

    def record(self, i: int) -> tuple[bytes, bytes]:
        """What stands before the trigger in its windows, and what stands from it on."""
        t = int(self.at[i])
        return self.data[int(self.low[i]) : t], self.data[t : int(self.high[i]) + self.window]

    def run_digests(self) -> np.ndarray:
        """Two records have one digest if they agree in bytes and in where the trigger is."""
        if not len(self.at):
            return np.zeros(0, np.int64)
        before = (self.at - self.low).tolist()
        return run_digests(self.data, self.low.tolist(), (self.high + self.window).tolist(), before)


def common(a: list[bytes], limit: int) -> np.ndarray:
    """Bytes that neighbours of a sorted list have in common; 0 for the first."""
    out = np.zeros(len(a), np.int64)
    if len(a) > 1:
        width = min(limit, max(map(len, a)))
        padded = np.frombuffer(b"".join([x[:width].ljust(width, b"\0") for x in a]), np.uint8).reshape(len(a), width)
        lengths = np.array([min(len(x), width) for x in a])
        differ = padded[1:] != padded[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if width else np.zeros(len(a) - 1, np.int64)
        out[1:] = np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))
    return out


def repeated_windows(keys: list[int], records: list[tuple[bytes, bytes]], window: int) -> list[np.ndarray]:
    """For records of whole buckets: which windows of each, counted from its first, another record also has.

    Different records of one bucket only share windows at equal distance before their triggers.
    """
    n = len(records)
    orders, ranks = [], []
    for side in (0, 1):
        texts = [r[0][::-1] if side == 0 else r[1] for r in records]
        order = sorted(range(n), key=lambda i: (keys[i], texts[i]))
        lengths = common([texts[i] for i in order], window)
        for j in range(1, n):
            if keys[order[j]] != keys[order[j - 1]]:
                lengths[j] = -1
        lengths[0] = -1
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        orders.append(lengths)
        ranks.append(rank)
    before = np.array([len(r[0]) for r in records])
    nearest = np.array([window - len(r[1]) for r in records])  # the last window begins so far before the trigger
    marks: list[tuple[np.ndarray, int]] = []
    for a in range(int(nearest.min()), int(before.max()) + 1):
        here = np.flatnonzero((nearest <= a) & (a <= before))
        if len(here) < 2:
            continue
        suffix = np.cumsum(orders[0] < a)[ranks[0][here]]
        prefix = np.cumsum(orders[1] < window - a)[ranks[1][here]]
        both = suffix * (n + 1) + prefix
        _, inverse, counts = np.unique(both, return_inverse=True, return_counts=True)
        if len(shared := here[counts[inverse] > 1]):
            marks.append((shared, a))
    if not marks:
        return [np.zeros(0, np.int64)] * n
    who = np.concatenate([m for m, _ in marks])
    offset = before[who] - np.repeat([a for _, a in marks], [len(m) for m, _ in marks])
    order = np.argsort(who, kind="stable")
    return np.split(offset[order], np.searchsorted(who[order], np.arange(1, n)))


def repeated_strings(docs: DataFrame, window: int = WINDOW, trigger: int = TRIGGER, hot: int = HOT) -> DataFrame:
    """(dk, found) for (dk, text): see runs.find_repeats. A window counts if it starts in two places."""
    spark = docs.sparkSession

    def occur(columns):
        out = {n: [] for n in ("key", "run", "dk", "n")}
        ids = np.array(columns["dk"])
        for base, texts in chunks(texts_of(columns["text"]), CHUNK):
            cut = Parse(texts, window, trigger)
            if len(cut.at):
                runs = cut.run_digests()
                one, counts = once_a_text(cut.doc, runs)
                for name, value in zip(out, (cut.key[one], runs[one], ids[base + cut.doc[one]], counts)):
                    out[name].append(value)
        return {n: np.concatenate(v) for n, v in out.items()} if out["key"] else None

    def pack(columns):
        out = {n: [] for n in ("key", "run", "dk", "total", "hot", "before", "after")}
        ids, wanted = columns["dk"].to_pylist(), columns["wanted"].to_pylist()
        for base, texts in chunks(texts_of(columns["text"]), CHUNK):
            cut, left = Parse(texts, window, trigger), {}
            for i, (doc, run) in enumerate(zip(cut.doc.tolist(), cut.run_digests().tolist())):
                if doc not in left:
                    left[doc] = {w["run"]: w for w in wanted[base + doc]}
                if w := left[doc].pop(run, None):
                    for name, value in zip(out, (int(cut.key[i]), run, ids[base + doc], w["total"], w["hot"], *cut.record(i))):
                        out[name].append(value)
        return out

    kinds = arrow_schema(spark, FOUND)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(batch.column(n).to_pylist() for n in ("key", "run", "dk", "total", "before", "after")))

        def judged(rows: list[tuple]) -> list[pa.RecordBatch]:
            """Runs that occur more than once are known as such already; they only bear witness here."""
            at = repeated_windows([r[0] for r in rows], [(r[4], r[5]) for r in rows], window)
            out = [(r[2], r[1], a.tolist()) for r, a in zip(rows, at) if r[3] == 1 and len(a)]
            return [pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)] if out else []

        held: list[tuple] = []
        for _, group in groupby(rows(), key=lambda r: r[0]):
            held += group
            if len(held) >= TOGETHER:
                yield from judged(held)
                held = []
        if held:
            yield from judged(held)

    def singly(columns):
        out = {n: [] for n in ("w1", "w2", "dk", "run", "total", "at")}
        for dk, run, total, before, after in zip(*(columns[n].to_pylist() for n in ("dk", "run", "total", "before", "after"))):
            whole = before + after
            for i in range(len(whole) - window + 1):
                d = hashlib.blake2b(whole[i : i + window], digest_size=16).digest()
                for name, value in zip(out, (int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), dk, run, total, i)):
                    out[name].append(value)
        return out

    always = lambda first, total: total > 1
    return find_repeats(
        docs,
        lambda d: map_rows(d, "key long, run long, dk long, n long", occur),
        always,
        lambda d: map_rows(d, "key long, run long, dk long, total long, hot boolean, before binary, after binary", pack),
        lambda p: p.repartition(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(buckets, FOUND),
        lambda p: map_rows(p, "w1 long, w2 long, dk long, run long, total long, at int", singly),
        always,
        hot,
    )


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def drop_repeated_bytes(docs: DataFrame, window: int = WINDOW, trigger: int = TRIGGER, hot: int = HOT, spans: bool = False) -> DataFrame:
    """Remove each byte in a window of bytes that starts in more than one place (RESULT).

    A row for each row of docs (doc_id, text; other columns are ignored); spans: also removed, an array of
    (start, end) byte offsets. Null texts are empty. Texts shorter than a window stay whole. Every row is a
    place of its own, whatever its doc_id, so repeated rows remove each other; null doc_ids take part.
    """
    # a document's key only brings results to it; what they say depends on content alone
    rows = typed(docs, doc_id="long", text="string").select(F.coalesce("doc_id", F.xxhash64("text")).alias("dk"), F.col("doc_id").isNull().alias("nameless"), "text")
    found = repeated_strings(rows, window, trigger, hot).withColumnRenamed("dk", "f")
    joined = rows.join(found, rows["dk"] == F.col("f"), "left").select(F.when(~F.col("nameless"), F.col("dk")).alias("doc_id"), "text", "found")

    def apply(columns):
        out = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")}
        founds = columns["found"].to_pylist()
        for base, some in chunks(texts_of(columns["text"]), CHUNK):
            gone = None
            if any(founds[base : base + len(some)]):
                cut = Parse(some, window, trigger)
                ends = np.zeros(int(cut.firsts[-1]) + 1, np.int64)
                marks = [{f["run"]: f["at"] for f in sorted(founds[base + d] or [], key=lambda f: f["at"] is None)} for d in range(len(some))]
                for doc, run, low, high in zip(cut.doc.tolist(), cut.run_digests().tolist(), cut.low.tolist(), cut.high.tolist()):
                    if run in marks[doc]:
                        at = marks[doc][run]
                        if at is None:
                            ends[low] += 1
                            ends[high + window] -= 1
                        else:
                            for i in at:
                                ends[low + i] += 1
                                ends[low + i + window] -= 1
                gone = np.cumsum(ends[:-1]) > 0
            for d, text in enumerate(some):
                edges = []
                if gone is not None:
                    mask = gone[cut.firsts[d] : cut.firsts[d + 1]]
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).tolist()
                cuts = list(zip(edges[::2], edges[1::2]))
                kept = b"".join([text[a:b] for a, b in zip([0, *edges[1::2]], [*edges[::2], len(text)])])
                for name, value in zip(out, (len(text), len(text) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in cuts])):
                    out[name].append(value)
        return {"doc_id": columns["doc_id"]} | {n: v for n, v in out.items() if spans or n != "removed"}

    return map_rows(joined, RESULT + ", removed array<struct<start long, end long>>" * spans, apply)


def oracle_sql(window: int = WINDOW, stretch: int = 2000) -> str:
    """DuckDB SQL for drop_repeated_bytes() of documents: digests of all windows, cut from hexadecimal stretches of the texts."""
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, o, substring(h, 2 * o + 1, {2 * (stretch + window - 1)}) AS x FROM (SELECT r, h, unnest(generate_series(0, length(h) // 2 - {window}, {stretch})) AS o FROM d)),
w AS (SELECT r, o + j AS i, md5(substring(x, 2 * j + 1, {2 * window})) AS v FROM (SELECT r, o, x, unnest(generate_series(0, least({stretch}, length(x) // 2 - {window - 1}) - 1)) AS j FROM p)),
c AS (SELECT v FROM w GROUP BY v HAVING count(*) > 1),
s AS (SELECT r, i FROM w SEMI JOIN c ON c.v = w.v),
n AS (SELECT r, i, CASE WHEN i - lag(i) OVER q <= {window} THEN 0 ELSE 1 END AS fresh FROM s WINDOW q AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM n),
e AS (SELECT r, min(i) AS a, max(i) + {window} AS b FROM g GROUP BY r, k),
k AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS z FROM e),
t AS (SELECT k.r, sum(b - a) AS gone, count(*) AS spans, max(b) AS z, string_agg(substring(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS head FROM k JOIN d ON d.r = k.r GROUP BY k.r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substring(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t ON t.r = d.r"""
