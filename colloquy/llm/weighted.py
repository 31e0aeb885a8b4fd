"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its shingles of five words, weight = count times idf, idf taken from
hashed document frequencies of the whole corpus. Each of BANDS x ROWS samples picks one (shingle, level)
so that two documents pick alike with probability equal to their weighted Jaccard similarity. Documents
that agree in a whole band are candidates; only pairs whose exact weighted Jaccard similarity reaches
LEAST are links; classes are the connected components.

Members of a bucket are first compared with its head, the member that meets most others. In buckets that this
leaves in several components, every two members of different ones are compared, in groups of a bounded number
of texts, behind an exact bound. So at the end every two members of a bucket are in one class or have been
compared, whatever its size, and no pairs are listed of members already joined. Texts of equal words are one
node throughout. Nothing about all documents comes to the driver but the table of document frequencies, which
has a fixed size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import arrow_schema, forget, kept, map_rows, settle, sliced, texts_of, tidy, typed
from colloquy.llm.runs import hash_words, mixed, word_grams

SHINGLE = 5
LEAST = 0.8
#: A pair at 0.8 shares a band with probability 1 - (1 - 0.8^6)^24 = 0.9993, one at 0.3 with 0.017.
BANDS, ROWS = 24, 6
#: Rows of each table of random variates; shingles are dealt to them by hash.
VARIATES = 1 << 14
#: Slots of hashed document frequencies, and how many of them go in one row of partial sums.
SLOTS, SLICE = 1 << 18, 1 << 12
SALTS = 32
#: A bucket of more than twice so many members is compared block by block.
BLOCK = 1000
#: Smoothing of the idf: added to the share of documents that have a shingle. Without it a group of near copies that is a large part of a
#: corpus loses the weight of what it shares to its own size, and its members fall under LEAST by the words in which they differ.
DAMPING = 0.2
#: Ids of documents to compare that may be broadcast, 8 bytes each; with more, all texts are shuffled.
BROADCAST = 200_000
SEED = 8


def shingles(plain: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of a text as rising hashes, and their counts. Fewer words than five are one shingle."""
    words = hash_words(plain)[2]
    return np.unique(word_grams(words, min(SHINGLE, max(1, len(words)))), return_counts=True)


def plain_words(text: bytes) -> bytes:
    return b" ".join(text.split())


def name_of(plain: bytes) -> bytes:
    """The node of all texts with these words: 128 bits, so that no two of 10^10 unlike texts share one (probability 10^-19)."""
    return hashlib.blake2b(plain, digest_size=16).digest()


def variates(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three seeded tables for BANDS x ROWS samples, r and log c of Gamma(2, 1), b uniform."""
    draw, shape = np.random.default_rng(seed), (VARIATES, BANDS * ROWS)
    r = draw.standard_gamma(2.0, shape, np.float32)
    c = draw.standard_gamma(2.0, shape, np.float32)
    return r, np.log(c, out=c), draw.random(shape, np.float32)


class Sampler:
    """Consistent weighted samples of weighted sets."""

    def __init__(self, idf: np.ndarray):
        self.idf = idf
        self.r, self.c, self.b = kept(variates, SEED)

    def samples(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A number for each sample, of the shingle and level that it picked.

        Each table is entered by other bits of a shingle, so that two shingles hardly share all three variates.
        """
        best = pick = level = None
        logs = np.log(weights).astype(np.float32)
        lanes = np.arange(BANDS * ROWS)
        for at in range(0, len(hashes), 2048):
            here = hashes[at : at + 2048]
            r, c, b = (table[((here >> np.uint64(shift)) & np.uint64(VARIATES - 1)).astype(np.int64)] for table, shift in ((self.r, 0), (self.c, 20), (self.b, 40)))
            t = np.floor(logs[at : at + 2048, None] / r + b)
            score = c - r * (t - b + np.float32(1))
            first = score.argmin(axis=0)
            now = score[first, lanes], here[first], t[first, lanes]
            if best is None:
                best, pick, level = now
            else:
                less = now[0] < best
                best, pick, level = (np.where(less, n, o) for n, o in zip(now, (best, pick, level)))
        return mixed(pick ^ mixed(level.astype(np.int64).view(np.uint64) + np.uint64(1)))

    def bands(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A number for each band, of its samples."""
        out = np.arange(1, BANDS + 1, dtype=np.uint64)
        for column in self.samples(hashes, weights).reshape(BANDS, ROWS).T:
            out = mixed(out ^ column)
        return out.view(np.int64)


def idf(frequencies: np.ndarray, total: int) -> np.ndarray:
    """log(1 + 1 / (share + DAMPING)), where share is that of the documents that have a shingle of the slot."""
    return np.log1p(total / np.maximum(frequencies + DAMPING * total, 1.0))


def weights_of(plain: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = shingles(plain)
    return hashes, counts * idf[(hashes >> np.uint64(40)).astype(np.int64) % SLOTS]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: the sum of lesser over the sum of greater weights."""
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][x], b[1][y]).sum())
    total = float(a[1].sum() + b[1].sum()) - both
    return both / total if total else 1.0


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Documents by hashed shingle, and all documents with words: sums of one vector a task, in two steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total, n = np.zeros(SLOTS, np.int64), 0
        for batch in sliced(batches):
            for text in texts_of(batch.column("text")):
                if plain := plain_words(text):
                    n += 1
                    total[np.unique((shingles(plain)[0] >> np.uint64(40)).astype(np.int64) % SLOTS)] += 1
        if n:
            salt = int(mixed(np.array([n + int(total[:SLICE].sum())], np.uint64))[0] % np.uint64(SALTS))
            parts = [np.array([n]).tobytes(), *(part.tobytes() for part in total.reshape(-1, SLICE))]
            yield pa.record_batch({"slice": pa.array(range(-1, SLOTS // SLICE), pa.int32()), "salt": pa.array([salt] * len(parts), pa.int32()), "counts": pa.array(parts, pa.binary())})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        sums = sum(np.frombuffer(c, np.int64) for c in rows["counts"])
        return pd.DataFrame({"slice": [rows["slice"].iloc[0]], "counts": [sums.tobytes()]})

    parts = rows.select("text").mapInArrow(run, "slice int, salt int, counts binary")
    parts = parts.groupBy("slice", "salt").applyInPandas(add, "slice int, counts binary").groupBy("slice").applyInPandas(add, "slice int, counts binary")
    found = {r["slice"]: np.frombuffer(r["counts"], np.int64) for r in parts.collect()}  # SLOTS numbers
    if not found:
        return np.zeros(SLOTS, np.int64), 0
    return np.concatenate([found[i] for i in range(SLOTS // SLICE)]), int(found[-1][0])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): nodes that can be reached from each other share a root.

    Nodes have the order of a hash. Each round a node points to its first neighbour before it, and on to what
    that points to; edges then go between what is pointed to, and those within one node are dropped. So nodes
    and edges shrink by half or more in a round, however long a chain is, and a star takes two.
    """
    spread = F.col("a") != F.col("b")
    edges = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(spread).distinct())
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    first, place = True, F.xxhash64
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(place("b").alias("place"), F.col("b").alias("to"))).alias("m"))
        least = least.select(F.col("a").alias("v"), F.when(F.col("m.place") < place("a"), F.col("m.to")).otherwise(F.col("a")).alias("up"))
        above = least.select(F.col("v").alias("x"), F.col("up").alias("top"))
        points = settle(least.join(above, least["up"] == above["x"]).select("v", "top"))
        to_a, to_b = (points.select(F.col("v").alias(n), F.col("top").alias(f"{n}_top")) for n in "ab")
        moved = edges.join(to_a, "a").join(to_b, "b").select(F.least("a_top", "b_top").alias("a"), F.greatest("a_top", "b_top").alias("b"))
        edges = settle(moved.where(spread).distinct())
        if first:
            roots, first = points.toDF("node", "root"), False
        else:
            roots = roots.join(points, roots["root"] == points["v"], "left").select("node", F.coalesce("top", "root").alias("root"))
        tidy(edges.sparkSession)
    return roots


def texts_for(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs with the doc_ids of ids (one column), before anything of them is shuffled; all of docs where ids are too many to broadcast."""
    ids = settle(ids.toDF("wanted_").distinct())
    return docs.join(F.broadcast(ids), docs["doc_id"] == F.col("wanted_"), "left_semi") if ids.count() <= BROADCAST else docs


def verified(docs: DataFrame, pairs: DataFrame, shared, least: float) -> DataFrame:
    """Of pairs (a, b, a_doc, b_doc) those whose similarity reaches least. A doc_id only leads to its text."""
    docs = texts_for(docs, pairs.select("a_doc").union(pairs.select("b_doc")))
    left = docs.join(pairs, docs["doc_id"] == F.col("a_doc")).select("a", "b", "b_doc", F.col("text").alias("a_text"))
    right = pairs.select(F.col("b").alias("of"), F.col("b_doc").alias("of_doc")).distinct()
    heads = docs.join(right, docs["doc_id"] == F.col("of_doc")).select("of", "of_doc", F.col("text").alias("b_text"))
    both = left.join(heads, (F.col("b") == F.col("of")) & (F.col("b_doc") == F.col("of_doc"))).select("a", "b", "a_text", "b_text")

    def compare(columns, cache):
        found = []
        for a, b, x, y in zip(columns["a"].to_pylist(), columns["b"].to_pylist(), texts_of(columns["a_text"]), texts_of(columns["b_text"])):
            sides = []
            for node, text in ((a, x), (b, y)):
                if node not in cache:
                    if len(cache) >= 64:
                        cache.clear()
                    plain = plain_words(text)
                    cache[node] = weights_of(plain, shared.value) if name_of(plain) == node else None
                sides.append(cache[node])
            if None not in sides and similarity(*sides) >= least:
                found.append((a, b))
            for node, side in zip((a, b), sides):
                if side is None:
                    cache.pop(node, None)  # another text under the same doc_id
        return dict(zip(("a", "b"), zip(*found))) if found else None

    return map_rows(both, "a binary, b binary", compare, dict).distinct()


def links_in(sides: list[tuple[np.ndarray, np.ndarray]], part: np.ndarray, asked: Callable[[int], np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs of weighted sets whose similarity reaches least, enough of them to join all parts that such pairs join.

    Asked(i) says for each set if it is to be compared with the i-th; sets of one part need not be. Shingles are
    ordered by how many of the sets have them. Two sets with a similarity of least or more have so much weight in
    common that the first shingle of it is among the first of both, before the rest weighs less than least of the
    whole: only pairs that share one of these are weighed.
    """
    sizes = np.array([len(h) for h, _ in sides])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    _, ids, counts = np.unique(np.concatenate([h for h, _ in sides]), return_inverse=True, return_counts=True)
    weights = np.concatenate([w for _, w in sides])
    sums = np.array([w.sum() for _, w in sides])
    early, owner = [], []
    for i, (a, b) in enumerate(zip(starts, ends)):
        order = np.lexsort((ids[a:b], counts[ids[a:b]]))
        n = int(np.searchsorted(np.cumsum(weights[a:b][order]), (1 - least) * sums[i] * (1 + 1e-9), "right")) + 1
        early.append(ids[a:b][order[:n]])
        owner.append(np.full(len(early[-1]), i))
    keys, owners = np.concatenate(early), np.concatenate(owner)
    order = np.argsort(keys, kind="stable")
    owners, edges = owners[order], np.searchsorted(keys[order], np.arange(len(counts) + 1))
    own, found, part = np.zeros(len(counts)), [], part.copy()
    for i in range(len(sides) - 1):
        share = np.zeros(len(sides), bool)
        for k in early[i]:
            share[owners[edges[k] : edges[k + 1]]] = True
        share[: i + 1] = False
        near = np.flatnonzero(share & (part != part[i]) & asked(i) & (np.minimum(sums, sums[i]) >= least * (1 - 1e-9) * np.maximum(sums, sums[i])))
        if not len(near):
            continue
        own[ids[starts[i] : ends[i]]] = weights[starts[i] : ends[i]]
        at = np.concatenate([np.arange(starts[j], ends[j]) for j in near])
        both = np.add.reduceat(np.minimum(own[ids[at]], weights[at]), np.cumsum(sizes[near]) - sizes[near])
        own[ids[starts[i] : ends[i]]] = 0
        for j in near[both >= least * (sums[near] + sums[i] - both) * (1 - 1e-12)].tolist():
            if part[i] != part[j]:
                found.append((i, j))
                part[part == part[j]] = part[i]
    return found


def linked_inside(docs: DataFrame, inside: DataFrame, shared, least: float, block: int) -> DataFrame:
    """Links (a, b) between roots, from the pairs of different roots within buckets: inside has (band, n, node, rep, root, bands).

    A bucket of up to twice block members is one group. A larger one is dealt to blocks, each two of which meet in a group.
    """
    blocks = F.when(F.col("n") <= 2 * block, 1).otherwise(F.ceil(F.col("n") / block)).cast("int")
    dealt = inside.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    members = settle(dealt.select("band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "rep", "root", "bands"))
    rows = texts_for(docs, members.select("rep"))
    rows = rows.join(members, rows["doc_id"] == members["rep"]).select("band", "low", "high", "own", "node", "root", "bands", "text")

    key, kinds = ("band", "low", "high"), arrow_schema(docs.sparkSession, "a binary, b binary")

    def compare(band: int, within: bool, rows: list[dict]) -> list[tuple[int, int]]:
        known, members, sides = set(), [], []
        for row in rows:
            plain = plain_words((row["text"] or "").encode())
            if name_of(plain) == row["node"] and row["node"] not in known:  # a doc_id may have other texts too, or the same text again
                known.add(row["node"])
                members.append(row)
                sides.append(weights_of(plain, shared.value))
        if len({row["root"] for row in members}) < 2:
            return []
        bands, own = np.array([row["bands"] for row in members], np.int64), np.array([row["own"] for row in members])
        lane = int(np.flatnonzero(bands[0] == band)[0])

        def asked(i: int) -> np.ndarray:
            """In the first bucket that the two share; of two blocks, only across."""
            return ((bands == bands[i]).argmax(axis=1) == lane) & ((own != own[i]) | within)

        numbers: dict[bytes, int] = {}
        part = np.array([numbers.setdefault(row["root"], len(numbers)) for row in members])
        return [(members[i]["root"], members[j]["root"]) for i, j in links_in(sides, part, asked, least)]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in sliced(batches) for row in batch.to_pylist())
        for (band, low, high), group in groupby(rows, key=lambda row: tuple(row[k] for k in key)):
            if found := compare(band, low == high, list(group)):
                yield pa.record_batch([pa.array(c, type=kind) for c, kind in zip(zip(*found), kinds.types)], schema=kinds)

    return rows.repartition(*key).sortWithinPartitions(*key, "node").mapInArrow(groups, "a binary, b binary")


def near_classes(docs: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id) for each row of docs (doc_id, text; other columns are ignored).

    class_id is the least doc_id of the class; a document like no other is its own. Texts of equal words,
    the empty one too (null is empty), are copies. Texts of fewer than five words are alike only as copies.
    Repeated rows come out as often; a null doc_id belongs to no class and has a null class_id. An empty table
    gives no rows.
    """
    return classed(docs, least, block).select("doc_id", "class_id")


def classed(docs: DataFrame, least: float, block: int) -> DataFrame:
    """near_classes() with the node of each row's text and the root of its class."""
    rows = typed(docs, doc_id="long", text="string")
    shared = docs.sparkSession.sparkContext.broadcast(idf(*document_frequencies(rows)))

    def sample(columns, sampler):
        nodes, bands = [], []
        for text in texts_of(columns["text"]):
            plain = plain_words(text)
            nodes.append(name_of(plain))
            bands.append(sampler.bands(*weights_of(plain, sampler.idf)).tolist() if plain else [])
        return {"doc_id": columns["doc_id"], "node": nodes, "bands": bands}

    named = rows.where("doc_id is not null")
    sampled = settle(map_rows(named, "doc_id long, node binary, bands array<long>", sample, lambda: Sampler(shared.value)))
    tidy(docs.sparkSession)
    nodes = settle(sampled.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))

    # every member of a bucket against its head: the member that most others meet in their buckets
    members = nodes.select(F.explode("bands").alias("band"), "node", "rep")
    sizes = members.groupBy(F.col("band").alias("k")).agg(F.count("*").alias("n")).where("n > 1")
    crowd = settle(members.join(sizes, members["band"] == sizes["k"]).select("band", "node", "rep", "n"))
    met = crowd.groupBy(F.col("node").alias("m")).agg(F.sum("n").alias("met"))
    heads = crowd.join(met, crowd["node"] == met["m"]).groupBy(F.col("band").alias("k")).agg(F.min(F.struct((-F.col("met")).alias("less"), "node", "rep")).alias("head"))
    headed = crowd.join(heads, crowd["band"] == heads["k"]).where(F.col("node") != F.col("head.node"))
    pairs = headed.select(F.col("node").alias("a"), F.col("head.node").alias("b"), F.col("rep").alias("a_doc"), F.col("head.rep").alias("b_doc")).distinct()
    pairs = settle(pairs)
    tidy(docs.sparkSession)
    roots = settle(components(verified(named, pairs, shared, least)))

    # buckets that are still in several components: all pairs of different ones
    crowd = crowd.where("n > 2")
    rooted = crowd.join(roots.withColumnRenamed("node", "r"), F.col("node") == F.col("r"), "left").select("band", "n", "node", "rep", F.coalesce("root", "node").alias("root"))
    split = rooted.groupBy(F.col("band").alias("k")).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("k")
    inside = rooted.join(split, rooted["band"] == split["k"]).drop("k")
    inside = inside.join(nodes.select(F.col("node").alias("m"), "bands"), F.col("node") == F.col("m")).drop("m")
    merged = components(linked_inside(named, inside, shared, least, block)).toDF("part", "whole")

    placed = nodes.select("node", "rep").join(roots.withColumnRenamed("node", "r"), F.col("node") == F.col("r"), "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    placed = settle(placed.join(merged, placed["root"] == merged["part"], "left").select("node", "rep", F.coalesce("whole", "root").alias("root")))
    tidy(docs.sparkSession)
    classes = placed.groupBy(F.col("root").alias("g")).agg(F.min("rep").alias("class_id"))
    by_node = placed.join(classes, placed["root"] == classes["g"]).select(F.col("node").alias("m"), "root", "class_id")
    out = sampled.select("doc_id", "node").join(by_node, F.col("node") == F.col("m")).select("doc_id", "node", "root", "class_id")
    return out.unionByName(rows.where("doc_id is null").select("doc_id", *[F.lit(None).cast(k).alias(n) for n, k in (("node", "binary"), ("root", "binary"), ("class_id", "long"))]))


def keep_one(docs: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """The rows of docs without near copies: of each class the least doc_id stays, once. Rows without doc_id all stay.

    Where a doc_id is repeated, each of its rows goes by its own text. Other columns, whatever their names, stay as
    they are. An empty table stays empty.
    """
    named = settle(classed(docs, least, block).where("doc_id is not null"))
    ids = named.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("class_id").alias("class_id"))
    listed = settle(ids.where((F.col("n") > 1) | (F.col("doc_id") != F.col("class_id"))).select(F.col("doc_id").alias("listed"), (F.col("n") > 1).alias("again")))
    # the texts that stay are not shuffled: only the ids that do not simply stay are looked up
    out = docs.join(listed, docs["doc_id"].cast("long") == listed["listed"], "left_anti")
    several = listed.where("again").select("listed")
    if several.isEmpty():
        return out
    rows = docs.join(several, docs["doc_id"].cast("long") == several["listed"], "left_semi").select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def name(columns):
        return {"row": columns["row"], "doc_id": columns["doc_id"], "node": [name_of(plain_words(t)) for t in texts_of(columns["text"])]}

    rows = map_rows(rows, f"row {rows.schema['row'].dataType.simpleString()}, doc_id long, node binary", name)
    stay = named.where("doc_id = class_id").join(several, F.col("doc_id") == F.col("listed"), "left_semi").select(F.col("doc_id").alias("d"), F.col("node").alias("n"), "root").distinct()
    own = rows.join(stay, (F.col("doc_id") == F.col("d")) & (F.col("node") == F.col("n"))).dropDuplicates(["doc_id", "root"])
    return out.unionByName(own.select("row.*"))
