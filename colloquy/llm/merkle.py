"""Document fingerprints: a Merkle tree over sections, paragraphs and the sentences in them.

A section is a run of lines up to and with the empty lines after it; a paragraph is a line; leaves are its
sentences, a long one cut at the first gap after LEAF bytes. A node's digest is that of its children's digests,
in order, up to the root, 128 bits each; so equal roots mean equal texts, and where roots differ only differing
branches need be followed.

As text: root, then for each section ``/digest``, for each of its paragraphs ``+digest`` and for each of
its leaves ``,digest.bytes``, in order; below the root the first SHOWN hex digits of each digest.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import arrow_schema, forget, partitions, sliced, typed

LEAF = 160
#: Hex digits of a node below the root as text.
SHOWN = 16
SENTENCE = re.compile(rb"[^.!?]{0,%d}[^.!?\x20]*(?:[.!?]+\x20?|\x20|\Z)" % LEAF)


def digest(kind: bytes, data: bytes) -> bytes:
    """Nodes of different kinds never have one digest."""
    return hashlib.blake2b(data, digest_size=16, person=kind).digest()


def paragraphs(text: bytes) -> Iterator[list[bytes]]:
    """Sections, each the list of its lines."""
    section: list[bytes] = []
    for line in text.split(b"\n"):
        if line and section and not section[-1]:
            yield section
            section = []
        section.append(line)
    yield section


def leaves(line: bytes) -> list[bytes]:
    return [m for m in SENTENCE.findall(line) if m]


def fingerprint(text: bytes) -> str:
    """The tree as text. It depends on nothing but the bytes."""
    shown, names = [], []
    for lines in paragraphs(text):
        below, of_lines = [], []
        for line in lines:
            parts = leaves(line)
            of_leaves = [digest(b"leaf", part) for part in parts]
            of_lines.append(digest(b"paragraph", b"".join(of_leaves)))
            below.append("+" + of_lines[-1].hex()[:SHOWN])
            below += [f",{d.hex()[:SHOWN]}.{len(part)}" for d, part in zip(of_leaves, parts)]
        names.append(digest(b"section", b"".join(of_lines)))
        shown += ["/" + names[-1].hex()[:SHOWN], *below]
    return digest(b"root", b"".join(names)).hex() + "".join(shown)


def branches(print_: str) -> dict:
    """Parsed: {"root", "size", "sections": [(digest, size, [(digest, size, [(digest, size)])])]}."""
    root, *sections = print_.split("/")
    out = []
    for section in sections:
        head, *nodes = section.split("+")
        below = []
        for node in nodes:
            name, *own = node.split(",")
            parts = [(d, int(n)) for d, n in (leaf.split(".") for leaf in own)]
            below.append((name, sum(n for _, n in parts), parts))
        out.append((head, sum(n for _, n, _ in below), below))
    return {"root": root, "size": sum(n for _, n, _ in out), "sections": out}


def unmatched(a: list, b: list) -> tuple[int, list, list]:
    """Bytes of nodes that both lists have, and the nodes that only one has, by digest and in order."""
    both = Counter((x[0], x[1]) for x in a) & Counter((x[0], x[1]) for x in b)
    shared = sum(key[1] * n for key, n in both.items())
    rest = []
    for nodes in (a, b):
        left, alone = Counter(both), []
        for x in nodes:
            if left[x[0], x[1]]:
                left[x[0], x[1]] -= 1
            else:
                alone.append(x)
        rest.append(alone)
    return shared, *rest


def likeness(a: dict, b: dict) -> float:
    """Twice the bytes under shared nodes over the bytes of both, descending only where nodes differ; 0 to 1."""
    if a["root"] == b["root"]:
        return 1.0
    total = a["size"] + b["size"]
    shared, x, y = unmatched(a["sections"], b["sections"])
    for _ in range(2):
        more, x, y = unmatched([n for s in x for n in s[2]], [n for s in y for n in s[2]])
        shared += more
    return 2 * shared / total if total else 1.0


def edits(a: str, b: str) -> list[tuple[str, int, int]]:
    """Where two texts differ: ("a" or "b", byte offset, bytes) of leaves that the other lacks; line ends count."""
    x, y = branches(a), branches(b)
    found = []
    for side, tree, other in (("a", x, y), ("b", y, x)):
        known, at = Counter(leaf for s in other["sections"] for p in s[2] for leaf in p[2]), 0
        for _, _, nodes in tree["sections"]:
            for _, _, parts in nodes:
                for leaf in parts:
                    if known[leaf]:
                        known[leaf] -= 1
                    else:
                        found.append((side, at, leaf[1]))
                    at += leaf[1]
                at += 1
    return found


def edited(text: str, following: str) -> str:
    """The last third of the code points gives way to the start of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


PRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbour_prints(docs: DataFrame) -> DataFrame:
    """Fingerprint each text, its edited text and the likeness to the next document's (PRINTS).

    Next is by descending doc_id, the first after the last. Documents are dealt to contiguous ranges of
    doc_id, and each range also gets a copy of the document that follows it, so texts are shuffled once and
    no task sees more than its range. Ties of doc_id follow the text's order; a null doc_id comes last; null
    texts are empty. A single document is its own next one; an empty table gives no rows.
    """
    rows = typed(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    wanted = 4 * partitions(docs.sparkSession)
    cuts = np.array(sorted(set(rows.approxQuantile("doc_id", [i / wanted for i in range(1, wanted)], 0.25 / wanted))), np.float64)  # one number a range

    # looked up by bisection, so that thousands of ranges cost no more; only the ids go to Python
    @F.pandas_udf("int")
    def range_of(doc: pd.Series) -> pd.Series:
        # larger ids come first: range 0 is above the last cut, and ids that are null have the last one
        return pd.Series(np.where(doc.isna(), len(cuts) + 1, len(cuts) - np.searchsorted(cuts, doc.fillna(0).to_numpy(np.float64), "left"))).astype("int32")

    rows = rows.withColumn("range", range_of("doc_id"))
    tops = {r["range"]: r["top"] for r in rows.groupBy("range").agg(F.max("doc_id").alias("top")).collect()}  # one row a range
    if not tops:
        return docs.sparkSession.createDataFrame([], PRINTS)
    order = sorted(tops)
    # the document that heads a range also follows the last of the range before it, the first of all follows the last of all
    before = {r: order[i - 1] for i, r in enumerate(order)}
    heads_of = {(r, t): before[r] for r, t in tops.items() if t is not None}

    @F.pandas_udf("int")
    def copied_to(range_: pd.Series, doc: pd.Series) -> pd.Series:
        return pd.Series([heads_of.get((r, None if pd.isna(d) else int(d)), -1) for r, d in zip(range_, doc)], dtype="int32")

    heads = rows.where("doc_id is not null").withColumn("to", copied_to("range", "doc_id")).where("to >= 0")
    copies = heads.select("doc_id", "text", F.col("to").alias("range"))
    if any(t is None for t in tops.values()):
        # of the range without ids only the first text is needed
        lone = rows.where("doc_id is null").agg(F.min("text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(before[order[-1]]).alias("range"))
        copies = copies.unionByName(lone)
    copies = copies.withColumn("copy", F.lit(1))
    dealt = rows.withColumn("copy", F.lit(0)).unionByName(copies).repartition(partitions(docs.sparkSession), "range")
    dealt = dealt.sortWithinPartitions("range", "copy", F.col("doc_id").desc_nulls_last(), "text")
    schema = arrow_schema(docs.sparkSession, PRINTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        last, out = None, []
        for batch in sliced(batches, 500):
            for doc, text, range_, copy in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "range", "copy"))):
                if copy and (last is None or last[2] != range_):
                    continue  # a later tie of the document that follows
                data = text.encode()
                print_ = fingerprint(data)
                now = (doc, text, range_, print_, branches(print_))
                if last is not None and last[2] == range_:
                    out.append(row(last, now))
                last = None if copy else now
            if out:
                yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []

    return dealt.mapInArrow(run, PRINTS)


def row(own: tuple, following: tuple) -> tuple:
    changed = edited(own[1], following[1])
    data = changed.encode()
    print_ = fingerprint(data)
    return own[0], len(own[1]), hashlib.sha256(data).hexdigest(), own[3], print_, likeness(own[4], branches(print_)), likeness(own[4], following[4])
