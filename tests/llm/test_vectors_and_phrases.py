"""Hard negatives, collocations and nearest neighbours, against loops over all pairs and all phrases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from colloquy.llm import collocations, hamming, negatives
from tests.conftest import SF

EMBEDDINGS = "note string, vec_id long, embedding array<float>, label int, rid int, score string"


def vectors(n, width=24, seed=5, cluster=0.3):
    """Rows of a table of vectors; a share of them near one another, some odd."""
    draw = np.random.default_rng(seed)
    middle = draw.standard_normal(width)
    rows = []
    for i in range(n):
        v = draw.standard_normal(width) * (0.02 if i % 10 < cluster * 10 else 0.4) + (middle if i % 10 < cluster * 10 else 0)
        rows.append(("x", i, [float(np.float32(x)) for x in v * (1 + i % 3)], int(draw.integers(0, 10)), 0, "y"))
    nan = float("nan")
    odd = [(None, 1000, None, 1, None, None), (None, 1100, [nan] * width, 1, None, None), (None, 1200, [None] + [0.5] * (width - 1), 2, None, None), (None, 1300, [math.inf] * width, 1, None, None)]
    odd += [(None, 1400, [0.0] * width, 3, None, None), (None, 1500, [], 3, None, None), (None, None, rows[1][2], 3, None, None), (None, 1600, rows[3][2], None, None, None)]
    return rows + odd + [rows[0], rows[0], rows[7], rows[20 % n]]


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def last(i):
    return (i is None, i or 0)


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute_negatives(rows):
    good = [(i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for _, i, v, label, *_ in rows if label is not None and finite(v)]
    out = []
    for at, (anchor, label, own) in enumerate(good):
        if anchor is None or anchor % 100:
            continue
        scores = [(-dot(own, v), last(i), i, k == label) for j, (i, k, v) in enumerate(good) if j != at]
        for p, _, positive, _ in sorted(s for s in scores if s[3])[:5]:
            fit = sorted(s for s in scores if not s[3] and 30 * -p <= 100 * -s[0] <= 90 * -p)
            out += [(anchor, positive, rank, s[2], -p, -s[0]) for rank, s in enumerate(fit[:10], 1)]
    return out


@pytest.mark.parametrize("chunk", [1, 16384])
def test_hard_negatives_against_all_pairs(spark, chunk):
    rows = vectors(420)
    found = [tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(rows, EMBEDDINGS).repartition(3), chunk).collect()]
    assert found and sorted(map(repr, found)) == sorted(map(repr, brute_negatives(rows)))


def test_products_by_planes():
    draw = np.random.default_rng(2)
    for width, high in ((1, 2), (64, 130), (70, 5), (130, 1 << 19)):
        values, own = draw.integers(-high, high, (50, width)), draw.integers(-high, high, width)
        anchor, seen = negatives.Anchor(own), []

        def may(low, up, exact=values @ own, seen=seen):
            assert (low <= exact).all() and (exact <= up).all()
            seen.append(float((up - low).max()))
            return np.ones(len(low), bool)

        places, scores = negatives.narrowed(negatives.Planes(values), anchor, np.arange(50), may)
        assert len(places) == 50 and (scores == values @ own).all() and seen[-1] == 0
        assert all(b <= a / 2 for a, b in zip(seen, seen[1:]))


def test_components_that_are_too_large_stop_the_run(spark):
    with pytest.raises(Exception, match="21 bits"):
        negatives.hard_negatives(spark.createDataFrame([("", 100, [5000.0], 1, 0, "")], EMBEDDINGS)).collect()


def brute_nearest(rows, first=20):
    good = [(i, v) for _, i, v, *_ in rows if finite(v) and any(v)]
    out = []
    for at, (query, own) in enumerate(good):
        if query is not None and query % 20 == 0:
            out.append((query, sorted((-dot(own, v), last(i), j) for j, (i, v) in enumerate(good) if j != at)[:first]))
    return out


@pytest.mark.parametrize("n, chunk", [(1200, 16384), (90, 2), (12, 16384)])
def test_nearest_recall_and_scores(spark, n, chunk):
    rows = vectors(n)
    found: dict = {}
    for r in hamming.nearest(spark.createDataFrame(rows, EMBEDDINGS).repartition(3), chunk).collect():
        found.setdefault(r["query_id"], []).append(r)
    by_id = {}
    for _, i, v, *_ in rows:
        if finite(v) and any(v):
            by_id.setdefault(i, v)
    wanted = brute_nearest(rows)
    assert set(found) == {q for q, _ in wanted}
    hits = total = 0
    for query, best in wanted:
        copies = sum(q == query for q, _ in wanted)
        got = sorted(found[query], key=lambda r: r["rank"])
        assert len(got) == copies * len(best)
        for r in got:
            assert r["score"] == pytest.approx(dot(by_id[query], by_id[r["vec_id"]]), rel=1e-12, abs=1e-12)
        assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)
        scores = sorted((-s for s, *_ in best), reverse=True)
        hits += sum(r["score"] >= scores[-1] - 1e-12 for r in got)
        total += len(got)
    assert hits / total >= 0.95


def test_nearest_of_the_table(spark):
    """Recall over the given vectors, which have hardly any neighbours: the worst case for codes."""
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [("", r["vec_id"], list(r["embedding"]), 0, 0, "") for r in table.collect()]
    found = {(r["query_id"], r["vec_id"]) for r in hamming.nearest(table, sample_rows=100).collect()}
    wanted = {(q, rows[j][1]) for q, best in brute_nearest(rows) for _, _, j in best}
    assert len(found) == len(wanted) and len(found & wanted) >= 0.9 * len(wanted)


def test_codes_within_a_radius():
    draw = np.random.default_rng(3)
    codes = draw.integers(0, 1 << 63, 300, dtype=np.uint64)
    codes[100:200] = codes[0] ^ (np.uint64(1) << draw.integers(0, 64, 100).astype(np.uint64))
    index = hamming.Index(codes)
    for radius in (0, 1, 3, 8, 17, 29, 40, 64):
        for own in codes[[0, 5, 150]]:
            assert (index.within(own, radius) == np.flatnonzero(np.bitwise_count(codes ^ own) <= radius)).all()


def test_no_vectors(spark):
    empty = spark.createDataFrame([], EMBEDDINGS)
    assert hamming.nearest(empty).collect() == [] and negatives.hard_negatives(empty).collect() == []
    assert hamming.nearest(spark.createDataFrame([("", 20, [1.0], 1, 0, "")], EMBEDDINGS)).collect() == []


def phrases_of(docs):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + size])) for size in (1, 2, 3) for i in range(len(words) - size + 1))
    return f, n


def brute_collocations(docs, first=2000):
    f, n = phrases_of(docs)
    often = {k: a for k, a in f.items() if a >= 10 and len(k[1]) > 1}
    gone = {(lang, p[j : j + m]) for (lang, p), a in often.items() for m in range(2, len(p)) for j in range(len(p) - m + 1) if 100 * a >= 50 * often.get((lang, p[j : j + m]), math.inf)}
    by_lang: dict = {}
    for (lang, p), a in often.items():
        if (lang, p) not in gone:
            cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            by_lang.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, rows in by_lang.items() for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:first], 1)]


def texts(seed=4, docs=150):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(25)] + ["Grün", "naïve", "New", "York", "日本", "a\xa0b", "x'y"]
    out = []
    for i in range(docs):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(0, 60))]
        text = "".join(w + draw.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "!"]) for w in words)
        out.append((text + " new YORK times" * draw.randint(0, 2), draw.choice(["en", "de", None, "und", ""])))
    return out + [(None, "en"), ("", None), (" \t\n.,", "en"), ("Same Line here\n" * 40, "fr"), ("a" * 5000, "xx"), ("and then " * 3000, "long")]


def test_collocations_against_all_phrases(spark):
    docs = texts()
    rows = [(i, text, lang, f"{i}", i, 0) for i, (text, lang) in enumerate(docs)]
    found = collocations.collocations(spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string, a int, size int").repartition(5))
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == sorted(brute_collocations(docs))
    few = collocations.collocations(spark.createDataFrame([(t, k) for t, k in docs], "text string, lang string"), first=3)
    assert sorted(map(tuple, few.collect())) == sorted(brute_collocations(docs, 3))


def test_no_documents(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).collect() == []


def test_scores_past_64_bits(spark):
    """a * a * SCALE and l * r of five billion occurrences need 90 and 66 bits."""
    a, left, right = 5_000_000_000, 7_000_000_011, 9_000_000_013
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").selectExpr(
        f"(cast({collocations.SCALE} as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0))) as s"
    )
    assert row.first()["s"] == collocations.SCALE * a * a // (left * right)


@pytest.mark.parametrize("size", [16, 40, 200])
def test_long_texts_in_portions(monkeypatch, size):
    """However a text is cut, each phrase is counted once."""
    monkeypatch.setattr(collocations, "CHUNK", size)
    docs = [t for t, _ in texts(9, 40)] + ["one two three four five six seven eight nine ten " * 30, "b" * 500 + " c d e", "x " * 300, "longer-than-a-portion-by-far " * 9]
    counted: Counter = Counter()
    for text, again in collocations.portions([(t or "").encode() for t in docs]):
        cut = collocations.Cut("en", text, again)
        for n in (1, 2, 3):
            counted.update(cut.phrase(int(k), n).decode() for k in cut.keys(cut.places(n), n))
    wanted = Counter({" ".join(p): n for (_, p), n in phrases_of([(t, "en") for t in docs])[0].items()})
    assert counted == wanted


def test_sketch_never_counts_too_little(spark):
    docs = spark.createDataFrame(texts(), "text string, lang string").fillna("und", ["lang"])
    cells = 1 << 16
    full = collocations.sketch(docs, cells, 4)
    f, _ = phrases_of(texts())
    for (lang, phrase), n in f.items():
        if n >= collocations.LEAST:
            cut = collocations.Cut(lang, " ".join(phrase).encode(), 0)
            for row, at in zip(full, collocations.cells_of(cut.grams(len(phrase)), cells)):
                assert (row[at[0] >> 3] >> (at[0] & 7)) & 1


def test_sql_of_collocations():
    import duckdb
    import pandas as pd

    docs = texts(6)
    with duckdb.connect() as connection:
        connection.register("documents", pd.DataFrame({"doc_id": range(len(docs)), "text": pd.array([t for t, _ in docs], "string"), "lang": pd.array([k for _, k in docs], "string")}))
        found = connection.sql(collocations.oracle_sql()).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").fetchall()
    assert found and sorted(found) == sorted(brute_collocations(docs))


def test_sql_of_hard_negatives():
    import duckdb
    import pyarrow as pa

    rows = [r for r in vectors(420)[:-4] if r[1] is not None and r[2] != []]  # its SQL looks rows up by vec_id and takes vectors of one length
    with duckdb.connect() as connection:
        connection.register("embeddings", pa.table({"vec_id": [r[1] for r in rows], "embedding": pa.array([r[2] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[3] for r in rows], pa.int32())}))
        found = connection.sql(negatives.oracle_sql()).fetchall()
    assert found and sorted(found) == sorted(brute_negatives(rows))
