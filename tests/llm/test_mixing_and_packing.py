import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from colloquy.llm import mixing, packing


def brute_targets(sizes, weights, repeats=3):
    capped = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        if not free:
            return [repeats * s for s in sizes]
        left = sum(sizes) - sum(repeats * sizes[i] for i in capped)
        unit = left / sum(weights[i] for i in free)
        over = {i for i in free if weights[i] * unit > repeats * sizes[i]}
        if not over:
            return [repeats * sizes[i] if i in capped else weights[i] * unit for i in range(len(sizes))]
        capped |= over


def test_targets():
    draw = random.Random(3)
    for _ in range(200):
        sizes = [draw.choice([0, 1, 5, 50, 500]) for _ in range(draw.randint(1, 7))]
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        assert mixing.target_sizes(sizes, weights) == pytest.approx(brute_targets(sizes, weights))


def reachable(lengths, counts, budget):
    sums = {0}
    for size, n in zip(lengths, counts):
        sums = {s + size * k for s in sums for k in range(n + 1)}
    return max(s for s in sums if s <= budget)


def test_budgets_are_fitted_as_well_as_can_be(monkeypatch):
    draw = random.Random(4)
    for _ in range(150):
        lengths = np.array(sorted(draw.sample(range(1, 40), 4)))
        counts = np.array([draw.randint(1, 4) for _ in lengths])
        budget = draw.randint(0, int((lengths * counts).sum()) + 3)
        took = mixing.fit_budget(lengths, counts, budget, 1)
        assert (took >= 0).all() and (took <= counts).all()
        total = int((took * lengths).sum())
        assert total <= budget and reachable(lengths, counts, budget) - total <= max(lengths)
    monkeypatch.setattr(mixing, "FITTED", 50)
    lengths, counts = np.arange(1, 60), np.full(59, 9)
    assert int((mixing.fit_budget(lengths, counts, 7001, 1) * lengths).sum()) == 7001


def corpus(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, source string, text string, size int, slot string")


def some_docs():
    draw = random.Random(6)
    rows = [(i, draw.choice(["b", "a", "Z", None, "é"]), "w " * draw.choice([0, 1, 2, 3, 7, 30])) for i in range(300)]
    return rows + [(7, "a", "w w w"), (7, "a", "w w w"), (None, "a", "w w"), (400, "a", None)]


@pytest.mark.parametrize("ranked", [20_000, 5])
def test_mix(spark, monkeypatch, ranked):
    monkeypatch.setattr(mixing, "RANKED", ranked)
    rows = some_docs()
    got = [r.asDict() for r in mixing.taken_words(corpus(spark, rows)).collect()]
    again = [r.asDict() for r in mixing.taken_words(corpus(spark, rows[::-1])).collect()]
    order = lambda rs: sorted(map(repr, rs))
    assert order(got) == order(again) and len(got) == len(rows)
    names = sorted({r[1] for r in rows if r[1]}, key=lambda s: s.encode()) + [None]
    sizes = [sum(len((t or "").split()) for _, s, t in rows if s == n) for n in names]
    targets = brute_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    by_size = {}
    for r in got:
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        by_size.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
    assert {k: None for k in by_size} == {(s, round(t, 6)): None for s, t in zip(sizes, targets)}
    for (_, target), taken in by_size.items():
        assert abs(sum(taken) - target) <= 1.5


@pytest.mark.parametrize("ranked", [20_000, 5])
def test_mixed_documents(spark, monkeypatch, ranked):
    monkeypatch.setattr(mixing, "RANKED", ranked)
    draw = random.Random(8)
    rows = some_docs()
    rows += [(i, draw.choice("ab"), "v " * draw.randint(1, 9)) for i in range(500, 520) for _ in range(2)]  # ids of two sources
    rows += [(None, s, "u " * draw.randint(1, 9)) for s in "ab" * 20] + [(600, "a", "z z z z")] * 30
    docs = corpus(spark, rows).withColumnsRenamed({"slot": "times", "size": "row"})
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    got = [(r["doc_id"], r["source"], r["text"]) for r in got.collect()]
    granted = {}
    for r in mixing.taken_words(docs).collect():
        granted.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
    names = {n for _, n, _ in rows}
    for name in names:
        size = sum(len((t or "").split()) for _, s, t in rows if s == name)
        mixed = sum(len((t or "").split()) for _, s, t in got if s == name)
        assert mixed in {sum(t) for (s, _), t in granted.items() if s == size}
    had, has = Counter(rows), Counter(got)
    assert set(has) <= set(had) and all(has[r] <= 3 * had[r] for r in has)
    assert all(has[r] == had[r] for r in had if not (r[2] or "").split())
    assert mixing.mix(docs.limit(0)).collect() == []


def test_no_documents(spark):
    assert mixing.taken_words(corpus(spark, [])).collect() == []
    assert [r["taken"] for r in mixing.taken_words(corpus(spark, [(1, None, None)])).collect()] == [0]


def test_sum_of_squares_places_as_defined():
    draw = random.Random(2)
    size = 12
    lengths = [draw.randint(1, size) for _ in range(300)]
    where, offset = packing.sum_of_squares(lengths, size)
    fill = {}
    for at, off, n in zip(where.tolist(), offset.tolist(), lengths):
        squares = lambda f: sum(c * c for c in np.bincount([size - x for x in f.values() if x < size], minlength=size + 1))
        best = min(squares({**fill, k: fill.get(k, 0) + n}) for k in [*fill, -1] if fill.get(k, 0) + n <= size)
        assert off == fill.get(at, 0)
        fill[at] = off + n
        assert squares(fill) == best
    assert max(fill.values()) <= size


@pytest.mark.parametrize("group", [25_000, 7])
def test_packing_round_trip(spark, group):
    texts = ["Hello, World! it's 42 o'clock.", "", None, "Thndea$$$ of. the,", "ΑΣ ΣΑΣ İstanbul", "a <|endoftext|> B", "e\u0301te\u0301 \u00a0x\u2003y\x1cz", "word " * 150, "  lead\n\n\ttail  ", "x" * 5000, "...,,,", "ﬁ ½ 漢字 한국어 🎉!"]
    rows = [(i, t, 5) for i, t in enumerate(texts * 3)] + [(3, texts[3], 5), (None, "no id", 5)]
    got = packing.best_fit_pack(spark.createDataFrame(rows, "doc_id long, text string, length int"), sequence=64, group=group).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    wanted = []
    for doc, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 64)):
            part = ids[start : start + 64]
            wanted.append((doc, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(wanted, key=repr)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    if group > 1000:
        assert len(places) <= 1.1 * -(-sum(r["length"] for r in got) // 64) + 1


def test_words_are_forgotten_in_time(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_BYTES", 2000)
    cache = packing.WordCache(packing.tokenizer_path())
    texts = [f"alpha{chr(97 + i)} beta{chr(97 + i)}, gamma. {'long' * 90}" for i in range(26)] * 40
    most = 0
    for text, ids in zip(texts, cache.ids(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == cache.tokenizer.encode(text, add_special_tokens=False).ids
        most = max(most, cache.size)
    assert len(cache) < 200 and most < 40_000 and not any(len(c) > packing.LONG for c in cache)


def test_ids_of_odd_texts():
    """Marks that combine, case that depends on neighbours, other scripts, spaces and special tokens, side by side."""
    draw = random.Random(11)
    bits = list("JjHhTtWwYyAaIiSs kK.,'!0") + ["\u030c", "\u0331", "\u0308", "\u030a", "\u0301", "\u0307", "Σ", "ς", "İ", "ı", "ß", "ẞ", "ﬁ", "Å", "é", "É", "漢", "ก็", "🎉", "\u200d", "\u00a0", "\u2003", "\x0b", "\x1c", "\x85", "\t", "\n", "<|endoftext|>", "<|", "n't", "'S", "½", "Ǆ", "ǆ", "\u1e96", "\u0345", "\x00"]
    texts = ["".join(draw.choices(bits, k=draw.randint(1, 12))) for _ in range(10_000)]
    cache = packing.WordCache(packing.tokenizer_path())
    for text, ids, want in zip(texts, cache.ids(texts), cache.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text


def test_nothing_to_pack(spark):
    assert packing.best_fit_pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_equal_rows_fill_all_groups_alike(spark):
    """Sixty thousand rows that are equal in every column: no group gets more than its share."""
    docs = spark.range(60_000).selectExpr("cast(null as long) as doc_id", "'' as text")
    rows = packing.best_fit_pack(docs, group=10_000).selectExpr("sequence_id % 6 as g", "length").groupBy("g").count().collect()
    assert len(rows) == 6 and sum(r["count"] for r in rows) == 60_000 and max(r["count"] for r in rows) < 11_000
