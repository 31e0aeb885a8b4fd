"""The exact substring operators against brute force, with small windows and every way through them."""

import hashlib
import random

import pytest

from colloquy.llm import superkmers
from colloquy.llm.parsing import drop_repeated_bytes
from colloquy.llm.superkmers import drop_repeats

SCHEMA = "doc_id long, text string, source string, dk string, found int, key string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "s", "x", 1, "k") for d, t in rows], SCHEMA)


def some_rows(seed, words=60, docs=60):
    draw = random.Random(seed)
    bits = [f"w{i}" for i in range(words)]
    passages = [" ".join(draw.choices(bits, k=30)) for _ in range(4)]
    rows = []
    for i in range(docs):
        parts = [" ".join(draw.choices(bits, k=draw.randint(0, 40))) for _ in range(3)]
        if draw.random() < 0.6:
            parts.insert(draw.randint(0, 3), draw.choice(passages))
        rows.append((i, draw.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(docs, rows[3][1]), (docs + 1, rows[3][1]), (docs + 2, None), (docs + 3, ""), (docs + 4, "é ü " * 40), (docs + 5, "é ü " * 41), (docs + 6, "a" * 300), (docs + 7, "b\x00" * 90)]
    return rows


def brute_words(rows, window):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, words in split:
        for j in range(len(words) - window + 1):
            key = b" ".join(words[j : j + window])
            if d is not None:
                first[key] = min(d, first.get(key, d))
    out = []
    for d, words in split:
        gone = [False] * len(words)
        for j in range(len(words) - window + 1):
            if d is not None and first[b" ".join(words[j : j + window])] < d:
                gone[j : j + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((d, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def brute_bytes(rows, window):
    counts = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for _, t in texts:
        for j in range(len(t) - window + 1):
            counts[t[j : j + window]] = counts.get(t[j : j + window], 0) + 1
    out = []
    for d, t in texts:
        gone = [False] * len(t)
        for j in range(len(t) - window + 1):
            if counts[t[j : j + window]] > 1:
                gone[j : j + window] = [True] * window
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,window,hot", [(1, 12, 20_000), (2, 12, 1), (3, 5, 3)])
def test_words(spark, seed, window, hot):
    rows = some_rows(seed)
    got = drop_repeats(table(spark, rows), window=window, hot=hot).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_words(rows, window)


def test_words_of_repeated_and_nameless_rows(spark):
    text = " ".join(f"u{i}" for i in range(20))
    rows = [(1, text), (1, text), (1, text + " more"), (None, text), (2, text), (5, text), (0, "short")]
    got = drop_repeats(table(spark, rows), window=6).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_words(rows, 6)


@pytest.mark.parametrize("window", [1, 2, 5, 12])
def test_late_windows_against_all_strings(window):
    draw = random.Random(window)
    rows = [(draw.randint(0, 9), 100 + i, " ".join(draw.choices("abc", k=draw.randint(0, 30))).encode()) for i in range(40)]
    at = {r: [rows[r][2].split()[i : i + window] for i in range(len(rows[r][2].split()) - window + 1)] for r in range(len(rows))}
    least = {}
    for r, windows in at.items():
        for w in windows:
            least[tuple(w)] = min(rows[r][0], least.get(tuple(w), 99))
    want = [(rows[r][0], rows[r][1], late) for r, windows in at.items() if (late := [i for i, w in enumerate(windows) if least[tuple(w)] < rows[r][0]])]
    assert list(superkmers.late_windows(rows, window)) == want
    assert list(superkmers.late_windows([], window)) == []


@pytest.mark.parametrize("together", [1, 300])
def test_words_of_buckets_sorted_in_turn(spark, monkeypatch, together):
    monkeypatch.setattr(superkmers, "TOGETHER", together)
    rows = some_rows(4)
    got = drop_repeats(table(spark, rows), window=8).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_words(rows, 8)


def test_words_that_stay_can_be_had(spark):
    text = " ".join(f"u{i}" for i in range(8))
    got = {r["doc_id"]: r["kept"] for r in drop_repeats(table(spark, [(1, text), (2, "a  b\n" + text + "\tc")]), window=6, texts=True).collect()}
    assert got == {1: text, 2: "a b c"}


@pytest.mark.parametrize("seed,window,hot", [(1, 40, 20_000), (2, 40, 1), (3, 33, 4)])
def test_bytes(spark, seed, window, hot):
    rows = some_rows(seed)
    got = drop_repeated_bytes(table(spark, rows), window=window, trigger=8, hot=hot).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_bytes(rows, window)


def test_bytes_of_repeated_and_nameless_rows(spark):
    text = "".join(chr(97 + i * 7 % 26) for i in range(60))
    rows = [(1, text), (1, text), (1, "x" + text), (None, text), (None, "other" * 3), (2, "zz" + text[:45])]
    got = drop_repeated_bytes(table(spark, rows), window=40, trigger=8).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_bytes(rows, 40)


def test_a_window_repeated_in_one_text_only(spark):
    part = "".join(chr(97 + i * 11 % 26) for i in range(50))
    rows = [(1, part + "-" + part), (2, "nothing to see here, nothing at all to see")]
    got = drop_repeated_bytes(table(spark, rows), window=40, trigger=8, spans=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute_bytes(rows, 40)
    assert [tuple(s) for s in {r["doc_id"]: r for r in got}[1]["removed"]] == [(0, 50), (51, 101)]


def test_stretches_of_a_long_text(monkeypatch):
    from colloquy.llm import parsing

    draw = random.Random(5)
    text = "".join(draw.choices("abcd ", k=5000)).encode()
    whole = parsing.Parse([text], 40, 8)
    monkeypatch.setattr(parsing, "STRETCH", 512)
    cut = parsing.Parse([text], 40, 8)
    windows = lambda p: {(int(a), i) for a, lo, hi in zip(p.at, p.low, p.high) for i in range(lo, hi + 1)}
    assert windows(whole) == windows(cut)
    assert len({i for _, i in windows(whole)}) == len(text) - 39


@pytest.mark.parametrize("operator", [drop_repeats, drop_repeated_bytes])
def test_empty(spark, operator):
    assert operator(table(spark, [])).collect() == []
    assert len(operator(table(spark, [(None, None), (1, None)])).collect()) == 2
