"""Importance resampling, near-duplicates, url filters and the pipeline."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from colloquy.llm import importance, urls, weighted
from tests.conftest import SF


def words(draw, n, kind="w"):
    return " ".join(f"{kind}{draw.randint(0, 300)}" for _ in range(n))


def labelled(spark, docs=200):
    draw = random.Random(1)
    rows = [(i, words(draw, draw.randint(30, 80), "w" if i % 4 else "junk"), i) for i in range(docs)] + [(docs, None, 1), (docs + 1, "", 1), (None, "w1 w2", 1), (5, words(draw, 40), 1), (5, words(draw, 40), 1)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(0, docs, 2)] + [(None, 1, 0), (7, None, None), (2, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, key int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_resampling_separates(spark):
    docs, labels = labelled(spark)
    got = {r["doc_id"] for r in importance.resample(docs, labels).collect()}
    clean, junk = {i for i in range(200) if i % 4}, {i for i in range(200) if not i % 4}
    assert len(clean & got) >= 0.97 * len(clean) and len(junk & got) <= 0.1 * len(junk)
    kept = importance.keep_drawn(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == got


def test_models_and_keys_against_brute_force(spark):
    docs, labels = labelled(spark)
    counts = np.zeros(importance.SLOTS, np.int64)
    for row in docs.collect():
        np.add.at(counts, importance.slots((row["text"] or "").encode()).astype(int), 1)
    assert (importance.slot_counts(docs) == counts).all()
    model, bound = importance.selected(docs, labels)
    rows = importance.weighed(docs.select("doc_id", "text"), model).collect()
    texts = [(r["text"] or "").encode() for r in docs.collect()]
    assert sorted(r["log_weight"] for r in rows) == pytest.approx(sorted(model.weigh(t) for t in texts))
    good = sum(model.weigh(t) >= model.limit for t in texts)
    keys = sorted((r["key"] for r in rows), reverse=True)
    assert sum(k >= bound for k in keys) >= good and sum(k > keys[good - 1] + 1e-9 for k in keys) < good
    assert keys[good] < bound <= keys[good - 1]


def test_weights_from_their_definition(spark):
    """Counts of words and pairs in dictionaries, the ratio of two models, toxic peaks, limits of held-out text, noise."""
    for start in range(50):  # words and pairs that share no slot, so that dictionaries say the same
        vocabulary = [f"{kind}{start}x{i}" for kind, n in (("good", 4), ("junk", 4), ("vile", 2)) for i in range(n)]
        every = [s for w in vocabulary for s in importance.slots(w.encode())] + [importance.slots(f"{a} {b}".encode())[2] for a in vocabulary for b in vocabulary]
        if len(set(every)) == len(every):
            break
    draw, rows = random.Random(6), []
    for i in range(600):
        odds = (8, 1) if i % 5 else (1, 8)
        text = draw.choices(vocabulary[:8], [odds[0]] * 4 + [odds[1]] * 4, k=draw.randint(1, 60))
        text += draw.choices(vocabulary[8:], k=draw.randint(1, 3)) if i % 9 == 0 else []
        rows.append((i, " ".join(text)))
    rows += [rows[3], rows[3], (None, "unseen"), (600, None)]
    labels = {i: (int(i % 5 > 0), int(i % 9 == 0)) for i in range(0, 600, 2)}
    ids = spark.createDataFrame([(i,) for i in labels], "l long").selectExpr("l", f"xxhash64({importance.SEED}, l) % 2 = 0 AS held").collect()
    held, texts = {r["l"]: r["held"] for r in ids}, {i: (text or "").split() for i, text in rows if i is not None}
    grams = lambda words: [*words, *zip(words, words[1:])]
    is_good, is_bad, is_toxic = ({i for i, (q, t) in labels.items() if test(q, t)} for test in (lambda q, t: q and not t, lambda q, t: not q, lambda q, t: t))
    raw = Counter(g for _, text in rows for g in grams((text or "").split()))
    # a doc_id that repeats is labelled with each of its rows
    times = Counter(i for i, _ in rows)
    target, checked = (Counter(g for i in is_good if held[i] == side for g in grams(texts[i]) * times[i]) for side in (False, True))
    size, aim = raw.total(), target.total()

    def ratio(gram):
        share = (raw[gram] + 1 / importance.SLOTS) / (size + 1)
        return math.log(0.75 * target[gram] / aim + 0.25 * share) - math.log(share)

    mean = sum(n * ratio(g) for g, n in checked.items()) / checked.total()
    clean, vile = ({i for i in kind - other if not held[i]} for kind, other in ((is_good, is_toxic), (is_toxic, is_good)))
    with_word = lambda kind, w: sum(times[i] for i in kind if w in texts[i])
    n_clean, n_vile = (sum(times[i] for i in kind) for kind in (clean, vile))
    tells = {w: max(0.0, math.log((with_word(vile, w) + 0.5) / (n_vile + 1)) - math.log((with_word(clean, w) + 0.5) / (n_clean + 1))) if with_word(vile, w) else 0.0 for w in vocabulary}

    def scores(words):
        found = [ratio(g) for g in grams(words)]
        peaks = sorted((tells.get(w, 0.0) for w in set(words)), reverse=True)
        return [(sum(found) - mean * len(found)) / (len(found) + 20) ** 0.75, *(-sum(peaks[:k]) for k in (1, 2, 3))]

    of = lambda kind: np.array([scores(texts[i]) for i in kind if held[i] for _ in range(times[i])])
    good, least = of(is_good), []
    for at in range(4):
        low, high = np.quantile(good[:, at], 0.005), np.quantile(of(is_toxic if at else is_bad)[:, at], 0.995)
        least.append((low + high) / 2 if high < low else low)
    least[0] = min(0.0, least[0])
    weight = lambda words: 10 * min((x - low) / max(sd, 1e-6) for x, low, sd in zip(scores(words), least, good.std(axis=0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    judged = spark.createDataFrame([(i, *x) for i, x in labels.items()], "doc_id long, quality int, toxic int")
    model, bound = importance.selected(docs, judged)
    found = importance.weighed(docs, model).collect()
    wanted = {i: weight(words) for i, words in texts.items()}
    for r in found:
        if r["doc_id"] is not None:
            assert r["log_weight"] == pytest.approx(wanted[r["doc_id"]], rel=2e-4, abs=2e-3)
    noise = np.array([r["key"] - r["log_weight"] for r in found])
    assert abs(noise.mean() - 0.5772) < 0.2 and abs(noise.std() - math.pi / 6**0.5) < 0.2
    k = sum(r["log_weight"] >= 0 for r in found)
    largest = sorted((r["key"] for r in found), reverse=True)[:k]
    assert sorted((r["key"] for r in importance.resample(docs, judged).collect()), reverse=True)[:k] == pytest.approx(largest)
    # what is drawn leaves out most of the rejected and hardly any of the good
    drawn = {r["doc_id"] for r in found if r["key"] >= bound}
    assert len({i for i in range(600) if i % 9 == 0} & drawn) <= 4 and len({i for i in range(600) if i % 5 and i % 9} & drawn) >= 400


def test_kth_largest(spark):
    values = [float(x) for x in [5, 5, 5, 1, 2, -3, 9, 9]]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in range(1, 9):
        # ties of the k-th all count
        assert [v for v in values if v >= importance.kth_largest(keys, k)] == [v for v in values if v >= sorted(values, reverse=True)[k - 1]]
    assert importance.kth_largest(keys, 0) == float("inf")


def test_no_labels_keep_all_and_no_documents(spark):
    docs, labels = labelled(spark, 20)
    assert importance.resample(docs, labels.limit(0)).count() == docs.count()
    assert importance.resample(docs.limit(0), labels).collect() == []


def near_rows():
    draw = random.Random(2)
    rows, doc = [], 0
    for _ in range(25):
        base = words(draw, 120).split()
        for _ in range(draw.randint(1, 5)):
            text = list(base)
            for _ in range(draw.randint(0, 3)):
                text[draw.randrange(len(text))] = f"z{draw.randint(0, 9999)}"
            rows.append((doc, " ".join(text)))
            doc += 1
    hub = words(draw, 150).split()
    for _ in range(30):  # a large group whose members are near its centre and less near to each other
        text = list(hub)
        for at in draw.sample(range(150), 4):
            text[at] = f"y{draw.randint(0, 9999)}"
        rows.append((doc, " ".join(text)))
        doc += 1
    rows += [(doc, "one two"), (doc + 1, "one  two"), (doc + 2, "one three"), (doc + 3, ""), (doc + 4, None), (None, rows[0][1]), (1, rows[1][1])]
    draw.shuffle(rows)
    return rows


def brute_classes(rows, least=0.8):
    """Classes by all pairs, from word tuples and their exact document frequencies: no code of the operator."""
    split = [tuple((t or "").split(" ")) for _, t in rows]
    split = [tuple(w for w in s if w) for s in split]
    sets = [Counter(s[i : i + 5] for i in range(max(1, len(s) - 4))) if s else Counter() for s in split]
    n = sum(map(bool, split))
    df = Counter(x for one in sets for x in one)
    weighed = [{x: k * math.log(1 + 1 / (df[x] / n + 0.2)) for x, k in one.items()} for one in sets]

    def alike(a, b):
        both = sum(min(w, b[x]) for x, w in a.items() if x in b)
        return both >= least * (sum(a.values()) + sum(b.values()) - both)

    named = [i for i, (d, _) in enumerate(rows) if d is not None]
    group = {i: i for i in named}
    for i in named:
        for j in named:
            if i < j and group[i] != group[j] and (split[i] == split[j] or (split[i] and split[j] and alike(weighed[i], weighed[j]))):
                a, b = group[i], group[j]
                group = {k: a if g == b else g for k, g in group.items()}
    low = {}
    for i in named:
        low[group[i]] = min(low.get(group[i], 10**9), rows[i][0])
    return sorted([(rows[i][0], low[group[i]]) for i in named] + [(None, None) for d, _ in rows if d is None], key=repr)


@pytest.mark.parametrize("block", [1000, 8])
def test_near_classes(spark, block):
    rows = near_rows()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, node int")
    got = sorted((tuple(r) for r in weighted.near_classes(docs, block=block).collect()), key=repr)
    assert got == brute_classes(rows)


def test_one_of_each_class_stays(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, node int, listed int, again int")
    kept = weighted.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted({c for _, c in brute_classes(rows)}, key=repr)
    assert weighted.near_classes(docs.limit(0)).collect() == [] and weighted.keep_one(docs.limit(0)).collect() == []


def test_components(spark):
    draw = random.Random(9)
    edges = [(draw.randint(0, 150), draw.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(280, 330)] + [(-5, -5)]
    group = {x: x for e in edges for x in e if e[0] != e[1]}
    for a, b in edges:
        if a != b and group[a] != group[b]:
            old, new = group[a], group[b]
            group = {k: new if g == old else g for k, g in group.items()}
    got = {r["node"]: r["root"] for r in weighted.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == set(group)
    assert len({(got[x], group[x]) for x in group}) == len(set(group.values())) == len(set(got.values()))
    assert weighted.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_links_in_a_group_against_all_pairs():
    draw = np.random.default_rng(3)
    for _ in range(40):
        base = draw.choice(2000, 60, replace=False)
        sides = []
        for _ in range(25):
            own = np.unique(np.where(draw.random(60) < draw.choice([0.02, 0.1, 0.3]), draw.integers(2000, 4000, 60), base))
            sides.append((own.astype(np.uint64), np.round(1 + draw.random(4000), 3)[own] if draw.random() < 0.1 else 1 + (own % 7) / 3))
        part = np.arange(25)
        got = weighted.links_in(sides, part, lambda i: np.ones(25, bool), 0.8)
        want, have = list(range(25)), list(range(25))
        for i in range(25):
            for j in range(i):
                x, y = (dict(zip(*map(np.ndarray.tolist, sides[k]))) for k in (i, j))
                both = sum(min(w, y.get(k, 0)) for k, w in x.items())
                if both >= 0.8 * (sum(x.values()) + sum(y.values()) - both):
                    want = [want[i] if k == want[j] else k for k in want]
        for i, j in got:
            have = [have[i] if k == have[j] else k for k in have]
        assert len(set(zip(want, have))) == len(set(want)) == len(set(have))


def test_samples_agree_as_often_as_sets_are_alike():
    draw = np.random.default_rng(0)
    sampler = weighted.Sampler(np.ones(weighted.SLOTS))
    for share in (0.5, 0.8):
        off = []
        for _ in range(20):
            hashes = np.unique(draw.integers(0, 1 << 63, 400).astype(np.uint64))
            weights, cut = np.exp(draw.random(len(hashes))), int(len(hashes) * (1 - share) / (1 + share))
            a, b = (hashes[:-cut], weights[:-cut]), (hashes[cut:], weights[cut:])
            alike = np.mean(sampler.samples(*a) == sampler.samples(*b))
            off.append(alike - weighted.similarity(a, b))
        assert abs(np.mean(off)) < 0.03


def test_url_parts_and_rules(spark):
    rows = [
        (1, "https://A.Example.COM/en/1?x#y", "a.example.com", "/en/1", "com/en/", "block"), (2, "http://example.com/en/7", "example.com", "/en/7", "example.com/en/7", "allow"),
        (3, "x://net/de/8", "net", "/de/8", "net/de/", "allow"), (4, "x://www.example.net/de/80#a?b", "www.example.net", "/de/80", "example.net/de/8", "block"), (5, "ftp://o.org/es/", "o.org", "/es/", "org/es/", "block"),
        (6, "http://notcom/en/", "notcom", "/en/", None, None), (7, None, "", "", None, None), (8, "no scheme", "", "", None, None), (9, "http://h?q/en/", "h", "", None, None), (10, "a://b://c/en/", "b:", "//c/en/", None, None),
        (11, "http://É.com/en/é", "É.com", "/en/é", "com/en/", "block"), (11, "http://x.com/en", "x.com", "/en", None, None), (None, "", "", "", None, None),
    ]
    pages = spark.createDataFrame([(r[0], r[1], "h") for r in rows], "page_id long, url string, host string")
    got = [tuple(r) for r in urls.judge_urls(pages).drop("score").collect()]
    assert sorted((r[:4] for r in got), key=repr) == sorted(((r[0], *r[2:5]) for r in rows), key=repr)
    assert {r[4] for r in got} <= {"allow", "block"}
    for row in rows:
        assert row[5] is None or (row[0], row[2], row[3], row[4], row[5]) in got
    assert urls.judge_urls(pages.limit(0)).collect() == []


def test_url_model_learns(spark):
    good, bad = [f"http://garden{i}.net/de/rose/{i}" for i in range(40)], [f"http://casino{i}.com/en/win/{i}" for i in range(40)]
    other = ["http://garden.info/rose/tulip", "http://casino.biz/win/big"]
    pages = spark.createDataFrame(list(enumerate(good + bad + other)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages).collect()}
    assert got[80] == "allow" and got[81] == "block"


def model_of_loops(counted: dict[str, int], symbols: int):
    """The likelihood of a gram's last character, by recursion over counts of (url with marks: times)."""
    seen: dict[str, dict[str, int]] = {}
    for text, times in counted.items():
        for i in range(urls.ORDERS, len(text)):
            for size in range(urls.ORDERS + 1):
                after = seen.setdefault(text[i - size : i], {})
                after[text[i]] = after.get(text[i], 0) + times

    def likelihood(context: str, character: str) -> float:
        shorter = likelihood(context[1:], character) if context else 1 / symbols
        after = seen.get(context, {})
        return (after.get(character, 0) + len(after) * shorter) / (sum(after.values()) + len(after)) if after else shorter

    return likelihood


@pytest.mark.parametrize("shares", [1, 7, urls.SHARES])
def test_url_scores_against_loops(spark, shares):
    """Drawn urls, many repeated, with characters of one to four bytes, against recursive models; tables of common keys of all sizes."""
    drawn = np.random.default_rng(5)
    word = lambda: "".join(drawn.choice(list("ab7_%Aé字🙂^"), drawn.integers(0, 5)))
    found = [f"x://{word()}{host}{path}{word()}" for host, path in [(".net", "/de/"), (".com", "/en/"), (".info", "/fr/")] for _ in range(30)]
    found += ["x://a.net/de/"] * 40 + [None, "", "x://", "x://" + "long.org/es/" * 300]
    pages = spark.createDataFrame(list(enumerate(found)), "page_id long, url string")
    rows = urls.judge_urls(pages, shares=shares).collect()
    assert sorted(r["page_id"] for r in rows) == list(range(len(found)))
    held = lambda text: hashlib.md5(text.encode()).hexdigest() < urls.HELD
    marked = lambda text: urls.START * urls.ORDERS + text + urls.END
    ruled, learnt = {r["host"] + r["path"]: r["verdict"] for r in rows if r["rule"]}, {"allow": {}, "block": {}}
    for r in rows:
        if r["rule"] and not held(text := r["host"] + r["path"]):
            learnt[r["verdict"]][marked(text)] = learnt[r["verdict"]].get(marked(text), 0) + 1
    symbols = len({c for kind in learnt.values() for text in kind for c in text[urls.ORDERS :]}) + 1
    allow, block = (model_of_loops(learnt[kind], symbols) for kind in ("allow", "block"))
    for r in rows:
        text = marked(r["host"] + r["path"])
        ratios = [np.log(allow(text[i - urls.ORDERS : i], text[i])) - np.log(block(text[i - urls.ORDERS : i], text[i])) for i in range(urls.ORDERS, len(text))]
        assert r["score"] == pytest.approx(np.mean(ratios), abs=1e-9)
    out = {kind: [r["score"] for r in rows if r["rule"] and r["verdict"] == kind and held(r["host"] + r["path"])] for kind in learnt}
    assert out["allow"] and out["block"] and ruled
    spread = {kind: np.std(out[kind]) for kind in out}
    limit = (np.mean(out["allow"]) * spread["block"] + np.mean(out["block"]) * spread["allow"]) / (spread["allow"] + spread["block"])
    for r in rows:
        if not r["rule"] and abs(r["score"] - limit) > 1e-9:
            assert r["verdict"] == ("allow" if r["score"] >= limit else "block")


def test_urls_that_differ_in_a_digit_or_script_score_apart(spark):
    found = [f"http://a{i}.net/de/{i}" for i in range(20)] + [f"http://b{i}.com/en/{i}" for i in range(20)]
    pages = spark.createDataFrame(list(enumerate([*found, "http://q/1", "http://q/8", "http://q/_", "http://q/字"])), "page_id long, url string")
    scores = [r["score"] for r in urls.judge_urls(pages).where("page_id >= 40").collect()]
    assert len(set(scores)) >= 3


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, held = docs, {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SF)
        after.write.parquet(f"{tmp_path}/{number}")
        after = spark.read.parquet(f"{tmp_path}/{number}")
        held[name] = after
        if number < 4:
            assert after.columns == docs.columns
        if number == 0:
            kept = {r["doc_id"] for r in importance.resample(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
            assert {r["doc_id"] for r in after.collect()} == kept
        if number == 1:
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert sorted(r["doc_id"] for r in after.collect()) == sorted({c for _, c in brute_classes(rows)})
        if number == 2:
            assert after.count() == before.count()
        before = after
    packed = held["best-fit packing"].collect()
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in held["mixing sources"].collect()}
    pieces = lambda rows: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert pieces(corpus_pipeline.run(spark, SF).collect()) == pieces(packed)


def test_short_junk_is_judged_like_long_junk(spark):
    draw = random.Random(3)
    rows = []
    for i in range(450):  # good text has up to half of its words in common with junk, which moves long sums far
        share = 1 if i % 5 == 0 else draw.random() / 2
        rows.append((i, " ".join(draw.choice("qrstuvwxyz" if draw.random() < share else "abcdefghij") * 2 for _ in range((80, 150, 1500)[i % 3]))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, 450, 2)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"] for r in importance.resample(docs, labels).collect()}
    for size in range(3):
        junk, clean = ({i for i in range(size, 450, 3) if (i % 5 == 0) == bad} for bad in (True, False))
        assert len(junk & got) <= 0.1 * len(junk) and len(clean & got) >= 0.95 * len(clean)


def test_toxic_text_goes(spark):
    draw = random.Random(4)
    insults, rows = ["zounds", "knave", "churl", "wretch"], []
    for i in range(400):
        text = words(draw, draw.choice([15, 60, 400])).split()
        for _ in range(draw.randint(1, 3) if i % 8 == 0 else 0):
            text.insert(draw.randrange(len(text)), draw.choice(insults) + draw.choice(["", ".", ","]))
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(400) if i % 16 < 11], "doc_id long, quality int, toxic int")
    got = {r["doc_id"] for r in importance.resample(docs, labels).collect()}
    toxic, clean = {i for i in range(400) if i % 8 == 0}, {i for i in range(400) if i % 8}
    assert len(toxic & got) <= 0.1 * len(toxic) and len(clean & got) >= 0.97 * len(clean)


def test_rows_of_a_repeated_doc_id_go_by_their_own_text(spark):
    draw = random.Random(5)
    a, b, c = (words(draw, 40) for _ in range(3))
    rows = [(1, a, 1), (2, a, 2), (2, b, 3), (2, b, 4), (3, c, 5), (3, a, 6), (4, b, 7)]
    kept = [(r["doc_id"], r["text"]) for r in weighted.keep_one(spark.createDataFrame(rows, "doc_id long, text string, key int")).collect()]
    assert sorted(kept) == sorted([(1, a), (2, b), (3, c)])


def test_names_of_texts_are_wide():
    """128 bits: what is equal in the first 64 is still told apart."""
    names = {weighted.name_of(f"text {i}".encode()) for i in range(2000)}
    assert len(names) == 2000 and all(isinstance(n, bytes) and len(n) == 16 for n in names)


def test_nodes_that_share_half_a_name_are_two(spark):
    a, b, c = b"x" * 8 + b"1" * 8, b"x" * 8 + b"2" * 8, b"x" * 8 + b"2" * 7 + b"\0"
    edges = spark.createDataFrame([(bytearray(a), bytearray(b))], "a binary, b binary")
    roots = {bytes(r["node"]): bytes(r["root"]) for r in weighted.components(edges).collect()}
    assert set(roots) == {a, b} and len(set(roots.values())) == 1 and c not in roots
