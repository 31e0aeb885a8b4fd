import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import automata
from colloquy.llm.secrets import BASE, MORE, Scanner, digest_spans, redact, secret_spans

SCANNER = Scanner(BASE + MORE)
PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)),
    ("access", re.compile("AKIA[A-Z0-9]+")),
    ("hex", re.compile("[0-9a-f]+")),
]
BITS = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", '"', "'", " ", "=", ":", "abc", "0123456789abcdef", "AKIA", "ZZ9", "é", "x.y", "-", "==", "\n", "a" * 16, "ABCDEFGHIJKLMN", "_", "eyJ", "ghp_"]


def brute(text):
    found = []
    for i, (kind, pattern) in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            if (kind == "assign" and len(m[2]) >= 12) or (kind == "access" and len(m[0]) >= 18) or (kind == "hex" and len(m[0]) >= 16):
                found.append((m.start(), i, m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(found)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=30))
def test_base_rules_against_regular_expressions(bits):
    text = "".join(bits)
    base = {r.kind for r in BASE}
    assert [s for s in SCANNER.spans([text.encode()])[0] if s[2] in base] == brute(text)


def test_other_kinds():
    text = "x ghp_" + "a1" * 20 + " -----BEGIN RSA PRIVATE KEY----- xoxb-" + "1" * 20
    assert [k for _, _, k in SCANNER.spans([text.encode()])[0]] == ["github", "hex", "private_key", "slack", "hex"]


def test_automaton_is_minimal_and_right():
    auto = automata.compile_rules([automata.parse("(a|b)*abb")], anywhere=False)
    assert len(auto.accepts) == 5  # four of the language and the dead one
    draw = random.Random(1)
    for _ in range(300):
        word = "".join(draw.choices("abc", k=draw.randint(0, 9)))
        longest = max((i for i in range(len(word) + 1) if re.fullmatch("(a|b)*abb", word[:i])), default=-1)
        assert auto.longest(word.encode(), 0) == longest


def test_spans_and_digests(spark):
    rows = [(1, "é token = abcdefghijkl AKIA" + "Z" * 14, 9), (2, None, 9), (3, "", 9), (1, "0123456789abcdef" * 2, 9), (None, "plain", 9)]
    found = digest_spans(secret_spans(spark.createDataFrame(rows, "doc_id long, text string, spans int")))
    got = {(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"]): r for r in found.collect()}
    assert set(got) == {(1, 1, 1, 0), (2, 0, 0, 0), (3, 0, 0, 0), (1, 0, 0, 1), (None, 0, 0, 0)}
    row = got[1, 1, 1, 0]
    assert row["spans"] == "assign:2:22,access:23:41"
    assert row["base_sha256"] == hashlib.sha256(row["spans"].encode()).hexdigest()
    assert got[2, 0, 0, 0]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_redaction_keeps_documents(spark):
    docs = spark.createDataFrame([(1, "a token=abcdefghijkl b", 21, "s"), (2, "clean", 5, "s"), (3, None, 0, "s")], "doc_id long, text string, n_chars long, source string")
    got = {r["doc_id"]: r for r in redact(docs).collect()}
    assert got[1]["text"] == "a [assign] b" and got[1]["n_chars"] == 12
    assert got[2]["text"] == "clean" and got[3]["text"] is None


def test_empty(spark):
    assert secret_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_runs():
    text = b"f" * 100_000 + b" token: " + b"x" * 50
    assert SCANNER.spans([text, b"", text])[2] == [(0, 100_000, "hex"), (100_001, 100_058, "assign")]


def test_redaction_of_odd_rows(spark):
    """Null and clean texts keep their n_chars, whatever it says; other columns and repeated rows stay; no rows give none."""
    schema = "doc_id long, text string, n_chars int, spans string, kind int"
    rows = [(1, None, 0, "x", 1), (2, "", 7, None, 2), (None, "clean", 99, "y", None), (3, "password=abcdefghijkl1 x", 24, "z", 3), (3, "password=abcdefghijkl1 x", 24, "z", 3)]
    got = [tuple(r) for r in redact(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got, key=repr) == sorted([*rows[:3], *[(3, "[assign] x", 10, "z", 3)] * 2], key=repr)
    assert redact(spark.createDataFrame([], schema)).collect() == [] and redact(spark.createDataFrame([], schema)).columns == ["doc_id", "text", "n_chars", "spans", "kind"]
