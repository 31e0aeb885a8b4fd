"""Secret scans by one combined deterministic automaton.

All rules, reversed, are compiled into a single minimal automaton. It reads every text once, from its last
byte to its first, and so marks each byte where a match of some rule begins. From the leftmost mark on, the
rule's own automaton gives the longest match; the next one begins at or after its end. Texts advance side
by side, a byte of each with every step, so the pass is array look-ups. Rules must be such that a regular
expression engine's first match from a place is also the longest, which holds for these.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import automata
from colloquy.llm.common import map_rows, texts_of, typed


@dataclass(frozen=True)
class Rule:
    """A match counts if it, or what follows its head, has least characters. fold: letters in either case."""

    kind: str
    pattern: str
    least: int = 0
    head: str | None = None
    fold: bool = False


ASSIGN_HEAD = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: Fixed by contract, listed in the order of ties.
BASE = (
    Rule("assign", ASSIGN_HEAD + r"[A-Za-z0-9+/_.=\-]+", 12, ASSIGN_HEAD, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    # a run of these is matched whole, so its least length can be part of the pattern
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
#: What the operator finds besides.
MORE = (
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", 30),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9\-]+", 20),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("google", r"AIza[A-Za-z0-9_\-]+", 39),
    Rule("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)
#: Steps between looks at which texts have ended.
STEPS = 256


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        trees = [automata.parse(r.pattern, r.fold) for r in rules]
        self.rules = rules
        self.starts = automata.compile_rules([automata.reverse(t) for t in trees], anywhere=True)
        self.whole = [automata.compile_rules([t], anywhere=False) for t in trees]
        self.heads = [automata.compile_rules([automata.parse(r.head, r.fold)], anywhere=False) if r.head else None for r in rules]

    def marks(self, texts: list[bytes]) -> dict[int, list[tuple[int, int]]]:
        """For texts where matches may begin: (byte, rules as bits), by falling byte."""
        auto, lengths = self.starts, np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        falling = lengths[order]
        data = auto.kinds[np.frombuffer(b"".join(texts) + b"\0", np.uint8)]
        ends = np.cumsum(lengths)[order]
        none, accepts = auto.width - 1, auto.accepts
        hot = np.zeros(len(auto.accepts), bool)
        hot[accepts > 0] = True
        state, found = np.zeros(len(texts), np.int32), {}
        for base in range(0, int(falling[0]) if len(texts) else 0, STEPS):
            n = int(np.searchsorted(-falling, -base, "left"))
            steps = np.arange(base, min(base + STEPS, int(falling[0])))[:, None]
            kinds = data[np.maximum(ends[:n] - 1 - steps, 0)]
            kinds[steps >= falling[:n]] = none
            state = state[:n]
            seen = np.empty((len(steps), n), np.int32)
            for j, kind in enumerate(kinds):
                state = auto.table.take(state + kind, out=seen[j], mode="clip")
            at = seen // auto.width
            for j, lane in zip(*np.nonzero(hot[at])):
                found.setdefault(int(order[lane]), []).append((int(falling[lane]) - 1 - base - int(j), int(accepts[at[j, lane]])))
        return found

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, str]]]:
        """For each text: (start, end, kind) in code points, by start and then as the rules are listed."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for i, marks in self.marks(texts).items():
            text, free, found = texts[i], [0] * len(self.rules), []
            for at, bits in reversed(marks):
                for r, rule in enumerate(self.rules):
                    if bits >> r & 1 and at >= free[r]:
                        end = free[r] = self.whole[r].longest(text, at)
                        body = self.heads[r].longest(text, at) if rule.head else at
                        if end - body >= rule.least:
                            found.append((at, r, end))
            found.sort()
            plain = text.isascii()
            out[i] = [(a, b, self.rules[r].kind) if plain else (len(text[:a].decode()), len(text[:b].decode()), self.rules[r].kind) for a, r, b in found]
        return out


@functools.lru_cache(4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """Compiled once for each worker process."""
    return Scanner(rules)


SPANS = "array<struct<kind string, start int, end int>>"


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """(doc_id, spans): what the rules find in the text, code points, end exclusive, by start and then rule.

    Rows stay one to one; null text is empty and has no spans; other columns are ignored.
    """

    def find(columns):
        spans = scanner(rules).spans(texts_of(columns["text"]))
        return {"doc_id": columns["doc_id"], "spans": [[{"kind": k, "start": a, "end": b} for a, b, k in s] for s in spans]}

    return map_rows(typed(docs, doc_id="long", text="string"), f"doc_id long, spans {SPANS}", find)


def digest_spans(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Counts of the base kinds, and a digest of their spans, from secret_spans()."""
    kinds = [r.kind for r in base]
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    own = F.filter("spans", lambda s: s["kind"].isin(kinds))
    return found.select("doc_id", *map(count, kinds), F.sha2(text(own), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """docs with every span in text replaced by ``[kind]``; overlapping spans go as one, under the first's name.

    n_chars, if there, becomes the new length of a text that changes. Rows without spans, those of a null or empty text too, stay as they
    are, as do all other columns, null ids and repeated rows. An empty table stays empty.
    """
    lengths = "n_chars" in docs.columns

    def clean(columns):
        values, texts, changed = columns["text"].to_pylist(), texts_of(columns["text"]), []
        for i, spans in enumerate(scanner(rules).spans(texts)):
            if spans:
                text, out, at = values[i], [], 0
                for a, b, kind in spans:
                    if a >= at:
                        out += [text[at:a], f"[{kind}]"]
                    at = max(at, b)
                values[i] = "".join(out) + text[at:]
                changed.append(i)
        out = {**columns, "text": values}
        if lengths and changed:
            own, as_text = columns["n_chars"].to_pylist(), pa.types.is_string(columns["n_chars"].type)
            for i in changed:
                own[i] = str(len(values[i])) if as_text else len(values[i])
            out["n_chars"] = own
        return out

    named = docs.withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema)
    return map_rows(named, schema, clean)


def sql_pattern(pattern: str, fold: bool) -> str:
    """The pattern with both cases of each letter outside its classes, where fold says so; as an SQL string."""
    both = re.sub(r"\\x20|\[[^]]*\]|[a-z]", lambda m: m[0] if len(m[0]) > 1 else f"[{m[0]}{m[0].upper()}]", pattern) if fold else pattern
    return "'" + both.replace("'", "''") + "'"


def oracle_sql(rules: tuple[Rule, ...] = BASE + MORE, base: tuple[Rule, ...] = BASE) -> str:
    """DuckDB SQL for digest_spans() of secret_spans() of documents: each rule by a regular expression, places by what lies between its matches."""
    found = " UNION ALL ".join(
        f"SELECT r, {n} AS k, '{rule.kind}' AS kind, regexp_extract_all(t, {(p := sql_pattern(rule.pattern, rule.fold))}) AS m, string_split_regex(t, {p}) AS b,"
        f" {rule.least} AS least, {sql_pattern('^' + rule.head, rule.fold) if rule.head else "''"} AS head FROM d"
        for n, rule in enumerate(rules)
    )
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{rule.kind}') AS n_{rule.kind}" for rule in base)
    span = "kind || ':' || s || ':' || e, ',' ORDER BY s, k"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
g AS (SELECT r, k, kind, m[i] AS w, least, head, list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM f)),
h AS (SELECT r, k, kind, s, s + length(w) AS e FROM g WHERE length(w) - length(regexp_extract(w, head)) >= least),
a AS (SELECT r, {counts}, string_agg({span}) FILTER (WHERE k < {len(base)}) AS own, string_agg({span}) AS spans FROM h GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{rule.kind}, 0) AS n_{rule.kind}" for rule in base)}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON a.r = d.r"""
