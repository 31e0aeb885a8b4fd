"""Regular expressions over bytes to one minimal deterministic automaton.

Syntax: literals, ``\\xNN`` and escaped marks, ``[...]`` and ``[^...]`` with ranges, ``(...)``, ``|`` and the
repeats ``? * + {m} {m,} {m,n}``. That is enough for detection rules and has no hidden cost: what is
compiled is a table, and matching is one look-up a byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: A tree: ("set", frozenset of bytes) | ("cat", parts) | ("alt", parts) | ("rep", part, least, most or None)
Tree = tuple


def parse(pattern: str, fold: bool = False) -> Tree:
    """fold: ASCII letters in either case."""
    at = 0

    def peek() -> str:
        return pattern[at : at + 1]

    def code() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "\\":
            c = pattern[at]
            at += 1
            if c == "x":
                at += 2
                return int(pattern[at - 2 : at], 16)
        if ord(c) > 127:
            raise ValueError("rules are ASCII")
        return ord(c)

    def both(codes: set[int]) -> frozenset[int]:
        return frozenset(codes | {ord(chr(c).swapcase()) for c in codes if fold and chr(c).isalpha() and c < 128})

    def one() -> Tree:
        nonlocal at
        if peek() == "(":
            at += 1
            inner = either()
            at += 1
            return inner
        if peek() == "[":
            at += 1
            negated = peek() == "^"
            at += negated
            codes: set[int] = set()
            while peek() != "]":
                low = high = code()
                if peek() == "-" and pattern[at + 1] != "]":
                    at += 1
                    high = code()
                codes |= set(range(low, high + 1))
            at += 1
            codes = set(both(codes))
            return ("set", frozenset(set(range(256)) - codes if negated else codes))
        return ("set", both({code()}))

    def repeated() -> Tree:
        nonlocal at
        node = one()
        while peek() and peek() in "?*+{":
            mark = peek()
            at += 1
            if mark == "{":
                bounds, _, _ = pattern[at:].partition("}")
                at += len(bounds) + 1
                low, comma, high = bounds.partition(",")
                node = ("rep", node, int(low), int(high) if high else None if comma else int(low))
            else:
                node = ("rep", node, int(mark == "+"), 1 if mark == "?" else None)
        return node

    def sequence() -> Tree:
        parts = []
        while peek() and peek() not in "|)":
            parts.append(repeated())
        return ("cat", parts)

    def either() -> Tree:
        nonlocal at
        parts = [sequence()]
        while peek() == "|":
            at += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    tree = either()
    if at != len(pattern):
        raise ValueError(f"can't read the rule from {at}: {pattern!r}")
    return tree


def reverse(tree: Tree) -> Tree:
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return (kind, reverse(tree[1]), *tree[2:])
    parts = [reverse(x) for x in tree[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


@dataclass
class Automaton:
    """table[state * width + kinds[byte]] is the next state times width; accepts[state] has a bit for each rule.

    State 0 is where a text begins; the kind width - 1 stands for no byte and leads to it. dead: the state
    that nothing leaves, or -1.
    """

    kinds: np.ndarray
    width: int
    table: np.ndarray
    accepts: np.ndarray
    dead: int

    def longest(self, data: bytes, start: int) -> int:
        """End of the longest match of an anchored automaton that begins at start; -1 if none does."""
        table, kinds, width, accepts = self.lists()
        state, end = 0, -1
        if accepts[0]:
            end = start
        for at in range(start, len(data)):
            state = table[state + kinds[data[at]]]
            if state == self.dead:
                break
            if accepts[state // width]:
                end = at + 1
        return end

    def lists(self):
        if not hasattr(self, "_lists"):
            self._lists = self.table.tolist(), self.kinds.tolist(), self.width, self.accepts.tolist()
        return self._lists


def compile_rules(trees: list[Tree], anywhere: bool) -> Automaton:
    """Subset construction over all rules at once, then minimisation. anywhere: a match may begin at any byte."""
    edges: list[list[tuple[frozenset[int] | None, int]]] = []

    def state() -> int:
        edges.append([])
        return len(edges) - 1

    def build(tree: Tree, start: int) -> int:
        kind = tree[0]
        if kind == "set":
            end = state()
            edges[start].append((tree[1], end))
        elif kind == "cat":
            end = start
            for part in tree[1]:
                end = build(part, end)
        elif kind == "alt":
            end = state()
            for part in tree[1]:
                begin = state()
                edges[start].append((None, begin))
                edges[build(part, begin)].append((None, end))
        else:
            _, part, least, most = tree
            end = start
            for _ in range(least):
                end = build(part, end)
            if most is None:
                loop, after = state(), state()
                edges[end] += [(None, loop), (None, after)]
                edges[build(part, loop)] += [(None, loop), (None, after)]
                end = after
            else:
                exits = [end]
                for _ in range(most - least):
                    end = build(part, end)
                    exits.append(end)
                end = state()
                for x in exits:
                    edges[x].append((None, end))
        return end

    root = state()
    finals = {}
    for rule, tree in enumerate(trees):
        begin = state()
        edges[root].append((None, begin))
        finals[build(tree, begin)] = rule

    # bytes that no set tells apart are one kind
    marks = np.zeros(256, np.int64)
    for wanted in {s for out in edges for s, _ in out if s is not None}:
        inside = np.isin(np.arange(256), list(wanted))
        marks = np.unique(marks * 2 + inside, return_inverse=True)[1]
    n_kinds = int(marks.max()) + 1
    sample = [int(np.flatnonzero(marks == k)[0]) for k in range(n_kinds)]

    def closure(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for wanted, to in edges[todo.pop()]:
                if wanted is None and to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(x for x in seen if x in finals or any(w is not None for w, _ in edges[x]))

    first = closure({root})
    numbers, todo, rows = {first: 0}, [first], []
    while todo:
        now = todo.pop(0)
        row = []
        for byte in sample:
            to = closure({t for x in now for w, t in edges[x] if w is not None and byte in w} | ({root} if anywhere else set()))
            if to not in numbers:
                numbers[to] = len(numbers)
                todo.append(to)
            row.append(numbers[to])
        rows.append(row)
    accepts = np.array([sum(1 << r for r in {finals[x] for x in s if x in finals}) for s in numbers], np.int64)
    return minimal(np.array(rows), accepts, marks, n_kinds)


def minimal(rows: np.ndarray, accepts: np.ndarray, kinds: np.ndarray, n_kinds: int) -> Automaton:
    """Merge states that no input tells apart: split classes until their successors' classes agree."""
    group = np.unique(accepts, return_inverse=True)[1]
    while True:
        signs = np.column_stack([group, group[rows]])
        finer = np.unique(signs, axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    # the first state is 0, then in order of first appearance
    order: dict[int, int] = {}
    for g in group.tolist():
        order.setdefault(g, len(order))
    to = np.array([order[g] for g in range(len(order))])
    pick = np.array([int(np.flatnonzero(group == g)[0]) for g, _ in sorted(order.items(), key=lambda x: x[1])])
    width = n_kinds + 1
    table = np.zeros((len(order), width), np.int32)
    table[:, :-1] = to[group[rows[pick]]] * width
    dead = [s for s in range(len(order)) if not accepts[pick[s]] and (table[s, :-1] == s * width).all()]
    return Automaton(kinds.astype(np.int32), width, table.ravel(), accepts[pick], dead[0] * width if dead else -1)
