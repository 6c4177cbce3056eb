"""Grammars over token symbols, with bracket groups reduced to one symbol.

Notation: ``rule = a b | c``; ``'x'`` is a token; ``P.ctx``, ``S.ctx``, ``B.ctx``, ``I.ctx`` are a reduced group in
round, square, curly brackets or an indented block whose content must match ``ctx``; ``< >`` groups; ``?``, ``*``,
``+`` repeat; ``&x`` and ``!x`` look ahead; ``.`` is any token. Choice is ordered.

Two things are derived from a grammar: a matcher for the content of one group (a *unit*), which also tells the
context of every group below it, and the set of token pairs that may stand side by side in a file.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict

OPEN = {"P": "(", "S": "[", "B": "{", "I": "INDENT"}
CLOSE = {"P": ")", "S": "]", "B": "}", "I": "DEDENT"}
START, END = "<start>", "<end>"
WILD = "any"  # the context of groups that hold any tokens, such as the arguments of a macro


def _parse(text: str) -> dict[str, tuple]:
    rules: dict[str, tuple] = {}
    for name, body in re.findall(r"^(\w+) *=((?:.*\n)(?:[ \t]+.*\n)*)", text, re.M):
        toks = re.findall(r"'[^'\s]+'|[PSBI]\.\w+|\w+|[<>|?*+&!.]", body)
        pos = 0

        def alt():
            nonlocal pos
            options = [seq()]
            while pos < len(toks) and toks[pos] == "|":
                pos += 1
                options.append(seq())
            return options[0] if len(options) == 1 else ("alt", options)

        def seq():
            items = []
            while pos < len(toks) and toks[pos] not in ("|", ">"):
                items.append(item())
            return items[0] if len(items) == 1 else ("seq", items)

        def item():
            nonlocal pos
            t = toks[pos]
            pos += 1
            if t in "&!":
                return ("look" if t == "&" else "not", item())
            if t == "<":
                node = alt()
                assert toks[pos] == ">", (name, toks[pos:])
                pos += 1
            elif t[0] == "'":
                node = ("tok", t[1:-1])
            elif t[1:2] == ".":
                node = ("grp", t[0], t[2:])
            elif t == ".":
                node = ("any",)
            else:
                node = ("ref", t)
            while pos < len(toks) and toks[pos] in "?*+":
                node = ({"?": "opt", "*": "star", "+": "plus"}[toks[pos]], node)
                pos += 1
            return node

        rules[name] = alt()
        assert pos == len(toks), (name, toks[pos:])
    return rules


class Grammar:
    """root: context of the file; first: context of its first unit, if other."""

    def __init__(self, text: str, root: str, first: str | None = None):
        self.rules, self.root, self.first = _parse(text), root, first or root
        self.tokens: frozenset[str] = frozenset()
        self._fn: dict[str, object] = {}
        for name in self.rules:
            self._fn[name] = self._ref(name)

    # -- matching ------------------------------------------------------------------------------------------
    def _ref(self, name: str):
        body: list = []

        def run(toks, i, memo):
            key = (name, i)
            got = memo.get(key)
            if got is None:
                if not body:
                    body.append(self._compile(self.rules[name]))
                got = memo[key] = body[0](toks, i, memo)
            return got

        return run

    def _compile(self, node):
        kind = node[0]
        fail = (-1, ())
        if kind == "tok":
            want = node[1]
            return lambda toks, i, memo: (i + 1, ()) if toks[i] == want else fail
        if kind == "any":
            return lambda toks, i, memo: (i + 1, ()) if toks[i] != END else fail
        if kind == "grp":
            want, ctx = OPEN[node[1]], node[2]
            return lambda toks, i, memo: (i + 1, ((i, ctx),)) if toks[i] == want else fail
        if kind == "ref":
            return self._ref(node[1]) if node[1] not in self._fn else self._fn[node[1]]
        if kind == "seq":
            parts = [self._compile(x) for x in node[1]]

            def seq(toks, i, memo):
                kids = ()
                for p in parts:
                    i, k = p(toks, i, memo)
                    if i < 0:
                        return fail
                    if k:
                        kids += k
                return i, kids

            return seq
        if kind == "alt":
            if all(x[0] == "tok" for x in node[1]):
                wants = frozenset(x[1] for x in node[1])
                return lambda toks, i, memo: (i + 1, ()) if toks[i] in wants else fail
            parts = [self._compile(x) for x in node[1]]

            def alt(toks, i, memo):
                for p in parts:
                    got = p(toks, i, memo)
                    if got[0] >= 0:
                        return got
                return fail

            return alt
        one = self._compile(node[1])
        if kind == "look":
            return lambda toks, i, memo: (i, ()) if one(toks, i, memo)[0] >= 0 else fail
        if kind == "not":
            return lambda toks, i, memo: (i, ()) if one(toks, i, memo)[0] < 0 else fail
        if kind == "opt":

            def opt(toks, i, memo):
                got = one(toks, i, memo)
                return got if got[0] >= 0 else (i, ())

            return opt
        least = kind == "plus"

        def many(toks, i, memo):
            kids, n = [], 0
            while True:
                j, k = one(toks, i, memo)
                if j <= i:
                    break
                i, n = j, n + 1
                if k:
                    kids.extend(k)
            return (i, tuple(kids)) if n or not least else fail

        return many

    def match(self, ctx: str, toks: list[str]) -> tuple | None:
        """Groups below as ((index, context), ...), or None where the unit is no production of the context.

        Rules call each other in plain Python, whose frames lie on the heap; as every rule that calls itself consumes a token
        first, the depth is bounded by the length of the unit.
        """
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, 10_000 + 100 * len(toks)))
        try:
            end, kids = self._fn[ctx]([*toks, END], 0, {})
        finally:
            sys.setrecursionlimit(limit)
        return kids if end == len(toks) else None

    # -- permissible pairs ---------------------------------------------------------------------------------
    def pairs(self) -> set[tuple[str, str]]:
        """All (token, next token) that some file of the language can hold outside of wild groups; brackets stand for themselves."""
        first, last, empty = defaultdict(set), defaultdict(set), dict.fromkeys(self.rules, False)

        def sets(node) -> tuple[set, set, bool]:
            kind = node[0]
            if kind == "tok":
                return {node[1]}, {node[1]}, False
            if kind == "any":  # pairs with what is in a wild group depend on the group, see ``WILD``
                return set(), set(), False
            if kind == "grp":
                return {OPEN[node[1]]}, {CLOSE[node[1]]}, False
            if kind == "ref":
                return first[node[1]], last[node[1]], empty[node[1]]
            if kind in ("look", "not"):
                return set(), set(), True
            if kind in ("opt", "star", "plus"):
                f, e, n = sets(node[1])
                return f, e, n or kind != "plus"
            if kind == "alt":
                got = [sets(x) for x in node[1]]
                return set().union(*[g[0] for g in got]), set().union(*[g[1] for g in got]), any(g[2] for g in got)
            f: set = set()
            e: set = set()
            n = True
            for x in node[1]:
                a, b, c = sets(x)
                if n:
                    f |= a
                e, n = (e | b if c else set(b)), n and c
            return f, e, n

        def walk(node, see):
            see(node)
            for x in node[1] if node[0] in ("alt", "seq") else [node[1]] if node[0] in ("opt", "star", "plus", "look", "not") else []:
                walk(x, see)

        changed = True
        while changed:
            changed = False
            for name, body in self.rules.items():
                f, e, n = sets(body)
                if not f <= first[name] or not e <= last[name] or n != empty[name]:
                    first[name] |= f
                    last[name] |= e
                    empty[name] = n
                    changed = True
        out: set[tuple[str, str]] = set()

        def see(node):
            if node[0] == "grp":
                o, c = OPEN[node[1]], CLOSE[node[1]]
                f, e, n = first[node[2]], last[node[2]], empty[node[2]]
                out.update((o, x) for x in f)
                out.update((x, c) for x in e)
                out.update((x, y) for x in e for y in f)  # between the units of a group
                out.add((o, c))
            elif node[0] in ("star", "plus"):
                f, e, _ = sets(node[1])
                out.update((x, y) for x in e for y in f)
            elif node[0] == "seq":
                tails: set = set()
                for x in node[1]:
                    f, e, n = sets(x)
                    out.update((a, b) for a in tails for b in f)
                    tails = tails | e if n else set(e)

        for body in self.rules.values():
            walk(body, see)
        for a in (self.first, self.root):
            out.update((START, x) for x in first[a])
            out.update((x, END) for x in last[a])
            out.update((x, y) for x in last[a] for y in first[self.root])
        if empty[self.first]:
            out.add((START, END))
        return out
