"""The same rules for one text in plain Python: what the distributed operator is tested against."""

from __future__ import annotations

from .engine import CLOSE, END, OPEN, START, WILD
from .grammars import grammar
from .lexers import lex

_KIND = {v: k for k, v in OPEN.items()}
_CLOSES = {CLOSE[k]: OPEN[k] for k in OPEN}


def faults(language: str, text: str) -> str | None:
    """None where the text parses, else the first rule that it breaks: pair, nesting or production."""
    g, rows = grammar(language), lex(language, text)
    allowed = g.pairs() if not hasattr(g, "_pairs") else g._pairs
    g._pairs = allowed
    syms = [START, *[r[0] for r in rows], END]
    stray = {i for i, (a, b) in enumerate(zip(syms, syms[1:])) if (a, b) not in allowed}  # by the position of the second
    groups: dict[int, list[list[tuple[str, int]]]] = {-1: [[]]}
    wild_only: set[tuple[int, int]] = set()  # units with a stray pair
    stack: list[tuple[str, bool, int]] = []
    at = -1
    for pos, (sym, d, sep) in enumerate(rows):
        if pos in stray:
            wild_only.add((at, len(groups[at]) - 1))
        if d < 0:
            if not stack or stack[-1][0] != _CLOSES[sym]:
                return f"nesting {pos}"
            _, sep, at = stack.pop()
            if sep:
                groups[at].append([])
            continue
        groups[at][-1].append((sym, pos))
        if d > 0:
            stack.append((sym, sep, at))
            groups[pos] = [[]]
            at = pos
        elif sep:
            groups[at].append([])
    if stack:
        return "nesting end"
    if len(rows) in stray:
        return f"pair {syms[-2]} {END}"
    todo = [(-1, g.root)]
    while todo:
        pos, ctx = todo.pop()
        us = [(u, (pos, k) in wild_only) for k, u in enumerate(groups[pos]) if u or (pos, k) in wild_only]
        for k, (u, strays) in enumerate(us or [([], False)]):
            c = g.first if pos == -1 and k == 0 else ctx
            if strays and c != WILD:
                return f"pair in {c}: {' '.join(s for s, _ in u)[:300]}"
            got = g.match(c, [s for s, _ in u])
            if got is None:
                return f"production {c}: {' '.join(s for s, _ in u)[:300]}"
            todo += [(u[i][1], x) for i, x in got]
    return None
