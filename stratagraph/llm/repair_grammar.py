"""Re-Pair grammars over token sequences."""

from __future__ import annotations

import heapq
import re

import numpy as np

#: One token: comment, literal, number, name or sign. Comments of all the languages are told apart by their first sign.
TOKEN = re.compile(
    r"(?P<com>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<hash>\#[^\n]*)"
    r"|(?P<str>\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\[\s\S])*(?:\"|(?=\n)|\Z)|`[^`]*(?:`|\Z)|'(?:[^'\\\n]|\\[\s\S])*(?:'|(?=\n)|\Z))"
    r"|(?P<num>\d[\w.]*)|(?P<id>[^\W\d][\w$]*|\$[\w$]+)|(?P<op>[^\s\w])"
)
_WORDS = frozenset(
    "break case class const continue def default defer del do elif else enum export extends fn for from func function go goto if impl import in interface let loop map match mod mut new nil None null "
    "package pass private protected pub public raise range return select self static struct super switch this throw trait try type typedef use var void while with yield".split()
)


def tokens(source: str, hash_comments: bool) -> tuple[list[str], list[tuple[int, str]], list[str], list[int]]:
    """(symbols of the code, comments with their offset, literals, offsets of the symbols): names, numbers and strings are reduced to their class."""
    syms: list[str] = []
    comments: list[tuple[int, str]] = []
    literals: list[str] = []
    at: list[int] = []
    pos, n = 0, len(source)
    while pos < n:
        m = TOKEN.search(source, pos)
        if not m:
            break
        kind, value = m.lastgroup, m.group()
        pos = m.end()
        if kind == "com" and hash_comments and value[1:2] == "/":
            kind, value, pos = "op", "/", m.start() + 1
        if kind == "hash":
            if hash_comments:
                comments.append((m.start(), value))
                continue
            kind, value, pos = "op", "#", m.start() + 1
        if kind == "com":
            comments.append((m.start(), value))
            continue
        at.append(m.start())
        if kind == "str":
            literals.append(value)
            syms.append("S")
        elif kind == "num":
            literals.append(value)
            syms.append("N")
        elif kind == "id":
            syms.append(value if value in _WORDS else "I")
        else:
            syms.append(value)
    return syms, comments, literals, at


def infer(codes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], int]:
    """(final sequence, rules, number of terminals): the most frequent pair (of equal ones, that of the smallest numbers) becomes a rule, until no pair comes twice.

    Places of each pair are kept up to date along a linked list, and the pairs in a heap whose outdated entries are passed by, so the
    time grows with the length times its logarithm.
    """
    k = terminals = int(codes.max()) + 1 if len(codes) else 1
    seq: list[int] = codes.tolist()
    n = len(seq)
    rules: list[tuple[int, int]] = []
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    at: dict[tuple[int, int], set[int]] = {}
    for i in range(n - 1):
        at.setdefault((seq[i], seq[i + 1]), set()).add(i)
    heap = [(-len(v), p) for p, v in at.items() if len(v) > 1]
    heapq.heapify(heap)
    while heap:
        waiting, places, pair = [], [], None
        while heap and pair is None:
            c, p = heapq.heappop(heap)
            here = at.get(p, ())
            if len(here) != -c:
                continue
            places = sorted(here)
            if p[0] == p[1]:  # in a run of the same symbol every second hit counts
                hits, places, last = places, [], -1
                for i in hits:
                    if i != last:
                        places.append(i)
                        last = after[i]
            if len(places) > 1:
                pair = p
            else:
                waiting.append((c, p))
        if pair is None:
            break
        a, b = pair
        rules.append(pair)
        changed = {pair}
        for i in places:
            j, h = after[i], before[i]
            far = after[j]
            at[pair].discard(i)
            if h >= 0:
                at[seq[h], a].discard(h)
                changed.add((seq[h], a))
            if far < n:
                at[b, seq[far]].discard(j)
                changed.add((b, seq[far]))
                before[far] = i
            seq[i], seq[j], after[i] = k, -1, far
            if h >= 0:
                at.setdefault((seq[h], k), set()).add(h)
                changed.add((seq[h], k))
            if far < n:
                at.setdefault((k, seq[far]), set()).add(i)
                changed.add((k, seq[far]))
        for p in changed:
            if len(at[p]) > 1:
                heapq.heappush(heap, (-len(at[p]), p))
            elif not at[p]:
                del at[p]
        for w in waiting:
            heapq.heappush(heap, w)
        k += 1
    return np.array([x for x in seq if x >= 0], np.int64), rules, terminals


def lengths(rules: list[tuple[int, int]], terminals: int) -> list[int]:
    """Expanded length of each rule."""
    out: list[int] = []
    for a, b in rules:
        out.append((1 if a < terminals else out[a - terminals]) + (1 if b < terminals else out[b - terminals]))
    return out


def occurrences(seq: np.ndarray, rules: list[tuple[int, int]], terminals: int) -> np.ndarray:
    """How often each rule's expansion stands in the whole text, rules within rules included."""
    out = np.bincount(seq[seq >= terminals] - terminals, minlength=len(rules)).astype(np.int64)
    for r in range(len(rules) - 1, -1, -1):
        for x in rules[r]:
            if x >= terminals:
                out[x - terminals] += out[r]
    return out


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a ^ (b + _MIX + (a << np.uint64(6)) + (a >> np.uint64(2)))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def global_rules(symbols: np.ndarray, rounds: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """(names, lengths) of the phrases that a text is made of, from pairing rules that depend on nothing but the two symbols.

    In every round, runs of one symbol become one; then each symbol takes a side by a bit of its hash, and a left one followed by a
    right one becomes the rule named by both. Equal stretches of different texts so get the same rules, whatever stands around
    them, and rules can be compared over all repositories by their names.
    """
    s, n = symbols.astype(np.uint64), np.ones(len(symbols), np.int64)
    for r in range(rounds):
        if len(s) < 2:
            break
        start = np.concatenate(([True], s[1:] != s[:-1]))
        if not start.all():
            at = np.flatnonzero(start)
            runs = np.diff(np.append(at, len(s))).astype(np.uint64)
            n = np.add.reduceat(n, at)
            s = np.where(runs > 1, _mix(s[at], runs + np.uint64(1 << 20)), s[at])
        side = (_mix(s, np.uint64(r + 1)) >> np.uint64(40)) & np.uint64(1)
        idx = np.flatnonzero((side[:-1] == 0) & (side[1:] == 1))
        if len(idx):
            s[idx] = _mix(s[idx], s[idx + 1])
            n[idx] += n[idx + 1]
            keep = np.ones(len(s), bool)
            keep[idx + 1] = False
            s, n = s[keep], n[keep]
    return s, n
