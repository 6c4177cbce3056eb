"""Cycles, depths and orders."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint
from .graph import SMALL, ends, fetch_small, nodes_of


def two_cycles(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(a, b), a < b, with edges both ways."""
    e = ends(edges, src, dst).where("src <> dst").distinct()
    sides = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    # Each direction is one row: a pair with two rows is a cycle. One shuffle, no self-join.
    return sides.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("a", "b")


def cyclic_core(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, dst): edges left when nodes without an incoming or without an outgoing edge are peeled off again and again."""
    e = checkpoint(ends(edges, src, dst).distinct())
    while True:
        starts, stops = e.select("src").distinct(), e.select("dst").distinct()
        kept = checkpoint(e.join(stops.withColumnRenamed("dst", "src"), "src", "left_semi").join(starts.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst"))
        if kept.count() == e.count():
            return kept
        e = kept


def _spread_min(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label): the smallest label among a node and all that reach it."""
    while True:
        near = edges.join(labels, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("near"))
        step = checkpoint(labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new")))
        labels = step.select("node", F.col("new").alias("label"))
        if step.where("label <> new").isEmpty():
            return labels


def components(edges: DataFrame, src: str = "src", dst: str = "dst", small: int = SMALL) -> DataFrame:
    """(node, scc): the smallest name of each strongly connected component, of the nodes that lie on a cycle of two or more.

    One label a node: where the smallest name that reaches a node is also the smallest that it reaches, the two are on one cycle.
    Edges between nodes that differ in either label join no component and fall away, and the rest is labelled again.
    """
    plain = ends(edges, src, dst).where("src <> dst")
    pairs = fetch_small(plain, small)
    if pairs is not None:
        names = [(n, min(c)) for c in _tarjan(pairs) if len(c) > 1 for n in c]
        return edges.sparkSession.createDataFrame(names, "node string, scc string")
    core, done = cyclic_core(plain), []
    while not core.isEmpty():
        names = checkpoint(nodes_of(core).select("node", F.col("node").alias("label")))
        back = core.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        both = checkpoint(_spread_min(core, names).withColumnRenamed("label", "f").join(_spread_min(back, names).withColumnRenamed("label", "b"), "node"))
        done.append(both.where("f = b").select("node", F.col("f").alias("scc")))
        a, z = both.select(F.col("node").alias("src"), F.col("f").alias("f1"), F.col("b").alias("b1")), both.select(F.col("node").alias("dst"), F.col("f").alias("f2"), F.col("b").alias("b2"))
        core = cyclic_core(core.join(a, "src").join(z, "dst").where("f1 = f2 AND b1 = b2 AND f1 <> b1").select("src", "dst"))
    if not done:
        return edges.sparkSession.createDataFrame([], "node string, scc string")
    # A node without a cycle can be its own smallest name both ways.
    labels = reduce(DataFrame.unionByName, done)
    sizes = labels.groupBy("scc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("scc")
    return labels.join(sizes, "scc", "left_semi").select("node", "scc")


def _tarjan(pairs: list[tuple[str, str]]) -> list[list[str]]:
    """Strongly connected components, with a stack of its own."""
    after: dict[str, list[str]] = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    held: set[str] = set()
    stack: list[str] = []
    out: list[list[str]] = []
    for root in after:
        if root in index:
            continue
        index[root] = low[root] = len(index)
        stack.append(root)
        held.add(root)
        work = [(root, iter(after[root]))]
        while work:
            v, rest = work[-1]
            w = next(rest, None)
            if w is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    one = []
                    while not one or one[-1] != v:
                        one.append(stack.pop())
                        held.discard(one[-1])
                    out.append(one)
            elif w not in index:
                index[w] = low[w] = len(index)
                stack.append(w)
                held.add(w)
                work.append((w, iter(after[w])))
            elif w in held:
                low[v] = min(low[v], index[w])
    return out


def on_cycle_nodes(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node): nodes that reach themselves in one step or more."""
    loops = ends(edges, src, dst).where("src = dst").select(F.col("src").alias("node"))
    return components(edges, src, dst).select("node").union(loops).distinct()


def elementary_cycles(edges: DataFrame, max_len: int | None = None, src: str = "src", dst: str = "dst", small: int = SMALL) -> DataFrame:
    """(cycle, len): each elementary circuit (of at most ``max_len`` nodes, where given) once, from its smallest member; self-loops have length 1.

    Only edges inside of a strongly connected component are followed. Graphs of at most ``small`` such edges are sent to the workers,
    which search the circuits of one smallest member each; in larger ones paths grow by one join a step.
    """
    e = ends(edges, src, dst).distinct()
    loops = e.where("src = dst").select(F.col("src").alias("cycle"), F.lit(1).alias("len"))
    scc = checkpoint(components(e))
    a, z = scc.select(F.col("node").alias("src"), F.col("scc").alias("s1")), scc.select(F.col("node").alias("dst"), F.col("scc").alias("s2"))
    core = checkpoint(e.where("src <> dst").join(a, "src").join(z, "dst").where("s1 = s2").select("src", "dst"))
    pairs = fetch_small(core, small)
    if pairs is not None:
        after: dict[str, list[str]] = {}
        for x, y in sorted(pairs):
            after.setdefault(x, []).append(y)
        shared = edges.sparkSession.sparkContext.broadcast(after)

        def search(batches):
            for pdf in batches:
                for s in pdf["node"]:
                    found = []
                    for path in _circuits_from(shared.value, s, max_len):
                        found.append(path)
                        if len(found) >= 10_000:
                            yield pd.DataFrame({"cycle": ["->".join(p) for p in found], "len": [len(p) for p in found]})
                            found = []
                    yield pd.DataFrame({"cycle": ["->".join(p) for p in found], "len": [len(p) for p in found]}, columns=["cycle", "len"]).astype({"cycle": object, "len": "int32"})

        starts = scc.select("node").repartition(edges.sparkSession.sparkContext.defaultParallelism, "node")
        return loops.unionByName(starts.mapInPandas(search, "cycle string, len int"))
    paths = core.where("src < dst").select(F.col("src").alias("start"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"))
    out, n = [loops], 1
    while max_len is None or n < max_len:
        n += 1
        closing = paths.join(core.select(F.col("src").alias("s"), F.col("dst").alias("t")), (F.col("last") == F.col("s")) & (F.col("start") == F.col("t")))
        out.append(closing.select(F.array_join("path", "->").alias("cycle"), F.lit(n).alias("len")))
        if n != max_len:
            step = paths.join(core.select(F.col("src").alias("s"), F.col("dst").alias("t")), F.col("last") == F.col("s"))
            paths = checkpoint(step.where((F.col("t") > F.col("start")) & ~F.array_contains("path", F.col("t"))).select("start", F.col("t").alias("last"), F.concat("path", F.array("t")).alias("path")))
            if paths.isEmpty():
                break
    return reduce(DataFrame.unionByName, out)


def _circuits_from(after: dict[str, list[str]], start: str, max_len: int | None) -> Iterator[list[str]]:
    """Elementary circuits whose smallest member is ``start``. Without a bound, nodes that led nowhere stay blocked until a circuit
    frees them, so that the time goes by the circuits; with one, nodes too far from the start to come back in time are passed by."""
    if max_len is not None:
        home, level, d = {start: 0}, [start], 0
        before: dict[str, list[str]] = {}
        for x, ys in after.items():
            for y in ys:
                before.setdefault(y, []).append(x)
        while level and d < max_len:
            d += 1
            level = [x for y in level for x in before.get(y, ()) if x > start and x not in home and not home.update({x: d})]
        path, on, work = [start], {start}, [iter(after.get(start, ()))]
        while work:
            w = next(work[-1], None)
            if w is None:
                work.pop()
                on.discard(path.pop())
            elif w == start:
                if len(path) > 1:
                    yield list(path)
            elif w > start and w not in on and len(path) + home.get(w, max_len) <= max_len:
                path.append(w)
                on.add(w)
                work.append(iter(after.get(w, ())))
        return
    path, blocked, waits = [start], {start}, {}
    work, closed = [iter(after.get(start, ()))], [False]
    while work:
        v = path[-1]
        w = next(work[-1], None)
        if w is None:
            work.pop()
            path.pop()
            if closed.pop():
                if closed:
                    closed[-1] = True
                free = [v]
                while free:
                    x = free.pop()
                    if x in blocked:
                        blocked.discard(x)
                        free.extend(waits.pop(x, ()))
            else:
                for y in after.get(v, ()):
                    if y > start:
                        waits.setdefault(y, set()).add(v)
        elif w == start:
            if len(path) > 1:
                yield list(path)
            closed[-1] = True
        elif w > start and w not in blocked:
            path.append(w)
            blocked.add(w)
            work.append(iter(after.get(w, ())))
            closed.append(False)


def import_depth(edges: DataFrame, src: str = "src", dst: str = "dst", small: int = SMALL) -> DataFrame:
    """(node, depth): longest way from nodes nobody imports; -1 on cycles.

    All edge rows count for the in-degree, those out of cycles too: a node below a cycle keeps the depth that its other importers
    gave it and is not followed further. Graphs of at most ``small`` distinct edges are worked out at once, larger ones by one join a
    level.
    """
    e = checkpoint(ends(edges, src, dst))
    pairs = e.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).limit(small + 1).collect()
    if len(pairs) <= small:
        return edges.sparkSession.createDataFrame(_depths([(r["src"], r["dst"], r["n"]) for r in pairs]), "node string, depth int")
    bad = checkpoint(on_cycle_nodes(e))
    names = nodes_of(e)
    free = names.join(bad, "node", "left_anti")
    degree = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("left"))
    state = checkpoint(free.join(degree, "node", "left").select("node", F.coalesce("left", F.lit(0)).alias("left"), F.lit(0).alias("depth")))
    out, queue = [], state.where("left = 0")
    inner = e.join(bad.withColumnRenamed("node", "dst"), "dst", "left_anti")
    while True:
        queue = checkpoint(queue.select("node", "depth"))
        if queue.isEmpty():
            break
        out.append(queue)
        hit = inner.join(queue, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("k"), (F.max("depth") + 1).alias("d"))
        state = state.join(queue.select("node"), "node", "left_anti").join(hit, "node", "left")
        state = checkpoint(state.select("node", (F.col("left") - F.coalesce("k", F.lit(0))).alias("left"), F.greatest("depth", F.coalesce("d", F.lit(0))).alias("depth")))
        queue = state.where("left = 0")
    done = reduce(DataFrame.unionByName, out) if out else state.select("node", "depth").limit(0)
    stuck = state.select("node", "depth")
    return done.unionByName(stuck).unionByName(bad.select("node", F.lit(-1).alias("depth")))


def _depths(pairs: list[tuple[str, str, int]]) -> list[tuple[str, int]]:
    bad = {a for a, b, _ in pairs if a == b} | {n for c in _tarjan([(a, b) for a, b, _ in pairs]) if len(c) > 1 for n in c}
    depth = {n: -1 if n in bad else 0 for a, b, _ in pairs for n in (a, b)}
    left, after = dict.fromkeys(depth, 0), {}
    for a, b, n in pairs:
        left[b] += n
        if b not in bad:
            after.setdefault(a, []).append((b, n))
    queue = [n for n in depth if n not in bad and not left[n]]
    for a in queue:
        for b, n in after.get(a, ()):
            depth[b] = max(depth[b], depth[a] + 1)
            left[b] -= n
            if not left[b]:
                queue.append(b)
    return list(depth.items())


class CycleError(ValueError):
    """The graph has a cycle."""


def topological_levels(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, level): level by level, self-loops left out; a cycle is an error."""
    e = checkpoint(ends(edges, src, dst).where("src <> dst").distinct())
    if not components(e).isEmpty():
        raise CycleError("the graph has a cycle")
    alone = nodes_of(edges, src, dst).join(nodes_of(e), "node", "left_anti").select("node", F.lit(0).alias("level"))
    return import_depth(e).select("node", F.col("depth").alias("level")).unionByName(alone)
