"""Global algorithms: Arrow kernels over graphs of a checked size, the same by joins, level by level, beyond it."""

from __future__ import annotations

from collections import deque
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import checkpoint, global_rank
from .graph import SMALL, ends, fetch_small, nodes_of, undirected


def _adjacency(pairs: list[tuple[str, str]]) -> dict[str, list[str]]:
    adj: dict[str, set[str]] = {}
    for a, b in pairs:
        adj.setdefault(a, set())
        adj.setdefault(b, set())
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    return {k: sorted(v) for k, v in sorted(adj.items())}


def betweenness(edges: DataFrame, src: str = "src", dst: str = "dst", max_sources: int | None = None, seed: int = 42, small: int = SMALL) -> DataFrame:
    """(node, betweenness): Brandes on the undirected simple graph, over (n-1)(n-2)·(used sources/n).

    With ``max_sources``, the sources with the smallest seeded hashes are used where there are more nodes. Graphs of at most ``small``
    edges are sent to the workers, which take a source each; larger ones are searched level by level, all sources at once.
    """
    nodes = checkpoint(nodes_of(edges, src, dst))
    n = nodes.count()
    sources, used = nodes, n
    if max_sources is not None and n > max_sources:
        sources, used = nodes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(max_sources), max_sources
    scale = (n - 1) * (n - 2) * (used / n) if n > 2 else 1.0
    pairs = fetch_small(ends(edges, src, dst), small)
    sums = _by_levels(undirected(edges, src, dst).where("src <> dst"), sources) if pairs is None else _by_source(edges.sparkSession, _adjacency(pairs), sources)
    return nodes.join(sums, "node", "left").select("node", (F.coalesce("b", F.lit(0.0)) / scale).alias("betweenness"))


def _by_levels(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, b): numbers of shortest ways forth, shares of them back, one join a level; rows are (source, node) pairs that have been reached."""
    e = checkpoint(edges)
    level = checkpoint(sources.select(F.col("node").alias("s"), "node", F.lit(1.0).alias("sigma")))
    levels = [level]
    while True:
        # In an undirected graph, a level's neighbours lie in it, before it or after it.
        near = reduce(DataFrame.unionByName, [x.select("s", "node") for x in levels[-2:]])
        step = level.join(e, F.col("node") == F.col("src")).groupBy("s", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma"))
        level = checkpoint(step.join(near, ["s", "node"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
    after, parts = levels[-1].withColumn("delta", F.lit(0.0)), []
    for before in reversed(levels[:-1]):
        parts.append(after.select("node", "delta"))
        down = after.select("s", F.col("node").alias("dst"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
        give = before.join(e, F.col("node") == F.col("src")).join(down, ["s", "dst"]).groupBy("s", "node").agg(F.sum("share").alias("share"))
        after = checkpoint(before.join(give, ["s", "node"], "left").withColumn("delta", F.col("sigma") * F.coalesce("share", F.lit(0.0))).drop("share"))
    return reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.sum("delta").alias("b")) if parts else after.select("node", F.col("delta").alias("b")).limit(0)


def _by_source(spark: SparkSession, adj: dict[str, list[str]], sources: DataFrame) -> DataFrame:
    """(node, b), each source searched by itself."""
    shared = spark.sparkContext.broadcast(adj)

    def brandes(batches):
        g = shared.value
        total: dict[str, float] = {}
        for pdf in batches:
            for s in pdf["node"]:
                order, sigma, dist, before = [], {s: 1.0}, {s: 0}, {}
                queue = deque([s])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for w in g[v]:
                        if w not in dist:
                            dist[w] = dist[v] + 1
                            queue.append(w)
                        if dist[w] == dist[v] + 1:
                            sigma[w] = sigma.get(w, 0.0) + sigma[v]
                            before.setdefault(w, []).append(v)
                delta = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in before.get(w, ()):
                        delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
                    if w != s:
                        total[w] = total.get(w, 0.0) + delta[w]
        yield pd.DataFrame({"node": list(total), "b": list(total.values())}, columns=["node", "b"])

    return sources.mapInPandas(brandes, "node string, b double").groupBy("node").agg(F.sum("b").alias("b"))


def rcm_order(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(pos, node): reverse Cuthill-McKee from the node of least degree; neighbours by degree, then name; unreached nodes by name; reversed.

    The queue's order, level by level: nodes of a level stand by the place of the first node that leads to them, then by degree and name.
    """
    e = checkpoint(undirected(edges, src, dst).where("src <> dst"))
    names = nodes_of(edges, src, dst)
    degree = checkpoint(names.join(e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg")), "node", "left").select("node", F.coalesce("deg", F.lit(0)).alias("deg")))
    first = degree.orderBy("deg", "node").limit(1).collect()
    if not first:
        return edges.sparkSession.createDataFrame([], "pos int, node string")
    n = degree.count()
    level = edges.sparkSession.createDataFrame([(first[0]["node"], 0)], "node string, at long")
    placed, done = [level], 1
    while True:
        near = reduce(DataFrame.unionByName, placed[-2:]).select("node")
        step = level.join(e, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min("at").alias("via")).join(near, "node", "left_anti").join(degree, "node")
        level = checkpoint(global_rank(step, ["via", "deg", "node"], "r").select("node", (F.col("r") - 1 + done).alias("at")))
        found = level.count()
        if not found:
            break
        placed.append(level)
        done += found
    reached = reduce(DataFrame.unionByName, placed)
    left = global_rank(degree.join(reached, "node", "left_anti"), ["node"], "r").select("node", (F.col("r") - 1 + done).alias("at"))
    return reached.unionByName(left).select((F.lit(n - 1) - F.col("at")).cast("int").alias("pos"), "node")


def typed_pipelines(edges: DataFrame, min_length: int = 3) -> DataFrame:
    """(start, length, steps, type_chain) of linear chains of calls whose return types feed the next parameters.

    ``edges``: source, target, param_types, return_types, file, line. A node's signature is that of its last typed incoming edge by
    (file, line, source). Names are walked in order and visited once; a chain ends at a fork or where no type fits. Only nodes with a
    single outgoing edge can be followed, so every node has one successor at most, and pointer doubling finds the chains.
    """
    e = edges.where("source IS NOT NULL AND target IS NOT NULL")
    strip = lambda c: F.transform(F.coalesce(c, F.expr("array()")), lambda x: F.regexp_replace(x, r"^\*+", ""))
    typed = e.where((F.size("param_types") > 0) | (F.size("return_types") > 0))
    sig = typed.groupBy(F.col("target").alias("node")).agg(F.max(F.struct("file", "line", "source", "param_types", "return_types")).alias("x")).select("node", F.col("x.param_types").alias("p"), F.col("x.return_types").alias("r"))
    single = e.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.first("target").alias("target")).where("n = 1").select("source", "target")
    a, b = sig.select(F.col("node").alias("source"), F.col("r").alias("ret")), sig.select(F.col("node").alias("target"), F.col("p").alias("par"))
    j = single.join(a, "source").join(b, "target")
    fits = F.filter("ret", lambda x: (x != "error") & F.array_contains(strip(F.col("par")), F.regexp_replace(x, r"^\*+", "")))
    link = j.select("source", "target", fits.alias("types")).where(F.size("types") > 0).select("source", "target", F.col("types")[0].alias("via"))

    # A chain starts at a name that no smaller one leads to, and goes on while its start is the smallest that leads there.
    far = checkpoint(link.select(F.col("source").alias("node")).union(link.select("target")).distinct().join(link.select(F.col("source").alias("node"), F.col("target").alias("next")), "node", "left"))
    # Names without a successor start nothing.
    far = far.select("node", "next", F.when(F.col("next").isNotNull(), F.struct(F.col("node").alias("low"), F.lit(0).alias("dist"))).alias("best"))
    hop = 1
    while True:  # each pass doubles how far names have come
        moved = F.struct(F.col("best.low").alias("low"), (F.col("best.dist") + hop).alias("dist"))
        come = far.where("next IS NOT NULL AND best IS NOT NULL").groupBy(F.col("next").alias("at")).agg(F.min(moved).alias("come"))
        jump = far.select(F.col("node").alias("via"), F.col("next").alias("then"))
        step = far.join(come, F.col("node") == F.col("at"), "left").join(jump, F.col("next") == F.col("via"), "left")
        step = checkpoint(step.select("node", F.col("then").alias("next"), F.least("best", "come").alias("best"), (~F.col("best.low").eqNullSafe(F.least("best", "come")["low"])).alias("new")))
        far, hop = step.drop("new"), hop * 2
        if step.where("new").isEmpty():
            break
    steps = far.where("best IS NOT NULL").select("node", "best.low", "best.dist").join(link.select(F.col("source").alias("node"), "via"), "node", "left")
    chains = steps.groupBy(F.col("low").alias("start")).agg(F.count(F.lit(1)).cast("int").alias("length"), F.sort_array(F.collect_list(F.struct("dist", "node", "via"))).alias("x"))
    types = F.slice(F.col("x.via"), 1, F.col("length") - 1)  # the last one leads on to another chain, or nowhere
    return chains.where(F.col("length") >= min_length).select("start", "length", F.col("x.node").alias("steps"), types.alias("type_chain"))
