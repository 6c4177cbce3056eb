"""Edge-list operators. Every one takes (edges, src column, dst column), so it works on any two string columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint

#: A graph with more edges than this is never gathered: iterative joins take over.
SMALL = 200_000


def ends(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where(F.col("src").isNotNull() & F.col("dst").isNotNull())


def nodes_of(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node), distinct."""
    return edges.select(F.explode(F.array(F.col(src), F.col(dst))).alias("node")).where("node IS NOT NULL").distinct()


def fan_in(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, fan_in): rows, not distinct sources."""
    return ends(edges, src, dst).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("fan_in"))


def fan_out(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return ends(edges, src, dst).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("fan_out"))


def weighted_fan_in(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str = "weight") -> DataFrame:
    """(node, weighted_fan_in): a weight of 0 counts as 1."""
    w = F.coalesce(F.col(weight), F.lit(0))
    return edges.groupBy(F.col(dst).alias("node")).agg(F.sum(F.when(w == 0, 1).otherwise(w)).alias("weighted_fan_in"))


def reverse_adjacency(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return ends(edges, src, dst).select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    e = ends(edges, src, dst)
    return e.union(e.select("dst", "src")).distinct()


def fetch_small(edges: DataFrame, limit: int = SMALL) -> list[tuple[str, str]] | None:
    """The distinct edges as a list where there are at most ``limit``; otherwise None."""
    rows = edges.select("src", "dst").distinct().limit(limit + 1).collect()
    return None if len(rows) > limit else [(r[0], r[1]) for r in rows]


def closure(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst", max_depth: int | None = None, valid: DataFrame | None = None, skip: DataFrame | None = None, small: int = SMALL) -> DataFrame:
    """(seed, node, depth): all nodes reached from each seed (column ``node``), the seeds themselves at depth 0.

    Seeds are kept whether valid or not. Graphs of at most ``small`` edges are sent to the workers whole and searched seed by seed;
    larger ones take one join a hop, with the found nodes checkpointed.
    """
    e = ends(edges, src, dst).distinct()
    if valid is not None:
        e = e.join(valid.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    if skip is not None:
        e = e.join(skip.select(F.col("node").alias("dst")).distinct(), "dst", "left_anti").select("src", "dst")
    start = seeds.select(F.col("node").alias("seed")).where("seed IS NOT NULL").distinct()
    pairs = fetch_small(e, small)
    if pairs is not None:
        adj: dict[str, list[str]] = {}
        for a, b in pairs:
            adj.setdefault(a, []).append(b)
        shared = edges.sparkSession.sparkContext.broadcast(adj)

        def search(batches):
            import pandas as pd

            out = shared.value
            for pdf in batches:
                for s in pdf["seed"]:
                    seen, level, depth = {s: 0}, [s], 0
                    while level and (max_depth is None or depth < max_depth):
                        depth += 1
                        after = []
                        for u in level:
                            for v in out.get(u, ()):
                                if v not in seen:
                                    seen[v] = depth
                                    after.append(v)
                        level = after
                    yield pd.DataFrame({"seed": s, "node": list(seen), "depth": list(seen.values())})

        return start.mapInPandas(search, "seed string, node string, depth int")
    found = start.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"))
    frontier, parts, depth = checkpoint(found), [], 0
    parts.append(frontier)
    while max_depth is None or depth < max_depth:
        depth += 1
        visited = reduce(DataFrame.unionByName, parts).select("seed", "node")
        step = frontier.join(e, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = checkpoint(step.join(visited, ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        parts.append(frontier)
    return reduce(DataFrame.unionByName, parts)


def reachability_counts(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, reachable): size of each node's closure without itself. Quadratic by nature: for component graphs."""
    return closure(edges, nodes_of(edges, src, dst), src, dst).groupBy(F.col("seed").alias("node")).agg((F.count(F.lit(1)) - 1).alias("reachable"))


def bfs_group(edges: DataFrame, start: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, depth, ord): the group around a start node in search order."""
    from pyspark.sql import Window

    seed = edges.sparkSession.createDataFrame([(start,)], "node string")
    c = closure(undirected(edges, src, dst), seed)
    return c.select("node", "depth", F.row_number().over(Window.partitionBy("seed").orderBy("depth", "node")).alias("ord"))


def weak_components(edges: DataFrame, src: str = "src", dst: str = "dst", nodes: DataFrame | None = None, small: int = SMALL) -> DataFrame:
    """(node, label): the smallest name of each weak component. Listed nodes without edges stand alone.

    Graphs of at most ``small`` edges are labelled at once, larger ones by label passing with pointer jumping.
    """
    plain = ends(edges, src, dst)
    base = nodes_of(edges, src, dst)
    if nodes is not None:
        base = base.union(nodes.select("node")).distinct()
    pairs = fetch_small(plain.where("src <> dst"), small)
    if pairs is not None:
        known = edges.sparkSession.createDataFrame(list(_joined(pairs).items()), "node string, label string")
        return base.join(known, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    e = checkpoint(undirected(edges, src, dst).where("src <> dst"))
    labels = checkpoint(base.select("node", F.col("node").alias("label")))
    while True:
        near = e.join(labels, F.col("dst") == F.col("node")).groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        # Jump: a label takes on the label that its own node has by now.
        hop = step.select(F.col("node").alias("via"), F.col("new").alias("jump"))
        step = checkpoint(step.join(hop, F.col("new") == F.col("via"), "left").select("node", "label", F.least("new", F.coalesce("jump", "new")).alias("new")))
        changed = not step.where("label <> new").isEmpty()
        labels = step.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def _joined(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """Each node's smallest companion: sets of nodes are merged edge by edge."""
    up: dict[str, str] = {}

    def top(x: str) -> str:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def component_count(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(components): weak components over the listed nodes alone."""
    n = nodes.select("node").distinct()
    inside = ends(edges, src, dst).join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return weak_components(inside, nodes=n).agg(F.countDistinct("label").alias("components"))


def shortest_path(edges: DataFrame, start: str, goal: str, src: str = "src", dst: str = "dst") -> list[str] | None:
    """Nodes of the shortest directed path, of equal ones the one of smallest names from the goal back; [start] where both are one."""
    if start == goal:
        return [start]
    spark = edges.sparkSession
    found = closure(edges, spark.createDataFrame([(start,)], "node string"), src, dst).select("node", "depth")
    at = found.where(F.col("node") == goal).collect()
    if not at:
        return None
    path, e = [goal], ends(edges, src, dst).distinct()
    for depth in range(at[0]["depth"] - 1, -1, -1):
        prev = e.where(F.col("dst") == path[-1]).join(found.where(F.col("depth") == depth), F.col("src") == F.col("node")).agg(F.min("src")).first()[0]
        path.append(prev)
    return path[::-1]


def distances(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, dst, hops) of all reachable pairs from the seeds."""
    return closure(edges, seeds, src, dst).select(F.col("seed").alias("src"), F.col("node").alias("dst"), F.col("depth").alias("hops"))


def cohesion(edges: DataFrame, groups: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(grp, cohesion) for (node, grp): distinct inner pairs over n(n-1)/2; a self-loop counts as a pair; groups under two nodes have 1."""
    a, b = groups.select(F.col("node").alias("src"), F.col("grp").alias("g1")), groups.select(F.col("node").alias("dst"), F.col("grp").alias("g2"))
    inner = ends(edges, src, dst).distinct().join(a, "src").join(b, "dst").where("g1 = g2").select(F.col("g1").alias("grp"), F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
    n = groups.groupBy("grp").agg(F.countDistinct("node").alias("n"))
    pairs = inner.groupBy("grp").agg(F.count(F.lit(1)).alias("p"))
    return n.join(pairs, "grp", "left").select("grp", F.when(F.col("n") < 2, F.lit(1.0)).otherwise(F.coalesce("p", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2)).alias("cohesion"))


def layer_violations(edges: DataFrame, layers: list[str], src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, dst): edges from an upper layer (earlier in the list) to a lower one; ends outside of the list are ignored."""
    rank = edges.sparkSession.createDataFrame([(x, i) for i, x in enumerate(layers)] or [("", 0)], "layer string, pos int")
    a, b = rank.select(F.col("layer").alias("src"), F.col("pos").alias("p1")), rank.select(F.col("layer").alias("dst"), F.col("pos").alias("p2"))
    return ends(edges, src, dst).join(F.broadcast(a), "src").join(F.broadcast(b), "dst").where("p1 < p2").select("src", "dst")


def resolve_symbol(nodes: DataFrame, name: str, fqn: str = "fqn") -> str | None:
    """The exact name, else one that ends in '.name', else one that contains it; the smallest of equals."""
    f = F.col(fqn)
    tier = F.when(f == name, 0).when(f.endswith("." + name), 1).when(f.contains(name), 2)
    row = nodes.select(f.alias("fqn"), tier.alias("tier")).where("tier IS NOT NULL").orderBy("tier", "fqn").limit(1).collect()
    return row[0]["fqn"] if row else None
