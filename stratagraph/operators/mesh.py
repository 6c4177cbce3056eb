"""The four-level hierarchy symbol < file < package < component and what is lifted to its levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import base_of, instability, package_of
from ..runtime import checkpoint, global_rank
from .cycles import two_cycles
from .graph import closure, fan_in, fan_out, undirected

LEVELS = ("symbol", "file", "package", "component")
#: Standard packages that nearly every file calls (fixed values).
PLUMBING = ("fmt", "strings", "errors", "strconv", "sort", "bytes", "math", "unicode", "log", "log/slog", "slices", "maps", "sync", "context", "time", "os", "io", "path", "path/filepath")


def ancestors(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """(symbol, file, package, component) of nodes (fqn, package, file) over components (name).

    The component is the longest listed one that is the package or a path prefix of it: the package's prefixes are joined by
    equality, not by a nested loop. No package belongs to (root), a package without a component is its own.
    """
    n = nodes.select(F.col("fqn").alias("symbol"), F.coalesce("package", F.lit("")).alias("package"), "file")
    parts = F.split("package", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    pk = n.select("package").distinct()
    hit = pk.select("package", F.explode(prefixes).alias("name")).join(components.select("name").distinct(), "name").groupBy("package").agg(F.max_by("name", F.length("name")).alias("found"))
    file = F.concat("package", F.lit("/"), F.when(F.coalesce("file", F.lit("")) == "", F.lit("(unknown)")).otherwise(base_of("file")))
    comp = F.when(F.col("package") == "", F.lit("(root)")).otherwise(F.coalesce("found", "package"))
    return n.join(hit, "package", "left").select("symbol", file.alias("file"), "package", comp.alias("component"))


def mesh_nodes(anc: DataFrame) -> DataFrame:
    """(name, level, parent, n_children): all nodes of the hierarchy; a package that is its own component appears as that component."""
    up = [anc.select(F.col("symbol").alias("name"), F.lit(0).alias("level"), F.col("file").alias("parent")), anc.select(F.col("file").alias("name"), F.lit(1).alias("level"), F.col("package").alias("parent"))]
    up += [anc.select(F.col("package").alias("name"), F.lit(2).alias("level"), F.col("component").alias("parent")), anc.select(F.col("component").alias("name"), F.lit(3).alias("level"), F.lit(None).cast("string").alias("parent"))]
    u = reduce(DataFrame.union, up).distinct()
    one = u.groupBy("name").agg(F.max(F.struct("level", "parent")).alias("x")).select("name", F.col("x.level").alias("level"), F.col("x.parent").alias("parent"))
    kids = u.where("parent IS NOT NULL AND parent <> name").select("parent", "name").distinct().groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    return one.join(kids, "name", "left").fillna(0, ["n_children"])


def lift(edges: DataFrame, anc: DataFrame, level: str, src: str = "source", dst: str = "target") -> DataFrame:
    """edges plus (a, b): both ends at the level; names outside of the hierarchy stand for themselves."""
    key = anc.select("symbol", F.col(level).alias("up"))
    x, y = key.select(F.col("symbol").alias(src), F.col("up").alias("a_")), key.select(F.col("symbol").alias(dst), F.col("up").alias("b_"))
    return edges.join(x, src, "left").join(y, dst, "left").withColumn("a", F.coalesce("a_", F.col(src))).withColumn("b", F.coalesce("b_", F.col(dst))).drop("a_", "b_")


def aggregate(edges: DataFrame, anc: DataFrame, level: str, weight: Column | None = None) -> DataFrame:
    """(source, target, weight, kind) at a level: weights added up, inner edges dropped, the smallest kind."""
    up = lift(edges.withColumn("_w", F.lit(1.0) if weight is None else weight), anc, level).where("a <> b AND a <> '' AND b <> ''")
    return up.groupBy(F.col("a").alias("source"), F.col("b").alias("target")).agg(F.sum("_w").alias("weight"), F.min("kind").alias("kind"))


def boundaries(edges: DataFrame, anc: DataFrame, min_weight: float = 0.0) -> DataFrame:
    """edges with at least ``min_weight`` between different components."""
    return lift(edges, anc, "component").where((F.col("weight") >= min_weight) & (F.col("a") != F.col("b"))).select(*edges.columns)


def neighborhood(edges: DataFrame, start: str, hops: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node) within the hops, edges read both ways, the start included."""
    seed = edges.sparkSession.createDataFrame([(start,)], "node string")
    return closure(undirected(edges, src, dst), seed, max_depth=max(0, hops)).select("node")


def neighborhood_weighted(edges: DataFrame, start: str, hops: int, src: str = "src", dst: str = "dst", weight: str = "weight") -> DataFrame:
    """(node, weight): the heaviest single edge between each reached node and any node that was expanded; without the start."""
    seed = edges.sparkSession.createDataFrame([(start,)], "node string")
    found = checkpoint(closure(undirected(edges, src, dst), seed, max_depth=max(0, hops)).select("node", "depth"))
    grown = found.where(F.col("depth") < hops).select(F.col("node").alias("from"))
    e = edges.select(F.col(src).alias("x"), F.col(dst).alias("y"), F.col(weight).cast("double").alias("w"))
    sides = e.union(e.select("y", "x", "w")).toDF("from", "node", "w")
    return sides.join(grown, "from", "left_semi").where(F.col("node") != start).groupBy("node").agg(F.max("w").alias("weight"))


def distance(edges: DataFrame, start: str, goal: str, src: str = "src", dst: str = "dst") -> int:
    """Hops with edges read both ways; 0 for the node itself, -1 where there is no way."""
    if start == goal:
        return 0
    seed = edges.sparkSession.createDataFrame([(start,)], "node string")
    row = closure(undirected(edges, src, dst), seed).where(F.col("node") == goal).select("depth").collect()
    return row[0]["depth"] if row else -1


def circuits(edges: DataFrame, min_weight: float = 0.0, src: str = "source", dst: str = "target", weight: str = "weight") -> DataFrame:
    """(circuit_id, a, b): pairs that call each other with at least the weight, numbered by name."""
    strong = edges.where(F.col(weight) >= min_weight)
    pairs = two_cycles(strong, src, dst)
    return global_rank(pairs, ["a", "b"], "circuit_id").select("circuit_id", "a", "b")


def overlay(nodes: DataFrame, edges: DataFrame, roles: DataFrame | None = None, src: str = "source", dst: str = "target") -> DataFrame:
    """nodes (name, level, ...) plus fan_in, fan_out, instability, choke_score and, at components, role."""
    from .kernels import betweenness

    fi, fo = fan_in(edges, src, dst).withColumnRenamed("node", "name"), fan_out(edges, src, dst).withColumnRenamed("node", "name")
    out = nodes.join(fi, "name", "left").join(fo, "name", "left").fillna(0, ["fan_in", "fan_out"])
    out = out.withColumn("instability", instability(F.col("fan_in"), F.col("fan_out")))
    out = out.join(betweenness(edges, src, dst).select(F.col("node").alias("name"), F.col("betweenness").alias("choke_score")), "name", "left").fillna(0.0, ["choke_score"])
    if roles is not None:
        out = out.join(roles.select(F.col("component").alias("name"), "role"), "name", "left").withColumn("role", F.when(F.col("level") == 3, F.col("role")))
    return out


def edge_weight(source: Column, target: Column, components: list[str]) -> Column:
    """1.0 across components, 0.5 inside one; calls that leave the components weigh 0.01 into plumbing and 0.3 elsewhere. The first listed prefix decides."""

    def component(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for c in reversed(components):
            out = F.when((package_of(x) == c) | x.startswith(c + "/") | x.startswith(c + "."), F.lit(c)).otherwise(out)
        return out

    a, b = component(source), component(target)
    pkg = package_of(target)
    # Paths into a toolchain carry the package behind the last /src/.
    pkg = F.when(pkg.contains("/src/"), F.regexp_extract(pkg, r".*/src/(.*)$", 1)).otherwise(pkg)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, 0.5).otherwise(1.0)).when(pkg.isin(*PLUMBING), 0.01).otherwise(0.3)
