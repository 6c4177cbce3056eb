"""From namespaces and imports to components: packages, groups, depths of grouping, size roll-ups."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import first_segments, short_path


def package_model(namespaces: DataFrame, edges: DataFrame, symbols: DataFrame, module: str, external: bool = False, no_tests: bool = False) -> dict[str, DataFrame]:
    """{'components': (name, n_symbols), 'edges': (src, dst, protocol, weight)} of namespaces (path), edges (src, dst, external, weight), symbols (package, exported).

    Names lose the module's path; only exported symbols count; inner edges need both ends among the namespaces, outer ones are kept on
    demand; test kits are left out on demand.
    """
    ns = namespaces.select("path").distinct()
    n = symbols.where("exported").groupBy(F.col("package").alias("path")).agg(F.count(F.lit(1)).alias("n_symbols"))
    comps = ns.join(n, "path", "left").select(short_path("path", module).alias("name"), F.coalesce("n_symbols", F.lit(0)).alias("n_symbols"))
    inner = edges.where("NOT external").join(ns.withColumnRenamed("path", "src"), "src", "left_semi").join(ns.withColumnRenamed("path", "dst"), "dst", "left_semi")
    out = inner.select(short_path("src", module).alias("src"), short_path("dst", module).alias("dst"), F.lit("import").alias("protocol"), "weight")
    if external:
        out = out.unionByName(edges.where("external").select(short_path("src", module).alias("src"), "dst", F.lit("external").alias("protocol"), "weight"))
    if no_tests:
        comps = comps.where(~F.col("name").startswith("testkit/"))
        out = out.where(~F.col("src").startswith("testkit/") & ~F.col("dst").startswith("testkit/"))
    return {"components": comps, "edges": out}


def group_model(components: DataFrame, edges: DataFrame, groups: DataFrame) -> dict[str, DataFrame]:
    """{'components': (name, churn), 'edges'} lifted to groups (name, grp): sums; external wins; edges inside of a group fall away; names without a group stay."""
    of = groups.groupBy("name").agg(F.min("grp").alias("grp"))
    comps = components.join(of, "name", "left").groupBy(F.coalesce("grp", "name").alias("name")).agg(F.sum("churn").alias("churn"))
    a, b = of.withColumnsRenamed({"name": "src", "grp": "ga"}), of.withColumnsRenamed({"name": "dst", "grp": "gb"})
    e = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("ga", "src").alias("src"), F.coalesce("gb", "dst").alias("dst"), "protocol", "weight").where("src <> dst")
    protocol = F.when(F.max(F.col("protocol") == "external"), "external").otherwise("import")
    return {"components": comps, "edges": e.groupBy("src", "dst").agg(protocol.alias("protocol"), F.sum("weight").alias("weight"))}


def default_groups(names: DataFrame, depth: int) -> DataFrame:
    """(name, grp): names that share their first segments with another one."""
    k = names.select("name", first_segments("name", depth).alias("grp"))
    many = k.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("grp")
    return k.join(many, "grp", "left_semi").select("name", "grp")


def group_counts(names: DataFrame, deepest: int = 5) -> DataFrame:
    """(depth, n): how many components each grouping depth leaves."""
    d = names.select("name", F.explode(F.sequence(F.lit(1), F.lit(deepest))).alias("depth"))
    # substring_index takes a constant only: the first segments by slicing.
    parts = F.split("name", "/")
    return d.select("depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("grp")).groupBy("depth").agg(F.countDistinct("grp").alias("n"))


def suggested_depth(names: DataFrame, deepest: int = 5) -> int:
    """The depth that leaves the fewest components; 0 for three or fewer, or where none leaves fewer; depths behind the first that leaves as many aren't tried."""
    flat = names.select("name").distinct().count()
    if flat <= 3:
        return 0
    best, depth = flat, 0
    for r in group_counts(names.select("name").distinct(), deepest).orderBy("depth").collect():  # one row a depth
        if r["n"] >= flat:
            break
        if r["n"] < best:
            best, depth = r["n"], r["depth"]
    return depth


def size_rollup(files: DataFrame, nesting: DataFrame) -> DataFrame:
    """(component, loc, max_nesting, avg_nesting) of files (component, lines) and functions (component, depth)."""
    loc = files.groupBy("component").agg(F.sum("lines").alias("loc"))
    deep = nesting.groupBy(F.when(F.col("component") == "(root)", ".").otherwise(F.col("component")).alias("component")).agg(F.max("depth").alias("max_nesting"), F.avg("depth").alias("avg_nesting"))
    return loc.join(deep, "component", "left").fillna(0, ["max_nesting", "avg_nesting"])


def project_path(files: dict[str, str], folder: str) -> str:
    """The project's own name: from go.mod, Cargo.toml, pyproject.toml or package.json, in this order, else the folder's."""
    for name, pattern in (("go.mod", r"(?m)^module\s+(\S+)"), ("Cargo.toml", r'(?ms)^\[package\].*?^name\s*=\s*"([^"]+)"'), ("pyproject.toml", r'(?ms)^\[(?:project|tool\.poetry)\].*?^name\s*=\s*"([^"]+)"'), ("package.json", r'"name"\s*:\s*"([^"]+)"')):
        m = re.search(pattern, files.get(name, ""))
        if m:
            return m.group(1)
    return folder.rstrip("/").rsplit("/", 1)[-1]

