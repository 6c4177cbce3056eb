"""Rules over components and their edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import matches_pattern
from .cycles import import_depth
from .graph import fan_in, layer_violations

#: Words in an import that make its package a boundary to the outside, and the zones of roles (fixed values).
NET_WORDS = ("net/http", "grpc", "net/rpc", "http", "api", "server", "handler")
ROLE_ZONES = {"entrypoint": "entrypoint", "entry": "entrypoint", "adapter": "boundary", "boundary": "boundary", "infra": "infra", "infrastructure": "infra", "port": "port", "data": "data", "store": "data", "repo": "data"}


def boundary_rules(edges: DataFrame, rules: list[tuple[str, str, bool]], src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, dst, rule, severity): edges that a rule (from pattern, to pattern, allow) forbids. Rules are compiled into the scan: no join."""
    hits = [
        F.when(matches_pattern(src, a) & matches_pattern(dst, b), F.lit(f"{a} -> {b}"))
        for a, b, allow in rules
        if not allow
    ]
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    if not hits:
        return e.select("src", "dst", F.lit("").alias("rule"), F.lit("error").alias("severity")).limit(0)
    return e.select("src", "dst", F.explode(F.array_compact(F.array(*hits))).alias("rule"), F.lit("error").alias("severity"))


def budgets(components: DataFrame, edges: DataFrame, limits: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(component, metric, actual, budget): values over their budgets (component, max_fan_in, max_churn, max_nesting; 0 is none)."""
    c = components.join(fan_in(edges, src, dst).withColumnRenamed("node", "name"), "name", "left").fillna(0, ["fan_in"])
    c = c.select(F.col("name").alias("component"), "fan_in", "churn", (F.col("max_nesting") if "max_nesting" in components.columns else F.lit(0)).alias("nesting"))
    j = limits.join(c, "component")
    x = lambda m, actual, cap: F.struct(F.lit(m).alias("metric"), actual.cast("bigint").alias("actual"), F.col(cap).cast("bigint").alias("budget"))
    many = j.select("component", F.explode(F.array(x("fan_in", F.col("fan_in"), "max_fan_in"), x("churn", F.col("churn"), "max_churn"), x("nesting", F.col("nesting"), "max_nesting"))).alias("b"))
    return many.select("component", "b.*").where("budget > 0 AND actual > budget")


def gaps(files: DataFrame) -> DataFrame:
    """(component, gap, severity) of files (component, file): folders without tests or without documentation."""
    base = F.lower(F.substring_index("file", "/", -1))
    tests = base.rlike(r"(_test\.go|^test_.*\.py|_test\.py|\.(test|spec)\.[jt]sx?|test\.java|_test\.rs)$")
    docs = base.rlike(r"^(readme|doc)(\.|$)|\.md$|^doc\.go$")
    g = files.groupBy("component").agg(F.max(tests).alias("t"), F.max(docs).alias("d"))
    gap = F.explode(F.array_compact(F.array(F.when(~F.col("t"), "no tests"), F.when(~F.col("d"), "no docs"))))
    return g.select("component", gap.alias("gap"), F.lit("warning").alias("severity"))


def import_direction(edges: DataFrame, depths: DataFrame | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, dst, d_src, d_dst): edges from a shallower, not topmost, to a deeper component; ends on cycles are left out."""
    d = import_depth(edges, src, dst) if depths is None else depths
    a, b = d.select(F.col("node").alias("src"), F.col("depth").alias("d_src")), d.select(F.col("node").alias("dst"), F.col("depth").alias("d_dst"))
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).join(a, "src", "left").join(b, "dst", "left").fillna(0, ["d_src", "d_dst"])
    return e.where("d_src > 0 AND d_src < d_dst AND d_dst <> -1").select("src", "dst", "d_src", "d_dst")


def interface_metrics(interfaces: DataFrame, impls: DataFrame) -> dict[str, DataFrame]:
    """{'interfaces': (name, methods, implementors, orphan), 'summary'}: by bare name."""
    imp = impls.groupBy(F.col("to").alias("name")).agg(F.sort_array(F.collect_set("from")).alias("implementors"))
    i = interfaces.groupBy("name").agg(F.max("methods").alias("methods")).join(imp, "name", "left")
    i = i.withColumn("implementors", F.coalesce("implementors", F.expr("cast(array() as array<string>)"))).withColumn("orphan", F.size("implementors") == 0)
    s = i.agg(F.count(F.lit(1)).alias("total"), F.count_if("orphan").alias("orphans"), F.avg("methods").alias("avg_methods"), F.max_by("name", F.struct("methods", (-F.ascii("name")))).alias("largest"))
    return {"interfaces": i, "summary": s}


def trust_zones(components: DataFrame, imports: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """(component, zone): by role where there is one; boundary where an import (component, target) reaches outside; else domain."""
    word = reduce(lambda a, b: a | b, [F.lower("target").contains(w) for w in NET_WORDS])
    net = imports.groupBy("component").agg(F.max(word).alias("net"))
    c = components.select(F.col("name").alias("component")).join(net, "component", "left")
    zone = F.when(F.col("net"), "boundary").otherwise("domain")
    if roles is not None:
        c = c.join(roles.select("component", "role"), "component", "left")
        z = F.create_map(*[F.lit(x) for kv in ROLE_ZONES.items() for x in kv])
        zone = F.when(F.col("role").isNotNull(), F.coalesce(z[F.lower("role")], F.lit("domain"))).otherwise(zone)
    return c.select("component", zone.alias("zone"))


def zone_crossings(edges: DataFrame, zones: DataFrame, trusted: list[str] | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, dst, from_zone, to_zone): edges between different known zones; with ``trusted``, only those into these."""
    a, b = zones.select(F.col("component").alias("src"), F.col("zone").alias("from_zone")), zones.select(F.col("component").alias("dst"), F.col("zone").alias("to_zone"))
    x = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).join(a, "src").join(b, "dst").where("from_zone <> '' AND to_zone <> '' AND from_zone <> to_zone")
    return x.where(F.col("to_zone").isin(*trusted)) if trusted else x


def api_surface(components: DataFrame) -> DataFrame:
    """(component, exported): exported symbols of each component (column symbols or n_symbols)."""
    if "n_symbols" in components.columns:
        return components.select(F.col("name").alias("component"), F.col("n_symbols").alias("exported"))
    n = F.size(F.filter(F.coalesce("symbols", F.expr("array()")), lambda s: s["exported"]))
    return components.select(F.col("name").alias("component"), n.cast("bigint").alias("exported"))


def hot_spots(components: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(component, fan_in, churn): at least 3 importers and at least 5 changes or 4 levels of nesting."""
    j = components.join(fan_in(edges, src, dst).withColumnRenamed("node", "name"), "name", "left").fillna(0, ["fan_in"])
    deep = (F.col("max_nesting") >= 4) if "max_nesting" in components.columns else F.lit(False)
    return j.where((F.col("fan_in") >= 3) & ((F.col("churn") >= 5) | deep)).select(F.col("name").alias("component"), "fan_in", "churn")


def drift(edges: DataFrame, components: DataFrame, layers: list[str], rules: list[tuple[str, str, bool]], limits: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(checks, violations, score), one row: how much of the desired state holds, in whole percent."""
    lv = layer_violations(edges, layers, src, dst).select(F.lit("layer").alias("k"))
    br = boundary_rules(edges, rules, src, dst).select(F.lit("boundary").alias("k"))
    bv = budgets(components, edges, limits, src, dst).select(F.lit("budget").alias("k"))
    v = lv.union(br).union(bv).agg(F.count(F.lit(1)).alias("violations"))
    e = edges.agg(F.count(F.lit(1)).alias("e"))
    asked = limits.join(components.select(F.col("name").alias("component")), "component", "left_semi")
    b = asked.agg(F.coalesce(F.sum((F.col("max_fan_in") > 0).cast("int") + (F.col("max_churn") > 0).cast("int") + (F.col("max_nesting") > 0).cast("int")), F.lit(0)).alias("b"))
    checks = (F.col("e") + F.lit(sum(not r[2] for r in rules)) + F.col("b")).cast("bigint")
    out = v.crossJoin(e).crossJoin(b).select(checks.alias("checks"), "violations")  # one row each
    return out.withColumn("score", F.when(F.col("checks") == 0, 100).otherwise(F.greatest(F.lit(0), F.floor(100 * (F.col("checks") - F.col("violations")) / F.col("checks")))).cast("bigint"))


def severity_rank(s: Column) -> Column:
    return F.when(s == "critical", 0).when(s == "error", 1).when(s == "warning", 2).otherwise(3)
