"""Impact of changes on component graphs: blast radius, risk, leverage, consolidation, what-if, diffs, evolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import bare_name, dir_of, package_of, percent, risk_level
from ..runtime import checkpoint
from .graph import closure, ends, fan_in, weak_components


def dependents(edges: DataFrame, components: DataFrame, targets: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(target, component, direct): known components that import a target, directly or through others; the target itself is left out."""
    known = components.select(F.col("name").alias("node"))
    back = ends(edges, src, dst).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    c = closure(back, targets.select("node"), valid=known)
    return c.where("seed <> node").select(F.col("seed").alias("target"), F.col("node").alias("component"), (F.col("depth") == 1).alias("direct"))


def impact(edges: DataFrame, components: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(component, direct, transitive, blast_pct, risk) of every component."""
    names = components.select(F.col("name").alias("node"))
    d = dependents(edges, components, names, src, dst).groupBy(F.col("target").alias("component")).agg(F.count_if("direct").alias("direct"), F.count(F.lit(1)).alias("transitive"))
    total = components.agg(F.count(F.lit(1)).alias("total"))  # one row
    out = components.select(F.col("name").alias("component")).join(d, "component", "left").fillna(0).crossJoin(F.broadcast(total))
    out = out.withColumn("blast_pct", percent(F.col("transitive"), F.col("total")))
    return out.select("component", "direct", "transitive", "blast_pct", risk_level(F.col("blast_pct")).alias("risk"))


def blast_radius(edges: DataFrame, components: DataFrame, files: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(component, changed): components of the changed files (column file) and all that depend on them."""
    changed = files.select(dir_of("file").alias("node")).join(components.select(F.col("name").alias("node")), "node", "left_semi").distinct()
    hit = dependents(edges, components, changed, src, dst).select("component").distinct()
    u = changed.select(F.col("node").alias("component"), F.lit(True).alias("changed")).union(hit.withColumn("changed", F.lit(False)))
    return u.groupBy("component").agg(F.max("changed").alias("changed"))


def symbol_blast(calls: DataFrame, symbol: str) -> dict[str, DataFrame]:
    """{'direct': call rows of the bare name, 'transitive': (caller, depth), 'packages'}: who calls a symbol, by bare callee name."""
    e = calls.select(bare_name("target").alias("src"), F.col("source").alias("caller"), bare_name("source").alias("dst")).where("src <> ''")
    seed = calls.sparkSession.createDataFrame([(symbol,)], "node string")
    c = checkpoint(closure(e, seed).select("node", "depth"))
    direct = calls.where(bare_name("target") == symbol)
    hit = e.join(c.select(F.col("node").alias("src"), (F.col("depth") + 1).alias("depth")), "src").groupBy("caller").agg(F.min("depth").alias("depth"))
    return {"direct": direct, "transitive": hit, "packages": hit.select(package_of("caller").alias("package")).distinct()}


def independence(edges: DataFrame, components: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(component, score): fan-in times exports over lines of code (0 counts as 1)."""
    fi = fan_in(edges, src, dst).withColumnRenamed("node", "name")
    j = components.join(fi, "name", "left").fillna(0, ["fan_in"])
    return j.select(F.col("name").alias("component"), (F.col("fan_in") * F.col("n_symbols") / F.when(F.col("loc") == 0, 1).otherwise(F.col("loc"))).alias("score"))


def consumer_similarity(edges: DataFrame, theta: float, src: str = "src", dst: str = "dst") -> DataFrame:
    """(a, b, sim): pairs of components whose consumer sets have a Jaccard similarity of at least theta > 0.

    Exact prefix filter instead of all pairs within a consumer: sets are ordered by how rare their consumers are, and only pairs that
    share a consumer among the first n - ceil(theta n) + 1 meet. Components with the very same consumers meet once, through a representative.
    """
    e = ends(edges, src, dst).distinct()
    rare = e.groupBy("src").agg(F.count(F.lit(1)).alias("df"))
    sets = e.join(rare, "src").groupBy("dst").agg(F.array_sort(F.collect_list(F.struct("df", "src"))).alias("s")).select("dst", F.col("s.src").alias("s"))
    sets = sets.withColumn("key", F.xxhash64(F.array_join("s", "\u0001")))
    same = sets.groupBy("key", "s").agg(F.min("dst").alias("rep"), F.sort_array(F.collect_list("dst")).alias("members"))
    n = F.size("s")
    pre = same.select("rep", "s", F.explode(F.slice("s", 1, F.greatest(F.lit(1), n - F.ceil(F.lit(theta) * n).cast("int") + 1))).alias("tok"))
    x, y = pre.select("tok", F.col("rep").alias("ra"), F.col("s").alias("sa")), pre.select("tok", F.col("rep").alias("rb"), F.col("s").alias("sb"))
    near = x.join(y, "tok").where((F.col("ra") < F.col("rb")) & (F.least(F.size("sa"), F.size("sb")) >= F.lit(theta) * F.greatest(F.size("sa"), F.size("sb"))))
    inter = F.size(F.array_intersect("sa", "sb"))
    sim = (inter / (F.size("sa") + F.size("sb") - inter)).alias("sim")
    reps = near.select("ra", "rb", sim).where(F.col("sim") >= theta).distinct()
    m = same.select("rep", "members")
    across = reps.join(m.withColumnsRenamed({"rep": "ra", "members": "ma"}), "ra").join(m.withColumnsRenamed({"rep": "rb", "members": "mb"}), "rb").select(F.explode("ma").alias("a"), "mb", "sim").select("a", F.explode("mb").alias("b"), "sim")
    # Members of one class form a chain of similarity 1; with them all links are implied.
    inside = m.where(F.size("members") > 1).select("rep", F.explode("members").alias("b")).where("rep <> b").select(F.col("rep").alias("a"), "b", F.lit(1.0).alias("sim"))
    u = across.unionByName(inside)
    return u.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").distinct()


def cohesion_clusters(edges: DataFrame, theta: float = 0.7, src: str = "src", dst: str = "dst") -> DataFrame:
    """(label, members, size, consumers): weak components of the similar pairs, with their number of distinct consumers."""
    pairs = checkpoint(consumer_similarity(edges, theta, src, dst))
    labels = checkpoint(weak_components(pairs, "a", "b"))
    use = ends(edges, src, dst).join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("label").agg(F.countDistinct("src").alias("consumers"))
    return labels.groupBy("label").agg(F.sort_array(F.collect_list("node")).alias("members"), F.count(F.lit(1)).alias("size")).join(use, "label")


def dependency_class(call_sites: Column, loc_surface: Column, weight: Column) -> Column:
    ratio = F.when(weight > 0, call_sites / weight).otherwise(call_sites.cast("double"))
    return F.when(ratio >= 2.0, "enrichment").when(loc_surface > 5, "enrichment").when(weight <= 1, "binary").otherwise("enrichment")


def leverage(edges: DataFrame, components: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(component, enrichment, binary, score) of every component: how its consumers use it."""
    cls = dependency_class(F.col("call_sites"), F.col("loc_surface"), F.col("weight"))
    use = edges.select(F.col(dst).alias("component"), cls.alias("cls")).groupBy("component").agg(F.count_if(F.col("cls") == "enrichment").alias("enrichment"), F.count_if(F.col("cls") == "binary").alias("binary"))
    total = components.agg(F.count(F.lit(1)).alias("total"))  # one row
    out = components.select(F.col("name").alias("component")).join(use, "component", "left").fillna(0).crossJoin(F.broadcast(total))
    return out.select("component", "enrichment", "binary", F.least(F.lit(100), F.floor(100 * (3 * F.col("enrichment") + F.col("binary")) / (3 * F.col("total")))).cast("bigint").alias("score"))


def risk_scores(edges: DataFrame, components: DataFrame, coverage: DataFrame | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """(component, score, level): churn and blast over their maxima and the coverage gap, 40:40:20; without churn and importers there is no row."""
    im = impact(edges, components, src, dst).select(F.col("component").alias("name"), "blast_pct")
    fi = fan_in(edges, src, dst).withColumnRenamed("node", "name")
    j = components.select("name", "churn").join(im, "name").join(fi, "name", "left").fillna(0, ["fan_in"])
    gap = F.lit(1.0)
    if coverage is not None:
        j = j.join(coverage.select(F.col("component").alias("name"), "coverage_pct"), "name", "left")
        gap = F.when(F.col("coverage_pct").isNull(), 1.0).otherwise(1 - F.col("coverage_pct") / 100)
    top = j.agg(F.greatest(F.max("churn"), F.lit(1)).alias("mc"), F.greatest(F.max("blast_pct"), F.lit(1)).alias("mb"))  # one row
    s = j.where("churn <> 0 OR fan_in <> 0").crossJoin(F.broadcast(top))
    score = F.least(F.lit(100.0), 100 * (0.4 * F.col("churn") / F.col("mc") + 0.4 * F.col("blast_pct") / F.col("mb") + 0.2 * gap))
    out = s.select(F.col("name").alias("component"), score.alias("score"))
    return out.withColumn("level", F.when(F.col("score") >= 75, "critical").when(F.col("score") >= 50, "high").when(F.col("score") >= 25, "medium").otherwise("low"))


def fold_moves(moves: list[dict], names: list[str]) -> dict[str, str | None]:
    """Sequential deletes ({'delete': x}) and renames ({'rename': x, 'to': y}) as one mapping; None means deleted."""
    now: dict[str, str | None] = {n: n for n in names}
    for m in moves:
        for k, v in now.items():
            if v is None:
                continue
            if v == m.get("delete"):
                now[k] = None
            elif v == m.get("rename"):
                now[k] = m["to"]
    return now


def what_if(edges: DataFrame, components: DataFrame, moves: list[dict], src: str = "src", dst: str = "dst") -> dict[str, DataFrame]:
    """{'components', 'edges', 'edge_diff': (src, dst, change), 'fan_in_delta'} after the moves; merged components add up their lines and symbols, self-loops fall away."""
    spark = edges.sparkSession
    touched = sorted({x for m in moves for x in m.values()})
    mapping = [(k, v) for k, v in fold_moves(moves, touched).items() if k != v]
    table = F.broadcast(spark.createDataFrame(mapping or [("", "")], "old string, new string").withColumn("hit", F.lit(True)))  # as many rows as moves

    def mapped(df: DataFrame, col: str) -> DataFrame:
        j = df.join(table, df[col] == table["old"], "left")
        return j.withColumn(col, F.when(F.col("hit"), F.col("new")).otherwise(F.col(col))).where(F.col(col).isNotNull()).drop("old", "new", "hit")

    before = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "weight", "call_sites", "loc_surface")
    after = mapped(mapped(before, "src"), "dst").where("src <> dst").groupBy("src", "dst").agg(F.max("weight").alias("weight"), F.sum("call_sites").alias("call_sites"), F.sum("loc_surface").alias("loc_surface"))
    comps = mapped(components.select("name", "loc", "n_symbols"), "name").groupBy("name").agg(F.sum("loc").alias("loc"), F.sum("n_symbols").alias("n_symbols"))
    sides = before.select("src", "dst", F.lit(1).alias("b"), F.lit(0).alias("a")).union(after.select("src", "dst", F.lit(0), F.lit(1))).groupBy("src", "dst").agg(F.max("b").alias("b"), F.max("a").alias("a"))
    diff = sides.where("a <> b").select("src", "dst", F.when(F.col("a") == 1, "added").otherwise("removed").alias("change"))
    x, y = fan_in(before).withColumnRenamed("fan_in", "before"), fan_in(after).withColumnRenamed("fan_in", "after")
    delta = x.join(y, "node", "full_outer").fillna(0).where("before <> after")
    return {"components": comps, "edges": after, "edge_diff": diff, "fan_in_delta": delta}


def cycle_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(members, change) of cycles (column cycle, a->b->c), compared by their sorted members."""
    key = lambda df, k: df.select(F.array_join(F.sort_array(F.split("cycle", "->")), ",").alias("members"), F.lit(k).alias("side"))
    g = key(before, 0).union(key(after, 1)).distinct().groupBy("members").agg(F.sum("side").alias("s"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return g.select("members", F.when(F.col("s") == 1, "new").otherwise("resolved").alias("change"))


def diff_intelligence(symbols: DataFrame, calls: DataFrame, packages: DataFrame) -> DataFrame:
    """(fqn, callers, severity): called symbols of the changed packages, callers counted by bare name."""
    s = symbols.join(packages.select("package").distinct(), "package", "left_semi").select("fqn", "name")
    n = calls.groupBy(bare_name("target").alias("name")).agg(F.count(F.lit(1)).alias("callers"))
    return s.join(n, "name").select("fqn", "callers", F.when(F.col("callers") > 10, "critical").when(F.col("callers") > 3, "error").otherwise("warning").alias("severity"))


def report_diff(components_before: DataFrame, components_after: DataFrame, edges_before: DataFrame, edges_after: DataFrame) -> DataFrame:
    """(kind, item, change, before, after): components and edges added or removed, churn that differs."""
    c = components_before.select("name", F.col("churn").alias("b"), F.lit(True).alias("ib")).join(components_after.select("name", F.col("churn").alias("a"), F.lit(True).alias("ia")), "name", "full_outer")
    both = F.col("ib").isNotNull() & F.col("ia").isNotNull()
    change = F.when(F.col("ib").isNull(), "added").when(F.col("ia").isNull(), "removed").when(both & ~F.col("a").eqNullSafe(F.col("b")), "churn")
    comps = c.select(F.lit("component").alias("kind"), F.col("name").alias("item"), change.alias("change"), F.col("b").cast("bigint").alias("before"), F.col("a").cast("bigint").alias("after"))
    e = lambda df, k: df.select(F.concat("src", F.lit("->"), "dst").alias("item")).distinct().withColumn(k, F.lit(True))
    j = e(edges_before, "ib").join(e(edges_after, "ia"), "item", "full_outer")
    es = j.select(F.lit("edge").alias("kind"), "item", F.when(F.col("ib").isNull(), "added").when(F.col("ia").isNull(), "removed").alias("change"), F.lit(None).cast("bigint").alias("before"), F.lit(None).cast("bigint").alias("after"))
    return comps.unionByName(es).where("change IS NOT NULL")


def scan_diff(components_before: DataFrame, components_after: DataFrame, edges_before: DataFrame, edges_after: DataFrame) -> DataFrame:
    """(added, removed, edges_before, edges_after, loc_before, loc_after, loc_delta), one row."""
    c = components_before.select("name", F.col("loc").alias("b"), F.lit(True).alias("ib")).join(components_after.select("name", F.col("loc").alias("a"), F.lit(True).alias("ia")), "name", "full_outer")
    one = c.agg(F.count_if(F.col("ib").isNull()).alias("added"), F.count_if(F.col("ia").isNull()).alias("removed"), F.coalesce(F.sum("b"), F.lit(0)).alias("loc_before"), F.coalesce(F.sum("a"), F.lit(0)).alias("loc_after"))
    n = lambda df, k: df.select("src", "dst").distinct().agg(F.count(F.lit(1)).alias(k))
    return one.crossJoin(n(edges_before, "edges_before")).crossJoin(n(edges_after, "edges_after")).withColumn("loc_delta", F.col("loc_after") - F.col("loc_before"))  # one row each


def validate_architecture(components: DataFrame, edges: DataFrame, want_components: DataFrame, want_edges: DataFrame) -> DataFrame:
    """(kind, item, status): what the desired architecture lacks or has in excess."""
    c = components.select(F.lit("component").alias("kind"), F.col("name").alias("item")).union(edges.select(F.lit("edge"), F.concat("src", F.lit("->"), "dst")))
    w = want_components.select(F.lit("component").alias("kind"), F.col("name").alias("item")).union(want_edges.select(F.lit("edge"), F.concat("src", F.lit("->"), "dst")))
    u = c.distinct().withColumn("s", F.lit(1)).union(w.distinct().withColumn("s", F.lit(2))).groupBy("kind", "item").agg(F.sum("s").alias("s")).where("s < 3")
    return u.select("kind", "item", F.when(F.col("s") == 1, "extra").otherwise("missing").alias("status"))


def cross_repo(names_a: DataFrame, names_b: DataFrame) -> DataFrame:
    """(name, side): both, a or b."""
    u = names_a.select("name").distinct().withColumn("s", F.lit(1)).union(names_b.select("name").distinct().withColumn("s", F.lit(2))).groupBy("name").agg(F.sum("s").alias("s"))
    return u.select("name", F.when(F.col("s") == 3, "both").when(F.col("s") == 1, "a").otherwise("b").alias("side"))


def new_cycles(edges_a: DataFrame, edges_b: DataFrame, max_len: int | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """(new_cycles), one row: elementary circuits of both repositories' edges together beyond those that each has by itself; never below zero."""
    from .cycles import elementary_cycles

    a, b = ends(edges_a, src, dst), ends(edges_b, src, dst)
    count = lambda e, sign: elementary_cycles(e, max_len).agg((F.count(F.lit(1)) * sign).alias("n"))
    return count(a.union(b), 1).union(count(a, -1)).union(count(b, -1)).agg(F.greatest(F.sum("n"), F.lit(0)).alias("new_cycles"))


def sample_commits(commits: DataFrame, target: int) -> DataFrame:
    """Every k-th commit from the oldest on, and always the last; at most about ``target`` of them. ``commits``: hash, date."""
    from ..runtime import global_rank

    ranked = global_rank(commits, ["date", "hash"], "n")
    total = commits.count()
    stride = max(1, -(-total // max(1, target)))
    return ranked.where(((F.col("n") - 1) % stride == 0) | (F.col("n") == total))


def evolution(steps: DataFrame, order: str, value: str = "value") -> DataFrame:
    """steps (order, value) plus delta to the step before and growth in percent from the first ('new' or '0%' from 0). Steps are few by sampling."""
    w = Window.orderBy(order)
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = steps.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.col(value)))
    growth = F.when(first == 0, F.when(F.col(value) > 0, "new").otherwise("0%")).otherwise(F.concat(F.floor((F.col(value) - first) * 100 / F.when(first == 0, 1).otherwise(first)).cast("string"), F.lit("%")))
    return d.withColumn("growth", growth)
