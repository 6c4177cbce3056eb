"""Questions about symbols: vitals, traces, convergence, isolation, entry points, islands, diagnosis, diffs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import instability, package_of
from ..runtime import checkpoint
from .graph import SMALL, closure, component_count, ends, fetch_small, nodes_of, resolve_symbol

TYPE_KINDS = ("struct", "interface")


def probe_all(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Vitals of every symbol: (fqn, fan_in, fan_out, instability, cross_pkg, circuits, boundaries).

    Both fans count rows; cross_pkg counts outgoing rows whose target's package differs; circuits counts distinct neighbours both ways (a
    self-loop counts 1); boundaries is the number of distinct target packages.
    """
    e = edges.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL")
    # One row per direction and end, aggregated once: no join of the edge table with itself.
    both = e.select(F.explode(F.array(F.struct(F.col("source").alias("fqn"), F.col("target").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("fqn"), F.col("source").alias("other"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    pair = both.groupBy("fqn", "other").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    # A package counts where something is called in it.
    per = pair.groupBy("fqn", package_of("other").alias("pkg")).agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.sum(F.when((F.col("o") > 0) & (F.col("i") > 0), 1).otherwise(0)).alias("c"))
    vit = per.join(nodes.select("fqn", F.col("package").alias("own")), "fqn").groupBy("fqn").agg(
        F.sum("i").alias("fan_in"),
        F.sum("o").alias("fan_out"),
        F.sum(F.when(F.col("pkg") != F.col("own"), F.col("o")).otherwise(0)).alias("cross_pkg"),
        F.sum("c").alias("circuits"),
        F.sum(F.when(F.col("o") > 0, 1).otherwise(0)).alias("boundaries"),
    )
    out = nodes.select("fqn").join(vit, "fqn", "left").fillna(0)
    return out.select("fqn", "fan_in", "fan_out", instability(F.col("fan_in"), F.col("fan_out")).alias("instability"), "cross_pkg", "circuits", "boundaries")


def probe(nodes: DataFrame, edges: DataFrame, symbol: str) -> DataFrame:
    """Vitals of one symbol; a struct or interface also absorbs all symbols below it."""
    name = resolve_symbol(nodes, symbol)
    own = nodes.where(F.col("fqn") == name).select("fqn", "package", "kind")
    row = own.limit(1).collect()
    if not row:
        return own.limit(0)
    is_type = row[0]["kind"] in TYPE_KINDS
    mine = lambda c: (F.col(c) == name) | (F.col(c).startswith(name + ".") if is_type else F.lit(False))
    e = edges.where(mine("source") | mine("target"))
    out, inn = mine("source"), mine("target")
    agg = e.agg(
        F.count_if(inn).alias("fan_in"),
        F.count_if(out).alias("fan_out"),
        F.count_if(out & (package_of("target") != F.lit(row[0]["package"] or ""))).alias("cross_pkg"),
        F.size(F.array_intersect(F.collect_set(F.when(out, F.col("target"))), F.collect_set(F.when(inn, F.col("source"))))).alias("circuits"),
        F.sort_array(F.collect_set(F.when(out, package_of("target")))).alias("boundaries"),
    )
    return own.limit(1).crossJoin(agg).withColumn("instability", instability(F.col("fan_in"), F.col("fan_out")))


def probe_types(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fqn, fan_in, fan_out) of all structs and interfaces, with what hangs below them; by an equality join on every name's prefixes."""
    types = nodes.where(F.col("kind").isin(*TYPE_KINDS)).select("fqn")
    ends_ = edges.select(F.explode(F.array(F.struct(F.col("source").alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("n"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    per = ends_.groupBy("n").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    parts = F.split("n", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    up = per.select(F.explode(prefixes).alias("fqn"), "o", "i")
    hit = up.join(types, "fqn", "left_semi").groupBy("fqn").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return types.join(hit, "fqn", "left").fillna(0)


def scenario(nodes: DataFrame, edges: DataFrame, symbol: str, max_depth: int, stress: bool = False, top_n: int | None = None, only: str | None = None) -> dict[str, DataFrame] | None:
    """Down- and upstream of a symbol within ``max_depth`` hops: {'downstream', 'upstream', 'edges'}; None for an unknown symbol or no depth.

    With ``only`` one of the two sides, that alone is searched.
    """
    name = resolve_symbol(nodes, symbol) if max_depth > 0 else None
    if name is None:
        return None
    spark = edges.sparkSession
    seed = spark.createDataFrame([(name,)], "node string")
    e = edges.select("source", "target", "kind")
    side = lambda a, b, sign: checkpoint(closure(e, seed, a, b, max_depth).where("depth > 0").select(F.col("node").alias("fqn"), (sign * F.col("depth")).alias("depth")))
    nothing = seed.select(F.col("node").alias("fqn"), F.lit(0).alias("depth")).limit(0)
    down = nothing if only == "upstream" else side("source", "target", 1)
    up = nothing if only == "downstream" else side("target", "source", -1)
    leaf = down.join(e.select(F.col("source").alias("fqn")).distinct().withColumn("has", F.lit(True)), "fqn", "left").select("fqn", "depth", F.col("has").isNull().alias("leaf"))
    entry = up.join(e.select(F.col("target").alias("fqn")).distinct().withColumn("has", F.lit(True)), "fqn", "left").select("fqn", "depth", F.col("has").isNull().alias("entry"))
    if stress:
        out = e.groupBy(F.col("source").alias("fqn")).agg(F.count(F.lit(1)).alias("fan_out"))
        full = closure(e, down.select(F.col("fqn").alias("node")), "source", "target").groupBy(F.col("seed").alias("fqn")).agg((F.count(F.lit(1)) - 1).alias("downstream_count"))
        leaf = leaf.join(out, "fqn", "left").join(full, "fqn", "left").fillna(0, ["fan_out", "downstream_count"])
    if only is not None:
        return {only: (leaf if top_n is None else leaf.orderBy("depth", "fqn").limit(top_n)) if only == "downstream" else entry}
    seen = down.select("fqn").union(up.select("fqn")).union(seed).distinct()
    induced = e.join(seen.select(F.col("fqn").alias("source")), "source", "left_semi").join(seen.select(F.col("fqn").alias("target")), "target", "left_semi").select("source", "target", "kind")
    if top_n is not None:
        leaf = leaf.orderBy("depth", "fqn").limit(top_n)
    return {"downstream": leaf, "upstream": entry, "edges": induced}


def convergence(nodes: DataFrame, edges: DataFrame, symbols: list[str], top_n: int | None = None) -> dict[str, DataFrame]:
    """{'nodes': (fqn, count, sources), 'edges'}: what at least two of the symbols reach; a symbol doesn't count for itself."""
    spark = edges.sparkSession
    names = sorted({n for n in (resolve_symbol(nodes, s) for s in symbols) if n})
    if len(names) < 2:
        return {"nodes": spark.createDataFrame([], "fqn string, count long, sources array<string>"), "edges": edges.select("source", "target", "kind").limit(0)}
    reach = closure(edges, spark.createDataFrame([(n,) for n in names], "node string"), "source", "target").where("seed <> node")
    hit = checkpoint(reach.groupBy(F.col("node").alias("fqn")).agg(F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_set("seed")).alias("sources")).where("count >= 2"))
    induced = edges.select("source", "target", "kind").join(hit.select(F.col("fqn").alias("source")), "source", "left_semi").join(hit.select(F.col("fqn").alias("target")), "target", "left_semi").select("source", "target", "kind")
    return {"nodes": hit.orderBy(F.desc("count"), "fqn").limit(top_n) if top_n is not None else hit, "edges": induced}


def isolate(nodes: DataFrame, edges: DataFrame, symbol: str) -> DataFrame:
    """(before, after): weak components over the listed nodes with and without the symbol."""
    n = nodes.select(F.col("fqn").alias("node"))
    before = component_count(edges, n, "source", "target").withColumnRenamed("components", "before")
    after = component_count(edges, n.where(F.col("node") != symbol), "source", "target").withColumnRenamed("components", "after")
    return before.crossJoin(after)  # one row each


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fqn): exported symbols that call and that nothing calls."""
    calls = edges.where("kind = 'call'")
    n = nodes.where("exported").select("fqn")
    return n.join(calls.select(F.col("target").alias("fqn")), "fqn", "left_anti").join(calls.select(F.col("source").alias("fqn")), "fqn", "left_semi").distinct()


def islands(nodes: DataFrame, edges: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(fqn): nodes that no entry point reaches over any edge."""
    start = (entry_points(nodes, edges) if entries is None else entries).select(F.col("fqn").alias("node"))
    return nodes.select("fqn").join(reach_from(edges, start).select(F.col("node").alias("fqn")), "fqn", "left_anti")


def reach_from(edges: DataFrame, start: DataFrame, src: str = "source", dst: str = "target", small: int = SMALL) -> DataFrame:
    """(node): the union of the closures of all start nodes; one state a node, whatever the number of starts.

    Where there are at most ``small`` edges and starts, they are searched at once, otherwise by one join a hop.
    """
    e = ends(edges, src, dst).distinct()
    frontier = checkpoint(start.select("node").where("node IS NOT NULL").distinct())
    first = frontier.limit(small + 1).collect()
    pairs = fetch_small(e, small) if len(first) <= small else None
    if pairs is not None:
        after: dict[str, list[str]] = {}
        for a, b in pairs:
            after.setdefault(a, []).append(b)
        seen = dict.fromkeys(r["node"] for r in first)
        todo = list(seen)
        for a in todo:
            for b in after.get(a, ()):
                if b not in seen:
                    seen[b] = None
                    todo.append(b)
        return edges.sparkSession.createDataFrame([(n,) for n in seen], "node string")
    parts = [frontier]
    while True:
        step = frontier.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = checkpoint(step.join(reduce(DataFrame.union, parts), "node", "left_anti"))
        if frontier.isEmpty():
            return reduce(DataFrame.union, parts)
        parts.append(frontier)


def diagnosis_keywords(vitals: dict) -> list[str]:
    """Search words for the knowledge graph from a symbol's vitals."""
    is_type = vitals["kind"] in TYPE_KINDS
    out: list[str] = []
    if vitals["fan_out"] > 6:
        out += ["fan-out"] + ([] if is_type else ["god", "facade"])
    if vitals["fan_in"] > 8:
        out += ["fan-in", "hub", "stability"]
    if vitals["circuits"] > 0:
        out += ["circular", "coupling"]
    return out + (["types", "cohesion", "data-class"] if is_type else [vitals["kind"] or ""])


def diff_symbols(before: DataFrame, after: DataFrame) -> DataFrame:
    """(fqn, change): added, removed, or modified where the signature differs; unchanged symbols give no row."""
    b, a = before.select("fqn", F.col("signature").alias("sb"), F.lit(1).alias("b")), after.select("fqn", F.col("signature").alias("sa"), F.lit(1).alias("a"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("sb").eqNullSafe(F.col("sa")), "modified")
    return b.join(a, "fqn", "full_outer").select("fqn", change.alias("change")).where("change IS NOT NULL")


def merge_symbols(*tables: DataFrame) -> DataFrame:
    """Union of symbol tables; of one name the first table's row wins, within a table the smallest (file, line)."""
    parts = [t.withColumn("_p", F.lit(i)) for i, t in enumerate(tables)]
    u = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    u = u.withColumn("name", F.regexp_replace("name", r"^\*+", "")) if "name" in u.columns else u
    cols = [c for c in u.columns if c not in ("_p", "fqn")]
    return u.groupBy("fqn").agg(F.min_by(F.struct(*cols), F.struct("_p", "file", "line")).alias("x")).select("fqn", *[F.col(f"x.{c}").alias(c) for c in cols])


def merge_edges(*tables: DataFrame) -> DataFrame:
    """Union of edge tables, one row for each (source, target, kind); the first table's wins."""
    parts = [t.withColumn("_p", F.lit(i)) for i, t in enumerate(tables)]
    u = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    rest = [c for c in u.columns if c not in ("_p", "source", "target", "kind")]
    g = u.groupBy("source", "target", "kind")
    return g.agg(F.min_by(F.struct(*rest), F.col("_p")).alias("x")).select("source", "target", "kind", *[F.col(f"x.{c}").alias(c) for c in rest]) if rest else g.agg(F.min("_p").alias("_p")).drop("_p")


def resolve_callees(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls (package, callee, ...) plus (target): a function of that name in the same package, else any (the smallest package)."""
    same = symbols.groupBy(F.col("package").alias("p"), F.col("name").alias("n")).agg(F.min("fqn").alias("same"))
    anywhere = symbols.groupBy(F.col("name").alias("n2")).agg(F.min_by("fqn", F.struct("package", "fqn")).alias("any"))
    j = calls.join(same, (F.col("package") == F.col("p")) & (F.col("callee") == F.col("n")), "left").join(anywhere, F.col("callee") == F.col("n2"), "left")
    return j.select(*calls.columns, F.coalesce("same", "any").alias("target"))


def enrich_types(edges: DataFrame, signatures: DataFrame) -> DataFrame:
    """Fills missing param_types and return_types of edges by (file, line), else by the target's name; ``signatures``: file, line, name, param_types, return_types."""
    at = signatures.groupBy(F.col("file").alias("f"), F.col("line").alias("l")).agg(F.min_by(F.struct("param_types", "return_types"), "name").alias("a"))
    by = signatures.groupBy(F.col("name").alias("n")).agg(F.min_by(F.struct("param_types", "return_types"), F.struct("file", "line")).alias("b"))
    j = edges.join(at, (F.col("file") == F.col("f")) & (F.col("line") == F.col("l")), "left").join(by, F.regexp_extract("target", r"([^.]*)$", 1) == F.col("n"), "left")
    fill = lambda c: F.when(F.size(F.coalesce(c, F.expr("array()"))) > 0, F.col(c)).otherwise(F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}"))).alias(c)
    return j.select(*[fill(c) if c in ("param_types", "return_types") else F.col(c) for c in edges.columns])


def call_graph_walk(nodes: DataFrame, edges: DataFrame, max_depth: int = 10, entry: str | None = None) -> dict[str, DataFrame]:
    """{'nodes': (fqn, depth), 'edges'} from all exported symbols or one entry; nodes at the limit are kept but not followed; callees outside of the nodes give edges, no nodes."""
    start = nodes.where(F.col("fqn") == entry) if entry else nodes.where("exported")
    e = edges.where("kind = 'call'").select("source", "target")
    inner = e.join(nodes.select(F.col("fqn").alias("target")), "target", "left_semi").select("source", "target")
    frontier = checkpoint(start.select(F.col("fqn").alias("node"), F.lit(0).alias("depth")).distinct())
    parts = [frontier]
    for depth in range(1, max_depth + 1):
        step = frontier.join(inner, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, parts).select("node")
        frontier = checkpoint(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        parts.append(frontier)
    found = reduce(DataFrame.unionByName, parts)
    walked = found.where(F.col("depth") < max_depth).select(F.col("node").alias("source"))
    return {"nodes": found.select(F.col("node").alias("fqn"), "depth"), "edges": e.join(walked, "source", "left_semi").distinct()}


def data_flow(nodes: DataFrame, edges: DataFrame, entry: str, max_depth: int = 8) -> dict[str, DataFrame]:
    """{'nodes': (name, kind), 'edges': (source, target, label)}: the walk from an entry; a call into a data store becomes an edge to '<package> Store'."""
    w = call_graph_walk(nodes, edges, max_depth, entry)
    store = F.lower(F.concat_ws(" ", package_of("target"))).rlike("(store|repository|repo|database|db|cache|dao)(/|$)")
    named = F.regexp_extract(package_of("target"), r"([^/]*)$", 1)
    e = w["edges"].select("source", F.when(store, F.concat(named, F.lit(" Store"))).otherwise(F.col("target")).alias("target"), F.when(store, F.regexp_extract("target", r"([^.]*)$", 1)).otherwise(F.lit("")).alias("label"), store.alias("s")).distinct()
    ends_ = e.select(F.col("source").alias("name"), F.lit("process").alias("kind")).union(e.select("target", F.when(F.col("s"), "data_store").otherwise("process")))
    kind = F.when(F.col("name") == entry, "entry").otherwise(F.min("kind"))
    return {"nodes": ends_.groupBy("name").agg(kind.alias("kind")), "edges": e.drop("s")}


def state_transitions(rows: DataFrame, entity: str, state: str, order: list[str]) -> DataFrame:
    """(from_state, to_state, n): changes of state in each entity's order."""
    from pyspark.sql import Window

    lag = F.lag(state).over(Window.partitionBy(entity).orderBy(*order))
    t = rows.select(lag.alias("from_state"), F.col(state).alias("to_state")).where("from_state IS NOT NULL AND to_state IS NOT NULL AND from_state <> to_state")
    return t.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
