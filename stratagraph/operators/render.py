"""Text forms of results. Every renderer is one aggregation to a single string; inputs are component graphs or cut by ``top``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bare_name, first_segments, health, mermaid_id, package_of
from .graph import fan_in


def joined(df: DataFrame, line: Column, order: list[Column | str], head: str, name: str = "text", sep: str = "\n") -> DataFrame:
    """(text), one row: the lines in order below a head."""
    rows = df.select(F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)], line.alias("line")).alias("x"))
    return rows.agg(F.concat_ws(sep, F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), sep)).alias(name))


def arrow(a: str, b: str, label: Column | None = None) -> Column:
    mid = F.lit(" --> ") if label is None else F.concat(F.lit(" -->|"), label, F.lit("| "))
    return F.concat(F.lit("  "), mermaid_id(a), mid, mermaid_id(b))


def edge_list(edges: DataFrame) -> DataFrame:
    return joined(edges, F.concat_ws(" -> ", "src", "dst"), ["src", "dst"], "edges:")


def markdown_table(df: DataFrame, columns: list[str], order: list[Column | str]) -> DataFrame:
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    return joined(df, F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |")), order, head)


def json_report(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(json), one row."""
    c = components.agg(F.array_sort(F.collect_list(F.struct(*sorted(components.columns)))).alias("components"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct("src", "dst", *[x for x in sorted(edges.columns) if x not in ("src", "dst")]))).alias("edges"))
    return c.crossJoin(e).select(F.to_json(F.struct("components", "edges")).alias("json"))  # one row each


def facts(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(fact): one sentence an edge and a component."""
    e = edges.select(F.concat_ws(" ", "src", F.lit("depends on"), "dst", F.lit("with"), F.col("weight").cast("string"), F.lit("uses.")).alias("fact"))
    return e.union(components.select(F.concat_ws(" ", "name", F.lit("has"), F.col("loc").cast("string"), F.lit("lines.")).alias("fact")))


# -- diagrams ------------------------------------------------------------------------------------------------


def dependency(components: DataFrame, edges: DataFrame, scope: str | None = None, **_) -> DataFrame:
    """Imports with the importers' number; a scope keeps its direct neighbours."""
    e = edges if scope is None else edges.where((F.col("src") == scope) | (F.col("dst") == scope))
    fi = fan_in(edges).withColumnRenamed("node", "dst")
    return joined(e.join(fi, "dst", "left"), arrow("src", "dst", F.concat(F.lit("fan-in "), F.coalesce("fan_in", F.lit(0)).cast("string"))), ["src", "dst"], "graph TD")


def c4(components: DataFrame, edges: DataFrame, depth: int = 1, **_) -> DataFrame:
    e = edges.select(first_segments("src", depth).alias("a"), first_segments("dst", depth).alias("b")).where("a <> b").distinct()
    return joined(e, F.concat(F.lit("  Rel("), mermaid_id("a"), F.lit(", "), mermaid_id("b"), F.lit(', "uses")')), ["a", "b"], "C4Container")


def tree(components: DataFrame, edges: DataFrame, depth: int = 1, **_) -> DataFrame:
    fi = fan_in(edges).withColumnRenamed("node", "name")
    g = components.join(fi, "name", "left").fillna(0, ["fan_in"]).withColumn("h", health(F.col("fan_in"), F.col("churn")))
    return joined(g, F.concat(F.lit("  "), "package", F.lit("/"), "name", F.lit(" ["), F.col("n_symbols").cast("string"), F.lit("] "), "h"), ["package", "name"], "tree")


def layers(components: DataFrame, edges: DataFrame, **_) -> DataFrame:
    from .cycles import import_depth

    d = import_depth(edges)
    return joined(d, F.concat(F.lit("  "), F.when(F.col("depth") < 0, "Cycle").otherwise(F.concat(F.lit("L"), F.col("depth").cast("string"))), F.lit(": "), "node"), ["depth", "node"], "layers")


def zones(components: DataFrame, edges: DataFrame, **_) -> DataFrame:
    zone = lambda c: F.when(F.col(c).contains("/"), F.substring_index(c, "/", 1)).otherwise(F.lit("(root)"))
    e = edges.select(zone("src").alias("a"), zone("dst").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return joined(e, arrow("a", "b", F.col("n").cast("string")), ["a", "b"], "graph LR")


def dsm(components: DataFrame, edges: DataFrame, **_) -> DataFrame:
    """(src, then one column a component): the dependency matrix in an order that keeps neighbours close."""
    from .kernels import rcm_order

    order = [r["node"] for r in rcm_order(edges).orderBy("pos").collect()]  # component graphs: the kernel has checked the size
    pos = F.create_map(*[F.lit(x) for i, n in enumerate(order) for x in (n, i)])
    return edges.groupBy("src").pivot("dst", order).agg(F.sum("weight")).fillna(0).orderBy(pos[F.col("src")])


def sequence(calls: DataFrame, nodes: DataFrame, start: str, depth: int = 5, **_) -> DataFrame:
    from .primitives import call_graph_walk

    w = call_graph_walk(nodes, calls, depth, start)
    e = w["edges"].join(w["nodes"].select(F.col("fqn").alias("source"), "depth"), "source")
    return joined(e, F.concat(F.lit("  "), mermaid_id(bare_name("source")), F.lit("->>"), mermaid_id(package_of("target")), F.lit(": "), bare_name("target")), ["depth", "source", "target"], "sequenceDiagram")


def callgraph(calls: DataFrame, nodes: DataFrame, start: str, depth: int = 3, **_) -> DataFrame:
    from .primitives import call_graph_walk

    e = call_graph_walk(nodes, calls, depth, start)["edges"]
    return joined(e, arrow("source", "target"), [package_of("source"), "source", "target"], "graph LR")


def dataflow(calls: DataFrame, nodes: DataFrame, start: str, depth: int = 8, **_) -> DataFrame:
    from .primitives import data_flow

    return joined(data_flow(nodes, calls, start, depth)["edges"], arrow("source", "target", F.col("label")), ["source", "target"], "graph LR")


def state(transitions: DataFrame, top: int | None = None, **_) -> DataFrame:
    t = transitions if top is None else transitions.orderBy(F.desc("n"), "from_state", "to_state").limit(top)
    return joined(t, F.concat(F.lit("  "), "from_state", F.lit(" --> "), "to_state", F.lit(" : "), F.col("n").cast("string")), ["from_state", "to_state"], "stateDiagram-v2")


def class_diagram(classes: DataFrame, impls: DataFrame, **_) -> DataFrame:
    c = joined(classes, F.concat(F.lit("  class "), "name", F.when(F.col("kind") == "interface", F.lit(" {\n    <<interface>>\n  }")).otherwise("")), ["name", "kind"], "classDiagram", "a")
    i = joined(impls.where("kind <> 'field_ref'"), F.concat(F.lit("  "), "to", F.when(F.col("kind") == "implements", F.lit(" <|.. ")).otherwise(F.lit(" <|-- ")), "from"), ["to", "from"], "", "b")
    return c.crossJoin(i).select(F.concat("a", "b").alias("text"))  # one row each


def interfaces(classes: DataFrame, impls: DataFrame, **_) -> DataFrame:
    return joined(impls.where("kind = 'implements'"), F.concat(F.lit("  "), "to", F.lit(" <|.. "), "from"), ["to", "from"], "classDiagram")


def er(classes: DataFrame, refs: DataFrame, **_) -> DataFrame:
    clean = F.regexp_replace(F.regexp_replace("ref_type", r"\*", "ptr_"), r"\[\]", "slice_")
    e = refs.select("owner", clean.alias("t"), "field").join(classes.select(F.col("name").alias("owner")).distinct(), "owner", "left_semi").groupBy("owner", "t").agg(F.min("field").alias("field"))
    return joined(e, F.concat(F.lit("  "), mermaid_id("owner"), F.lit(" ||--o{ "), mermaid_id("t"), F.lit(" : "), "field"), ["owner", "t"], "erDiagram")


def coupling(components: DataFrame, edges: DataFrame, top: int = 30, **_) -> DataFrame:
    """Sankey rows by the first positive of call sites, lines and weight."""
    pos = lambda c: F.when(F.col(c) > 0, F.col(c))
    e = edges.select("src", "dst", F.coalesce(pos("call_sites"), pos("loc_surface"), pos("weight"), F.lit(1)).alias("v")).orderBy(F.desc("v"), "src", "dst").limit(top)
    quote = lambda c: F.when(F.col(c).rlike('[",]'), F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))).otherwise(F.col(c))
    return joined(e, F.concat_ws(",", quote("src"), quote("dst"), F.col("v").cast("string")), [-F.col("v"), "src", "dst"], "sankey-beta")


def churn(components: DataFrame, edges: DataFrame, top: int = 10, **_) -> DataFrame:
    return joined(components.orderBy(F.desc("churn"), "name").limit(top), F.concat(F.lit("  "), "name", F.lit(": "), F.col("churn").cast("string")), [-F.col("churn"), "name"], "churn")


def hexa(roles: DataFrame, violations: DataFrame, **_) -> DataFrame:
    a = joined(roles, F.concat(F.lit("  "), mermaid_id("component"), F.lit(":::"), "role"), ["role", "component"], "graph TD", "a")
    b = joined(violations, arrow("src", "dst", F.col("severity")), ["src", "dst"], "", "b")
    return a.crossJoin(b).select(F.concat("a", "b").alias("text"))  # one row each


DIAGRAMS = {
    "dependency": dependency, "c4": c4, "tree": tree, "layers": layers, "zones": zones, "dsm": dsm, "symbol_dsm": dsm, "sequence": sequence, "callgraph": callgraph, "dataflow": dataflow, "state": state,
    "classes": class_diagram, "interfaces": interfaces, "er": er, "coupling": coupling, "churn": churn, "hexa": hexa,
}


def render(kind: str, **tables) -> DataFrame:
    if kind not in DIAGRAMS:
        raise ValueError(f"unknown diagram {kind!r}; known: {', '.join(DIAGRAMS)}")
    return DIAGRAMS[kind](**tables)
