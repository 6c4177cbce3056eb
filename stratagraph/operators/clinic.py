"""Checks of roles, design principles, patterns and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import health, split_camel
from .constraint import severity_rank
from .cycles import components as cycle_members
from .cycles import two_cycles
from .graph import fan_in, fan_out

ROLE_ORDER = ("entrypoint", "adapter", "infra", "port", "app", "domain")

#: (from role, to role) that the architecture forbids, with their severity (fixed values).
ROLE_RULES = {("domain", "adapter"): "error", ("domain", "infra"): "error", ("port", "adapter"): "error", ("port", "infra"): "error", ("domain", "app"): "warning"}
DIP_RULES = {("domain", "adapter"): "error", ("domain", "infra"): "error", ("app", "adapter"): "warning"}

#: Shortened words at the end of names, names exempt from that, endings that say nothing, words that functions begin with (fixed values).
ABBREVIATIONS = ("Cfg", "Srv", "Mgr", "Impl", "Util", "Hlpr", "Ctx", "Req", "Resp", "Btn", "Msg", "Pkg", "Env", "Tmp", "Buf")
IDIOMS = ("DB", "HTTP", "URL", "API", "ID", "IO", "IP", "TCP", "UDP", "JSON", "XML", "SQL", "CSS", "HTML", "OK", "EOF")
GENERIC = ("Manager", "Helper", "Util", "Utils", "Data", "Info", "Object", "Base", "Common", "General", "Misc")
VERBS = (
    "get set create delete update find run start stop open close read write parse build make check validate compute render handle process init register add remove send receive load save fetch put do "
    "apply enable disable reset clear format convert transform resolve execute marshal unmarshal encode decode scan sort filter map reduce merge split join wrap unwrap lock unlock wait signal notify subscribe "
    "publish listen serve dial connect disconnect flush sync log print dump detect extract infer suggest classify diff generate partition reverse collect cache contain change "
    "is has can must no with new default max min err to from"
).split()

#: Words of one meaning and the word they are counted under (fixed values).
SYNONYMS = {
    "fetch": "get", "retrieve": "get", "obtain": "get", "acquire": "get", "create": "new", "build": "new", "construct": "new", "make": "new", "delete": "remove", "destroy": "remove", "drop": "remove", "erase": "remove",
    "update": "set", "modify": "set", "change": "set", "alter": "set", "mutate": "set", "find": "search", "query": "search", "lookup": "search", "seek": "search", "config": "configuration", "cfg": "configuration", "conf": "configuration",
    "init": "initialize", "setup": "initialize", "err": "error", "fail": "error", "msg": "message", "info": "information", "ctx": "context", "req": "request", "resp": "response", "res": "response",
}


def role_rank(role: Column) -> Column:
    out = F.lit(len(ROLE_ORDER))
    for i, r in reversed(list(enumerate(ROLE_ORDER))):
        out = F.when(role == r, i).otherwise(out)
    return out


def hexa_roles(components: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(component, role) of components (name, has_main, n_interfaces, n_types, n_symbols, external), by the first rule that holds."""
    total = components.agg(F.count(F.lit(1)).alias("n"))  # one row
    j = components.join(fan_in(edges, src, dst).withColumnRenamed("node", "name"), "name", "left").join(fan_out(edges, src, dst).withColumnRenamed("node", "name"), "name", "left")
    j = j.fillna(0, ["fan_in", "fan_out"]).crossJoin(F.broadcast(total))
    ratio = F.when(F.col("n_symbols") > 0, F.col("n_interfaces") / F.col("n_symbols")).otherwise(0.0)
    role = (
        F.when(F.col("has_main"), "entrypoint")
        .when((F.col("fan_out") >= 10) & (F.col("fan_in") <= 1), "entrypoint")
        .when(ratio > 0.5, "port")
        .when(F.col("external"), "adapter")
        .when((F.col("n") > 2) & (F.col("fan_in") / F.col("n") > 0.4) & (F.col("n_types") <= 3), "infra")
        .otherwise("domain")
    )
    return j.select(F.col("name").alias("component"), role.alias("role"))


def resolve_roles(roles: DataFrame, desired: DataFrame) -> DataFrame:
    """Classified roles, overridden by the desired ones."""
    return roles.join(desired.select("component", F.col("role").alias("want")), "component", "full_outer").select("component", F.coalesce("want", "role").alias("role"))


def _role_pairs(edges: DataFrame, roles: DataFrame, rules: dict, src: str, dst: str) -> DataFrame:
    a, b = roles.select(F.col("component").alias("src"), F.col("role").alias("from_role")), roles.select(F.col("component").alias("dst"), F.col("role").alias("to_role"))
    sev = reduce(lambda acc, r: F.when((F.col("from_role") == r[0][0]) & (F.col("to_role") == r[0][1]), r[1]).otherwise(acc), rules.items(), F.lit(None).cast("string"))
    return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).join(a, "src").join(b, "dst").withColumn("severity", sev).where("severity IS NOT NULL")


def hexa_violations(edges: DataFrame, roles: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, dst, from_role, to_role, severity)"""
    return _role_pairs(edges, roles, ROLE_RULES, src, dst).select("src", "dst", "from_role", "to_role", "severity")


def srp(components: DataFrame, edges: DataFrame, roles: DataFrame | None = None, accepted: DataFrame | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """(component, principle, severity, reason): too long with too many imports, or too many domains with too many symbols."""
    fo = fan_out(edges, src, dst).withColumnRenamed("node", "name")
    domains = edges.groupBy(F.col(src).alias("name")).agg(F.countDistinct(F.substring_index(dst, "/", 1)).alias("domains"))
    j = components.join(fo, "name", "left").join(domains, "name", "left").fillna(0, ["fan_out", "domains"])
    if roles is not None:
        j = j.join(roles.where("role = 'entrypoint'").select(F.col("component").alias("name")), "name", "left_anti")
    size = F.when((F.col("loc") > 1000) & (F.col("fan_out") > 8), "size").when((F.col("loc") > 500) & (F.col("fan_out") > 5), "size")
    wide = F.when((F.col("domains") > 3) & (F.col("n_symbols") > 20), "domains")
    out = j.select(F.col("name").alias("component"), F.lit("SRP").alias("principle"), F.lit("warning").alias("severity"), F.explode(F.array_compact(F.array(size, wide))).alias("reason"))
    return suppress(out, accepted)


def isp(interfaces: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """(component, principle, severity, reason) of interfaces (component, name, methods) with more than 5 or 8 methods."""
    out = interfaces.where("methods > 5").select("component", F.lit("ISP").alias("principle"), F.when(F.col("methods") > 8, "error").otherwise("warning").alias("severity"), F.col("name").alias("reason"))
    return suppress(out, accepted)


def ocp(sources: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """(component, principle, severity, reason) of sources (component, source): type switches with more than 5 or 10 cases.

    A switch is read up to the closing bracket at its own indentation, which formatted source has.
    """
    blocks = F.regexp_extract_all("source", F.lit(r"(?m)^([ \t]*)switch [^\n{]*\.\(type\) *\{\n((?:\1[ \t]*[^ \t}\n][^\n]*\n|\1[ \t]+\}[^\n]*\n|[ \t]*\n)*)"), F.lit(2))
    b = sources.select("component", F.explode(blocks).alias("b"))
    n = b.select("component", F.size(F.regexp_extract_all("b", F.lit(r"(?m)^\s*case\b"), F.lit(0))).alias("n")).where("n > 5")
    out = n.select("component", F.lit("OCP").alias("principle"), F.when(F.col("n") > 10, "error").otherwise("warning").alias("severity"), F.concat(F.col("n").cast("string"), F.lit(" cases")).alias("reason"))
    return suppress(out, accepted)


def dip(edges: DataFrame, roles: DataFrame, accepted: DataFrame | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """(component, principle, severity, reason): inner roles that import outer ones."""
    v = _role_pairs(edges, roles, DIP_RULES, src, dst)
    return suppress(v.select(F.col("src").alias("component"), F.lit("DIP").alias("principle"), "severity", F.col("dst").alias("reason")), accepted)


def suppress(violations: DataFrame, accepted: DataFrame | None) -> DataFrame:
    """Without those that the project accepted (component, principle)."""
    return violations if accepted is None else violations.join(accepted.select("component", "principle"), ["component", "principle"], "left_anti").select(*violations.columns)


def solid_scan(*violations: DataFrame) -> dict[str, DataFrame]:
    """{'violations' in order of severity and component, 'summary': (principle, n)}"""
    u = reduce(DataFrame.unionByName, violations)
    return {"violations": u.orderBy(severity_rank(F.col("severity")), "component", "principle", "reason"), "summary": u.groupBy("principle").agg(F.count(F.lit(1)).alias("n"))}


def pattern_scan(edges: DataFrame, cycles: DataFrame | None = None, accepted: DataFrame | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """(pattern, component, confidence): members of cycles of two or more (of those given, column cycle, a->b->c, else of all), and pairs that import each other."""
    on = cycle_members(edges, src, dst).select(F.col("node").alias("component")) if cycles is None else cycles.where("len > 1").select(F.explode(F.split("cycle", "->")).alias("component")).distinct()
    circ = on.select(F.lit("circular_dependency").alias("pattern"), "component", F.lit(1.0).alias("confidence"))
    close = two_cycles(edges, src, dst).select(F.lit("inappropriate_intimacy").alias("pattern"), F.col("a").alias("component"), F.lit(0.9).alias("confidence")).distinct()
    u = circ.unionByName(close)
    return u if accepted is None else u.join(accepted.select("component", F.col("principle").alias("pattern")), ["component", "pattern"], "left_anti").select("pattern", "component", "confidence")


#: Smells that a scan finds by structure alone (fixed values): id, kind, name, about.
CATALOG = (
    ("circular_dependency", "smell", "Circular Dependency", "Mutual dependency cycle"),
    ("inappropriate_intimacy", "smell", "Inappropriate Intimacy", "Bidirectional coupling between components"),
)


def pattern_catalog(spark, text: str = "") -> DataFrame:
    """(id, kind, name, about): all, those of a kind, or those that hold the text."""
    df = spark.createDataFrame(list(CATALOG), "id string, kind string, name string, about string")
    if not text or text == "all":
        return df
    if text in ("smell", "pattern"):
        return df.where(F.col("kind") == text)
    return df.where(reduce(lambda a, b: a | b, [F.lower(c).contains(text.lower()) for c in df.columns]))


def symbol_quality(symbols: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(fqn, issue, severity): abbreviated, generic or, for exported functions, verbless names; with weights (node, weighted_fan_in), in the order of severity and weight."""
    word = F.element_at(split_camel("name"), -1)
    short = F.when(~F.col("name").isin(*IDIOMS) & word.isin(*ABBREVIATIONS) & (F.length("name") > F.length(word)), F.struct(F.lit("abbreviation").alias("issue"), F.lit("info").alias("severity")))
    vague = F.when(word.isin(*GENERIC) & (F.length("name") - F.length(word) < 3), F.struct(F.lit("generic_name").alias("issue"), F.lit("warning").alias("severity")))
    first = F.lower(F.element_at(split_camel("name"), 1))
    verbless = F.when(F.col("exported") & F.col("kind").isin("function", "method") & ~first.isin(*VERBS), F.struct(F.lit("verbless").alias("issue"), F.lit("info").alias("severity")))
    out = symbols.select("fqn", F.explode(F.array_compact(F.array(short, vague, verbless))).alias("q")).select("fqn", "q.issue", "q.severity")
    if weights is not None:
        out = out.join(weights.select(F.col("node").alias("fqn"), "weighted_fan_in"), "fqn", "left").fillna(0, ["weighted_fan_in"])
        out = out.orderBy(severity_rank(F.col("severity")), F.desc("weighted_fan_in"), "fqn", "issue")
    return out


def vocabulary(symbols: DataFrame) -> DataFrame:
    """(canonical, variants, packages): words of one meaning that go by several names in several packages."""
    syn = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    w = symbols.select("package", F.explode(F.transform(split_camel("name"), F.lower)).alias("word")).distinct()
    w = w.withColumn("canonical", F.coalesce(syn[F.col("word")], F.col("word")))
    g = w.groupBy("canonical").agg(F.sort_array(F.collect_set("word")).alias("variants"), F.countDistinct("package").alias("packages"))
    return g.where((F.size("variants") > 1) & (F.col("packages") > 1))


def component_meta(components: DataFrame, edges: DataFrame, depths: DataFrame | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """(component, role, keywords, health, depth) of components (name, symbols array<string>, churn)."""
    j = components.join(fan_in(edges, src, dst).withColumnRenamed("node", "name"), "name", "left").fillna(0, ["fan_in"])
    top = F.substring_index("name", "/", 1)
    role = F.when(top == "cmd", "entrypoint").when(top.isin("internal", "pkg", "lib"), "library").when(top == "test", "test").otherwise("component")
    words = F.array_distinct(F.concat(F.split(F.lower("name"), "/"), F.transform(F.slice(F.coalesce("symbols", F.expr("cast(array() as array<string>)")), 1, 10), F.lower)))
    out = j.select(F.col("name").alias("component"), role.alias("role"), words.alias("keywords"), health(F.col("fan_in"), F.coalesce("churn", F.lit(0))).alias("health"))
    if depths is not None:
        out = out.join(depths.select(F.col("node").alias("component"), "depth"), "component", "left")
    return out
