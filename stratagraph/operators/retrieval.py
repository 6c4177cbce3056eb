"""Keyword retrieval and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bare_name, health
from .graph import closure, fan_in, fan_out, shortest_path, undirected

#: Words without a meaning of their own (fixed values).
STOP_WORDS = ("a", "an", "the", "is", "are", "in", "on", "at", "to", "for", "of", "and", "or", "my", "me", "i", "it", "do", "does", "this", "that", "with", "from", "can", "how")


def book_tokens(text: Column) -> Column:
    """Lower-case words without punctuation around them and over one character; repeated words stay."""
    w = F.transform(F.split(F.lower(F.trim(text)), r"\s+"), lambda x: F.regexp_replace(x, r"^\p{Punct}+|\p{Punct}+$", ""))
    return F.filter(w, lambda x: F.length(x) > 1)


def book_score(tokens: Column, keywords: Column) -> Column:
    """Matches (equal, containing or contained) over tokens + keywords - matches."""
    kw = F.transform(keywords, F.lower)
    hits = F.size(F.filter(tokens, lambda t: F.exists(kw, lambda k: (k == t) | k.contains(t) | t.contains(k))))
    return hits / F.greatest(F.lit(1), F.size(tokens) + F.size(kw) - hits)


def book_query(nodes: DataFrame, edges: DataFrame, query: str, hops: int = 1, roots: int = 3) -> dict[str, DataFrame]:
    """{'roots', 'nodes', 'edges'}: the best entries (id, keywords, ...) and what lies within the hops around them."""
    score = book_score(book_tokens(F.lit(query)), F.col("keywords"))
    best = nodes.select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(roots)
    found = closure(undirected(edges, "from", "to"), best.select(F.col("id").alias("node")), max_depth=hops).select(F.col("node").alias("id")).distinct()
    near = nodes.join(found, "id", "left_semi")
    e = edges.join(found.withColumnRenamed("id", "from"), "from", "left_semi").join(found.withColumnRenamed("id", "to"), "to", "left_semi")
    return {"roots": best, "nodes": near, "edges": e}


def triage_tokens(text: Column) -> Column:
    w = F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda x: F.length(x) > 0)
    return F.filter(w, lambda x: ~x.isin(*STOP_WORDS))


def triage_score(tokens: Column, keywords: Column) -> Column:
    """Jaccard of words and keywords where a word that shares a prefix with a keyword counts half; repeated words count each time above, once below."""
    kw = F.transform(keywords, F.lower)
    exact = F.size(F.filter(tokens, lambda t: F.array_contains(kw, t)))
    prefix = F.size(F.filter(tokens, lambda t: ~F.array_contains(kw, t) & F.exists(kw, lambda k: (F.length(t) >= 3) & (F.length(k) >= 3) & (k.startswith(t) | t.startswith(k)))))
    union = F.size(F.array_union(F.array_distinct(tokens), kw))
    return F.when(union > 0, (exact + 0.5 * prefix) / union).otherwise(0.0)


def triage(tools: DataFrame, intent: str) -> DataFrame:
    """(tool, category, score, confidence): tools (name, categories, keywords, priority) of the best category; scan_project where nothing fits."""
    t = tools.select("name", "priority", F.explode("categories").alias("category"), triage_score(triage_tokens(F.lit(intent)), F.col("keywords")).alias("score"))
    cats = t.groupBy("category").agg(F.sum("score").alias("total"))
    best = cats.where("total > 0").orderBy(F.desc("total"), "category").limit(1)
    n = cats.agg(F.count(F.lit(1)).alias("n_cats"))  # one row
    out = t.join(best, "category").where("score > 0").crossJoin(F.broadcast(n)).select(F.col("name").alias("tool"), "category", "score", F.least(F.lit(1.0), F.col("total") / F.col("n_cats")).alias("confidence"), "priority")
    if out.isEmpty():
        return tools.sparkSession.createDataFrame([("scan_project", "fallback", 0.0, 0.0, 0)], "tool string, category string, score double, confidence double, priority int")
    return out.orderBy("priority", F.desc("score"), "tool")


#: Words that name an action in a question, in the order they are tried (fixed values).
ROUTES = (
    ("coupling view=hot_spots", ("risk", "hot")),
    ("cycles", ("cycle", "circular")),
    ("deps", ("depend", "import", "who uses")),
    ("violations", ("violat", "layer")),
    ("scan_diff", ("change", "diff", "what changed")),
    ("preset=architecture_review", ("overview", "architect")),
    ("preset=health_check", ("health", "status")),
    ("preset=onboarding", ("onboard", "getting started")),
)


def route(question: Column) -> Column:
    """The action that the first matching words name; none otherwise."""
    out = F.lit("none")
    for action, words in reversed(ROUTES):
        out = F.when(reduce(lambda a, b: a | b, [F.lower(question).contains(w) for w in words]), action).otherwise(out)
    return out


def search_symbols(nodes: DataFrame, pattern: str) -> DataFrame:
    """Exported symbols whose name holds the pattern, in any case of letters."""
    return nodes.where(F.col("exported") & F.lower("name").contains(pattern.lower()))


def search_components(components: DataFrame, query: str) -> DataFrame:
    return components.where(F.lower("name").contains(query.lower()))


def dependencies(edges: DataFrame, component: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """(direction, other): what a component imports and what imports it."""
    out = edges.where(F.col(src) == component).select(F.lit("out").alias("direction"), F.col(dst).alias("other"))
    return out.union(edges.where(F.col(dst) == component).select(F.lit("in"), F.col(src)))


def callers(calls: DataFrame, symbol: str) -> DataFrame:
    """(caller, file): distinct callers of a bare name."""
    return calls.where(bare_name("target") == symbol).select(F.col("source").alias("caller"), "file").distinct()


def callees(calls: DataFrame, symbol: str) -> DataFrame:
    return calls.where(bare_name("source") == symbol).select(F.col("target").alias("callee")).distinct()


def call_path(calls: DataFrame, start: str, goal: str) -> tuple[list[str] | None, int]:
    """(path, hops) over bare names; (None, -1) where there is none."""
    e = calls.select(bare_name("source").alias("src"), bare_name("target").alias("dst")).distinct()
    p = shortest_path(e, start, goal)
    return (p, len(p) - 1) if p else (None, -1)


def component_detail(components: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(component, imports, importers, churn, health): sorted neighbour lists of every component."""
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
    out = e.groupBy(F.col("src").alias("name")).agg(F.array_join(F.sort_array(F.collect_set("dst")), ",").alias("imports"))
    inn = e.groupBy(F.col("dst").alias("name")).agg(F.array_join(F.sort_array(F.collect_set("src")), ",").alias("importers"), F.count(F.lit(1)).alias("fi"))
    j = components.join(out, "name", "left").join(inn, "name", "left").fillna("", ["imports", "importers"]).fillna(0, ["fi"])
    return j.select(F.col("name").alias("component"), "imports", "importers", "churn", health(F.col("fi"), F.col("churn")).alias("health"))


def coupling_table(components: DataFrame, edges: DataFrame, sort_by: str = "fan_in", top: int | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """(component, fan_in, fan_out, churn, loc) of components with any coupling, in the order asked for."""
    j = components.join(fan_in(edges, src, dst).withColumnRenamed("node", "name"), "name", "left").join(fan_out(edges, src, dst).withColumnRenamed("node", "name"), "name", "left").fillna(0, ["fan_in", "fan_out"])
    key = {"fan_in": "fan_in", "fan_out": "fan_out", "churn": "churn", "nesting": "max_nesting", "loc": "loc"}.get(sort_by, "fan_in")
    j = j.where("fan_in > 0 OR fan_out > 0").orderBy(F.desc(key if key in j.columns else "fan_in"), "name")
    out = j.select(F.col("name").alias("component"), "fan_in", "fan_out", "churn", "loc")
    return out.limit(top) if top is not None else out


def top_churn(components: DataFrame, top: int = 10) -> DataFrame:
    return components.orderBy(F.desc("churn"), "name").limit(top).select(F.col("name").alias("component"), "churn")
