"""Queries of the engine's own operators over the tables, each with its DuckDB counterpart where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import dir_of, package_of, short_hash
from ..operators import clinic, constraint, cycles, graph, impact, kernels, mesh, model, primitives, render, retrieval, temporal
from ..runtime import checkpoint, table
from ..sources import scanners
from . import bind

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


# -- common table expressions --------------------------------------------------------------------------------
CE = """pairs AS (
  SELECT cn.n_name AS src, sn.n_name AS dst, s_nationkey, count(*) AS weight, count(DISTINCT l_orderkey) AS loc_surface
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey GROUP BY ALL),
ce AS (SELECT src, dst, weight, weight AS call_sites, loc_surface FROM pairs)"""
DAG = CE + ",\ndag AS (SELECT * FROM ce WHERE src < dst)"
COMPS = """comps AS (
  SELECT n_name AS name, r_name AS package,
    (SELECT count(*) * 10 FROM customer WHERE c_nationkey = n_nationkey) AS loc, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_symbols,
    (SELECT count(*) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = n_nationkey AND l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 90 DAY) AS churn
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""
E = "e AS (SELECT DISTINCT call_id AS edge_id, caller AS source, callee AS target, 'call' AS kind, file, line FROM calls WHERE caller IS NOT NULL AND callee IS NOT NULL)"
SE = "se AS (SELECT DISTINCT caller AS source, callee AS target FROM calls WHERE caller IS NOT NULL AND callee IS NOT NULL)"
N = """n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fqn ORDER BY loaded_at DESC, symbol_id DESC) AS r FROM (
  SELECT CASE WHEN coalesce(package, '') = '' THEN name ELSE package || '.' || name END AS fqn, symbol_id, loaded_at, coalesce(package, '') AS package, name, kind, exported, file, line, end_line, signature, receiver_type FROM symbols) WHERE fqn IS NOT NULL) WHERE r = 1)"""


def pkg(x: str) -> str:
    return f"CASE WHEN contains({x}, '.') THEN regexp_replace({x}, '\\.[^.]*$', '') ELSE '' END"


def bare(x: str) -> str:
    return f"regexp_extract({x}, '([^.]*)$', 1)"


FI = "fi AS (SELECT dst AS name, count(*) AS fan_in FROM ce GROUP BY 1), fo AS (SELECT src AS name, count(*) AS fan_out FROM ce GROUP BY 1)"
PIVOT = "(SELECT min(source) FROM se)"


def _pivot(spark: SparkSession, d: str) -> str:
    return bind.simple_call_edges(spark, d).agg(F.min("source")).first()[0]


def _seed(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "node string")


def _text(c: str):
    return F.array_join(c, ",").alias(c)


def _round(df: DataFrame, *cols: str) -> DataFrame:
    """Doubles to six places, as in the SQL: the two engines may add up in another order."""
    return df.withColumns({c: F.round(c, 6) for c in cols})


# -- edges and degrees -----------------------------------------------------------------------------------------
query("component_edges", f"WITH {CE} SELECT * FROM ce")(bind.component_edges)
query("fan_in", f"WITH {E} SELECT target AS node, count(*) AS fan_in FROM e GROUP BY 1")(lambda s, d: graph.fan_in(bind.call_edges(s, d), "source", "target"))
query("fan_out", f"WITH {E} SELECT source AS node, count(*) AS fan_out FROM e GROUP BY 1")(lambda s, d: graph.fan_out(bind.call_edges(s, d), "source", "target"))
query("weighted_fan_in", f"WITH {CE} SELECT dst AS node, sum(CASE WHEN weight = 0 THEN 1 ELSE weight END)::BIGINT AS weighted_fan_in FROM ce GROUP BY 1")(lambda s, d: graph.weighted_fan_in(bind.component_edges(s, d)))
query("reverse_adjacency", f"WITH {SE} SELECT target AS src, source AS dst FROM se")(lambda s, d: graph.reverse_adjacency(bind.call_edges(s, d), "source", "target"))
query(
    "symbol_edge_kinds",
    r"""WITH x AS (SELECT from_name AS a, to_name AS b, 'implements' AS kind FROM impl_edges UNION ALL SELECT owner, ref_type, 'field_ref' FROM field_refs),
y AS (SELECT trim(a) AS source, CASE WHEN b LIKE '%/%' THEN regexp_extract(b, '([A-Za-z0-9_]+(?:[-./]+[A-Za-z0-9_]+)*/[A-Za-z0-9_./-]*[A-Za-z0-9_])', 1) ELSE regexp_extract(b, '([A-Za-z0-9_.]+)', 1) END AS target, kind FROM x
  UNION ALL SELECT caller, callee, 'call' FROM calls)
SELECT kind, count(*) AS n FROM (SELECT DISTINCT * FROM y WHERE source IS NOT NULL AND target IS NOT NULL AND target <> '') GROUP BY 1""",
)(lambda s, d: bind.symbol_edges(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n")))

# -- primitives ------------------------------------------------------------------------------------------------
query(
    "probe_all",
    f"""WITH {E}, {N}, o AS (SELECT source AS fqn, count(*) AS fan_out, count(DISTINCT {pkg("target")}) AS boundaries FROM e GROUP BY 1), i AS (SELECT target AS fqn, count(*) AS fan_in FROM e GROUP BY 1),
x AS (SELECT source AS fqn, count(*) FILTER ({pkg("target")} <> n.package) AS cross_pkg FROM e JOIN n ON n.fqn = source GROUP BY 1),
c AS (SELECT a.source AS fqn, count(DISTINCT a.target) AS circuits FROM e a JOIN e b ON a.source = b.target AND a.target = b.source GROUP BY 1)
SELECT n.fqn, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, CASE WHEN coalesce(fan_in, 0) + coalesce(fan_out, 0) > 0 THEN round(coalesce(fan_out, 0)::DOUBLE / (coalesce(fan_in, 0) + coalesce(fan_out, 0)), 6) ELSE 0.0::DOUBLE END AS instability,
coalesce(cross_pkg, 0) AS cross_pkg, coalesce(circuits, 0) AS circuits, coalesce(boundaries, 0) AS boundaries FROM n LEFT JOIN o USING (fqn) LEFT JOIN i USING (fqn) LEFT JOIN x USING (fqn) LEFT JOIN c USING (fqn)""",
)(lambda s, d: _round(primitives.probe_all(bind.symbol_nodes(s, d), bind.call_edges(s, d)), "instability"))
query(
    "probe_types",
    f"""WITH {E}, {N}, t AS (SELECT fqn FROM n WHERE kind IN ('struct', 'interface')), x AS (SELECT source AS m, 1 AS o, 0 AS i FROM e UNION ALL SELECT target, 0, 1 FROM e), y AS (SELECT m, sum(o) AS o, sum(i) AS i FROM x GROUP BY 1),
z AS (SELECT t.fqn, sum(i) AS i, sum(o) AS o FROM t JOIN y ON y.m = t.fqn OR starts_with(y.m, t.fqn || '.') GROUP BY 1) SELECT t.fqn, coalesce(i, 0)::BIGINT AS fan_in, coalesce(o, 0)::BIGINT AS fan_out FROM t LEFT JOIN z USING (fqn)""",
)(lambda s, d: primitives.probe_types(bind.symbol_nodes(s, d), bind.call_edges(s, d)))
query(
    "probe_one",
    f"""WITH {E}, {N}, {SE}, p AS (SELECT fqn, package, kind FROM n WHERE fqn = (SELECT min(source) FROM se JOIN n ON n.fqn = source WHERE kind NOT IN ('struct', 'interface'))) SELECT fqn, count(*) FILTER (target = fqn) AS fan_in, count(*) FILTER (source = fqn) AS fan_out FROM p JOIN e ON source = fqn OR target = fqn GROUP BY 1""",
)(lambda s, d: _probe_one(s, d))


def _probe_one(s: SparkSession, d: str) -> DataFrame:
    nodes = bind.symbol_nodes(s, d)
    plain = nodes.where(~F.col("kind").isin("struct", "interface")).select(F.col("fqn").alias("source"))
    name = bind.simple_call_edges(s, d).join(plain, "source", "left_semi").agg(F.min("source")).first()[0]
    return primitives.probe(nodes, bind.call_edges(s, d), name).select("fqn", "fan_in", "fan_out")


ENTRY = f"ent AS (SELECT fqn FROM n WHERE exported AND fqn NOT IN (SELECT target FROM se) AND fqn IN (SELECT source FROM se))"
query("entry_points", f"WITH {SE}, {N}, {ENTRY} SELECT fqn FROM ent")(lambda s, d: primitives.entry_points(bind.symbol_nodes(s, d), bind.call_edges(s, d)))
DOWN = f"down AS (SELECT node, min(depth) AS depth FROM (SELECT {PIVOT} AS node, 0 AS depth UNION SELECT target, 1 FROM se WHERE source = {PIVOT} UNION SELECT b.target, 2 FROM se a JOIN se b ON a.target = b.source WHERE a.source = {PIVOT}) GROUP BY 1)"
UP = f"up AS (SELECT node, min(depth) AS depth FROM (SELECT {PIVOT} AS node, 0 AS depth UNION SELECT source, 1 FROM se WHERE target = {PIVOT} UNION SELECT b.source, 2 FROM se a JOIN se b ON a.source = b.target WHERE a.target = {PIVOT}) GROUP BY 1)"


def _scenario(s: SparkSession, d: str, only: str | None = None) -> dict:
    e = bind.simple_call_edges(s, d).withColumn("kind", F.lit("call"))
    name = _pivot(s, d)
    nodes = e.select(F.col("source").alias("fqn")).union(e.select("target")).distinct()
    return primitives.scenario(nodes, e, name, 2, only=only)


query("scenario_downstream", f"WITH {SE}, {DOWN} SELECT node AS fqn, depth, node NOT IN (SELECT source FROM se) AS leaf FROM down WHERE depth > 0")(lambda s, d: _scenario(s, d, "downstream")["downstream"])
query("scenario_upstream", f"WITH {SE}, {UP} SELECT node AS fqn, -depth AS depth, node NOT IN (SELECT target FROM se) AS entry FROM up WHERE depth > 0")(lambda s, d: _scenario(s, d, "upstream")["upstream"])
query(
    "scenario_edges",
    f"WITH {SE}, {DOWN}, {UP}, seen AS (SELECT node FROM down UNION SELECT node FROM up) SELECT source, target, 'call' AS kind FROM se WHERE source IN (SELECT node FROM seen) AND target IN (SELECT node FROM seen)",
)(lambda s, d: _scenario(s, d)["edges"])


def _three(s: SparkSession, d: str) -> list[str]:
    return [r[0] for r in bind.simple_call_edges(s, d).select("source").distinct().orderBy("source").limit(3).collect()]


@query(
    "convergence",
    f"""WITH RECURSIVE {SE}, seeds AS (SELECT DISTINCT source AS seed FROM se ORDER BY 1 LIMIT 3), r AS (SELECT seed, seed AS node FROM seeds UNION SELECT seed, target FROM r JOIN se ON node = source)
SELECT node AS fqn, count(*) AS count, string_agg(seed, ',' ORDER BY seed) AS sources FROM r WHERE seed <> node GROUP BY 1 HAVING count(*) >= 2""",
)
def _convergence(s: SparkSession, d: str) -> DataFrame:
    e = bind.simple_call_edges(s, d).withColumn("kind", F.lit("call"))
    nodes = e.select(F.col("source").alias("fqn")).distinct()
    return primitives.convergence(nodes, e, _three(s, d))["nodes"].select("fqn", "count", _text("sources"))


query("islands", f"WITH RECURSIVE {SE}, {N}, {ENTRY}, r AS (SELECT fqn AS node FROM ent UNION SELECT target FROM r JOIN se ON node = source) SELECT fqn FROM n WHERE fqn NOT IN (SELECT node FROM r)")(
    lambda s, d: primitives.islands(bind.symbol_nodes(s, d), bind.call_edges(s, d))
)


@query(
    "isolate",
    f"""WITH RECURSIVE {SE}, h AS (SELECT source AS hub FROM se GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), nd AS (SELECT source AS x FROM se UNION SELECT target FROM se), u AS (SELECT source AS a, target AS b FROM se UNION SELECT target, source FROM se),
v AS (SELECT * FROM u WHERE a <> (SELECT hub FROM h) AND b <> (SELECT hub FROM h)), r AS (SELECT x AS node, x AS m FROM nd UNION SELECT b, m FROM r JOIN u ON node = a WHERE m < b), q AS (SELECT x AS node, x AS m FROM nd WHERE x <> (SELECT hub FROM h) UNION SELECT b, m FROM q JOIN v ON node = a WHERE m < b)
SELECT (SELECT count(DISTINCT m) FROM (SELECT min(m) AS m FROM r GROUP BY node)) AS before, (SELECT count(DISTINCT m) FROM (SELECT min(m) AS m FROM q GROUP BY node)) AS after""",
)
def _isolate(s: SparkSession, d: str) -> DataFrame:
    e = bind.simple_call_edges(s, d)
    hub = e.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").first()[0]
    return primitives.isolate(graph.nodes_of(e, "source", "target").withColumnRenamed("node", "fqn"), e, hub)


query("symbol_diff", "WITH x AS (SELECT CASE WHEN coalesce(package, '') = '' THEN name ELSE package || '.' || name END AS fqn, signature, loaded_at, deleted_at, symbol_id FROM symbols), t AS (SELECT TIMESTAMP '2025-03-01' AS a, TIMESTAMP '2025-06-01' AS b),\n"
      "sa AS (SELECT fqn, arg_max(coalesce(signature, chr(1)), (loaded_at, symbol_id)) AS sig FROM x, t WHERE fqn IS NOT NULL AND loaded_at <= t.a AND (deleted_at IS NULL OR deleted_at > t.a) GROUP BY 1), sb AS (SELECT fqn, arg_max(coalesce(signature, chr(1)), (loaded_at, symbol_id)) AS sig FROM x, t WHERE fqn IS NOT NULL AND loaded_at <= t.b AND (deleted_at IS NULL OR deleted_at > t.b) GROUP BY 1)\n"
      "SELECT fqn, CASE WHEN sa.sig IS NULL THEN 'added' WHEN sb.sig IS NULL THEN 'removed' ELSE 'modified' END AS change FROM sa FULL JOIN sb USING (fqn) WHERE sa.sig IS DISTINCT FROM sb.sig")(lambda s, d: _symbol_diff(s, d))  # fmt: skip


def _standing(s: SparkSession, d: str, at: str) -> DataFrame:
    from ..functions.scalar import fqn_of

    t = F.lit(at).cast("timestamp_ntz")
    x = table(s, d, "symbols").withColumn("fqn", fqn_of("package", "name")).where((F.col("loaded_at") <= t) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > t)) & F.col("fqn").isNotNull())
    return x.groupBy("fqn").agg(F.max(F.struct("loaded_at", "symbol_id", "signature")).alias("x")).select("fqn", "x.signature")


def _symbol_diff(s: SparkSession, d: str) -> DataFrame:
    return primitives.diff_symbols(_standing(s, d, "2025-03-01"), _standing(s, d, "2025-06-01"))


query(
    "merge_symbol_graph",
    f"""WITH {N}, p AS (SELECT fqn, coalesce(kind, '') AS kind, 0 AS p FROM n UNION ALL SELECT fqn, kind, 1 FROM platform_symbols) SELECT fqn, arg_min(kind, p) AS kind FROM p GROUP BY 1""",
)(lambda s, d: primitives.merge_symbols(bind.symbol_nodes(s, d).select("fqn", "kind", "file", "line"), table(s, d, "platform_symbols").select("fqn", "kind", F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"))).select("fqn", F.coalesce("kind", F.lit("")).alias("kind")))
query(
    "resolve_callees",
    f"""WITH {N}, c AS (SELECT DISTINCT package, {bare("callee")} AS callee FROM calls WHERE package IS NOT NULL AND callee IS NOT NULL),
a AS (SELECT package AS p, name, min(fqn) AS same FROM n GROUP BY 1, 2), b AS (SELECT name, arg_min(fqn, (package, fqn)) AS any_one FROM n GROUP BY 1)
SELECT c.package, c.callee, coalesce(same, any_one) AS target FROM c LEFT JOIN a ON c.package = a.p AND c.callee = a.name LEFT JOIN b ON c.callee = b.name""",
)(lambda s, d: primitives.resolve_callees(table(s, d, "calls").where("package IS NOT NULL AND callee IS NOT NULL").select("package", F.regexp_extract("callee", r"([^.]*)$", 1).alias("callee")).distinct(), bind.symbol_nodes(s, d)))
query(
    "call_graph_walk",
    f"""WITH {SE}, {N}, {ENTRY}, i AS (SELECT source, target FROM se WHERE target IN (SELECT fqn FROM n)), a AS (SELECT fqn FROM n WHERE exported), b AS (SELECT DISTINCT target AS fqn FROM i WHERE source IN (SELECT fqn FROM a) AND target NOT IN (SELECT fqn FROM a)),
c AS (SELECT DISTINCT target AS fqn FROM i WHERE source IN (SELECT fqn FROM b) AND target NOT IN (SELECT fqn FROM a UNION SELECT fqn FROM b)) SELECT fqn, 0 AS depth FROM a UNION ALL SELECT fqn, 1 FROM b UNION ALL SELECT fqn, 2 FROM c""",
)(lambda s, d: primitives.call_graph_walk(bind.symbol_nodes(s, d), bind.call_edges(s, d), 2)["nodes"])
query("state_transitions", "WITH t AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, event_type AS b FROM events) SELECT a AS from_state, b AS to_state, count(*) AS n FROM t WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b GROUP BY 1, 2")(
    lambda s, d: primitives.state_transitions(table(s, d, "events"), "user_id", "event_type", ["ts", "event_id"])
)

# -- traversal over components -----------------------------------------------------------------------------------
_R = "r AS (SELECT DISTINCT node AS seed, node, 0 AS depth FROM (SELECT src AS node FROM ce UNION SELECT dst FROM ce) UNION SELECT seed, dst, depth + 1 FROM r JOIN ce ON node = src WHERE depth < 25), m AS (SELECT seed, node, min(depth) AS depth FROM r GROUP BY 1, 2)"
query("reachability_counts", f"WITH RECURSIVE {CE}, {_R} SELECT seed AS node, count(*) - 1 AS reachable FROM m GROUP BY 1")(lambda s, d: graph.reachability_counts(bind.component_edges(s, d)))


def _ce(s: SparkSession, d: str) -> DataFrame:
    return checkpoint(bind.component_edges(s, d))


@query("shortest_path_lengths", f"WITH RECURSIVE {CE}, {_R} SELECT seed AS src, node AS dst, depth AS hops FROM m")
def _lengths(s: SparkSession, d: str) -> DataFrame:
    e = _ce(s, d)
    return graph.distances(e, graph.nodes_of(e))


@query("shortest_path")
def _path(s: SparkSession, d: str) -> DataFrame:
    e = bind.simple_call_edges(s, d)
    start = _pivot(s, d)
    goal = graph.closure(e, _seed(s, start), "source", "target").agg(F.max(F.struct("depth", "node")).alias("x")).first()["x"]["node"]
    p = graph.shortest_path(e, start, goal, "source", "target")
    return s.createDataFrame(list(enumerate(p)), "pos int, node string")


_U = "u AS (SELECT src AS a, dst AS b FROM ce UNION SELECT dst, src FROM ce), s AS (SELECT min(src) AS node FROM ce)"


@query("bfs_group", f"WITH RECURSIVE {CE}, {_U}, r AS (SELECT node, 0 AS depth FROM s UNION SELECT b, depth + 1 FROM r JOIN u ON node = a WHERE depth < 25), m AS (SELECT node, min(depth) AS depth FROM r GROUP BY 1) SELECT node, depth, row_number() OVER (ORDER BY depth, node)::INTEGER AS ord FROM m")
def _group(s: SparkSession, d: str) -> DataFrame:
    e = _ce(s, d)
    return graph.bfs_group(e, e.agg(F.min("src")).first()[0])


@query(
    "bfs_skip",
    f"WITH RECURSIVE {CE}, st AS (SELECT min(src) AS node FROM ce), sk AS (SELECT dst AS node FROM ce WHERE src = (SELECT node FROM st) ORDER BY 1 LIMIT 1), r AS (SELECT node FROM st UNION SELECT dst FROM r JOIN ce ON node = src WHERE dst NOT IN (SELECT node FROM sk)) SELECT node FROM r",
)
def _skip(s: SparkSession, d: str) -> DataFrame:
    e = _ce(s, d)
    start = e.agg(F.min("src")).first()[0]
    skip = e.where(F.col("src") == start).agg(F.min("dst").alias("node"))
    return graph.closure(e, _seed(s, start), skip=skip).select("node")


@query("neighborhood", f"WITH {CE}, {_U}, a AS (SELECT b AS node FROM u WHERE a = (SELECT node FROM s)), b2 AS (SELECT b AS node FROM u WHERE a IN (SELECT node FROM a)) SELECT node FROM s UNION SELECT node FROM a UNION SELECT node FROM b2")
def _near(s: SparkSession, d: str) -> DataFrame:
    e = _ce(s, d)
    return mesh.neighborhood(e, e.agg(F.min("src")).first()[0], 2)


@query(
    "neighborhood_weighted",
    f"WITH {CE}, {_U}, g AS (SELECT node FROM s UNION SELECT b FROM u WHERE a = (SELECT node FROM s)), x AS (SELECT src AS a, dst AS b, weight FROM ce UNION ALL SELECT dst, src, weight FROM ce) SELECT b AS node, max(weight)::DOUBLE AS weight FROM x WHERE a IN (SELECT node FROM g) AND b <> (SELECT node FROM s) GROUP BY 1",
)
def _near_w(s: SparkSession, d: str) -> DataFrame:
    e = _ce(s, d)
    return mesh.neighborhood_weighted(e, e.agg(F.min("src")).first()[0], 2)


@query("mesh_distance", f"WITH RECURSIVE {CE}, {_U}, g AS (SELECT max(dst) AS node FROM ce), r AS (SELECT node, 0 AS depth FROM s UNION SELECT b, depth + 1 FROM r JOIN u ON node = a WHERE depth < 25) SELECT coalesce(min(depth), -1)::INTEGER AS hops FROM r WHERE node = (SELECT node FROM g)")
def _dist(s: SparkSession, d: str) -> DataFrame:
    e = _ce(s, d)
    a, b = e.agg(F.min("src"), F.max("dst")).first()
    return s.createDataFrame([(mesh.distance(e, a, b),)], "hops int")


# -- cycles, depth, order ------------------------------------------------------------------------------------------
query("on_cycle_nodes", f"WITH RECURSIVE {CE}, r AS (SELECT src AS o, dst AS node FROM ce UNION SELECT o, dst FROM r JOIN ce ON node = src) SELECT DISTINCT o AS node FROM r WHERE o = node")(lambda s, d: cycles.on_cycle_nodes(_ce(s, d)))
query("two_cycles", f"WITH {SE} SELECT a.source AS a, a.target AS b FROM se a JOIN se b ON a.source = b.target AND a.target = b.source WHERE a.source < a.target")(lambda s, d: cycles.two_cycles(bind.call_edges(s, d), "source", "target"))
CYC = "cyc AS (WITH RECURSIVE p AS (SELECT src AS st, dst AS last, [src, dst] AS path FROM x WHERE src < dst UNION ALL SELECT st, dst, list_append(path, dst) FROM p JOIN x ON last = src WHERE dst > st AND NOT list_contains(path, dst) AND len(path) < 4) SELECT array_to_string(path, '->') AS cycle, len(path)::INTEGER AS len FROM p JOIN x ON last = src AND st = dst UNION ALL SELECT src, 1 FROM x WHERE src = dst)"
XD = "x AS (SELECT DISTINCT src, dst FROM ce)"
query("elementary_cycles_len4", f"WITH {CE}, {XD}, {CYC} SELECT * FROM cyc")(lambda s, d: cycles.elementary_cycles(_ce(s, d), 4))
_DEPTH = "dn AS (SELECT src AS node FROM dag UNION SELECT dst FROM dag), r AS (SELECT node, 0 AS depth FROM dn WHERE node NOT IN (SELECT dst FROM dag) UNION SELECT dst, depth + 1 FROM r JOIN dag ON node = src), dep AS (SELECT node, max(depth)::INTEGER AS depth FROM r GROUP BY 1)"
query("import_depth", f"WITH RECURSIVE {DAG}, {_DEPTH} SELECT * FROM dep")(lambda s, d: cycles.import_depth(checkpoint(bind.component_dag(s, d))))
query("import_depth_general")(lambda s, d: cycles.import_depth(_ce(s, d)))
query("topological_levels", f"WITH RECURSIVE {DAG}, {_DEPTH} SELECT node, depth AS level FROM dep")(lambda s, d: cycles.topological_levels(checkpoint(bind.component_dag(s, d))))
query(
    "connected_components",
    f"WITH RECURSIVE {SE}, u AS (SELECT source AS a, target AS b FROM se UNION SELECT target, source FROM se), r AS (SELECT a AS node, a AS m FROM u UNION SELECT b, m FROM r JOIN u ON node = a WHERE m < b) SELECT node, min(m) AS label FROM r GROUP BY 1",
)(lambda s, d: graph.weak_components(bind.simple_call_edges(s, d), "source", "target"))
query(
    "impl_components",
    r"""WITH RECURSIVE i AS (SELECT DISTINCT trim(from_name) AS source, regexp_extract(to_name, '([A-Za-z0-9_]+(?:[-./]+[A-Za-z0-9_]+)*)', 1) AS target FROM impl_edges WHERE from_name IS NOT NULL AND to_name IS NOT NULL),
u AS (SELECT source AS a, target AS b FROM i UNION SELECT target, source FROM i), r AS (SELECT a AS node, a AS m FROM u UNION SELECT b, m FROM r JOIN u ON node = a), w AS (SELECT node, min(m) AS label FROM r GROUP BY 1) SELECT * FROM w""",
)(lambda s, d: graph.weak_components(bind.symbol_edges(s, d).where("kind = 'implements'"), "source", "target"))
query("betweenness")(lambda s, d: kernels.betweenness(_ce(s, d)))
query("rcm_order")(lambda s, d: kernels.rcm_order(_ce(s, d)))
query(
    "cohesion",
    f"""WITH {SE}, g AS (SELECT source AS node, {pkg("source")} AS grp FROM se UNION SELECT target, {pkg("target")} FROM se), i AS (SELECT DISTINCT a.grp, least(source, target) AS x, greatest(source, target) AS y FROM se JOIN g a ON a.node = source JOIN g b ON b.node = target AND a.grp = b.grp),
c AS (SELECT grp, count(DISTINCT node) AS n FROM g GROUP BY 1), p AS (SELECT grp, count(*) AS p FROM i GROUP BY 1) SELECT grp, round(CASE WHEN n < 2 THEN 1.0 ELSE coalesce(p, 0) / (n * (n - 1) / 2) END::DOUBLE, 6) AS cohesion FROM c LEFT JOIN p USING (grp)""",
)(lambda s, d: _round(graph.cohesion(bind.simple_call_edges(s, d), graph.nodes_of(bind.simple_call_edges(s, d), "source", "target").withColumn("grp", package_of("node")), "source", "target"), "cohesion"))
LAYERS = [f"NATION_{i}" for i in range(25)]
_L = "lay AS (SELECT 'NATION_' || i AS layer, i AS pos FROM range(25) t(i))"
query("layer_violations", f"WITH {CE}, {_L} SELECT src, dst FROM ce JOIN lay a ON src = a.layer JOIN lay b ON dst = b.layer WHERE a.pos < b.pos")(lambda s, d: graph.layer_violations(bind.component_edges(s, d), LAYERS))

# -- mesh ------------------------------------------------------------------------------------------------------------
ANC = f"""anc AS (SELECT fqn AS symbol, package || '/' || CASE WHEN coalesce(file, '') = '' THEN '(unknown)' ELSE regexp_extract(file, '([^/]*)$', 1) END AS file, package,
  CASE WHEN package = '' THEN '(root)' WHEN (SELECT count(*) FROM projects WHERE package = path OR starts_with(package, path || '/')) > 0 THEN array_to_string(string_split(package, '/')[1:2], '/') ELSE package END AS component FROM n)"""


def _anc(s: SparkSession, d: str) -> DataFrame:
    return mesh.ancestors(bind.symbol_nodes(s, d), table(s, d, "projects").select(F.col("path").alias("name")))


query(
    "mesh_nodes",
    f"""WITH {N}, {ANC}, u AS (SELECT symbol AS name, 0 AS level, file AS parent FROM anc UNION SELECT file, 1, package FROM anc UNION SELECT package, 2, component FROM anc UNION SELECT component, 3, NULL FROM anc),
o AS (SELECT name, max(level) AS level FROM u GROUP BY 1), k AS (SELECT parent AS name, count(*) AS n_children FROM (SELECT DISTINCT parent, name FROM u WHERE parent IS NOT NULL AND parent <> name) GROUP BY 1)
SELECT o.name, o.level::INTEGER AS level, (SELECT max(parent) FROM u WHERE u.name = o.name AND u.level = o.level) AS parent, coalesce(n_children, 0) AS n_children FROM o LEFT JOIN k ON k.name = o.name""",
)(lambda s, d: mesh.mesh_nodes(_anc(s, d)))


def _lifted(level: str) -> str:
    return f"""WITH {SE}, {N}, {ANC}, l AS (SELECT coalesce(a.{level}, source) AS a, coalesce(b.{level}, target) AS b FROM se LEFT JOIN anc a ON a.symbol = source LEFT JOIN anc b ON b.symbol = target)
SELECT a AS source, b AS target, count(*)::DOUBLE AS weight, 'call' AS kind FROM l WHERE a <> b AND a <> '' AND b <> '' GROUP BY 1, 2"""


def _kinded(s: SparkSession, d: str) -> DataFrame:
    return bind.simple_call_edges(s, d).withColumn("kind", F.lit("call"))


for _level in ("file", "package", "component"):
    query(f"mesh_aggregate_{_level}", _lifted(_level))(lambda s, d, level=_level: mesh.aggregate(_kinded(s, d), _anc(s, d), level))
query(
    "mesh_boundaries",
    f"WITH {SE}, {N}, {ANC} SELECT source, target, 1.0::DOUBLE AS weight FROM se LEFT JOIN anc a ON a.symbol = source LEFT JOIN anc b ON b.symbol = target WHERE coalesce(a.component, source) <> coalesce(b.component, target)",
)(lambda s, d: mesh.boundaries(bind.simple_call_edges(s, d).withColumn("weight", F.lit(1.0)), _anc(s, d), 0.5).select("source", "target", "weight"))
query(
    "mesh_circuits",
    f"WITH {SE}, p AS (SELECT a.source AS a, a.target AS b FROM se a JOIN se b ON a.source = b.target AND a.target = b.source WHERE a.source < a.target) SELECT row_number() OVER (ORDER BY a, b) AS circuit_id, a, b FROM p",
)(lambda s, d: mesh.circuits(bind.simple_call_edges(s, d).withColumn("weight", F.lit(1.0)), 0.3))
query("mesh_overlay")(lambda s, d: mesh.overlay(bind.components(s, d).select("name", F.lit(3).alias("level")), _ce(s, d), None, "src", "dst"))
query(
    "edge_weight_class",
    f"""WITH {SE}, w AS (SELECT CASE WHEN starts_with(source, 'platform/') AND starts_with(target, 'platform/') THEN 0.5 WHEN {pkg("target")} IN ({", ".join(f"'{x}'" for x in mesh.PLUMBING)}) THEN 0.01 ELSE 0.3 END AS w FROM se) SELECT w::DOUBLE AS weight, count(*) AS n FROM w GROUP BY 1""",
)(lambda s, d: bind.simple_call_edges(s, d).select(mesh.edge_weight(F.col("source"), F.col("target"), ["platform"]).alias("weight")).groupBy("weight").agg(F.count(F.lit(1)).alias("n")))

# -- components from packages ---------------------------------------------------------------------------------------------
_PE = f"pe AS (SELECT {pkg('source')} AS src, {pkg('target')} AS dst, starts_with(target, 'platform/') AS external, count(*) AS weight FROM se GROUP BY 1, 2, 3)"
_NS = "ns AS (SELECT DISTINCT package AS path FROM n WHERE package <> '')"


def _short(x: str) -> str:
    return f"CASE WHEN starts_with({x}, 'tinfern/') THEN substr({x}, 9) ELSE {x} END"


def _package_edges(s: SparkSession, d: str) -> DataFrame:
    e = bind.simple_call_edges(s, d).select(package_of("source").alias("src"), package_of("target").alias("dst"), F.col("target").startswith("platform/").alias("external"))
    return e.groupBy("src", "dst", "external").agg(F.count(F.lit(1)).alias("weight"))


def _package_model(s: SparkSession, d: str) -> dict:
    n = bind.symbol_nodes(s, d)
    return model.package_model(n.where("package <> ''").select(F.col("package").alias("path")), _package_edges(s, d), n.select("package", "exported"), "tinfern", external=True)


query("package_components", f"WITH {N}, {_NS}, x AS (SELECT package AS path, count(*) AS k FROM n WHERE exported GROUP BY 1) SELECT {_short('path')} AS name, coalesce(k, 0) AS n_symbols FROM ns LEFT JOIN x USING (path)")(
    lambda s, d: _package_model(s, d)["components"]
)
_PM = f"pm AS (SELECT {_short('src')} AS src, {_short('dst')} AS dst, 'import' AS protocol, weight FROM pe WHERE NOT external AND src IN (SELECT path FROM ns) AND dst IN (SELECT path FROM ns) UNION ALL SELECT {_short('src')}, dst, 'external', weight FROM pe WHERE external)"
query("package_edges", f"WITH {SE}, {N}, {_NS}, {_PE}, {_PM} SELECT * FROM pm")(lambda s, d: _package_model(s, d)["edges"])
_DG = "array_to_string(string_split({x}, '/')[1:2], '/')"


def _group_model(s: SparkSession, d: str) -> dict:
    m = _package_model(s, d)
    return model.group_model(m["components"].select("name", F.lit(1).alias("churn")), m["edges"], model.default_groups(m["components"], 2))


_GR = f"cm AS (SELECT {_short('path')} AS name FROM ns), g0 AS (SELECT name, {_DG.format(x='name')} AS grp FROM cm), g AS (SELECT * FROM g0 WHERE grp IN (SELECT grp FROM g0 GROUP BY 1 HAVING count(*) > 1))"
query("group_components", f"WITH {N}, {_NS}, {_GR} SELECT coalesce(grp, name) AS name, count(*) AS churn FROM cm LEFT JOIN g USING (name) GROUP BY 1")(lambda s, d: _group_model(s, d)["components"])
query(
    "group_edges",
    f"WITH {SE}, {N}, {_NS}, {_PE}, {_PM}, {_GR}, l AS (SELECT coalesce(a.grp, src) AS src, coalesce(b.grp, dst) AS dst, protocol, weight FROM pm LEFT JOIN g a ON a.name = src LEFT JOIN g b ON b.name = dst) SELECT src, dst, CASE WHEN bool_or(protocol = 'external') THEN 'external' ELSE 'import' END AS protocol, sum(weight)::BIGINT AS weight FROM l WHERE src <> dst GROUP BY 1, 2",
)(lambda s, d: _group_model(s, d)["edges"])
query("group_counts", f"WITH {N}, {_NS} SELECT d::INTEGER AS depth, count(DISTINCT array_to_string(string_split(path, '/')[1:d], '/')) AS n FROM ns, range(1, 6) t(d) GROUP BY 1")(
    lambda s, d: model.group_counts(bind.symbol_nodes(s, d).where("package <> ''").select(F.col("package").alias("name")).distinct())
)
query("size_rollup", "WITH x AS (SELECT DISTINCT file_id, project, package, lines FROM parsed_files WHERE package IS NOT NULL) SELECT project || '/' || package AS component, sum(lines)::BIGINT AS loc FROM x GROUP BY 1")(
    lambda s, d: model.size_rollup(
        table(s, d, "parsed_files").where("package IS NOT NULL").select("file_id", "project", "package", "lines").distinct().select(F.concat_ws("/", "project", "package").alias("component"), "lines"),
        s.createDataFrame([], "component string, depth int"),
    ).select("component", "loc")
)

# -- impact --------------------------------------------------------------------------------------------------------------
_REV = "r AS (SELECT name AS seed, name AS node FROM comps UNION SELECT seed, src FROM r JOIN ce ON node = dst WHERE src IN (SELECT name FROM comps)), tot AS (SELECT count(*) AS n FROM comps), b AS (SELECT seed AS name, count(*) - 1 AS transitive FROM r GROUP BY 1), dr AS (SELECT dst AS name, count(DISTINCT src) AS direct FROM ce WHERE src <> dst GROUP BY 1), bl AS (SELECT comps.name, coalesce(direct, 0) AS direct, transitive, (transitive * 100) // n AS blast_pct FROM comps JOIN b USING (name) LEFT JOIN dr USING (name), tot)"
query("impact", f"WITH RECURSIVE {CE}, {COMPS}, {_REV} SELECT name AS component, direct, transitive, blast_pct, CASE WHEN blast_pct >= 50 THEN 'critical' WHEN blast_pct >= 25 THEN 'high' WHEN blast_pct >= 10 THEN 'medium' ELSE 'low' END AS risk FROM bl")(
    lambda s, d: impact.impact(_ce(s, d), bind.components(s, d))
)
query("blast_radius", f"WITH RECURSIVE {CE}, {COMPS}, ch AS (SELECT 'NATION_1' AS node UNION ALL SELECT 'NATION_3'), r AS (SELECT node FROM ch UNION SELECT src FROM r JOIN ce ON node = dst) SELECT node AS component, node IN (SELECT node FROM ch) AS changed FROM r")(
    lambda s, d: impact.blast_radius(_ce(s, d), bind.components(s, d), s.createDataFrame([("NATION_1/a.go",), ("NATION_3/b.go",), ("ELSEWHERE/c.go",)], "file string"))
)


@query(
    "symbol_blast",
    f"""WITH RECURSIVE {SE}, c AS (SELECT {bare("target")} AS src, source AS caller, {bare("source")} AS dst FROM se), p AS (SELECT {bare(PIVOT)} AS node), r AS (SELECT node FROM p UNION SELECT dst FROM r JOIN c ON node = src) SELECT DISTINCT caller FROM r JOIN c ON node = src""",
)
def _blast(s: SparkSession, d: str) -> DataFrame:
    e = bind.simple_call_edges(s, d)
    return impact.symbol_blast(e, _pivot(s, d).rpartition(".")[2])["transitive"].select("caller")


query(
    "risk_scores",
    f"""WITH RECURSIVE {CE}, {COMPS}, {_REV}, {FI}, top AS (SELECT greatest(max(churn), 1) AS mc FROM comps), tb AS (SELECT greatest(max(blast_pct), 1) AS mb FROM bl),
sc AS (SELECT name AS component, least(100.0, 100 * (0.4 * churn / mc + 0.4 * blast_pct / mb + 0.2 * 1.0)) AS score FROM comps JOIN bl USING (name) LEFT JOIN fi USING (name), top, tb WHERE churn <> 0 OR coalesce(fan_in, 0) <> 0)
SELECT component, round(score::DOUBLE, 6) AS score, CASE WHEN score >= 75 THEN 'critical' WHEN score >= 50 THEN 'high' WHEN score >= 25 THEN 'medium' ELSE 'low' END AS level FROM sc""",
)(lambda s, d: _round(impact.risk_scores(_ce(s, d), bind.components(s, d)), "score"))
query(
    "leverage",
    f"""WITH {CE}, {COMPS}, k AS (SELECT dst AS name, CASE WHEN call_sites / weight >= 2.0 OR loc_surface > 5 THEN 'e' WHEN weight <= 1 THEN 'b' ELSE 'e' END AS c FROM ce), u AS (SELECT name, count(*) FILTER (c = 'e') AS en, count(*) FILTER (c = 'b') AS bi FROM k GROUP BY 1), t AS (SELECT count(*) AS n FROM comps)
SELECT name AS component, coalesce(en, 0) AS enrichment, coalesce(bi, 0) AS binary, least(100, 100 * (3 * coalesce(en, 0) + coalesce(bi, 0)) // (3 * n)) AS score FROM comps LEFT JOIN u USING (name), t""",
)(lambda s, d: impact.leverage(bind.component_edges(s, d), bind.components(s, d)))
query("independence", f"WITH {CE}, {COMPS}, {FI} SELECT name AS component, round(coalesce(fan_in, 0)::DOUBLE * n_symbols / CASE WHEN loc = 0 THEN 1 ELSE loc END, 6) AS score FROM comps LEFT JOIN fi USING (name)")(lambda s, d: _round(impact.independence(bind.component_edges(s, d), bind.components(s, d)), "score"))
query(
    "consumer_similarity",
    f"""WITH {CE}, c AS (SELECT DISTINCT src, dst FROM ce), n AS (SELECT dst, count(*) AS n FROM c GROUP BY 1), i AS (SELECT a.dst AS a, b.dst AS b, count(*) AS k FROM c a JOIN c b ON a.src = b.src AND a.dst < b.dst GROUP BY 1, 2), s AS (SELECT a, b, k / (x.n + y.n - k) AS sim FROM i JOIN n x ON x.dst = a JOIN n y ON y.dst = b) SELECT a, b, round(sim, 6) AS sim FROM s WHERE sim >= 0.3""",
)(lambda s, d: _round(impact.consumer_similarity(bind.component_edges(s, d), 0.3).where("sim < 1").unionByName(_equal_pairs(s, d)), "sim"))


def _equal_pairs(s: SparkSession, d: str) -> DataFrame:
    # For the comparison with SQL, classes of equal consumer sets are written out in pairs: there are 25 components.
    e = bind.component_edges(s, d).select("src", "dst").distinct().groupBy("dst").agg(F.array_join(F.sort_array(F.collect_list("src")), ",").alias("k"))
    return e.alias("x").join(e.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.dst") < F.col("y.dst"))).select(F.col("x.dst").alias("a"), F.col("y.dst").alias("b"), F.lit(1.0).alias("sim"))


query(
    "cohesion_clusters",
    f"""WITH RECURSIVE {CE}, c AS (SELECT DISTINCT src, dst FROM ce), n AS (SELECT dst, count(*) AS n FROM c GROUP BY 1), i AS (SELECT a.dst AS a, b.dst AS b, count(*) AS k FROM c a JOIN c b ON a.src = b.src AND a.dst < b.dst GROUP BY 1, 2),
s AS (SELECT a, b FROM i JOIN n x ON x.dst = a JOIN n y ON y.dst = b WHERE k / (x.n + y.n - k) >= 0.3), u AS (SELECT a, b FROM s UNION SELECT b, a FROM s), r AS (SELECT a AS node, a AS m FROM u UNION SELECT b, m FROM r JOIN u ON node = a),
l AS (SELECT node, min(m) AS label FROM r GROUP BY 1), g AS (SELECT label, string_agg(node, ',' ORDER BY node) AS members, count(*) AS size FROM l GROUP BY 1), k AS (SELECT label, count(DISTINCT src) AS consumers FROM ce JOIN l ON node = dst GROUP BY 1) SELECT * FROM g JOIN k USING (label)""",
)(lambda s, d: impact.cohesion_clusters(_ce(s, d), 0.3).select("label", _text("members"), "size", "consumers"))
MOVES = [{"delete": "NATION_1"}, {"rename": "NATION_2", "to": "NATION_3"}]
_WI = "mp AS (SELECT CASE WHEN src = 'NATION_2' THEN 'NATION_3' ELSE src END AS src, CASE WHEN dst = 'NATION_2' THEN 'NATION_3' ELSE dst END AS dst, weight, call_sites, loc_surface FROM ce WHERE src <> 'NATION_1' AND dst <> 'NATION_1'), af AS (SELECT src, dst, max(weight) AS weight, sum(call_sites)::BIGINT AS call_sites, sum(loc_surface)::BIGINT AS loc_surface FROM mp WHERE src <> dst GROUP BY 1, 2)"
query("what_if_edges", f"WITH {CE}, {_WI} SELECT * FROM af")(lambda s, d: impact.what_if(_ce(s, d), bind.components(s, d), MOVES)["edges"])
query("what_if_diff", f"WITH {CE}, {_WI}, b AS (SELECT DISTINCT src, dst FROM ce) SELECT src, dst, 'removed' AS change FROM b WHERE (src, dst) NOT IN (SELECT (src, dst) FROM af) UNION ALL SELECT src, dst, 'added' FROM af WHERE (src, dst) NOT IN (SELECT (src, dst) FROM b)")(
    lambda s, d: impact.what_if(_ce(s, d), bind.components(s, d), MOVES)["edge_diff"]
)
query("what_if_components", f"WITH {COMPS} SELECT CASE WHEN name = 'NATION_2' THEN 'NATION_3' ELSE name END AS name, sum(loc)::BIGINT AS loc, sum(n_symbols)::BIGINT AS n_symbols FROM comps WHERE name <> 'NATION_1' GROUP BY 1")(
    lambda s, d: impact.what_if(_ce(s, d), bind.components(s, d), MOVES)["components"]
)
query("what_if_fan_in", f"WITH {CE}, {_WI}, x AS (SELECT dst AS node, count(*) AS b FROM ce GROUP BY 1), y AS (SELECT dst AS node, count(*) AS a FROM af GROUP BY 1) SELECT node, coalesce(b, 0) AS before, coalesce(a, 0) AS after FROM x FULL JOIN y USING (node) WHERE coalesce(a, 0) <> coalesce(b, 0)")(
    lambda s, d: impact.what_if(_ce(s, d), bind.components(s, d), MOVES)["fan_in_delta"]
)
query(
    "diff_intelligence",
    f"""WITH {E}, {N}, p AS (SELECT DISTINCT package FROM n WHERE package LIKE '%/onyx%' OR package LIKE 'platform/%' OR package LIKE 'tinfern/%'), k AS (SELECT {bare("target")} AS name, count(*) AS callers FROM e GROUP BY 1)
SELECT fqn, callers, CASE WHEN callers > 10 THEN 'critical' WHEN callers > 3 THEN 'error' ELSE 'warning' END AS severity FROM n JOIN p USING (package) JOIN k USING (name)""",
)(lambda s, d: impact.diff_intelligence(bind.symbol_nodes(s, d), bind.call_edges(s, d), bind.symbol_nodes(s, d).where("package LIKE '%/onyx%' OR package LIKE 'platform/%' OR package LIKE 'tinfern/%'")))
_SIDES = "sc AS (SELECT project || ':' || name AS name, snapshot_no, arg_max(churn, delivered_at) AS churn, arg_max(loc, delivered_at) AS loc FROM (SELECT DISTINCT * EXCLUDE (symbols) FROM component_snapshots) GROUP BY 1, 2), ca AS (SELECT * FROM sc WHERE snapshot_no = 1), cb AS (SELECT * FROM sc WHERE snapshot_no = 2), ea AS (SELECT DISTINCT {p} AS src, {q} AS dst FROM calls WHERE caller IS NOT NULL AND callee IS NOT NULL AND seen_at < TIMESTAMP '2025-04-01'), eb AS (SELECT DISTINCT {p} AS src, {q} AS dst FROM calls WHERE caller IS NOT NULL AND callee IS NOT NULL AND seen_at >= TIMESTAMP '2025-04-01')".format(
    p=pkg("caller"), q=pkg("callee")
)


def _sides(s: SparkSession, d: str):
    c = table(s, d, "component_snapshots").select(F.concat_ws(":", "project", "name").alias("name"), "snapshot_no", "delivered_at", "churn", "loc")
    # Nulls of the latest delivery count as such, like in arg_max over non-null values in SQL.
    one = c.groupBy("name", "snapshot_no").agg(F.max_by("churn", F.when(F.col("churn").isNotNull(), F.col("delivered_at"))).alias("churn"), F.max_by("loc", F.when(F.col("loc").isNotNull(), F.col("delivered_at"))).alias("loc"))
    calls = table(s, d, "calls").where("caller IS NOT NULL AND callee IS NOT NULL").select(package_of("caller").alias("src"), package_of("callee").alias("dst"), "seen_at")
    cut = F.col("seen_at") < F.lit("2025-04-01").cast("timestamp_ntz")
    return one.where("snapshot_no = 1"), one.where("snapshot_no = 2"), calls.where(cut).select("src", "dst").distinct(), calls.where(~cut).select("src", "dst").distinct()


query(
    "report_diff",
    f"""WITH {_SIDES}, c AS (SELECT 'component' AS kind, coalesce(ca.name, cb.name) AS item, CASE WHEN ca.name IS NULL THEN 'added' WHEN cb.name IS NULL THEN 'removed' WHEN ca.churn IS DISTINCT FROM cb.churn THEN 'churn' END AS change, ca.churn::BIGINT AS before, cb.churn::BIGINT AS after FROM ca FULL JOIN cb ON ca.name = cb.name),
e AS (SELECT 'edge' AS kind, coalesce(ea.src, eb.src) || '->' || coalesce(ea.dst, eb.dst) AS item, CASE WHEN ea.src IS NULL THEN 'added' WHEN eb.src IS NULL THEN 'removed' END AS change, NULL::BIGINT AS before, NULL::BIGINT AS after FROM ea FULL JOIN eb ON ea.src = eb.src AND ea.dst = eb.dst) SELECT * FROM (SELECT * FROM c UNION ALL SELECT * FROM e) WHERE change IS NOT NULL""",
)(lambda s, d: impact.report_diff(*_sides(s, d)))
query(
    "scan_diff",
    f"""WITH {_SIDES}, c AS (SELECT ca.name AS a, cb.name AS b, ca.loc AS la, cb.loc AS lb FROM ca FULL JOIN cb ON ca.name = cb.name) SELECT count(*) FILTER (a IS NULL) AS added, count(*) FILTER (b IS NULL) AS removed, coalesce(sum(la), 0)::BIGINT AS loc_before, coalesce(sum(lb), 0)::BIGINT AS loc_after,
(SELECT count(*) FROM ea) AS edges_before, (SELECT count(*) FROM eb) AS edges_after, (coalesce(sum(lb), 0) - coalesce(sum(la), 0))::BIGINT AS loc_delta FROM c""",
)(lambda s, d: impact.scan_diff(*_sides(s, d)))
query(
    "validate_arch",
    f"""WITH {CE}, {COMPS}, h AS (SELECT 'component' AS kind, name AS item FROM comps UNION SELECT 'edge', src || '->' || dst FROM ce), w AS (SELECT 'component' AS kind, 'NATION_' || i AS item FROM range(20, 30) t(i) UNION SELECT 'edge', 'NATION_' || i || '->NATION_' || (i + 1) FROM range(20) t(i))
SELECT kind, item, 'extra' AS status FROM h WHERE (kind, item) NOT IN (SELECT (kind, item) FROM w) UNION ALL SELECT kind, item, 'missing' FROM w WHERE (kind, item) NOT IN (SELECT (kind, item) FROM h)""",
)(lambda s, d: impact.validate_architecture(bind.components(s, d), bind.component_edges(s, d), s.createDataFrame([(f"NATION_{i}",) for i in range(20, 30)], "name string"), s.createDataFrame([(f"NATION_{i}", f"NATION_{i + 1}") for i in range(20)], "src string, dst string")))
query("cross_repo_overlap", "WITH a AS (SELECT DISTINCT name FROM symbols WHERE project < 'n' AND name IS NOT NULL), b AS (SELECT DISTINCT name FROM symbols WHERE project >= 'n' AND name IS NOT NULL) SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'a' WHEN a.name IS NULL THEN 'b' ELSE 'both' END AS side FROM a FULL JOIN b ON a.name = b.name")(
    lambda s, d: impact.cross_repo(table(s, d, "symbols").where("project < 'n' AND name IS NOT NULL"), table(s, d, "symbols").where("project >= 'n' AND name IS NOT NULL"))
)
query(
    "evolution",
    "WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS step, count(*) AS value FROM orders GROUP BY 1), f AS (SELECT arg_min(value, step) AS first FROM m) SELECT step, value, value - coalesce(lag(value) OVER (ORDER BY step), value) AS delta, CASE WHEN first = 0 THEN CASE WHEN value > 0 THEN 'new' ELSE '0%' END ELSE floor((value - first) * 100.0 / first)::BIGINT || '%' END AS growth FROM m, f",
)(lambda s, d: impact.evolution(table(s, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("step")).agg(F.count(F.lit(1)).alias("value")), "step"))
query("sample_commits", "WITH c AS (SELECT event_id::VARCHAR AS hash, ts AS date, row_number() OVER (ORDER BY ts, event_id::VARCHAR) AS n, count(*) OVER () AS t FROM events) SELECT hash, n FROM c WHERE (n - 1) % ((t + 49) // 50) = 0 OR n = t")(
    lambda s, d: impact.sample_commits(bind.commits(s, d).select("hash", "date"), 50).select("hash", F.col("n").cast("bigint").alias("n"))
)

# -- constraints -------------------------------------------------------------------------------------------------------------
RULES = [("NATION_1*", "NATION_2", False), ("", "NATION_5", False), ("NATION_3", "*", True)]
query("boundary_rules", f"WITH {CE} SELECT src, dst, 'NATION_1* -> NATION_2' AS rule, 'error' AS severity FROM ce WHERE src LIKE 'NATION\\_1%' ESCAPE '\\' AND contains(dst, 'NATION_2') UNION ALL SELECT src, dst, ' -> NATION_5', 'error' FROM ce WHERE contains(dst, 'NATION_5')")(
    lambda s, d: constraint.boundary_rules(bind.component_edges(s, d), RULES)
)


def _limits(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(f"NATION_{i}", 3, 50, 0) for i in range(25)], "component string, max_fan_in int, max_churn int, max_nesting int")


query("budgets", f"WITH {CE}, {COMPS}, {FI} SELECT name AS component, 'fan_in' AS metric, fan_in AS actual, 3::BIGINT AS budget FROM comps JOIN fi USING (name) WHERE fan_in > 3 UNION ALL SELECT name, 'churn', churn, 50 FROM comps WHERE churn > 50")(
    lambda s, d: constraint.budgets(bind.components(s, d), bind.component_edges(s, d), _limits(s))
)
query("trust_zones", f"WITH {E}, {N}, i AS (SELECT {pkg('source')} AS component, bool_or({' OR '.join(f'''contains(lower(target), '{w}')''' for w in constraint.NET_WORDS)}) AS net FROM e GROUP BY 1), c AS (SELECT DISTINCT package AS component FROM n WHERE package <> '') SELECT component, CASE WHEN net THEN 'boundary' ELSE 'domain' END AS zone FROM c LEFT JOIN i USING (component)")(
    lambda s, d: constraint.trust_zones(bind.symbol_nodes(s, d).where("package <> ''").select(F.col("package").alias("name")).distinct(), bind.call_edges(s, d).select(package_of("source").alias("component"), "target"))
)
query("boundary_crossings", f"WITH {CE}, {COMPS} SELECT src, dst, a.package AS from_zone, b.package AS to_zone FROM ce JOIN comps a ON a.name = src JOIN comps b ON b.name = dst WHERE a.package <> b.package")(
    lambda s, d: constraint.zone_crossings(bind.component_edges(s, d), bind.components(s, d).select(F.col("name").alias("component"), F.col("package").alias("zone")))
)
query("api_surface", "WITH d AS (SELECT project, max(snapshot_no) AS snapshot_no FROM snapshot_log WHERE status = 'complete' GROUP BY 1), c AS (SELECT c.* FROM component_snapshots c JOIN d USING (project, snapshot_no) WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project, name ORDER BY delivered_at DESC NULLS LAST) = 1) SELECT project || ':' || name AS component, len(list_filter(coalesce(symbols, []), lambda s: s.exported)) AS exported FROM c")(
    lambda s, d: constraint.api_surface(bind.latest_components(s, d).where("name IS NOT NULL").withColumn("name", F.concat_ws(":", "project", "name")))
)
query("hot_spots", f"WITH {CE}, {COMPS}, {FI} SELECT name AS component, fan_in, churn FROM comps JOIN fi USING (name) WHERE fan_in >= 3 AND churn >= 5")(lambda s, d: constraint.hot_spots(bind.components(s, d), bind.component_edges(s, d)))
query(
    "drift",
    f"""WITH {CE}, {COMPS}, {FI}, {_L}, v AS (SELECT (SELECT count(*) FROM ce JOIN lay a ON src = a.layer JOIN lay b ON dst = b.layer WHERE a.pos < b.pos) + (SELECT count(*) FROM ce WHERE src LIKE 'NATION\\_1%' ESCAPE '\\' AND contains(dst, 'NATION_2')) + (SELECT count(*) FROM ce WHERE contains(dst, 'NATION_5'))
+ (SELECT count(*) FROM comps JOIN fi USING (name) WHERE fan_in > 3) + (SELECT count(*) FROM comps WHERE churn > 50) AS violations, (SELECT count(*) FROM ce) + 2 + 2 * (SELECT count(*) FROM comps) AS checks) SELECT checks, violations, greatest(0, 100 * (checks - violations) // checks) AS score FROM v""",
)(lambda s, d: constraint.drift(_ce(s, d), bind.components(s, d), LAYERS, RULES, _limits(s)))
query("import_direction", f"WITH RECURSIVE {DAG}, {_DEPTH} SELECT src, dst, a.depth AS d_src, b.depth AS d_dst FROM dag JOIN dep a ON a.node = src JOIN dep b ON b.node = dst WHERE a.depth > 0 AND a.depth < b.depth")(
    lambda s, d: constraint.import_direction(checkpoint(bind.component_dag(s, d)))
)
_IFACE = "im AS (SELECT DISTINCT regexp_extract(trim(from_name), '([^.]*)$', 1) AS f, regexp_extract(regexp_extract(to_name, '([A-Za-z0-9_]+(?:[-./]+[A-Za-z0-9_]+)*)', 1), '([^.]*)$', 1) AS t FROM impl_edges WHERE from_name IS NOT NULL AND to_name IS NOT NULL AND kind = 'implements')"
query("interface_metrics", f"WITH {N}, {_IFACE}, i AS (SELECT name, max(end_line - line) AS methods FROM n WHERE kind = 'interface' GROUP BY 1), m AS (SELECT t AS name, string_agg(f, ',' ORDER BY f) AS implementors FROM im GROUP BY 1) SELECT name, methods, coalesce(implementors, '') AS implementors, implementors IS NULL AS orphan FROM i LEFT JOIN m USING (name)")(
    lambda s, d: _interfaces(s, d)["interfaces"].select("name", "methods", _text("implementors"), "orphan")
)


def _interfaces(s: SparkSession, d: str) -> dict:
    from ..functions.scalar import bare_name
    from ..operators.orphans import target_name

    i = bind.symbol_nodes(s, d).where("kind = 'interface'").select("name", (F.col("end_line") - F.col("line")).alias("methods"))
    imp = table(s, d, "impl_edges").where("from_name IS NOT NULL AND to_name IS NOT NULL AND kind = 'implements'").select(bare_name(F.trim("from_name")).alias("from"), bare_name(target_name(F.col("to_name"))).alias("to"))
    return constraint.interface_metrics(i, imp)


# -- clinic -----------------------------------------------------------------------------------------------------------------------
HX = "hx AS (SELECT name, name = 'NATION_0' AS has_main, n_symbols, CASE WHEN n_symbols % 5 = 0 THEN n_symbols ELSE 0 END AS n_interfaces, n_symbols AS n_types, loc % 3 = 0 AS external FROM comps), tot AS (SELECT count(*) AS n FROM comps), rl AS (SELECT name AS component, CASE WHEN has_main THEN 'entrypoint' WHEN coalesce(fan_out, 0) >= 10 AND coalesce(fan_in, 0) <= 1 THEN 'entrypoint' WHEN n_symbols > 0 AND n_interfaces / n_symbols > 0.5 THEN 'port' WHEN external THEN 'adapter' WHEN n > 2 AND coalesce(fan_in, 0) / n > 0.4 AND n_types <= 3 THEN 'infra' ELSE 'domain' END AS role FROM hx LEFT JOIN fi USING (name) LEFT JOIN fo USING (name), tot)"


def _hexa(s: SparkSession, d: str) -> DataFrame:
    c = bind.components(s, d)
    c = c.select("name", "n_symbols", (F.col("name") == "NATION_0").alias("has_main"), F.when(F.col("n_symbols") % 5 == 0, F.col("n_symbols")).otherwise(0).alias("n_interfaces"), F.col("n_symbols").alias("n_types"), (F.col("loc") % 3 == 0).alias("external"))
    return clinic.hexa_roles(c, _ce(s, d))


query("hexa_roles", f"WITH {CE}, {COMPS}, {FI}, {HX} SELECT * FROM rl")(_hexa)
query("hexa_violations", f"WITH {CE}, {COMPS}, {FI}, {HX}, v AS (SELECT src, dst, a.role AS from_role, b.role AS to_role FROM ce JOIN rl a ON a.component = src JOIN rl b ON b.component = dst) SELECT *, CASE WHEN to_role = 'app' THEN 'warning' ELSE 'error' END AS severity FROM v WHERE (from_role = 'domain' AND to_role IN ('adapter', 'infra', 'app')) OR (from_role = 'port' AND to_role IN ('adapter', 'infra'))")(
    lambda s, d: clinic.hexa_violations(_ce(s, d), checkpoint(_hexa(s, d)))
)
query("dip", f"WITH {CE}, {COMPS}, {FI}, {HX}, v AS (SELECT src, dst, a.role AS f, b.role AS t FROM ce JOIN rl a ON a.component = src JOIN rl b ON b.component = dst) SELECT src AS component, 'DIP' AS principle, CASE WHEN f = 'app' THEN 'warning' ELSE 'error' END AS severity, dst AS reason FROM v WHERE (f = 'domain' AND t IN ('adapter', 'infra')) OR (f = 'app' AND t = 'adapter')")(
    lambda s, d: clinic.dip(_ce(s, d), checkpoint(_hexa(s, d)))
)
_SRP = f"""g AS (SELECT {pkg("source")} AS name, {pkg("target")} AS t FROM se), o AS (SELECT name, count(*) AS fan_out, count(DISTINCT split_part(t, '/', 1)) AS domains FROM g GROUP BY 1), l AS (SELECT package AS name, sum(coalesce(end_line - line, 0)) AS loc, count(*) AS n_symbols FROM n WHERE package <> '' GROUP BY 1),
sr AS (SELECT name AS component, 'SRP' AS principle, 'warning' AS severity, 'size' AS reason FROM l JOIN o USING (name) WHERE (loc > 1000 AND fan_out > 8) OR (loc > 500 AND fan_out > 5) UNION ALL SELECT name, 'SRP', 'warning', 'domains' FROM l JOIN o USING (name) WHERE domains > 3 AND n_symbols > 20)"""


def _packages(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = bind.symbol_nodes(s, d).where("package <> ''").groupBy(F.col("package").alias("name")).agg(F.sum(F.coalesce(F.col("end_line") - F.col("line"), F.lit(0))).alias("loc"), F.count(F.lit(1)).alias("n_symbols"))
    return c, bind.simple_call_edges(s, d).select(package_of("source").alias("src"), package_of("target").alias("dst"))


query("srp", f"WITH {SE}, {N}, {_SRP} SELECT * FROM sr")(lambda s, d: clinic.srp(*_packages(s, d)))
_ISP = "isp AS (SELECT package AS component, 'ISP' AS principle, CASE WHEN end_line - line > 8 THEN 'error' ELSE 'warning' END AS severity, name AS reason FROM n WHERE kind = 'interface' AND end_line - line > 5)"


def _isp(s: SparkSession, d: str) -> DataFrame:
    return clinic.isp(bind.symbol_nodes(s, d).where("kind = 'interface'").select(F.col("package").alias("component"), "name", (F.col("end_line") - F.col("line")).alias("methods")))


query("isp", f"WITH {N}, {_ISP} SELECT * FROM isp")(_isp)
query("solid_summary", f"WITH {SE}, {N}, {_SRP}, {_ISP} SELECT principle, count(*) AS n FROM (SELECT * FROM sr UNION ALL SELECT * FROM isp) GROUP BY 1")(lambda s, d: clinic.solid_scan(clinic.srp(*_packages(s, d)), _isp(s, d))["summary"])
query("ocp")(lambda s, d: clinic.ocp(table(s, d, "parsed_files").select(F.col("path").alias("component"), "source")))
query(
    "pattern_scan",
    f"WITH RECURSIVE {CE}, {XD}, y AS (SELECT * FROM x WHERE src <> dst), far AS (SELECT src AS a, dst AS b FROM y UNION SELECT a, dst FROM far JOIN y ON b = src) SELECT 'circular_dependency' AS pattern, a AS component, 1.0::DOUBLE AS confidence FROM far WHERE a = b UNION ALL SELECT DISTINCT 'inappropriate_intimacy', a.src, 0.9 FROM x a JOIN x b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst",
)(lambda s, d: clinic.pattern_scan(_ce(s, d)))
query("pattern_catalog", " UNION ALL ".join("SELECT " + ", ".join(f"'{v}' AS {k}" for k, v in zip(("id", "kind", "name", "about"), row)) for row in clinic.CATALOG))(lambda s, d: clinic.pattern_catalog(s))
query(
    "cross_repo_new_cycles_len4",
    f"WITH {CE}, {XD}, {CYC} SELECT count(*) FILTER (len > 1) AS new_cycles FROM cyc",
)(lambda s, d: impact.new_cycles(_ce(s, d).where("src < dst"), _ce(s, d).where("src >= dst"), 4))
query("resolve_roles", f"WITH {CE}, {COMPS}, {FI}, {HX} SELECT component, CASE WHEN component = 'NATION_1' THEN 'infra' ELSE role END AS role FROM rl UNION ALL SELECT 'elsewhere', 'port'")(
    lambda s, d: clinic.resolve_roles(_hexa(s, d), s.createDataFrame([("NATION_1", "infra"), ("elsewhere", "port")], "component string, role string"))
)
query("suppressed", f"WITH {SE}, {N}, {_SRP} SELECT * FROM sr WHERE component <> (SELECT min(component) FROM sr)")(lambda s, d: _suppressed(s, d))


def _suppressed(s: SparkSession, d: str) -> DataFrame:
    found = checkpoint(clinic.srp(*_packages(s, d)))
    return clinic.suppress(found, found.agg(F.min("component").alias("component")).withColumn("principle", F.lit("SRP")))


query(
    "gaps",
    r"""WITH f AS (SELECT CASE WHEN contains(rel_path, '/') THEN regexp_replace(rel_path, '/[^/]*$', '') ELSE '' END AS component, lower(regexp_extract(rel_path, '([^/]*)$', 1)) AS base FROM parsed_files WHERE rel_path IS NOT NULL),
g AS (SELECT component, bool_or(regexp_matches(base, '(_test\.go|^test_.*\.py|_test\.py|\.(test|spec)\.[jt]sx?|test\.java|_test\.rs)$')) AS t, bool_or(regexp_matches(base, '^(readme|doc)(\.|$)|\.md$|^doc\.go$')) AS d FROM f GROUP BY 1)
SELECT component, 'no tests' AS gap, 'warning' AS severity FROM g WHERE NOT t UNION ALL SELECT component, 'no docs', 'warning' FROM g WHERE NOT d""",
)(lambda s, d: constraint.gaps(table(s, d, "parsed_files").where("rel_path IS NOT NULL").select(dir_of("rel_path").alias("component"), F.col("rel_path").alias("file"))))
query("search_components", f"WITH {COMPS} SELECT name, loc, churn FROM comps WHERE contains(lower(name), 'nation_1')")(lambda s, d: retrieval.search_components(bind.components(s, d), "Nation_1").select("name", "loc", "churn"))
query("top_churn", f"WITH {COMPS} SELECT name AS component, churn FROM comps ORDER BY churn DESC, name LIMIT 10")(lambda s, d: retrieval.top_churn(bind.components(s, d)))
query("symbol_hashes", f"WITH {N} SELECT fqn, substr(sha256(fqn), 1, 16) AS hash FROM n")(lambda s, d: bind.symbol_nodes(s, d).select("fqn", short_hash("fqn").alias("hash")))
query(
    "changed_packages",
    f"WITH c AS (SELECT DISTINCT event_type AS name FROM events UNION SELECT n_name FROM nation), h AS (SELECT DISTINCT event_type AS name FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY) SELECT name, name IN (SELECT name FROM h) AS changed FROM c",
)(lambda s, d: _changed(s, d))


def _changed(s: SparkSession, d: str) -> DataFrame:
    c, last = bind.commits(s, d), table(s, d, "events").agg(F.max("ts").alias("last"))  # one row
    recent = c.crossJoin(F.broadcast(last)).where(F.col("date") >= F.col("last") - F.expr("INTERVAL 1 DAY"))
    names = table(s, d, "events").select(F.col("event_type").alias("name")).union(table(s, d, "nation").select("n_name")).distinct()
    return temporal.changed_packages(recent.select("file"), names)


query("detect_language")(lambda s, d: scanners.detect_language(table(s, d, "parsed_files").where("rel_path IS NOT NULL").select(F.col("project").alias("root"), F.col("rel_path").alias("path")).distinct()))
query("call_path")(lambda s, d: _call_path(s, d))


def _call_path(s: SparkSession, d: str) -> DataFrame:
    """From the first caller to the last of the names it reaches within three hops."""
    e = checkpoint(bind.simple_call_edges(s, d).select(F.regexp_extract("source", r"([^.]*)$", 1).alias("source"), F.regexp_extract("target", r"([^.]*)$", 1).alias("target")).distinct())
    start = e.agg(F.min("source")).first()[0]
    if start is None:
        return s.createDataFrame([], "pos int, node string")
    goal = graph.closure(e, _seed(s, start), "source", "target", max_depth=3).agg(F.max(F.struct("depth", "node")).alias("x")).first()["x"]["node"]
    path, _ = retrieval.call_path(e, start, goal)
    return s.createDataFrame(list(enumerate(path)), "pos int, node string")


query("symbol_quality")(lambda s, d: clinic.symbol_quality(bind.symbol_nodes(s, d), graph.weighted_fan_in(bind.call_edges(s, d).withColumn("weight", F.lit(1)), "source", "target")))
_V = "ARRAY[" + ", ".join(f"'{k}'" for k in clinic.SYNONYMS) + "]", "ARRAY[" + ", ".join(f"'{v}'" for v in clinic.SYNONYMS.values()) + "]"
query(
    "vocab_map",
    f"""WITH {N}, w AS (SELECT DISTINCT package, lower(unnest(regexp_extract_all(name, '[A-Z]+[a-z0-9]*|[a-z0-9]+'))) AS word FROM n WHERE NOT regexp_matches(name, '[A-Z]{{2}}|[^A-Za-z]') AND name IS NOT NULL),
c AS (SELECT package, word, coalesce({_V[1]}[list_position({_V[0]}, word)], word) AS canonical FROM w), g AS (SELECT canonical, string_agg(DISTINCT word, ',' ORDER BY word) AS variants, count(DISTINCT word) AS k, count(DISTINCT package) AS packages FROM c GROUP BY 1) SELECT canonical, variants, packages FROM g WHERE k > 1 AND packages > 1""",
)(lambda s, d: clinic.vocabulary(bind.symbol_nodes(s, d).where(~F.col("name").rlike("[A-Z]{2}|[^A-Za-z]"))).select("canonical", _text("variants"), "packages"))
query("component_meta", f"WITH {CE}, {COMPS}, {FI} SELECT name AS component, 'component' AS role, lower(name) AS keywords, CASE WHEN coalesce(fan_in, 0) >= 5 AND churn >= 15 THEN 'fatal' WHEN coalesce(fan_in, 0) >= 3 AND churn >= 8 THEN 'sick' ELSE 'healthy' END AS health FROM comps LEFT JOIN fi USING (name)")(
    lambda s, d: clinic.component_meta(bind.components(s, d).withColumn("symbols", F.expr("cast(array() as array<string>)")), bind.component_edges(s, d)).select("component", "role", _text("keywords"), "health")
)

# -- time ---------------------------------------------------------------------------------------------------------------------------
_AS_OF = "2024-01-30"


def _at(s: str = _AS_OF):
    return F.lit(s).cast("timestamp_ntz")


query("churn", f"SELECT event_type AS package, count(*) AS changes FROM events WHERE ts >= TIMESTAMP '{_AS_OF}' - INTERVAL 20 DAY AND ts <= TIMESTAMP '{_AS_OF}' GROUP BY 1")(lambda s, d: temporal.churn(bind.commits(s, d), _at(), 20))
query("recent_commits", "SELECT left(event_id::VARCHAR, 8) AS hash8, event_type AS package, user_id::VARCHAR AS author, ts AS date, event_type || ': ' || props AS subject FROM events")(lambda s, d: temporal.recent_commits(bind.commits(s, d)))
query("author_ownership", "WITH g AS (SELECT event_type AS package, user_id::VARCHAR AS author, count(*) AS changes FROM events GROUP BY 1, 2) SELECT package, author, changes FROM g QUALIFY row_number() OVER (PARTITION BY package ORDER BY changes DESC, author) <= 5")(
    lambda s, d: temporal.author_ownership(bind.commits(s, d))
)
query("file_hotspots", f"WITH g AS (SELECT event_type || '/f' || (user_id % 7) || '.go' AS file, count(*) AS changes FROM events WHERE ts >= TIMESTAMP '{_AS_OF}' - INTERVAL 30 DAY AND ts <= TIMESTAMP '{_AS_OF}' GROUP BY 1) SELECT * FROM g ORDER BY changes DESC, file LIMIT 50")(
    lambda s, d: temporal.file_hot_spots(bind.commits(s, d), _at())
)
query("coverage", "SELECT component, round(cov, 6) AS coverage_pct FROM (SELECT event_type AS component, sum(CASE WHEN user_id % 3 > 0 THEN event_id % 9 + 1 ELSE 0 END) * 100.0::DOUBLE / sum(event_id % 9 + 1) AS cov FROM events GROUP BY 1)")(
    lambda s, d: temporal.coverage(table(s, d, "events").select(F.concat("event_type", F.lit("/a.go:1.1,2.2 "), (F.col("event_id") % 9 + 1).cast("string"), F.lit(" "), (F.col("user_id") % 3).cast("string")).alias("value"))).withColumn("coverage_pct", F.round("coverage_pct", 6))
)

# -- retrieval ------------------------------------------------------------------------------------------------------------------------
query("search_symbols", f"WITH {N} SELECT fqn FROM n WHERE exported AND contains(lower(name), 'onyx')")(lambda s, d: retrieval.search_symbols(bind.symbol_nodes(s, d), "Onyx").select("fqn"))
query("dependencies", f"WITH {CE} SELECT 'out' AS direction, dst AS other FROM ce WHERE src = 'NATION_3' UNION ALL SELECT 'in', src FROM ce WHERE dst = 'NATION_3'")(lambda s, d: retrieval.dependencies(bind.component_edges(s, d), "NATION_3"))
query("coupling_table", f"WITH {CE}, {COMPS}, {FI} SELECT name AS component, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, churn, loc FROM comps LEFT JOIN fi USING (name) LEFT JOIN fo USING (name) WHERE coalesce(fan_in, 0) > 0 OR coalesce(fan_out, 0) > 0 ORDER BY 2 DESC, 1 LIMIT 10")(
    lambda s, d: retrieval.coupling_table(bind.components(s, d), bind.component_edges(s, d), "fan_in", 10)
)
query(
    "component_detail",
    f"WITH {CE}, {COMPS}, o AS (SELECT src AS name, string_agg(dst, ',' ORDER BY dst) AS imports FROM (SELECT DISTINCT src, dst FROM ce) GROUP BY 1), i AS (SELECT dst AS name, string_agg(src, ',' ORDER BY src) AS importers, count(*) AS k FROM (SELECT DISTINCT src, dst FROM ce) GROUP BY 1) SELECT name AS component, coalesce(imports, '') AS imports, coalesce(importers, '') AS importers, churn, CASE WHEN coalesce(k, 0) >= 5 AND churn >= 15 THEN 'fatal' WHEN coalesce(k, 0) >= 3 AND churn >= 8 THEN 'sick' ELSE 'healthy' END AS health FROM comps LEFT JOIN o USING (name) LEFT JOIN i USING (name)",
)(lambda s, d: retrieval.component_detail(bind.components(s, d), bind.component_edges(s, d)))
query("callers", f"WITH {E} SELECT DISTINCT source AS caller, file FROM e WHERE {bare('target')} = (SELECT {bare('min(target)')} FROM e)")(lambda s, d: retrieval.callers(bind.call_edges(s, d), bind.call_edges(s, d).agg(F.min("target")).first()[0].rpartition(".")[2]))
query("callees", f"WITH {E} SELECT DISTINCT target AS callee FROM e WHERE {bare('source')} = (SELECT {bare('min(source)')} FROM e)")(lambda s, d: retrieval.callees(bind.call_edges(s, d), _pivot(s, d).rpartition(".")[2]))


def _parts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.split("p_name", " ").alias("keywords"))


_TOK = "['metric', 'steel', 'small']"
query(
    "book_roots",
    f"""WITH p AS (SELECT p_partkey::VARCHAR AS id, list_transform(string_split(p_name, ' '), lambda x: lower(x)) AS kw FROM part), s AS (SELECT id, len(list_filter({_TOK}, lambda t: len(list_filter(kw, lambda k: k = t OR contains(k, t) OR contains(t, k))) > 0)) AS h, len(kw) AS n FROM p)
SELECT id, round(h / greatest(1, 3 + n - h), 6) AS score FROM s WHERE h > 0 ORDER BY 2 DESC, 1 LIMIT 3""",
)(lambda s, d: retrieval.book_query(_parts(s, d), s.createDataFrame([("1", "2"), ("2", "3")], "`from` string, `to` string"), "Metric, steel small!")["roots"].withColumn("score", F.round("score", 6)))
query("route")(lambda s, d: table(s, d, "documents").where("text IS NOT NULL").select(retrieval.route(F.col("text")).alias("action")).groupBy("action").agg(F.count(F.lit(1)).alias("n")))
ORACLES["route"] = (
    "WITH t AS (SELECT lower(text) AS q FROM documents WHERE text IS NOT NULL) SELECT CASE "
    + " ".join("WHEN " + " OR ".join(f"contains(q, '{w}')" for w in words) + f" THEN '{a}'" for a, words in retrieval.ROUTES)
    + " ELSE 'none' END AS action, count(*) AS n FROM t GROUP BY 1"
)

# -- sources ---------------------------------------------------------------------------------------------------------------------------
def _files(s: SparkSession, d: str) -> DataFrame:
    """Each file once, by its normal path."""
    f = table(s, d, "parsed_files").where("source IS NOT NULL").select("file_id", F.coalesce("rel_path", "path").alias("path"), "source")
    return f.groupBy("file_id").agg(F.min(F.struct("path", "source")).alias("x")).select(F.concat_ws("/", F.col("file_id").cast("string"), "x.path").alias("path"), F.col("x.source").alias("text"))


_FILES = "f AS (SELECT file_id || '/' || x.path AS path, x.source AS text FROM (SELECT file_id, min({'path': coalesce(rel_path, path), 'source': source}) AS x FROM parsed_files WHERE source IS NOT NULL GROUP BY 1))"
_LINES = "l AS (SELECT path, generate_subscripts(t, 1)::INTEGER AS line, unnest(t) AS value FROM (SELECT path, regexp_split_to_array(text, '\\r?\\n') AS t FROM f))"
query("c_includes", f"WITH {_FILES}, {_LINES} SELECT path, line, regexp_extract(value, '^\\s*#\\s*include\\s+\"([^\"]+)\"', 1) AS target FROM l WHERE regexp_matches(path, '(?i)\\.[ch]$') AND regexp_matches(value, '^\\s*#\\s*include\\s+\"[^\"]+\"')")(
    lambda s, d: scanners.imports(_files(s, d).where(F.col("path").rlike(r"(?i)\.[ch]$"))).select("path", "line", "target")
)
query("python_imports", f"WITH {_FILES}, {_LINES}, x AS (SELECT path, line, coalesce(nullif(regexp_extract(value, '^\\s*from\\s+([\\w]+(?:\\.\\w+)*)\\s+import\\b', 1), ''), nullif(regexp_extract(value, '^\\s*import\\s+([\\w.]+)', 1), '')) AS target FROM l WHERE regexp_matches(path, '(?i)\\.py$')) SELECT * FROM x WHERE target IS NOT NULL")(
    lambda s, d: scanners.imports(_files(s, d).where(F.col("path").rlike(r"(?i)\.py$"))).select("path", "line", "target")
)
query("declarations")(lambda s, d: scanners.declarations(_files(s, d)))
query("import_edges")(lambda s, d: scanners.import_edges(scanners.imports(_files(s, d)), table(s, d, "parsed_files").select("package").distinct()))
query("classes")(lambda s, d: scanners.classes(_files(s, d)))
query("implementations")(lambda s, d: scanners.implementations(_files(s, d)))
query("nesting_depth")(lambda s, d: scanners.nesting_depth(_files(s, d)))
query("regex_calls")(lambda s, d: scanners.regex_calls(_files(s, d)))
query("anchors")(lambda s, d: scanners.anchors(_files(s, d)))
query("state_machines")(lambda s, d: scanners.state_machines(_files(s, d)).select("path", "name", _text("states"), "initial"))
query("conventions")(lambda s, d: scanners.conventions(table(s, d, "parsed_files").where("rel_path IS NOT NULL").select(F.col("rel_path").alias("path")).distinct()))
query("source_snippet")(lambda s, d: scanners.source_snippet(_snip_files(s, d), _snip_edges(s, d)))


def _snip_files(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "parsed_files").where("rel_path IS NOT NULL AND source IS NOT NULL")
    return f.groupBy("rel_path").agg(F.min("source").alias("text")).withColumnRenamed("rel_path", "path")


def _snip_edges(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "parsed_files").where("rel_path IS NOT NULL").select("project", F.col("package").alias("target"), F.col("rel_path").alias("file"), F.lit(3).alias("line")).distinct().withColumnRenamed("project", "source")


query("go_signatures", f"WITH {N} SELECT count(*) AS n FROM n WHERE signature IS NOT NULL")(lambda s, d: bind.symbol_nodes(s, d).where("signature IS NOT NULL").select(*[c.alias(k) for k, c in zip(("p", "r"), scanners.go_signature(F.col("signature")))]).agg(F.count(F.coalesce("p", "r")).alias("n")))


@query("typed_pipelines")
def _pipelines(s: SparkSession, d: str) -> DataFrame:
    p, r = scanners.go_signature(F.col("signature"))
    sig = bind.symbol_nodes(s, d).where("signature IS NOT NULL").select(F.col("fqn").alias("target"), p.alias("param_types"), r.alias("return_types"))
    e = bind.call_edges(s, d).join(sig, "target", "left").select("source", "target", "param_types", "return_types", "file", "line")
    return kernels.typed_pipelines(e, 2).select("start", "length", _text("steps"), _text("type_chain"))


# -- text ---------------------------------------------------------------------------------------------------------------------------------
query("facts", f"WITH {CE}, {COMPS} SELECT src || ' depends on ' || dst || ' with ' || weight || ' uses.' AS fact FROM ce UNION ALL SELECT name || ' has ' || loc || ' lines.' FROM comps")(lambda s, d: render.facts(bind.components(s, d), bind.component_edges(s, d)))
query("edge_list", f"WITH {CE} SELECT 'edges:' || chr(10) || string_agg(src || ' -> ' || dst, chr(10) ORDER BY src, dst) AS text FROM ce")(lambda s, d: render.edge_list(bind.component_edges(s, d)))
for _kind in ("dependency", "tree", "coupling", "churn", "c4", "layers", "zones", "dsm"):
    query(f"diagram_{_kind}")(lambda s, d, kind=_kind: render.render(kind, components=bind.components(s, d), edges=_ce(s, d)))
for _kind in ("sequence", "callgraph", "dataflow"):
    query(f"diagram_{_kind}")(lambda s, d, kind=_kind: render.render(kind, calls=bind.call_edges(s, d), nodes=bind.symbol_nodes(s, d), start=_pivot(s, d), depth=2))


def _types(s: SparkSession, d: str) -> dict[str, DataFrame]:
    n, e = bind.symbol_nodes(s, d), bind.symbol_edges(s, d)
    refs = table(s, d, "field_refs").where("owner IS NOT NULL AND ref_type IS NOT NULL").select(F.trim("owner").alias("owner"), "field", "ref_type").distinct()
    return {"classes": n.where(F.col("kind").isin("struct", "class", "interface")).select(F.col("fqn").alias("name"), "kind"), "impls": e.where("kind <> 'call'").select(F.col("source").alias("from"), F.col("target").alias("to"), "kind"), "refs": refs}


for _kind in ("classes", "interfaces", "er"):
    query(f"diagram_{_kind}")(lambda s, d, kind=_kind: render.render(kind, **{k: v for k, v in _types(s, d).items() if kind == "er" or k != "refs"}))
query("diagram_hexa")(lambda s, d: render.render("hexa", roles=_hexa(s, d), violations=clinic.hexa_violations(_ce(s, d), checkpoint(_hexa(s, d)))))
query("json_report")(lambda s, d: render.json_report(bind.components(s, d), _ce(s, d)))
