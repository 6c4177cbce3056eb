"""Queries pN_ of the general problems, with their DuckDB counterparts where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import heavy_keys, orphans, radix_select, snapshot_diff
from ..runtime import table

PS = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)

#: Spellings of languages besides the lower-case name (fixed values).
LANGUAGE_ALIASES = {"golang": "go", "py": "python", "ts": "typescript", "js": "javascript", "rs": "rust"}


def _p2(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_diff.snapshot_changes(table(spark, d, "component_snapshots"), table(spark, d, "snapshot_log"))


def _p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_diff.change_counts(table(spark, d, "component_snapshots"), table(spark, d, "snapshot_log"))


def _p3_tables(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("impl_edges", "field_refs", "calls", "symbols", "platform_symbols")]


def _p3(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(*_p3_tables(spark, d)).select("tab", "ref_id")


def _p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(*_p3_tables(spark, d))


def current_components(spark: SparkSession, d: str) -> DataFrame:
    """One row for each (project, name, snapshot_no), the latest delivery, with the language's one spelling."""
    c = table(spark, d, "component_snapshots")
    lang = F.lower(F.trim("language"))
    for alias, name in LANGUAGE_ALIASES.items():
        lang = F.when(lang == alias, name).otherwise(lang)
    state = F.max(F.struct("delivered_at", lang.alias("language"), "loc", "churn")).alias("s")
    return c.groupBy("project", "name", "snapshot_no").agg(state).select("project", "name", "snapshot_no", "s.language", "s.loc", "s.churn")


def _p4(spark: SparkSession, d: str) -> DataFrame:
    c = current_components(spark, d)
    probes = table(spark, d, "probe_results").select("probe_id", "kind", "fan_out").distinct()
    # All measures go through the same passes: the group is (measure, language or kind).
    one = lambda m, g, v: F.struct(F.struct(F.lit(m).alias("measure"), F.col(g).alias("grp")).alias("key"), F.col(v).cast("bigint").alias("v"))
    sizes = c.select(F.explode(F.array(one("loc", "language", "loc"), one("churn", "language", "churn"))).alias("x"))
    rows = sizes.unionByName(probes.select(one("fan_out", "kind", "fan_out").alias("x"))).select("x.key", "x.v")
    return radix_select.percentiles(rows, "key", "v", PS).select("grp.measure", "grp.grp", "p", "n", "value")


def _p4_combined(spark: SparkSession, d: str) -> DataFrame:
    c = current_components(spark, d)
    probes = table(spark, d, "probe_results").select("probe_id", "kind", "fan_out", F.to_date("probed_at").alias("day")).distinct()
    loc = radix_select.combine(radix_select.sketch(c, "language", "snapshot_no", "loc"), PS)
    churn = radix_select.combine(radix_select.sketch(c, "language", "snapshot_no", "churn"), PS)
    fan = radix_select.combine(radix_select.sketch(probes, "kind", "day", "fan_out"), PS)
    return loc.select(F.lit("loc").alias("measure"), "*").unionByName(churn.select(F.lit("churn").alias("measure"), "*")).unionByName(fan.select(F.lit("fan_out").alias("measure"), "*"))


def _p4_error(spark: SparkSession, d: str) -> DataFrame:
    """The combined sketches against the exact percentiles: (measure, grp, p, n, exact, within the bound)."""
    exact = _p4(spark, d).select("measure", F.col("grp").alias("g"), F.col("p").alias("q"), F.col("value").alias("exact"))
    both = _p4_combined(spark, d).join(exact.withColumnRenamed("measure", "m"), (F.col("measure") == F.col("m")) & F.col("grp").eqNullSafe(F.col("g")) & (F.col("p") == F.col("q")))
    off = F.abs(F.col("value") - F.col("exact"))
    return both.select("measure", "grp", "p", "n", "exact", (off <= F.abs("exact") * 2.0**-12).alias("within"))


def _p4_snapshots(spark: SparkSession, d: str) -> DataFrame:
    c = current_components(spark, d).withColumn("part", F.concat_ws("/", F.coalesce("language", F.lit("")), F.col("snapshot_no").cast("string")))
    return radix_select.percentiles(c, "part", "loc", (0.5,)).select("grp", "n", F.col("value").cast("bigint").alias("value"))


def _p5(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.heavy_names(table(spark, d, "calls"))


def _p5_stats(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.name_stats(table(spark, d, "calls"))


def _p5_probes(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.probe_stats(table(spark, d, "probe_results"))


QUERIES = {
    "p2_found": _p2,
    "p2_counts": _p2_counts,
    "p3_found": _p3,
    "p3_counts": _p3_counts,
    "p4_percentiles": _p4,
    "p4_combined": _p4_combined,
    "p4_combined_error": _p4_error,
    "p4_snapshot_medians": _p4_snapshots,
    "p5_found": _p5,
    "p5_name_stats": _p5_stats,
    "p5_probe_stats": _p5_probes,
}

_P2 = """
WITH done AS (
  SELECT project, snapshot_no, lag(snapshot_no) OVER w AS prev FROM (SELECT DISTINCT project, snapshot_no FROM snapshot_log WHERE status = 'complete')
  WINDOW w AS (PARTITION BY project ORDER BY snapshot_no)),
latest AS (
  SELECT * FROM component_snapshots WHERE project IS NOT NULL AND name IS NOT NULL AND snapshot_no IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY project, name, snapshot_no ORDER BY delivered_at DESC NULLS LAST) = 1),
pairs AS (SELECT * FROM done WHERE prev IS NOT NULL),
a AS (SELECT p.project, p.snapshot_no AS sn, l.* EXCLUDE (project, snapshot_no) FROM pairs p JOIN latest l ON l.project = p.project AND l.snapshot_no = p.snapshot_no),
b AS (SELECT p.project, p.snapshot_no AS sn, l.* EXCLUDE (project, snapshot_no) FROM pairs p JOIN latest l ON l.project = p.project AND l.snapshot_no = p.prev),
comp AS (
  SELECT 'component' AS tab, coalesce(a.sn, b.sn) AS snapshot_no, coalesce(a.project, b.project) AS project, coalesce(a.name, b.name) AS item,
    CASE WHEN b.name IS NULL THEN 'added' WHEN a.name IS NULL THEN 'removed'
      WHEN a.package IS DISTINCT FROM b.package OR a.trust_zone IS DISTINCT FROM b.trust_zone OR a.churn IS DISTINCT FROM b.churn
        OR a.loc IS DISTINCT FROM b.loc OR a.max_nesting IS DISTINCT FROM b.max_nesting THEN 'changed' END AS change
  FROM a FULL JOIN b ON a.project = b.project AND a.sn = b.sn AND a.name = b.name),
sa AS (SELECT project, sn, name || '.' || s.name AS item, list_sort(list_distinct(list(coalesce(s.signature, chr(1))))) AS sig FROM (SELECT project, sn, name, unnest(symbols) AS s FROM a) WHERE s.name IS NOT NULL GROUP BY ALL),
sb AS (SELECT project, sn, name || '.' || s.name AS item, list_sort(list_distinct(list(coalesce(s.signature, chr(1))))) AS sig FROM (SELECT project, sn, name, unnest(symbols) AS s FROM b) WHERE s.name IS NOT NULL GROUP BY ALL),
sym AS (
  SELECT 'symbol' AS tab, coalesce(sa.sn, sb.sn) AS snapshot_no, coalesce(sa.project, sb.project) AS project, coalesce(sa.item, sb.item) AS item,
    CASE WHEN sb.item IS NULL THEN 'added' WHEN sa.item IS NULL THEN 'removed' WHEN sa.sig <> sb.sig THEN 'changed' END AS change
  FROM sa FULL JOIN sb ON sa.project = sb.project AND sa.sn = sb.sn AND sa.item = sb.item),
found AS (SELECT * FROM (SELECT * FROM comp UNION ALL SELECT * FROM sym) WHERE change IS NOT NULL)
"""

_P3 = r"""
WITH refs AS (
  SELECT 'impl_edges' AS tab, edge_id AS ref_id, to_name AS raw, loaded_at AS t FROM impl_edges
  UNION ALL SELECT 'field_refs', ref_id, ref_type, loaded_at FROM field_refs),
named AS (
  SELECT tab, ref_id, t, CASE WHEN raw LIKE '%/%' THEN regexp_extract(raw, '([A-Za-z0-9_]+(?:[-./]+[A-Za-z0-9_]+)*/[A-Za-z0-9_./-]*[A-Za-z0-9_])', 1) ELSE regexp_extract(raw, '([A-Za-z0-9_.]+)', 1) END AS fqn FROM refs
  UNION ALL SELECT 'calls', call_id, loaded_at, trim(callee) FROM calls),
decl AS (
  SELECT CASE WHEN coalesce(package, '') = '' THEN name ELSE package || '.' || name END AS fqn, loaded_at AS since, deleted_at AS until FROM symbols
  UNION ALL SELECT fqn, TIMESTAMP '0001-01-01', NULL FROM platform_symbols),
found AS (
  SELECT DISTINCT tab, ref_id, t FROM named n WHERE fqn IS NOT NULL AND fqn <> '' AND NOT EXISTS (
    SELECT 1 FROM decl d WHERE d.fqn = n.fqn AND d.since <= n.t AND (d.until IS NULL OR d.until > n.t)))
"""

_LANG = "CASE lower(trim(language)) WHEN 'golang' THEN 'go' WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'rs' THEN 'rust' ELSE lower(trim(language)) END"

_CURRENT = f"""current AS (
  SELECT project, name, snapshot_no, {_LANG} AS language, loc, churn FROM component_snapshots
  QUALIFY row_number() OVER (PARTITION BY project, name, snapshot_no ORDER BY delivered_at DESC NULLS LAST) = 1)"""


def _ranked(source: str, group: str, value: str, measure: str) -> str:
    return f"""
  SELECT '{measure}' AS measure, grp, p, n, value FROM (
    SELECT {group} AS grp, {value} AS value, row_number() OVER (PARTITION BY {group} ORDER BY {value}) AS r, count(*) OVER (PARTITION BY {group}) AS n FROM {source} WHERE {value} IS NOT NULL) v,
    (SELECT unnest([{", ".join(f"{p}::DOUBLE" for p in PS)}]) AS p) q WHERE r = greatest(1, ceil(p * n))"""


_P4 = (
    f"WITH {_CURRENT}, probes AS (SELECT DISTINCT probe_id, kind, fan_out FROM probe_results), exact AS ("
    + " UNION ALL ".join([_ranked("current", "language", "loc", "loc"), _ranked("current", "language", "churn", "churn"), _ranked("probes", "kind", "fan_out", "fan_out")])
    + ") "
)

ORACLES = {
    "p2_found": _P2 + "SELECT tab, snapshot_no::INTEGER AS snapshot_no, project, item, change FROM found",
    "p2_counts": _P2 + "SELECT tab, snapshot_no::INTEGER AS snapshot_no, project, change, count(*) AS n FROM found GROUP BY ALL",
    "p3_found": _P3 + "SELECT DISTINCT tab, ref_id FROM found",
    "p3_counts": _P3 + "SELECT tab, strftime(t, '%Y-%m') AS month, count(DISTINCT ref_id) AS n FROM found GROUP BY ALL",
    "p4_percentiles": _P4 + "SELECT measure, grp, p, n, value::BIGINT AS value FROM exact",
    "p4_combined_error": _P4 + "SELECT measure, grp, p, n, value::BIGINT AS exact, TRUE AS within FROM exact",
    "p4_snapshot_medians": f"""WITH {_CURRENT} SELECT grp, n, value::BIGINT AS value FROM (
      SELECT grp, loc AS value, row_number() OVER (PARTITION BY grp ORDER BY loc) AS r, count(*) OVER (PARTITION BY grp) AS n
      FROM (SELECT coalesce(language, '') || '/' || snapshot_no AS grp, loc FROM current WHERE loc IS NOT NULL)) WHERE r = greatest(1, ceil(0.5 * n))""",
    "p5_found": """SELECT field, fqn FROM (SELECT 'callee' AS field, callee AS fqn FROM calls UNION ALL SELECT 'caller', caller FROM calls) WHERE fqn IS NOT NULL
      GROUP BY field, fqn HAVING count(*) >= 0.01 * (SELECT count(*) FROM calls)""",
    "p5_name_stats": """SELECT field, fqn, count(*) AS n, count(DISTINCT partner) AS partners, sum(line)::BIGINT AS sum_line, min(seen_at) AS first_seen, max(seen_at) AS last_seen
      FROM (SELECT 'callee' AS field, callee AS fqn, caller AS partner, line, seen_at FROM calls UNION ALL SELECT 'caller', caller, callee, line, seen_at FROM calls)
      WHERE fqn IS NOT NULL GROUP BY field, fqn""",
    "p5_probe_stats": """SELECT fqn, count(*) AS n, sum(fan_in)::BIGINT AS sum_fan_in, max(fan_in) AS max_fan_in, sum(fan_out)::BIGINT AS sum_fan_out, count(fan_out) AS n_fan_out
      FROM (SELECT DISTINCT probe_id, fqn, fan_in, fan_out FROM probe_results WHERE fqn IS NOT NULL) GROUP BY fqn""",
}
