"""The code-graph reading of the tables: symbols and call edges as they are, components and their edges from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import fqn_of
from ..operators.orphans import target_name
from ..runtime import table


def symbol_nodes(spark: SparkSession, d: str) -> DataFrame:
    """One row a name: the declaration loaded last (ties: the larger id)."""
    s = table(spark, d, "symbols").withColumn("fqn", fqn_of("package", "name")).where(F.col("fqn").isNotNull())
    s = s.withColumn("package", F.coalesce("package", F.lit("")))
    cols = ["package", "name", "kind", "exported", "file", "line", "end_line", "signature", "receiver_type"]
    return s.groupBy("fqn").agg(F.max(F.struct("loaded_at", "symbol_id", *cols)).alias("x")).select("fqn", *[F.col(f"x.{c}").alias(c) for c in cols])


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    """(source, target, kind, file, line, edge_id): each delivered call once."""
    c = table(spark, d, "calls").where(F.col("caller").isNotNull() & F.col("callee").isNotNull())
    return c.select(F.col("call_id").alias("edge_id"), F.col("caller").alias("source"), F.col("callee").alias("target"), F.lit("call").alias("kind"), "file", "line").distinct()


def simple_call_edges(spark: SparkSession, d: str) -> DataFrame:
    """(source, target), distinct."""
    c = table(spark, d, "calls").where(F.col("caller").isNotNull() & F.col("callee").isNotNull())
    return c.select(F.col("caller").alias("source"), F.col("callee").alias("target")).distinct()


def symbol_edges(spark: SparkSession, d: str) -> DataFrame:
    """(source, target, kind): distinct calls, implementations and field references."""
    calls = simple_call_edges(spark, d).withColumn("kind", F.lit("call"))
    impl = table(spark, d, "impl_edges").select(F.trim("from_name").alias("source"), target_name(F.col("to_name")).alias("target"), F.lit("implements").alias("kind"))
    refs = table(spark, d, "field_refs").select(F.trim("owner").alias("source"), target_name(F.col("ref_type")).alias("target"), F.lit("field_ref").alias("kind"))
    return calls.unionByName(impl).unionByName(refs).where(F.col("source").isNotNull() & F.col("target").isNotNull() & (F.col("target") != "")).distinct()


def _nation_pairs(spark: SparkSession, d: str) -> DataFrame:
    li, o, c, s, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
    j = li.select("l_orderkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    # Only keys travel through the joins; the 25 names come last.
    w = j.groupBy("c_nationkey", "s_nationkey", "l_orderkey").agg(F.count(F.lit(1)).alias("k")).groupBy("c_nationkey", "s_nationkey").agg(F.sum("k").alias("weight"), F.count(F.lit(1)).alias("loc_surface"))
    a, b = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("src")), n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("dst"))
    return w.join(a, "c_nationkey").join(b, "s_nationkey")


def component_edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, weight, call_sites, loc_surface): customers' nation to suppliers' nation, every pair that trades."""
    return _nation_pairs(spark, d).select("src", "dst", "weight", F.col("weight").alias("call_sites"), "loc_surface")


def component_dag(spark: SparkSession, d: str) -> DataFrame:
    return component_edges(spark, d).where("src < dst")


def components(spark: SparkSession, d: str) -> DataFrame:
    """(name, package, loc, churn, n_symbols)."""
    n, r, c, s, li = (table(spark, d, t) for t in ("nation", "region", "customer", "supplier", "lineitem"))
    base = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("name"), F.col("r_name").alias("package"))
    loc = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg((F.count(F.lit(1)) * 10).alias("loc"))
    sym = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_symbols"))
    last = li.agg(F.max("l_shipdate").alias("last"))  # one row
    recent = li.select("l_suppkey", "l_shipdate").crossJoin(F.broadcast(last)).where(F.col("l_shipdate") >= F.col("last") - F.expr("INTERVAL 90 DAYS"))
    per_supplier = recent.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("k"))
    churn = per_supplier.join(s, "s_suppkey").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sum("k").alias("churn"))
    out = base.join(loc, "n_nationkey", "left").join(sym, "n_nationkey", "left").join(churn, "n_nationkey", "left")
    return out.select("name", "package", *[F.coalesce(x, F.lit(0)).cast("bigint").alias(x) for x in ("loc", "churn", "n_symbols")])


def commits(spark: SparkSession, d: str) -> DataFrame:
    """(hash, author, date, message, file): events as commits."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").cast("string").alias("hash"),
        F.col("user_id").cast("string").alias("author"),
        F.col("ts").alias("date"),
        F.concat(F.col("event_type"), F.lit(": "), F.col("props"), F.lit("\nbody")).alias("message"),
        F.concat(F.col("event_type"), F.lit("/f"), (F.col("user_id") % 7).cast("string"), F.lit(".go")).alias("file"),
    )


def latest_components(spark: SparkSession, d: str) -> DataFrame:
    """Each project's components in its last complete snapshot, the latest delivery of each."""
    log = table(spark, d, "snapshot_log").where("status = 'complete'").groupBy("project").agg(F.max("snapshot_no").alias("snapshot_no"))
    c = table(spark, d, "component_snapshots").join(log, ["project", "snapshot_no"])
    cols = ["package", "language", "trust_zone", "symbols", "churn", "loc", "max_nesting", "avg_nesting", "changed"]
    key = F.struct("delivered_at", F.xxhash64(*[F.coalesce(F.col(x).cast("string"), F.lit("\0")) for x in ("package", "trust_zone", "churn", "loc", "max_nesting")]), *cols)
    return c.groupBy("project", "name").agg(F.max(key).alias("x")).select("project", "name", *[F.col(f"x.{x}").alias(x) for x in cols])
