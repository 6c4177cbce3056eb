"""Aggregations over commit rows (hash, author, date, message, file)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import dir_of


def _in_window(as_of: Column, days: int) -> Column:
    return (F.col("date") >= as_of - F.expr(f"INTERVAL {days} DAYS")) & (F.col("date") <= as_of)


def churn(commits: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """(package, changes): changed files a folder within the days before; tests and files at the root don't count."""
    c = commits.where(_in_window(as_of, days) & ~F.col("file").endswith("_test.go")).select(dir_of("file").alias("package"))
    return c.where("package <> ''").groupBy("package").agg(F.count(F.lit(1)).alias("changes"))


def recent_commits(commits: DataFrame) -> DataFrame:
    """(hash8, package, author, date, subject): distinct; files at the root don't count."""
    c = commits.select(F.substring("hash", 1, 8).alias("hash8"), dir_of("file").alias("package"), "author", "date", F.substring_index("message", "\n", 1).alias("subject")).where("package <> ''")
    return c.groupBy("hash8", "package").agg(F.max(F.struct("date", "author", "subject")).alias("x")).select("hash8", "package", "x.author", "x.date", "x.subject")


def author_ownership(commits: DataFrame, top: int = 5) -> DataFrame:
    """(package, author, changes): the most frequent authors of each folder, by changed files."""
    g = commits.select(dir_of("file").alias("package"), "author").where("package <> ''").groupBy("package", "author").agg(F.count(F.lit(1)).alias("changes"))
    return g.withColumn("r", F.row_number().over(Window.partitionBy("package").orderBy(F.desc("changes"), "author"))).where(F.col("r") <= top).drop("r")


def file_hot_spots(commits: DataFrame, as_of: Column, days: int = 30, top: int = 50) -> DataFrame:
    """(file, changes): the most changed files within the days before."""
    g = commits.where(_in_window(as_of, days)).groupBy("file").agg(F.count(F.lit(1)).alias("changes"))
    return g.orderBy(F.desc("changes"), "file").limit(top)


def changed_packages(files: DataFrame, components: DataFrame) -> DataFrame:
    """components plus (changed): whether one of the changed files lies in its folder."""
    hit = files.select(dir_of("file").alias("name")).distinct().withColumn("hit", F.lit(True))
    return components.drop("changed").join(hit, "name", "left").withColumn("changed", F.coalesce("hit", F.lit(False))).drop("hit")


def coverage(lines: DataFrame, module: str = "", threshold: float | None = None) -> DataFrame:
    """(component, coverage_pct) of profile lines 'file:range stmts count' (column value); optionally only those under a threshold."""
    m = lambda k: F.regexp_extract("value", r"^(.+):\S+ (\d+) (\d+)\s*$", k)
    p = lines.select(m(1).alias("file"), m(2).alias("stmts"), m(3).alias("count")).where("file <> ''")
    pkg = dir_of(F.regexp_replace("file", f"^{module}/", "") if module else F.col("file"))
    s = F.col("stmts").cast("bigint")
    g = p.groupBy(pkg.alias("component")).agg((F.sum(F.when(F.col("count").cast("bigint") > 0, s).otherwise(0)) * 100.0 / F.sum(s)).alias("coverage_pct"))
    return g if threshold is None else g.where(F.col("coverage_pct") < threshold)
