"""Churn and heavy names of a commit or call stream. An extension: batch results, kept up to date with late rows allowed for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import dir_of


def windowed_churn(commits: DataFrame, window: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """(start, package, changes) of a stream of (date, file): tumbling or sliding windows, rows later than ``late`` are left out."""
    w = F.window("date", window, slide) if slide else F.window("date", window)
    c = commits.withColumn("date", F.col("date").cast("timestamp")).withWatermark("date", late).where(~F.col("file").endswith("_test.go")).withColumn("package", dir_of("file")).where("package <> ''")
    return c.groupBy(w.alias("w"), "package").agg(F.count(F.lit(1)).alias("changes")).select(F.col("w.start").alias("start"), "package", "changes")


def name_counts(calls: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """(start, field, fqn, n) of a stream of calls: per-window states of names, to be added up over windows."""
    sides = F.array(F.struct(F.lit("callee").alias("field"), F.col("callee").alias("fqn")), F.struct(F.lit("caller").alias("field"), F.col("caller").alias("fqn")))
    c = calls.withColumn("t", F.col("loaded_at").cast("timestamp")).withWatermark("t", late).select("t", F.explode(sides).alias("s")).select("t", "s.*").where("fqn IS NOT NULL")
    return c.groupBy(F.window("t", window).alias("w"), "field", "fqn").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "field", "fqn", "n")
