"""Per-key results over keys that dwarf all others (problem 5).

All results are algebraic: every task keeps one small state a key in its (spilling) hash table, and only these
states are shuffled, so a key with a third of all rows sends no more than one state a task. Distinct partners use
two such levels: first the pairs (name, partner), which no single name can dominate after the local merge, then
the counts per name.

Defined cases: null names form no key, yet their rows belong to the totals; null partners are not counted as
partners; repeated rows count as delivered; an empty table gives no rows; extra columns are never read.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_states(calls: DataFrame, fields: tuple[str, ...] = ("callee", "caller")) -> DataFrame:
    """(field, fqn, n): rows of each non-null name in each of the fields, from one scan."""
    sides = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("fqn")) for f in fields])
    return calls.select(F.explode(sides).alias("s")).select("s.field", "s.fqn").where(F.col("fqn").isNotNull()).groupBy("field", "fqn").agg(F.count(F.lit(1)).alias("n"))


def heavy_names(calls: DataFrame, share: float = 0.01) -> DataFrame:
    """(field, fqn) of names with at least ``share`` of all rows as delivered."""
    total = calls.agg(F.count(F.lit(1)).alias("total"))  # one row
    return key_states(calls).crossJoin(F.broadcast(total)).where(F.col("n") >= F.lit(Decimal(str(share))) * F.col("total")).select("field", "fqn")


def name_stats(calls: DataFrame) -> DataFrame:
    """(field, fqn, n, partners, sum_line, first_seen, last_seen) of every non-null name."""
    sides = F.array(
        F.struct(F.lit("callee").alias("field"), F.col("callee").alias("fqn"), F.col("caller").alias("partner")),
        F.struct(F.lit("caller").alias("field"), F.col("caller").alias("fqn"), F.col("callee").alias("partner")),
    )
    rows = calls.select(F.explode(sides).alias("s"), "package", "line", "seen_at").select("s.*", "package", "line", "seen_at").where(F.col("fqn").isNotNull())
    pairs = rows.groupBy("field", "fqn", "partner").agg(
        F.count(F.lit(1)).alias("n"), F.sum("line").alias("sum_line"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen")
    )
    return pairs.groupBy("field", "fqn").agg(
        F.sum("n").alias("n"),
        F.count("partner").alias("partners"),
        F.sum("sum_line").alias("sum_line"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def probe_stats(probes: DataFrame) -> DataFrame:
    """(fqn, n, sum_fan_in, max_fan_in, sum_fan_out, n_fan_out) over distinct probes."""
    once = probes.where(F.col("fqn").isNotNull()).select("probe_id", "fqn", "fan_in", "fan_out").distinct()
    return once.groupBy("fqn").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("fan_in").alias("sum_fan_in"),
        F.max("fan_in").alias("max_fan_in"),
        F.sum("fan_out").alias("sum_fan_out"),
        F.count("fan_out").alias("n_fan_out"),
    )
