"""Differences between consecutive full snapshots (problem 2).

Every row of a complete snapshot is tagged twice: as the *after* side of the comparison that ends in its
snapshot and as the *before* side of the comparison that starts there. Both tags are grouped by
(project, later snapshot, key) and classified from one hash a side, in a single shuffle. Nested entries
(the symbols of a component) ride along in the same group and are compared without a further exchange,
because their key extends the key that the rows are already partitioned by.

Defined cases
-------------
* Several deliveries of one key: the latest ``delivered_at`` counts; equal times are broken by the larger row hash.
* A null equals only a null; a null ``delivered_at`` is older than any other.
* Rows with a null project, snapshot or name have no key and are left out. Entries with a null symbol name likewise.
* Null or empty symbol arrays hold no entry. Repeated entries and their order mean nothing; a symbol name that
  stands with several signatures is compared by its set of signatures.
* Extra columns are never read. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPARED = ("package", "trust_zone", "churn", "loc", "max_nesting")


def row_hash(*cols: Column) -> Column:
    """64-bit hash in which nulls count by position."""
    parts: list[Column] = []
    for c in cols:
        parts += [c, c.isNull()]
    return F.xxhash64(*parts)


def complete_pairs(log: DataFrame) -> DataFrame:
    """(project, snapshot_no, first, next): each complete snapshot with the later complete one of its project."""
    done = log.where(F.col("status") == "complete").select("project", "snapshot_no").distinct()
    w = Window.partitionBy("project").orderBy("snapshot_no")
    return done.select("project", "snapshot_no", F.lag("snapshot_no").over(w).isNull().alias("first"), F.lead("snapshot_no").over(w).alias("next"))


def tagged_sides(components: DataFrame, log: DataFrame) -> DataFrame:
    """The union of both sides: (project, later, name, side, delivered_at, h, sh, symbols)."""
    rows = components.where(F.col("project").isNotNull() & F.col("snapshot_no").isNotNull() & F.col("name").isNotNull()).select(
        "project",
        "snapshot_no",
        "name",
        "delivered_at",
        row_hash(*[F.col(c) for c in COMPARED]).alias("h"),
        F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce(F.col("symbols"), F.expr("array()")), lambda s: s["name"].isNotNull()), lambda s: F.struct(s["name"].alias("name"), s["signature"].alias("signature"))))).alias("symbols"),
    )
    rows = rows.withColumn("sh", row_hash(F.to_json("symbols")))
    sides = rows.join(complete_pairs(log), ["project", "snapshot_no"])
    tags = F.filter(
        F.array(
            F.when(~F.col("first"), F.struct(F.col("snapshot_no").alias("later"), F.lit(1).alias("side"))),
            F.when(F.col("next").isNotNull(), F.struct(F.col("next").alias("later"), F.lit(0).alias("side"))),
        ),
        lambda t: t.isNotNull(),
    )
    return sides.withColumn("t", F.explode(tags)).select("project", F.col("t.later").alias("later"), "name", F.col("t.side").alias("side"), "delivered_at", "h", "sh", "symbols")


def snapshot_changes(components: DataFrame, log: DataFrame) -> DataFrame:
    """(tab, snapshot_no, project, item, change) for components and their symbols."""
    state = F.struct("delivered_at", "h", "sh", "symbols")
    both = (
        tagged_sides(components, log)
        .groupBy("project", "later", "name")
        .agg(F.max(F.when(F.col("side") == 0, state)).alias("b"), F.max(F.when(F.col("side") == 1, state)).alias("a"))
    )
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("b.h") != F.col("a.h"), "changed")
    comps = F.when(change.isNotNull(), F.struct(F.lit("component").alias("tab"), F.col("name").alias("item"), change.alias("change")))

    def signatures(side: str) -> Column:
        return F.coalesce(F.col(side)["symbols"], F.expr("array()"))

    # The aggregation keeps its rows where they are: each group compares its own two arrays.
    before, after = signatures("b"), signatures("a")
    gone, new = F.array_except(before, after), F.array_except(after, before)
    names_b, names_a = F.transform(before, lambda s: s["name"]), F.transform(after, lambda s: s["name"])
    touched = F.array_distinct(F.concat(F.transform(gone, lambda s: s["name"]), F.transform(new, lambda s: s["name"])))
    lookup = both.where(F.col("b").isNull() | F.col("a").isNull() | (F.col("b.h") != F.col("a.h")) | (F.col("b.sh") != F.col("a.sh")))
    symbols = F.transform(
        touched,
        lambda n: F.struct(
            F.lit("symbol").alias("tab"),
            F.concat(F.col("name"), F.lit("."), n).alias("item"),
            F.when(~F.array_contains(names_b, n), "added").when(~F.array_contains(names_a, n), "removed").otherwise("changed").alias("change"),
        ),
    )
    out = lookup.select("project", F.col("later").alias("snapshot_no"), F.explode(F.array_compact(F.concat(F.array(comps), symbols))).alias("x"))
    return out.select("x.tab", F.col("snapshot_no").cast("int").alias("snapshot_no"), "project", "x.item", "x.change")


def change_counts(components: DataFrame, log: DataFrame) -> DataFrame:
    """Changes per table, snapshot, project and kind of change."""
    return snapshot_changes(components, log).groupBy("tab", "snapshot_no", "project", "change").agg(F.count(F.lit(1)).alias("n"))
