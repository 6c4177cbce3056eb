"""Percentiles by radix selection (problem 4).

Values are mapped to 64-bit integers whose order is that of the values. A pass counts, per group and target rank,
the values by their next ``digit_bits`` bits; only the digit that holds the target rank is followed by the next
pass. A histogram has at most 2**digit_bits entries a group whatever the number of rows, is built by local
combining, and is the only thing shuffled. After all bits the value is exact.

Histograms of the leading bits (``sketch``) of separate days, snapshots or partitions are combined by adding their
counts; percentiles read from them have a relative error of at most 2**-(bits - 12) for doubles (one sign and
eleven exponent bits come first).

Defined cases: nulls and NaN values are not ranked; a null group is a group; -0.0 counts as 0.0; ties need no
rule, since equal values share all digits; groups without values give no rows; a percentile p of n values is the
one of rank max(1, ceil(p * n)). Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpoint

_SIGN = -(1 << 63)


_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def order_key(value: Column, kind: str) -> Column:
    """A bigint that sorts, read as unsigned, like the value: integers with the sign bit flipped, doubles by their IEEE-754 bits, all of them flipped below zero."""
    if kind in _INTEGERS:
        return value.cast("bigint").bitwiseXOR(F.lit(_SIGN))
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("bigint")
    return F.transform(F.array(bits), lambda b: F.when(b >= 0, b.bitwiseXOR(F.lit(_SIGN))).otherwise(F.bitwise_not(b)))[0]


def from_key(key: Column, kind: str) -> Column:
    """The value of an order key."""
    if kind in _INTEGERS:
        return key.bitwiseXOR(F.lit(_SIGN))
    bits = F.when(key < 0, key.bitwiseXOR(F.lit(_SIGN))).otherwise(F.bitwise_not(key))
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def _keys(df: DataFrame, group: str, value: str) -> tuple[DataFrame, str]:
    kind = dict(df.dtypes)[value]
    v = F.col(f"`{value}`")
    keep = v.isNotNull() if kind in _INTEGERS else v.isNotNull() & ~F.isnan(v.cast("double"))
    return df.where(keep).select(F.col(f"`{group}`").alias("grp"), order_key(v, kind).alias("k")), kind


def percentiles(df: DataFrame, group: str, value: str, ps: Sequence[float], digit_bits: int = 16) -> DataFrame:
    """(grp, p, n, value): exact percentiles of ``value`` per ``group``."""
    assert 64 % digit_bits == 0
    rows, kind = _keys(df, group, value)
    rows = checkpoint(rows)  # every pass reads it: 8 bytes a value and its group
    mask = (1 << digit_bits) - 1
    p = F.explode(F.array(*[F.lit(float(x)) for x in ps]))
    targets = None
    for shift in range(64 - digit_bits, -1, -digit_bits):
        digit = F.shiftrightunsigned(F.col("k"), shift).bitwiseAND(F.lit(mask))
        if targets is None:
            hist = rows.groupBy("grp", digit.alias("d")).agg(F.count(F.lit(1)).alias("c"))
            w = Window.partitionBy("grp")
            hist = hist.withColumn("upto", F.sum("c").over(w.orderBy("d"))).withColumn("n", F.sum("c").over(w))
            found = hist.withColumn("p", p).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("n"))))
        else:
            # Several targets may follow the same prefix: the histogram is made once for each prefix.
            prefixes = targets.select("grp", "prefix").distinct()
            hist = (
                rows.withColumn("prefix", F.shiftrightunsigned(F.col("k"), shift + digit_bits))
                .join(prefixes.withColumnRenamed("grp", "g2").withColumnRenamed("prefix", "p2"), F.col("grp").eqNullSafe(F.col("g2")) & (F.col("prefix") == F.col("p2")), "left_semi")
                .groupBy("grp", "prefix", digit.alias("d"))
                .agg(F.count(F.lit(1)).alias("c"))
            )
            hist = hist.withColumn("upto", F.sum("c").over(Window.partitionBy("grp", "prefix").orderBy("d")))
            t = targets.select(F.col("grp").alias("g2"), F.col("prefix").alias("p2"), "p", "n", "rank")
            found = hist.join(t, F.col("grp").eqNullSafe(F.col("g2")) & (F.col("prefix") == F.col("p2")))
        found = found.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank")))
        head = F.col("d") if targets is None else F.shiftleft(F.col("prefix"), digit_bits).bitwiseOR(F.col("d"))
        # A row for each group and target: kept, so that no pass is made again for the next.
        targets = checkpoint(found.select("grp", "p", "n", (F.col("rank") - (F.col("upto") - F.col("c"))).alias("rank"), head.alias("prefix")))
    return targets.select("grp", "p", "n", from_key(F.col("prefix"), kind).alias("value"))


def sketch(df: DataFrame, group: str, part: str, value: str, bits: int = 24) -> DataFrame:
    """(grp, part, d, c): counts of the leading ``bits`` bits for each part (day, snapshot ...)."""
    v = F.col(f"`{value}`").cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(F.col(f"`{group}`").alias("grp"), F.col(f"`{part}`").alias("part"), order_key(v, "double").alias("k"))
    return rows.groupBy("grp", "part", F.shiftrightunsigned(F.col("k"), 64 - bits).alias("d")).agg(F.count(F.lit(1)).alias("c"))


def combine(sketches: DataFrame, ps: Sequence[float], bits: int = 24) -> DataFrame:
    """(grp, p, n, value) of the sum of all parts' sketches; value is the lower edge of the digit, at most 2**-(bits - 12) of the value away for normal doubles."""
    hist = sketches.groupBy("grp", "d").agg(F.sum("c").alias("c"))
    w = Window.partitionBy("grp")
    hist = hist.withColumn("upto", F.sum("c").over(w.orderBy("d"))).withColumn("n", F.sum("c").over(w))
    found = hist.withColumn("p", F.explode(F.array(*[F.lit(float(x)) for x in ps]))).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("n"))))
    found = found.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank")))
    key = F.shiftleft(F.col("d"), 64 - bits)
    # Negative values keep their inverted low bits at one, so that the edge nearest to zero is read on both sides.
    key = F.when(key >= 0, key.bitwiseOR(F.lit((1 << (64 - bits)) - 1))).otherwise(key)
    return found.select("grp", "p", "n", from_key(key, "double").alias("value"))
