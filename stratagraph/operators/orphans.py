"""References to records that do not stand (problem 3), by bitmaps per key range and period.

1. The target names of all references are reduced to distinct (name, month) pairs by local combining, so a hot
   target costs one row a task and month.
2. A distributed dictionary gives each name a dense integer within its key range (a hash range of names).
3. Per key range and month, one bitmap holds the referenced codes and one the codes whose declaration stands
   during the whole month. Reference AND-NOT parent leaves the codes that may be orphans; their bits are decoded.
4. Names that are declared, deleted or declared again within the month survive that step; the exact check compares
   each of their rows' loaded_at with the intervals. Hot names are split over salts for both joins by rows.

Defined cases: null targets and targets without a name are no references; a null loaded_at counts as later than no
declaration (the row is no case); type syntax and blanks around the one name are removed; names are compared exactly;
declarations with a null name or loaded_at never stand; repeated rows give one result row; empty tables are allowed;
extra columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import types as T
from pyspark.sql import functions as F

#: Words of type syntax that can stand beside a bare name (fixed values).
TYPE_WORDS = (
    "map list set vec option result box rc arc array slice string str int uint bool float double char void long short byte object any null none undefined "
    "const struct enum union mut ref dyn impl unsigned signed volatile final optional readonly promise record partial sequence iterable iterator dict tuple "
    "union callable chan func fn interface class type hashmap btreemap hashset arraylist linkedlist collection stream refcell mutex cell cow pin pointer unique_ptr shared_ptr "
    "vector usize isize i8 i16 i32 i64 u8 u16 u32 u64 f32 f64 int8 int16 int32 int64 uint8 uint16 uint32 uint64 number boolean error static extern"
)


def target_name(raw: Column) -> Column:
    """The one name inside type syntax: the piece with a path or package, else the one that is no type word, else the first."""
    # '-' belongs to a name only between word characters, so that an arrow is no part of it.
    pieces = F.regexp_extract_all(raw, F.lit(r"(?U)([\w$]+(?:[-./:@$]+[\w$]+)*)"), F.lit(1))
    dotted = F.filter(pieces, lambda x: x.rlike(r"[./]"))
    words = F.array(*[F.lit(w) for w in dict.fromkeys(TYPE_WORDS.split())])
    plain = F.filter(pieces, lambda x: (F.length(x) > 1) & ~F.array_contains(words, F.lower(x)))
    # One-letter words are type parameters, unless they stand alone.
    return F.when(F.size(dotted) > 0, F.get(dotted, F.lit(0))).when(F.size(plain) > 0, F.get(plain, F.lit(0))).otherwise(F.get(pieces, F.lit(0)))


def references(impl_edges: DataFrame, field_refs: DataFrame, calls: DataFrame) -> DataFrame:
    """(tab, ref_id, fqn, t): all references with a target."""
    parts = [
        impl_edges.select(F.lit("impl_edges").alias("tab"), F.col("edge_id").alias("ref_id"), target_name(F.col("to_name")).alias("fqn"), F.col("loaded_at").alias("t")),
        field_refs.select(F.lit("field_refs").alias("tab"), F.col("ref_id"), target_name(F.col("ref_type")).alias("fqn"), F.col("loaded_at").alias("t")),
        calls.select(F.lit("calls").alias("tab"), F.col("call_id").alias("ref_id"), F.trim("callee").alias("fqn"), F.col("loaded_at").alias("t")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.where(F.col("fqn").isNotNull() & (F.col("fqn") != "") & F.col("t").isNotNull()).withColumn("period", F.trunc("t", "month"))


def declarations(symbols: DataFrame, platform: DataFrame) -> DataFrame:
    """(fqn, since, until): distinct intervals in which a name is declared; until null means still."""
    own = symbols.select(
        F.when(F.coalesce("package", F.lit("")) == "", F.col("name")).otherwise(F.concat("package", F.lit("."), "name")).alias("fqn"), F.col("loaded_at").alias("since"), F.col("deleted_at").alias("until")
    )
    always = platform.select("fqn", F.lit("0001-01-01").cast("timestamp_ntz").alias("since"), F.lit(None).cast("timestamp_ntz").alias("until"))
    return own.unionByName(always).where(F.col("fqn").isNotNull() & F.col("since").isNotNull() & (F.col("until").isNull() | (F.col("until") > F.col("since")))).distinct()


@F.pandas_udf(T.ArrayType(T.LongType()))
def and_not(ref: pd.Series, parent: pd.Series) -> pd.Series:
    """Positions of the bits that stand in ref and not in parent."""
    out = []
    for a, b in zip(ref, parent):
        x = np.frombuffer(a, np.uint8)
        if b is not None:
            x = x & ~np.frombuffer(b, np.uint8)
        out.append(np.flatnonzero(np.unpackbits(x, bitorder="little")).astype(np.int64))
    return pd.Series(out)


def suspects(refs: DataFrame, decls: DataFrame, key_ranges: int | None = None) -> DataFrame:
    """(fqn, period) of references whose name isn't declared during the whole period. There are as many key ranges as shuffle partitions, 64 at least: each is numbered in one task."""
    key_ranges = key_ranges or max(64, int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = refs.groupBy("fqn", "period").agg(F.count(F.lit(1)).alias("n"))
    keys = pairs.groupBy("fqn").agg(F.collect_set("period").alias("periods"))
    w = Window.partitionBy("kr").orderBy("fqn")
    # bitmap_bit_position() starts at code 1: 32,768 codes a bitmap.
    coded = keys.withColumn("kr", F.pmod(F.xxhash64("fqn"), F.lit(key_ranges)).cast("int")).withColumn("code", F.row_number().over(w).cast("bigint"))
    coded = coded.select("fqn", "periods", "kr", F.bitmap_bucket_number("code").alias("block"), F.bitmap_bit_position("code").alias("bit"))
    at = ["kr", "block", "period"]
    month_end = F.add_months("period", 1)
    wanted = coded.select("fqn", "kr", "block", "bit", F.explode("periods").alias("period"))
    standing = (
        coded.join(decls, "fqn")
        .select("kr", "block", "bit", "since", "until", F.explode("periods").alias("period"))
        .where((F.col("since") <= F.col("period").cast("timestamp_ntz")) & (F.col("until").isNull() | (F.col("until") >= month_end.cast("timestamp_ntz"))))
    )
    ref_maps = wanted.groupBy(*at).agg(F.bitmap_construct_agg("bit").alias("ref"))
    par_maps = standing.groupBy(*at).agg(F.bitmap_construct_agg("bit").alias("parent"))
    left = ref_maps.join(par_maps, at, "left").select(*at, F.explode(and_not("ref", "parent")).alias("bit"))
    return left.join(wanted, [*at, "bit"]).select("fqn", "period")


def orphans(impl_edges: DataFrame, field_refs: DataFrame, calls: DataFrame, symbols: DataFrame, platform: DataFrame, salts: int = 8) -> DataFrame:
    """(tab, ref_id, period) of distinct references whose target does not stand at their loaded_at."""
    refs, decls = references(impl_edges, field_refs, calls), declarations(symbols, platform)
    all_salts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    salted = refs.withColumn("salt", F.pmod(F.xxhash64("ref_id"), F.lit(salts)).cast("int"))
    open_rows = salted.join(suspects(refs, decls).select("fqn", "period", all_salts), ["fqn", "period", "salt"], "left_semi")
    d = decls.select(F.col("fqn").alias("d_fqn"), "since", "until", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("d_salt"))
    gone = open_rows.join(
        d, (F.col("fqn") == F.col("d_fqn")) & (F.col("salt") == F.col("d_salt")) & (F.col("since") <= F.col("t")) & (F.col("until").isNull() | (F.col("until") > F.col("t"))), "left_anti"
    )
    return gone.select("tab", "ref_id", "period").distinct()


def orphan_counts(impl_edges: DataFrame, field_refs: DataFrame, calls: DataFrame, symbols: DataFrame, platform: DataFrame) -> DataFrame:
    """(tab, month, n): orphans per table and month of loaded_at."""
    return orphans(impl_edges, field_refs, calls, symbols, platform).groupBy("tab", F.date_format("period", "yyyy-MM").alias("month")).agg(F.countDistinct("ref_id").alias("n"))
