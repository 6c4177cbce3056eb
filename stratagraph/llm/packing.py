"""Items into containers of fixed capacity (problem 8).

1. The global histogram of item sizes (at most ``capacity`` entries, whatever the number of items) is the only
   thing the driver sees.
2. Dynamic programming over it chooses the bucket boundaries that minimise the total padding, where an item counts
   as large as the upper boundary of its bucket.
3. Containers are planned over the buckets: a pattern takes a token-budget batch of items from each of several
   buckets (the largest that still fits, as often as it fits), and is repeated while the buckets last. Filling up a
   batch of large items with batches of smaller buckets goes beyond batches of one bucket alone, which would leave
   up to half a container unused for items of over half the capacity.
4. Items find their container from their rank in the bucket alone. Ranks are counted per hash salt, so a bucket
   with a third of all rows is spread over many tasks.

Defined cases: an item over the capacity is split into full containers and a rest; items of size 0 (null or empty
texts) take no space and get a null container; equal sizes are taken in the order of salt and id; repeated ids
are items of their own; an empty table gives no rows; extra columns are never read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpoint


def bucket_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Ascending upper boundaries of at most ``buckets`` buckets with the least total padding."""
    sizes = np.array(sorted(histogram), np.int64)
    if len(sizes) <= buckets:
        return sizes.tolist()
    counts = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    cum, tot = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * sizes)))
    n = len(sizes)
    # cost(i, j): padding when sizes i..j-1 share the boundary sizes[j-1]
    best = np.concatenate(([0], sizes * cum[1:] - tot[1:])).astype(np.float64)
    choice = []
    for _ in range(1, buckets):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        new[0] = 0
        stack = [(1, n, 0, n - 1)]
        while stack:  # divide and conquer: the best cut moves right with j
            lo, hi, a, b = stack.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            c = best[i] + sizes[j - 1] * (cum[j] - cum[i]) - (tot[j] - tot[i])
            k = int(np.argmin(c))
            new[j], cut[j] = c[k], i[k]
            stack += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        best = new
        choice.append(cut)
    bounds, j = [], n
    for cut in reversed(choice):
        if j <= 0:
            break
        bounds.append(int(sizes[j - 1]))
        j = int(cut[j])
    if j > 0:
        bounds.append(int(sizes[j - 1]))
    return sorted(set(bounds))


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(bucket size, first rank, last rank + 1, items a container, first container) for all items, largest first."""
    left, used, out, container = dict(counts), dict.fromkeys(counts, 0), [], 0
    order = sorted((s for s in counts if counts[s] > 0), reverse=True)
    while order:
        space, pattern = capacity, []
        for s in order:
            k = min(space // s, left[s])
            if k:
                pattern.append((s, k))
                space -= s * k
                if not space:
                    break
        times = min(left[s] // k for s, k in pattern)
        for s, k in pattern:
            out.append((s, used[s], used[s] + k * times, k, container))
            used[s] += k * times
            left[s] -= k * times
        container += times
        order = [s for s in order if left[s]]
    return out


def pack(sizes: DataFrame, capacity: int = 2048, buckets: int = 256, salts: int = 64, key: str = "doc_id", size: str = "n") -> DataFrame:
    """(container_id, key, part, start, tokens): where each piece of each item goes. ``sizes`` is read three times: checkpoint it if it is dear."""
    spark = sizes.sparkSession
    item = sizes.select(F.col(f"`{key}`").alias(key), F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("bigint").alias("n"))
    starts = F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(capacity).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint")))
    pieces = item.select(key, "n", F.posexplode(starts).alias("part", "start")).select(key, "part", "start", F.least(F.col("n") - F.col("start"), F.lit(capacity)).alias("tokens"))
    full = pieces.where("tokens > 0")
    histogram = {r["tokens"]: r["c"] for r in full.groupBy("tokens").agg(F.count(F.lit(1)).alias("c")).collect()}  # at most `capacity` rows
    empty = pieces.where("tokens = 0").select(F.lit(None).cast("bigint").alias("container_id"), key, "part", "start", "tokens")
    if not histogram:
        return empty
    bounds = bucket_bounds(histogram, buckets)
    counts = dict.fromkeys(bounds, 0)
    for s, c in histogram.items():
        counts[bounds[int(np.searchsorted(bounds, s))]] += c
    steps = spark.createDataFrame(plan(counts, capacity), "bucket long, lo long, hi long, k long, base long")  # bounded by the number of buckets
    to_bucket = spark.createDataFrame([(s, bounds[int(np.searchsorted(bounds, s))]) for s in histogram], "tokens long, bucket long")
    salted = full.join(F.broadcast(to_bucket), "tokens").withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    per_salt = salted.groupBy("bucket", "salt").agg(F.count(F.lit(1)).alias("c"))
    offset = per_salt.select("bucket", "salt", (F.sum("c").over(Window.partitionBy("bucket").orderBy("salt")) - F.col("c")).alias("before"))  # at most buckets x salts rows
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("bucket", "salt").orderBy(key, "part")) - 1)
    ranked = ranked.join(F.broadcast(offset), ["bucket", "salt"]).withColumn("rank", F.col("r") + F.col("before"))
    s = F.broadcast(steps.withColumnRenamed("bucket", "b"))
    placed = ranked.join(s, (F.col("bucket") == F.col("b")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    placed = placed.select((F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("k"))).cast("bigint").alias("container_id"), key, "part", "start", "tokens")
    return placed.unionByName(empty)


def pack_documents(token_counts: DataFrame, capacity: int = 2048, buckets: int = 256) -> DataFrame:
    """``pack`` over counts that are written once."""
    return pack(checkpoint(token_counts), capacity, buckets)


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(containers, tokens, unused_share, pieces, split_items): how full the containers are."""
    one = packed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("c"), F.sum(F.when(F.col("part") == 1, 1).otherwise(0)).alias("s"))
    return one.agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("t").alias("tokens"),
        (1 - F.sum("t") / (F.count(F.lit(1)) * F.lit(capacity))).alias("unused_share"),
        F.sum("c").alias("pieces"),
        F.sum("s").alias("split_items"),
    )
