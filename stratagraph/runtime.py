"""Session helpers: table access, checkpoints, column-name safety."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the session's own, the shared one of ``spark.checkpoint.dir``, else a local one (tests only)."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), "stratagraph-checkpoints")
    spark.sparkContext.setCheckpointDir(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns can never clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def global_rank(df: DataFrame, cols: list[str], name: str = "rank") -> DataFrame:
    """df plus 1, 2, ... in the order of the columns, without sorting everything in one task: ranges are numbered apart and shifted by the sizes before them."""
    from pyspark.sql import Window

    ranged = checkpoint(df.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a partition
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*cols))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, own + F.col("_before")).drop("_part", "_before")


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], salt_by: str, limit: int = 200_000, salts: int = 16) -> DataFrame:
    """Left join of rows with a table of one row a key, null keys included, that a hot key can't hold up.

    A table of at most ``limit`` rows is broadcast after it has been counted; for a larger one the rows of each key are spread over salts.
    """
    table = checkpoint(table)
    right = table.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        same = one if same is None else same & one
    drop = [f"_k_{k}" for k in keys]
    if table.count() <= limit:
        return rows.join(F.broadcast(right), same, "left").drop(*drop)
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    right = right.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, same & (F.col("_salt") == F.col("_s")), "left").drop(*drop, "_salt", "_s")


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than there are cores, spread over them; larger inputs stay as they are. For work that is dear by the row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
