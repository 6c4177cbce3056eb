"""Persistence: scans and graphs as partitioned Parquet, history as appended rows, notes with a staleness flag."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


class Store(Protocol):
    """What a session needs of a store."""

    def put(self, name: str, repo: str, sha: str, df: DataFrame, intent: str = "") -> None: ...
    def get(self, name: str, repo: str, sha: str, intent: str = "") -> DataFrame | None: ...


def repo_key(repo: str) -> str:
    import hashlib

    return hashlib.sha256(repo.encode()).hexdigest()[:16]


class ParquetStore:
    """One dataset a table, partitioned by repository, revision and intent; a write replaces its own partition only."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def put(self, name: str, repo: str, sha: str, df: DataFrame, intent: str = "") -> None:
        keyed = df.withColumn("repo", F.lit(repo_key(repo))).withColumn("sha", F.lit(sha)).withColumn("intent", F.lit(intent or "none"))
        keyed.write.partitionBy("repo", "sha", "intent").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self._path(name))

    def get(self, name: str, repo: str, sha: str, intent: str = "") -> DataFrame | None:
        try:
            df = self.spark.read.option("basePath", self._path(name)).parquet(f"{self._path(name)}/repo={repo_key(repo)}/sha={sha}/intent={intent or 'none'}")
        except AnalysisException:
            return None
        return df.drop("repo", "sha", "intent")

    def invalidate(self, name: str, repo: str) -> None:
        """Drops the partitions of a repository."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(name)}/repo={repo_key(repo)}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class History:
    """Appended scan records (timestamp, repo, sha, ...), in JSON lines; lines that do not parse are skipped."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, entries: DataFrame) -> None:
        entries.write.mode("append").json(self.path)

    def all(self, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).option("mode", "DROPMALFORMED").json(self.path)

    def last(self, schema: str, n: int) -> DataFrame:
        return self.all(schema).orderBy(F.desc("timestamp")).limit(n).orderBy("timestamp")

    def at(self, schema: str, index: int) -> DataFrame:
        """The entry of an index; negative ones count from the end."""
        from ..runtime import global_rank

        df = self.all(schema)
        k = index + 1 if index >= 0 else df.count() + index + 1
        return global_rank(df, ["timestamp"], "n").where(F.col("n") == k).drop("n")


class Notes:
    """Context notes by scope and name, with the revision they were written at."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def put(self, scope: str, name: str, text: str, sha: str) -> None:
        clean = re.sub(r"[^A-Za-z0-9._-]+", "_", name).strip("._") or "note"
        row = self.spark.createDataFrame([(scope, clean, text, sha)], "scope string, name string, text string, sha string")
        row.write.partitionBy("scope", "name").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.root)

    def get(self, scope: str, name: str, current_sha: str) -> DataFrame:
        """(text, sha, stale)"""
        df = self.spark.read.parquet(self.root).where((F.col("scope") == scope) & (F.col("name") == name))
        return df.select("text", "sha", (F.col("sha") != current_sha).alias("stale"))


class GraphCache:
    """Graphs in the memory of the executors (and on their disks where that is short), by repository and commit; beyond ``most``, the one unused for longest goes."""

    def __init__(self, most: int = 8):
        self.most, self.held = most, {}

    def get(self, repo: str, sha: str, build: Callable[[], DataFrame]) -> DataFrame:
        df = self.held.pop((repo, sha), None)
        if df is None:
            df = build().persist()
        self.held[repo, sha] = df
        while len(self.held) > self.most:
            self.held.pop(next(iter(self.held))).unpersist()
        return df

    def invalidate(self, repo: str) -> None:
        for key in [k for k in self.held if k[0] == repo]:
            self.held.pop(key).unpersist()
