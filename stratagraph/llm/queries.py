"""Queries pN_ of the problems over text, with their DuckDB counterparts where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import mojibake, packing, provenance, tokens
from .syntax import operator as syntax


def _p1(spark: SparkSession, d: str) -> DataFrame:
    return syntax.unparsable(table(spark, d, "parsed_files")).select("file_id").distinct()


def _p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(table(spark, d, "parsed_files"), table(spark, d, "projects"))


def _p6(spark: SparkSession, d: str) -> DataFrame:
    return provenance.not_handwritten(table(spark, d, "parsed_files"), table(spark, d, "thirdparty_files")).select("file_id").distinct()


def _p6_kinds(spark: SparkSession, d: str) -> DataFrame:
    return provenance.not_handwritten(table(spark, d, "parsed_files"), table(spark, d, "thirdparty_files"))


def _p6_evidence(spark: SparkSession, d: str) -> DataFrame:
    return provenance.evidence_counts(table(spark, d, "parsed_files"), table(spark, d, "thirdparty_files"))


def _p7(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def _p8(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(tokens.count_tokens(table(spark, d, "documents")))


def _p8_complete(spark: SparkSession, d: str) -> DataFrame:
    """(documents, over_capacity), one row: documents that have come out whole or in parts, containers over their capacity."""
    rows = _p8(spark, d)
    full = rows.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("tokens").alias("t")).agg(F.count_if(F.col("t") > 2048).alias("over_capacity"))
    return rows.agg(F.countDistinct("doc_id").alias("documents")).crossJoin(full)  # one row each


def _p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(_p8(spark, d))


def _p9(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.found(table(spark, d, "documents")).distinct()


def _p9_repaired(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restore(table(spark, d, "documents")).select("doc_id", "chain", "lost", "repaired")


QUERIES = {"p1_found": _p1, "p1_rates": _p1_rates, "p6_found": _p6, "p6_kinds": _p6_kinds, "p6_evidence": _p6_evidence, "p7_ids": _p7, "p8_containers": _p8, "p8_complete": _p8_complete, "p8_fill": _p8_fill, "p9_found": _p9, "p9_repaired": _p9_repaired}
ORACLES: dict[str, str] = {"p8_complete": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS over_capacity FROM documents"}
