"""Problem 9 as queries: documents that lost their end, and the share of them per source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deuceframe.llm.truncation import truncated, truncation_report
from deuceframe.sources.tables import table


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    return truncated(table(spark, folder, "documents").select("doc_id", "text", "lang", "source"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder).where("is_cut").select("doc_id")


def p9_sources(spark: SparkSession, folder: str) -> DataFrame:
    return truncation_report(_judged(spark, folder))


QUERIES = {"p9_found": p9_found, "p9_sources": p9_sources}
SQL: dict[str, str] = {}
