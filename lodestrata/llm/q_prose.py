"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.prose_quality import not_prose, text_quality
from lodestrata.sources import load_table


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(load_table(spark, sf_dir, "documents"), ["doc_id"])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_prose(p9_statistics(spark, sf_dir)).select("doc_id")


QUERIES = {"p9_found": p9_found, "p9_statistics": p9_statistics}
ORACLES: dict[str, str] = {}
