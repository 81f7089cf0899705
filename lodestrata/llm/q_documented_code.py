"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.documented_code import documented_functions
from lodestrata.sources import load_table


def _tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [load_table(spark, sf_dir, t) for t in ("files", "chunks", "symbols")]


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented_functions(*_tables(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented_functions(*_tables(spark, sf_dir), with_code=False).select("symbol_id")


QUERIES = {"p4_found": p4_found, "p4_pairs": p4_pairs}
ORACLES: dict[str, str] = {}
