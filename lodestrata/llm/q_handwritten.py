"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.handwritten import source_classes
from lodestrata.sources import load_table


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_classes(load_table(spark, sf_dir, "files"), load_table(spark, sf_dir, "chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_classes(spark, sf_dir).filter("class <> 'handwritten'").select("file_id").distinct()


QUERIES = {"p5_found": p5_found, "p5_classes": p5_classes}
ORACLES: dict[str, str] = {}
