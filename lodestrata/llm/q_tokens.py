"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.trie_bpe import encoded_bytes, token_ids
from lodestrata.sources import load_table


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(load_table(spark, sf_dir, "documents"), ["doc_id"])


def p7_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes that the ids of each document stand for: those of its text."""
    return encoded_bytes(p7_ids(spark, sf_dir), ["doc_id"])


QUERIES = {"p7_ids": p7_ids, "p7_bytes": p7_bytes}
ORACLES = {"p7_bytes": "select doc_id, strlen(coalesce(text, '')) as n_bytes from documents"}
