"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.chunking import MAX_BYTES, MAX_LINES, OVERLAP_BYTES, OVERLAP_LINES, split_oversized
from lodestrata.sources import load_table


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(load_table(spark, sf_dir, "chunks"), load_table(spark, sf_dir, "symbols"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pieces(spark, sf_dir).filter("piece_no = 0").select("file_id")


def p1_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each file that was cut: the bytes that its pieces cover without their overlaps, and whether all pieces keep the limits and meet."""
    p = p1_pieces(spark, sf_dir)
    size, breaks = F.octet_length("piece"), F.length("piece") - F.length(F.replace("piece", F.lit("\n")))
    lines = breaks + F.when(F.col("piece").endswith("\n"), 0).otherwise(1)
    kept = (size <= MAX_BYTES) & (lines <= MAX_LINES) & (size == F.col("byte_end") - F.col("byte_start")) & (F.col("overlap_bytes") <= OVERLAP_BYTES) & (F.col("overlap_lines") <= OVERLAP_LINES)
    own = F.col("byte_end") - F.col("byte_start") - F.col("overlap_bytes")
    meets = F.min("byte_start") == 0
    return p.groupBy("file_id").agg(F.sum(own).alias("n_bytes"), F.max("byte_end").alias("last_byte"), (F.min(kept) & meets).alias("kept"))


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_limits": p1_limits}
ORACLES = {
    "p1_limits": """select file_id, strlen(content) as n_bytes, strlen(content) as last_byte, true as kept from (select file_id, content, length(content) - length(replace(content, chr(10), '')) as breaks from chunks where chunk_kind = 'file' and content is not null)
 where strlen(content) > 6000 or breaks + case when content = '' or right(content, 1) = chr(10) then 0 else 1 end > 150""",
    "p1_found": """select file_id from (select file_id, content, length(content) - length(replace(content, chr(10), '')) as breaks from chunks where chunk_kind = 'file' and content is not null)
 where strlen(content) > 6000 or breaks + case when content = '' or right(content, 1) = chr(10) then 0 else 1 end > 150""",
}
