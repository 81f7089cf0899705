"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.mixing import mixed
from lodestrata.sources import load_table


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixed(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "mix_targets"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each listed source, its documents, and whether any came too often or is missed although each is wanted at least once."""
    mixture, shares = _mixed(spark, sf_dir)
    times = mixture.groupBy("source", "doc_id").agg(F.count("*").alias("n")).groupBy("source").agg(F.max("n").alias("most"), F.min("n").alias("least"), F.count("*").alias("taken"))
    j = shares.join(times, "source", "left")
    within = F.coalesce(F.col("most"), F.lit(0)) <= F.ceil("copies")
    whole = F.coalesce(F.col("taken"), F.lit(0)) == F.col("n_docs")
    capped = F.coalesce(F.col("most"), F.lit(0)) <= F.col("max_repeats")
    return j.select("source", F.col("n_docs"), (within & capped & ((F.col("copies") < 1) | whole)).alias("kept"))


QUERIES = {"p8_mixture": p8_mixture, "p8_shares": p8_shares, "p8_limits": p8_limits}
ORACLES = {"p8_limits": "select source, count(d.doc_id) as n_docs, true as kept from (select distinct source from mix_targets where target_share > 0 and source is not null) t left join (select doc_id, source from documents where text <> '' and doc_id is not null) d using (source) group by 1"}
