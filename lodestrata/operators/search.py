"""Lexical ranking: BM25, additive scores, postings, reciprocal-rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.text import folded, term_frequency, token_count, tokens
from lodestrata.runtime import spread

K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6
RRF_K = 60


def postings(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """The inverted index: ``term, id, tf, dl``; partial counts are combined before the shuffle."""
    words = df.select(F.col(id_col).alias("id"), tokens(text).alias("words"))
    return words.select("id", F.size("words").alias("dl"), F.explode("words").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def document_frequency(index: DataFrame) -> DataFrame:
    """``term, df, cf`` of an index."""
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25(df: DataFrame, terms: list[str], text: Column, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``score`` of the rows that hold any term; the higher, the better.

    Two narrow passes: one aggregates the statistics of the collection to a single row, the other scores.
    That row is the only thing broadcast, and its size is the number of terms.
    """
    if not terms:
        return df.select(*keep, F.lit(0.0).alias("score")).filter("false")
    low = spread(df.select(*keep, text.alias("__text"))).select(*keep, folded(F.col("__text")).alias("__low"))
    counted = low.select(*keep, token_count(F.col("__low")).alias("__dl"), *(term_frequency(F.col("__low"), t).alias(f"__tf{i}") for i, t in enumerate(terms)))
    stats = counted.agg(F.count("*").alias("__n"), F.avg("__dl").alias("__avgdl"), *(F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(terms))))
    hits = counted.filter(reduce(lambda a, b: a | b, (F.col(f"__tf{i}") > 0 for i in range(len(terms))))).join(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(terms)):
        df_, tf = F.col(f"__df{i}"), F.col(f"__tf{i}")
        idf = F.greatest(F.lit(IDF_FLOOR), F.log((F.col("__n") - df_ + 0.5) / (df_ + 0.5)))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__dl") / F.col("__avgdl")))
    return hits.select(*keep, score.alias("score"))


def snippet(found: Column, terms: list[str], width: int = 24) -> Column:
    """The tokens around the first hit."""
    first = F.aggregate(F.transform(F.array(*map(F.lit, terms)), lambda t: F.array_position(found, t)), F.lit(None).cast("long"), lambda a, p: F.when(p > 0, F.least(F.coalesce(a, p), p)).otherwise(a))
    return F.array_join(F.slice(found, F.greatest(F.lit(1).cast("long"), first - width // 4).cast("int"), width), " ")


def reciprocal_rank_fusion(lists: list[DataFrame], id_col: str, k: int = RRF_K) -> DataFrame:
    """``id, score`` of ids with their ``rank`` (from 1) in each list; absent ids add nothing."""
    parts = [x.select(F.col(id_col), (F.lit(1.0) / (k + F.col("rank"))).alias("part")) for x in lists]
    return reduce(DataFrame.unionByName, parts).groupBy(id_col).agg(F.sum("part").alias("score"))


def ranked(df: DataFrame, *order: Column, within: list[str] | None = None, name: str = "rank", limit: int | None = None) -> DataFrame:
    """``df`` with its rank from 1.

    Without groups, only the first ``limit`` rows are numbered: they come from a top-k, never from a
    global sort, so that the one task which numbers them holds ``limit`` rows.
    """
    if within:
        out = df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
        return out.filter(F.col(name) <= limit) if limit else out
    if limit is None:
        raise ValueError("a global rank needs a limit")
    return df.orderBy(*order).limit(limit).withColumn(name, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def best_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; groups are cut to one row before the shuffle."""
    return ranked(df, *order, within=keys, name="__best", limit=1).drop("__best")
