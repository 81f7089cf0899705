"""A stored inverted index: written once, answered from the postings of a query's terms alone.

The postings lie in buckets of term hashes, sorted by term: a query reads the buckets of its terms (partition pruning) and in
them the row groups that hold the terms (pushed filters), whatever the size of the corpus.  The postings of one term are spread
over ``SPREAD`` files, so that a term of a third of all texts is no single task's work, neither when written nor when read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import tokens
from lodestrata.operators.search import B, IDF_FLOOR, K1, postings
from lodestrata.runtime import spread

#: Buckets of a small corpus, postings that a bucket should hold at most, and files of a bucket.
BUCKETS, BUCKET_ROWS, SPREAD = 8, 20_000_000, 2


@dataclass(frozen=True)
class TextIndex:
    """Where the postings of a corpus lie, and what ranking needs to know of it."""

    path: str
    buckets: int
    texts: int
    mean_length: float
    id_type: str

    def postings(self, spark: SparkSession, terms: list[str] | None = None) -> DataFrame:
        """``term, id, tf, dl``, of all terms or of the given ones."""
        rows = spark.read.schema(f"term string, id {self.id_type}, tf long, dl int, bucket int").parquet(self.path)
        if terms is not None:
            rows = rows.filter(F.col("bucket").isin(sorted({bucket_of(t, self.buckets) for t in terms})) & F.col("term").isin(terms))
        return rows.drop("bucket")


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def build_index(df: DataFrame, id_col: str, text: Column, path: str) -> TextIndex:
    """Writes the postings of a text column below ``path``; null texts count as texts without tokens."""
    rows = spread(df.select(F.col(id_col), text.alias("__text")))
    texts, mean, total = rows.select(F.size(tokens(F.col("__text"))).alias("dl")).agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(0.0)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    buckets = max(BUCKETS, -(-total // BUCKET_ROWS))
    placed = postings(rows, id_col, F.col("__text")).withColumn("bucket", (F.crc32("term") % buckets).cast("int"))
    salted = placed.repartition(min(buckets * SPREAD, 2000), "bucket", F.pmod(F.xxhash64("id"), F.lit(SPREAD)))
    salted.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)
    return TextIndex(path, buckets, texts, mean, df.schema[id_col].dataType.simpleString())


def index_bm25(spark: SparkSession, index: TextIndex, terms: list[str], id_col: str) -> DataFrame:
    """``id_col, score`` of the texts that hold any term, as :func:`lodestrata.operators.search.bm25` ranks them."""
    if not terms:
        return spark.createDataFrame([], f"{id_col} {index.id_type}, score double")
    rows = index.postings(spark, terms)
    stats = rows.agg(*(F.count_if(F.col("term") == t).alias(f"__df{i}") for i, t in enumerate(terms)))
    found = rows.groupBy("id").agg(F.max("dl").alias("dl"), *(F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"__tf{i}") for i, t in enumerate(terms)))
    norm = K1 * (1 - B + B * F.col("dl") / F.lit(index.mean_length))

    def part(i: int) -> Column:
        df_, tf = F.col(f"__df{i}"), F.col(f"__tf{i}")
        return F.greatest(F.lit(IDF_FLOOR), F.log((index.texts - df_ + 0.5) / (df_ + 0.5))) * tf * (K1 + 1) / (tf + norm)

    return found.join(F.broadcast(stats)).select(F.col("id").alias(id_col), reduce(lambda a, b: a + b, map(part, range(len(terms))), F.lit(0.0)).alias("score"))
