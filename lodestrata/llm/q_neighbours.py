"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.prefix_forest import nearest, similar_pairs
from lodestrata.sources import load_table

#: The cosine from which two embeddings count as a pair.
LEAST_COSINE = 0.97


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(load_table(spark, sf_dir, "harness_embeddings"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(p2_neighbours(spark, sf_dir), LEAST_COSINE)


QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours}
ORACLES = {
    "p2_found": """
with v as (select embedding_id, model, dim, any_value(cast(vector as double[])) as vec from harness_embeddings
 where model is not null and vector is not null and len(vector) = dim and len(list_filter(vector, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0 group by all),
p as (select a.embedding_id as a, b.embedding_id as b, list_cosine_similarity(a.vec, b.vec) as cosine from v a join v b on a.model = b.model and a.dim = b.dim and a.embedding_id <> b.embedding_id),
r as (select *, row_number() over (partition by a order by cosine desc, b) as rank from p)
select distinct least(a, b) as embedding_id_a, greatest(a, b) as embedding_id_b from r where rank <= 5 and cosine >= 0.97""",
}
