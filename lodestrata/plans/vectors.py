"""Vector similarity, fusion with lexical ranks, and embedding backlog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.vectors import cosine
from lodestrata.operators.search import ranked, reciprocal_rank_fusion
from lodestrata.operators.text_index import index_bm25
from lodestrata.plans.lexical import document_index, memory_index
from lodestrata.sources import load_table

TERMS = ["snapshot", "budget"]


def depth(k: int) -> int:
    """How deep each list of a fusion is read for a page of k."""
    return max(4 * k, 50)


def _similar(spark: SparkSession, d: str, limit: int) -> DataFrame:
    """Vectors ranked against the one with the smallest id; that single row is broadcast."""
    e = load_table(spark, d, "embeddings")
    query = e.agg(F.min_by("embedding", "vec_id").alias("q"), F.min("vec_id").alias("qid"))
    rows = e.join(F.broadcast(query)).filter("vec_id <> qid").select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))
    return ranked(rows, F.col("similarity").desc(), F.col("vec_id"), limit=limit)


def _lexical(spark: SparkSession, d: str, limit: int) -> DataFrame:
    hits = index_bm25(spark, document_index(spark, d), TERMS, "doc_id").withColumn("score", F.round("score", 5))
    return ranked(hits, F.col("score").desc(), F.col("doc_id"), limit=limit)


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d, 20)


def hybrid_rrf_topk(spark: SparkSession, d: str) -> DataFrame:
    lists = [_lexical(spark, d, depth(20)).select(F.col("doc_id").alias("id"), "rank"), _similar(spark, d, depth(20)).select(F.col("vec_id").alias("id"), "rank")]
    fused = reciprocal_rank_fusion(lists, "id").withColumn("score", F.round("score", 8))
    return fused.orderBy(F.col("score").desc(), "id").limit(20)


def hybrid_concatenated_topk(spark: SparkSession, d: str) -> DataFrame:
    """Fusion in which a second lexical source is appended to the first: its ranks go on where those end."""
    first = _lexical(spark, d, depth(25)).select(F.concat(F.lit("doc:"), "doc_id").alias("id"), "rank")
    hits = index_bm25(spark, memory_index(spark, d), TERMS, "part_id").withColumn("score", F.round("score", 5))
    second = ranked(hits, F.col("score").desc(), F.col("part_id"), limit=depth(25)).select(F.concat(F.lit("part:"), "part_id").alias("id"), "rank")
    shift = first.agg(F.count("*").alias("n"))
    lexical = first.unionByName(second.join(F.broadcast(shift)).select("id", (F.col("rank") + F.col("n")).alias("rank")))
    vector = _similar(spark, d, depth(25)).select(F.concat(F.lit("doc:"), "vec_id").alias("id"), "rank")
    fused = reciprocal_rank_fusion([lexical, vector], "id").withColumn("score", F.round("score", 8))
    return fused.orderBy(F.col("score").desc(), "id").limit(25)


def memory_recall(spark: SparkSession, d: str) -> DataFrame:
    """Memories of one model ranked against its first well-formed vector."""
    e = load_table(spark, d, "harness_embeddings").filter("owner_kind = 'memory' and model = 'lark-embed-m' and dim = 64 and size(vector) = 64").select("embedding_id", "owner_id", "vector").filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e30)))
    query = e.agg(F.min_by("vector", "embedding_id").alias("q"), F.min("embedding_id").alias("qid"))
    rows = e.dropDuplicates(["embedding_id"]).join(F.broadcast(query)).filter("embedding_id <> qid").select("embedding_id", "owner_id", F.round(cosine(F.col("vector"), F.col("q")), 5).alias("similarity"))
    return ranked(rows, F.col("similarity").desc(), F.col("embedding_id"), limit=15).select("embedding_id", "owner_id", "similarity", "rank")


def lexical_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Search that ranks by words where the wanted model has no vectors."""
    have = load_table(spark, d, "harness_embeddings").filter("model = 'no-such-model'").agg((F.count("*") > 0).alias("has_vectors"))
    return _lexical(spark, d, 10).join(F.broadcast(have)).filter("not has_vectors").select("doc_id", "score", "rank", F.lit("lexical").alias("mode"))


def embedding_backlog(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that lack a vector of a model."""
    models = spark.createDataFrame([("lark-embed-s",), ("lark-embed-m",)], "model string")
    owners = load_table(spark, d, "symbols").select(F.col("symbol_id").cast("string").alias("owner_id"), "kind").distinct()
    have = load_table(spark, d, "harness_embeddings").filter("owner_kind = 'symbol' and vector is not null").select("owner_id", "model")
    return owners.join(F.broadcast(models)).join(have, ["owner_id", "model"], "left_anti").groupBy("model", "kind").agg(F.count("*").alias("missing"))


QUERIES = {f.__name__: f for f in (cosine_topk, hybrid_rrf_topk, hybrid_concatenated_topk, memory_recall, lexical_fallback, embedding_backlog)}

_TOK = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]+')"


def _lex_sql(name: str, source: str, key: str) -> str:
    return f"""{name}w as (select {key} as k, {_TOK} as words from {source}), {name}n as (select count(*) as n, avg(len(words)) as avgdl from {name}w),
 {name}tf as (select k, term, len(words) as dl, len(list_filter(words, lambda x: x = term)) as tf from {name}w cross join (values ('snapshot'), ('budget')) t(term)), {name}df as (select term, count(*) as df from {name}tf where tf > 0 group by 1),
 {name}s as (select k, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 5) as score from {name}tf join {name}df using (term) cross join {name}n where tf > 0 group by 1),
 {name} as (select k, score, row_number() over (order by score desc, k) as rank from {name}s)"""


_VEC = """q as (select cast(embedding as double[]) as q from embeddings order by vec_id limit 1), vs as (select vec_id, round(list_cosine_similarity(cast(embedding as double[]), q), 6) as similarity from embeddings, q where vec_id <> (select min(vec_id) from embeddings)),
 vec as (select vec_id, similarity, row_number() over (order by similarity desc, vec_id) as rank from vs)"""
_PARTS = "(select distinct part_id, json_extract_string(payload_json, '$.text') as text from harness_message_parts where kind = 'text')"
ORACLES = {
    "cosine_topk": f"with {_VEC} select vec_id, similarity, cast(rank as integer) as rank from vec where rank <= 20",
    "hybrid_rrf_topk": f"with {_VEC}, {_lex_sql('lex', 'documents', 'doc_id')}, u as (select k as id, 1.0::double / (60 + rank) as part from lex where rank <= 80 union all select vec_id, 1.0::double / (60 + rank) from vec where rank <= 80) select id, round(sum(part), 8) as score from u group by 1 order by score desc, id limit 20",
    "hybrid_concatenated_topk": f"""with {_VEC}, {_lex_sql('lex', 'documents', 'doc_id')}, {_lex_sql('mem', _PARTS, 'part_id')},
 u as (select 'doc:' || k as id, 1.0::double / (60 + rank) as part from lex where rank <= 100 union all select 'part:' || k, 1.0::double / (60 + rank + (select least(100, count(*)) from lex)) from mem where rank <= 100 union all select 'doc:' || vec_id, 1.0::double / (60 + rank) from vec where rank <= 100)
 select id, round(sum(part), 8) as score from u group by 1 order by score desc, id limit 25""",
    "memory_recall": """with e as (select embedding_id, any_value(owner_id) as owner_id, any_value(cast(vector as double[])) as v from harness_embeddings where owner_kind = 'memory' and model = 'lark-embed-m' and dim = 64 and len(vector) = 64 and len(list_filter(vector, lambda x: x is null or isnan(x) or abs(x) >= 1e30)) = 0 group by 1),
 q as (select v as q, embedding_id as qid from e order by embedding_id limit 1), s as (select embedding_id, owner_id, case when len(list_filter(v, lambda x: x <> 0)) = 0 then 0.0 else round(list_cosine_similarity(v, q), 5) end as similarity from e, q where embedding_id <> qid)
 select embedding_id, owner_id, similarity, cast(row_number() over (order by similarity desc, embedding_id) as integer) as rank from s qualify rank <= 15""",
    "lexical_fallback": f"with {_lex_sql('lex', 'documents', 'doc_id')} select k as doc_id, score, cast(rank as integer) as rank, 'lexical' as mode from lex where rank <= 10 and not exists (select 1 from harness_embeddings where model = 'no-such-model')",
    "embedding_backlog": """with o as (select distinct cast(symbol_id as varchar) as owner_id, kind from symbols) select model, kind, count(*) as missing from o cross join (values ('lark-embed-s'), ('lark-embed-m')) m(model)
 where not exists (select 1 from harness_embeddings h where h.owner_kind = 'symbol' and h.vector is not null and h.owner_id = o.owner_id and h.model = m.model) group by 1, 2""",
}
