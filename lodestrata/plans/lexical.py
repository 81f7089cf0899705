"""Text search and ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import contains_ci, expand_identifier, has_all_prefixes, has_any_prefix, has_phrase, matches_glob, query_terms, token_estimate, tokens, weighted
from lodestrata.operators.corpus import semantic_units
from lodestrata.operators.search import best_per_key, document_frequency, ranked, snippet
from lodestrata.operators.text_index import TextIndex, build_index, index_bm25
from lodestrata.runtime import stored
from lodestrata.sources import load_table, table_path

QUERY = "snapshot reader budget"
NAME_QUERY = "resolve snapshot"
TERMS = query_terms(QUERY)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "documents")


def _file_chunks(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "chunks").filter("chunk_kind = 'file'")


def document_index(spark: SparkSession, d: str) -> TextIndex:
    return stored(spark, "index-documents", [table_path(d, "documents")], lambda path: build_index(_docs(spark, d), "doc_id", F.col("text"), path))


def content_index(spark: SparkSession, d: str) -> TextIndex:
    """The texts of files."""
    return stored(spark, "index-content", [table_path(d, "chunks")], lambda path: build_index(_file_chunks(spark, d), "file_id", F.col("content"), path))


def _chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with their content, path and name in one text."""
    files = load_table(spark, d, "files").select("file_id", "path")
    return load_table(spark, d, "chunks").join(files, "file_id").withColumn("all_text", F.concat_ws(" ", "content", "path", F.coalesce("name", F.lit(""))))


def chunk_index(spark: SparkSession, d: str) -> TextIndex:
    return stored(spark, "index-chunks", [table_path(d, "chunks"), table_path(d, "files")], lambda path: build_index(_chunk_texts(spark, d), "chunk_id", F.col("all_text"), path))


def _units(spark: SparkSession, d: str) -> DataFrame:
    return semantic_units(load_table(spark, d, "chunks"))


def unit_index(spark: SparkSession, d: str) -> TextIndex:
    return stored(spark, "index-units", [table_path(d, "chunks")], lambda path: build_index(_units(spark, d), "unit_id", F.col("content"), path))


def _memories(spark: SparkSession, d: str) -> DataFrame:
    """The texts that the message log remembers."""
    return load_table(spark, d, "harness_message_parts").filter("kind = 'text'").select("part_id", F.get_json_object("payload_json", "$.text").alias("text")).distinct()


def memory_index(spark: SparkSession, d: str) -> TextIndex:
    return stored(spark, "index-memories", [table_path(d, "harness_message_parts")], lambda path: build_index(_memories(spark, d), "part_id", F.col("text"), path))


def unit_text_search(spark: SparkSession, d: str) -> DataFrame:
    """Units of code and notes by rank."""
    hits = index_bm25(spark, unit_index(spark, d), query_terms("budget overlay"), "unit_id").select("unit_id", F.round("score", 6).alias("score"))
    return ranked(hits, F.col("score").desc(), F.col("unit_id"), limit=20)


def memory_text_search(spark: SparkSession, d: str) -> DataFrame:
    """Remembered texts by rank."""
    hits = index_bm25(spark, memory_index(spark, d), query_terms("snapshot budget"), "part_id").select("part_id", F.round("score", 6).alias("score"))
    return ranked(hits, F.col("score").desc(), F.col("part_id"), limit=20)


def lexical_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = index_bm25(spark, document_index(spark, d), TERMS, "doc_id").select("doc_id", F.round("score", 6).alias("score"))
    return ranked(hits, F.col("score").desc(), F.col("doc_id"), limit=20).select("doc_id", "score", "rank")


def token_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return document_frequency(document_index(spark, d).postings(spark)).orderBy(F.col("df").desc(), "term").limit(100)


def chunk_search_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Chunks ranked over their content, name and path, with a snippet; only the texts of the page are read whole."""
    terms = query_terms("snapshot overlay")
    hits = index_bm25(spark, chunk_index(spark, d), terms, "chunk_id").select("chunk_id", F.round("score", 6).alias("score"))
    named = hits.join(load_table(spark, d, "chunks").select("chunk_id", "file_id"), "chunk_id").join(load_table(spark, d, "files").select("file_id", "path"), "file_id")
    page = named.orderBy(F.col("score").desc(), "path", "chunk_id").limit(20).select("chunk_id", "score")
    # the page has 20 rows at most
    top = _chunk_texts(spark, d).join(F.broadcast(page), "chunk_id")
    return top.select("chunk_id", "path", "score", snippet(tokens(F.col("all_text")), terms).alias("snippet"))


def symbol_chunk_search(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of symbols alone, ranked as among all chunks."""
    hits = index_bm25(spark, chunk_index(spark, d), query_terms("branch overlay"), "chunk_id").select("chunk_id", F.round("score", 6).alias("score"))
    own = load_table(spark, d, "chunks").filter("chunk_kind = 'symbol'").select("chunk_id", "name")
    return ranked(hits.join(own, "chunk_id"), F.col("score").desc(), F.col("chunk_id"), limit=20)


def prefix_all_search(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).filter(has_all_prefixes(tokens(F.col("text")), ["snap", "rea"])).select("doc_id", "lang")


def prefix_any_search(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).filter(has_any_prefix(tokens(F.col("text")), ["verzeich", "registr"])).select("doc_id", "lang")


def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).filter(has_phrase(tokens(F.col("text")), ["the", "token", "budget"])).select("doc_id", "source")


def identifier_words(spark: SparkSession, d: str) -> DataFrame:
    """How often each word occurs inside the names of symbols."""
    names = load_table(spark, d, "symbols").filter("name is not null").select("symbol_id", "name").distinct()
    words = names.select("symbol_id", F.explode(F.split(F.lower(expand_identifier(F.col("name"))), " ")).alias("word")).filter("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("uses"), F.count_distinct("symbol_id").alias("symbols"))


def file_search_merged(spark: SparkSession, d: str) -> DataFrame:
    """Path hits before content hits; the first hit of a path holds."""
    files = load_table(spark, d, "files").select("file_id", "path")
    by_path = files.filter(contains_ci(F.col("path"), "overlay")).select("path", F.lit(0).alias("tier"), F.lit(0.0).alias("score"))
    content = index_bm25(spark, content_index(spark, d), ["overlay"], "file_id").join(files, "file_id").select("path", F.lit(1).alias("tier"), F.round("score", 6).alias("score"))
    merged = best_per_key(by_path.unionByName(content), ["path"], F.col("tier"), F.col("score").desc())
    return merged.orderBy("tier", F.col("score").desc(), F.length("path"), "path").limit(40).select("path", "tier", "score")


def exact_text_search(spark: SparkSession, d: str) -> DataFrame:
    """Lines that contain a fixed string, with their numbers; at most 3 a file."""
    rows = _file_chunks(spark, d).filter(contains_ci(F.col("content"), "token budget"))
    lines = rows.select("file_id", F.posexplode(F.split("content", "\n")).alias("pos", "line")).filter(contains_ci(F.col("line"), "token budget"))
    return ranked(lines, F.col("pos"), within=["file_id"], limit=3).select("file_id", (F.col("pos") + 1).alias("line_no"), F.trim(F.regexp_replace("line", r"[\r\t]", " ")).alias("excerpt"))


def file_lookup_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Exact path first, else the shortest path that contains the query."""
    q = "queue"
    hit = (F.col("path") == q) | contains_ci(F.col("path"), q)
    return load_table(spark, d, "files").filter(hit).orderBy(F.when(F.col("path") == q, 0).otherwise(1), F.length("path"), "path").limit(1).select("file_id", "path")


def path_glob_filter(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "files").filter(matches_glob(F.col("path"), "**/src/*/*.ts") | matches_glob(F.col("path"), "*/docs/**")).select("file_id", "path")


def symbol_additive_rank(spark: SparkSession, d: str) -> DataFrame:
    """Exact name 100, key 90, phrase 60, 10 for each token and 20 for all of them."""
    terms = query_terms(NAME_QUERY)
    rows = load_table(spark, d, "symbols").filter("name is not null").select("symbol_id", "name", "kind").distinct()
    expanded = F.lower(expand_identifier(F.col("name")))
    found = [expanded.contains(t) for t in terms]
    score = weighted((expanded == NAME_QUERY, 100), (F.lower("name") == NAME_QUERY.replace(" ", ""), 90), (expanded.contains(NAME_QUERY), 60), *((f, 10) for f in found), (found[0] & found[1], 20))
    return rows.withColumn("score", score).filter("score > 0").orderBy(F.col("score").desc(), "name", "symbol_id").limit(50).select("symbol_id", "name", "score")


def body_additive_rank(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of SQL functions: name exact 400 or contained 220, object exact 320 or contained 180, body 100."""
    files = load_table(spark, d, "files").filter("language = 'sql'").select("file_id", "path")
    rows = _file_chunks(spark, d).join(files, "file_id").select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?i)function\s+([\w.]+)\s*\("), F.lit(1))).alias("name"), F.lower("content").alias("body"))
    bare = F.lower(F.regexp_replace("name", r"^\w+\.", ""))
    score = weighted((bare == "track_branch_report", 400), ((bare != "track_branch_report") & bare.contains("branch"), 220), (F.lower("name") == "app.load_shard", 320), (F.lower("name").contains("shard"), 180), (F.col("body").contains("group by 1"), 100))
    return rows.select("path", "name", score.alias("score")).distinct().orderBy(F.col("score").desc(), "path", "name").limit(40)


def hot_index_rank(spark: SparkSession, d: str) -> DataFrame:
    """Terms of names: exact 100, contained 60, 10 for each token."""
    rows = load_table(spark, d, "symbols").filter("name is not null").groupBy(F.lower(expand_identifier(F.col("name"))).alias("entry")).agg(F.count("*").alias("uses"))
    score = weighted((F.col("entry") == "load shard", 100), (F.col("entry").contains("load shard"), 60), (F.array_contains(F.split("entry", " "), "load"), 10), (F.array_contains(F.split("entry", " "), "shard"), 10))
    return rows.withColumn("score", score).filter("score > 0").select("entry", "uses", "score")


def cross_source_search(spark: SparkSession, d: str) -> DataFrame:
    """One ranked list over documents, symbols, paths and message parts."""
    def score(text):  # 90 for each term, 140 for all of them together
        hits = [F.lower(F.coalesce(text, F.lit(""))).contains(t) for t in ("route", "map")]
        return weighted((hits[0], 90), (hits[1], 90), (hits[0] & hits[1], 140))

    docs = _docs(spark, d).select(F.lit("document").alias("origin"), F.col("doc_id").cast("string").alias("key"), score(F.col("text")).alias("score"))
    symbols = load_table(spark, d, "symbols").select("symbol_id", "name").distinct().select(F.lit("symbol").alias("origin"), F.col("symbol_id").cast("string").alias("key"), (score(F.col("name")) + 30).alias("score")).filter("score > 30")
    paths = load_table(spark, d, "files").select(F.lit("path").alias("origin"), F.col("path").alias("key"), (score(F.col("path")) + F.when(F.col("path").startswith("orchid-"), 15).otherwise(0)).alias("score")).filter("score > 15")
    parts = load_table(spark, d, "harness_message_parts").select("part_id", F.get_json_object("payload_json", "$.text").alias("text")).distinct().select(F.lit("message").alias("origin"), F.col("part_id").alias("key"), score(F.col("text")).alias("score"))
    rows = docs.unionByName(symbols).unionByName(paths).unionByName(parts).filter("score > 0")
    return ranked(rows, F.col("score").desc(), F.col("key"), within=["origin"], limit=15).select("origin", "key", "score", "rank")


def answer_recall(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose tokens match, united with texts that contain the query; total count beside the page."""
    parts = load_table(spark, d, "harness_message_parts").filter("kind = 'text'").select("part_id", "message_id", F.get_json_object("payload_json", "$.text").alias("text")).distinct().filter("text is not null")
    by_token = parts.filter(F.array_contains(tokens(F.col("text")), "recall") & F.array_contains(tokens(F.col("text")), "service"))
    by_text = parts.filter(contains_ci(F.col("text"), "shared cache"))
    matched = by_token.select("part_id", "message_id").union(by_text.select("part_id", "message_id")).distinct()
    total = matched.agg(F.count("*").alias("total"))
    return matched.orderBy("part_id").limit(25).join(F.broadcast(total)).select("part_id", "message_id", "total", (F.col("total") > 25).alias("truncated"))


def scout_rank(spark: SparkSession, d: str) -> DataFrame:
    """2 for each contained token, severity 3 / 2 / 1, focus 10 or 8, intent adjustments; nothing at or below 0."""
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    severity = F.when(text.contains("error"), 3).when(text.contains("wrong"), 2).otherwise(1)
    score = weighted(*((text.contains(t), 2) for t in ("branch", "schema", "watcher"))) + severity + weighted((F.col("source") == "runbooks", 10), (F.col("source") == "faq", 8), (F.col("lang") == "en", 1), (F.length(text) < 100, -8))
    return _docs(spark, d).select("doc_id", score.alias("score")).filter("score > 0").orderBy(F.col("score").desc(), "doc_id").limit(50)


def context_rank(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by confidence, source, focus, changes and freshness."""
    files = load_table(spark, d, "files")
    freshness = F.when(F.col("indexed_at").isNull() | F.col("last_modified_at").isNull(), -15).when(F.col("indexed_at") < F.col("last_modified_at"), -35).otherwise(0)
    confidence = F.when(F.coalesce("is_generated", F.lit(0)) == 1, 0.3).otherwise(0.8)
    source = F.when(F.col("language") == "typescript", 20).when(F.col("language") == "sql", 12).otherwise(5)
    score = F.round(confidence * 100 + source + weighted((F.col("path").contains("/core/"), 70), (F.col("path").contains("/server/"), 55), (F.col("line_count") > 0, 4)) + freshness, 3)
    return files.filter("is_deleted = 0").select("file_id", "path", score.alias("score")).orderBy(F.col("score").desc(), "path").limit(60)


def name_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Exact 100, prefix 80, contained 60, same first word 40, same last word 30."""
    q = "loadshard"
    name = F.lower("name")
    words = F.split(F.lower(expand_identifier(F.col("name"))), " ")
    score = F.when(name == q, 100).when(name.startswith(q), 80).when(name.contains(q), 60).when(F.element_at(words, 1) == "load", 40).when(F.element_at(words, -1) == "shard", 30).otherwise(0)
    rows = load_table(spark, d, "symbols").filter("name is not null and name <> ''").select("name").distinct().select("name", score.alias("score")).filter("score > 0")
    return rows.orderBy(F.col("score").desc(), "name").limit(25)


def tool_rank(spark: SparkSession, d: str) -> DataFrame:
    """Tools of the message log ranked for a request: name 120 / 70 / 35, then 40 for each token of the request."""
    calls = load_table(spark, d, "harness_message_parts").filter("kind = 'tool_call'").select("part_id", F.get_json_object("payload_json", "$.tool").alias("tool")).distinct().filter("tool is not null")
    tools = calls.groupBy("tool").agg(F.count("*").alias("calls"))
    score = F.when(F.col("tool") == "file_search", 120).when(F.col("tool").startswith("file"), 70).when(F.col("tool").contains("search"), 35).otherwise(0) + weighted((F.col("tool").contains("symbol"), 40), (F.col("tool").contains("map"), 40))
    return tools.select("tool", "calls", score.alias("score"))


def precedent_rank(spark: SparkSession, d: str) -> DataFrame:
    """Kind base 50 / 45 / 38 / 18, focus 18, generated files less 8; strength by the score."""
    files = load_table(spark, d, "files").select("file_id", "path", "is_generated")
    rows = load_table(spark, d, "symbols").select("symbol_id", "file_id", "kind", "name").distinct().join(files, "file_id")
    base = F.when(F.col("kind") == "function", 50).when(F.col("kind") == "method", 45).when(F.col("kind") == "class", 38).otherwise(18)
    score = base + weighted((F.col("path").contains("/core/"), 18), (F.coalesce("is_generated", F.lit(0)) == 1, -8), (F.lower("name").startswith("resolve"), 12))
    strength = F.when(score >= 60, "safe").when(score >= 45, "partial").otherwise("weak")
    return rows.groupBy("kind", strength.alias("strength")).agg(F.count("*").alias("symbols"), F.max(score).alias("best"))


def token_costs(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).groupBy("source").agg(F.sum(token_estimate(F.col("text"))).alias("tokens"), F.count("*").alias("documents"))


QUERIES = {f.__name__: f for f in (lexical_bm25_topk, unit_text_search, memory_text_search, token_document_frequency, chunk_search_bm25, symbol_chunk_search, prefix_all_search, prefix_any_search, phrase_search, identifier_words, file_search_merged, exact_text_search, file_lookup_ranked, path_glob_filter, symbol_additive_rank, body_additive_rank, hot_index_rank, cross_source_search, answer_recall, scout_rank, context_rank, name_suggestions, tool_rank, precedent_rank, token_costs)}

_TOK = "regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]+')"
# another way to the same words: a blank before each capitalised word, then the runs of one kind of character
_EXPAND = "array_to_string(regexp_extract_all(regexp_replace({0}, '[A-Z][a-z]', ' \\0', 'g'), '[A-Z][a-z]+|[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9_./\\\\:\\s-]+'), ' ')"


def _bm25_sql(source: str, key: str, text: str, terms: list[str]) -> str:
    listed = ", ".join(f"('{t}')" for t in terms)
    return f"""w as (select {key} as k, {_TOK.format(text)} as words from {source}), n as (select count(*) as n, avg(len(words)) as avgdl from w),
 tf as (select k, term, len(words) as dl, len(list_filter(words, lambda x: x = term)) as tf from w cross join (values {listed}) t(term)),
 dfs as (select term, count(*) as df from tf where tf > 0 group by 1),
 bm as (select k, sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) as score from tf join dfs using (term) cross join n where tf > 0 group by 1)"""


_SYM = "(select distinct symbol_id, name from symbols)"
ORACLES = {
    "symbol_chunk_search": f"""with src as (select chunk_id, concat_ws(' ', content, path, coalesce(name, '')) as all_text from chunks join files using (file_id)), {_bm25_sql('src', 'chunk_id', 'all_text', ['branch', 'overlay'])},
 r as (select k as chunk_id, round(score, 6) as score, name from bm join chunks on k = chunk_id where chunk_kind = 'symbol') select chunk_id, score, name, cast(row_number() over (order by score desc, chunk_id) as integer) as rank from r order by score desc, chunk_id limit 20""",
    "lexical_bm25_topk": f"with {_bm25_sql('documents', 'doc_id', 'text', TERMS)}, r as (select k as doc_id, round(score, 6) as score from bm) select doc_id, score, cast(row_number() over (order by score desc, doc_id) as integer) as rank from r order by score desc, doc_id limit 20",
    "memory_text_search": f"with src as (select distinct part_id, json_extract_string(payload_json, '$.text') as text from harness_message_parts where kind = 'text'), {_bm25_sql('src', 'part_id', 'text', ['snapshot', 'budget'])}, r as (select k as part_id, round(score, 6) as score from bm) select part_id, score, cast(row_number() over (order by score desc, part_id) as integer) as rank from r order by score desc, part_id limit 20",
    "unit_text_search": f"with src as (select distinct 'su_' || sha256(concat_ws(chr(31), case when chunk_kind = 'symbol' then 'code' else 'doc' end, cast(file_id as varchar), sha256(content))) as unit_id, content from chunks where content is not null), {_bm25_sql('src', 'unit_id', 'content', ['budget', 'overlay'])}, r as (select k as unit_id, round(score, 6) as score from bm) select unit_id, score, cast(row_number() over (order by score desc, unit_id) as integer) as rank from r order by score desc, unit_id limit 20",
    "token_document_frequency": f"select term, count(distinct doc_id) as df, count(*) as cf from (select doc_id, unnest({_TOK.format('text')}) as term from documents) group by 1 order by df desc, term limit 100",
    "chunk_search_bm25": f"""with src as (select chunk_id, path, concat_ws(' ', content, path, coalesce(name, '')) as all_text from chunks join files using (file_id)), {_bm25_sql('src', 'chunk_id', 'all_text', ['snapshot', 'overlay'])},
 top as (select k, path, round(score, 6) as score, words from bm join src on k = chunk_id join w using (k) order by score desc, path, k limit 20),
 hit as (select *, coalesce(least(nullif(list_position(words, 'snapshot'), 0), nullif(list_position(words, 'overlay'), 0)), 0) as p from top)
 select k as chunk_id, path, score, array_to_string(words[greatest(1, p - 6):greatest(1, p - 6) + 23], ' ') as snippet from hit""",
    "prefix_all_search": f"select doc_id, lang from documents where len(list_filter({_TOK.format('text')}, lambda x: starts_with(x, 'snap'))) > 0 and len(list_filter({_TOK.format('text')}, lambda x: starts_with(x, 'rea'))) > 0",
    "prefix_any_search": f"select doc_id, lang from documents where len(list_filter({_TOK.format('text')}, lambda x: starts_with(x, 'verzeich') or starts_with(x, 'registr'))) > 0",
    "phrase_search": f"select doc_id, source from documents where contains(' ' || array_to_string({_TOK.format('text')}, ' ') || ' ', ' the token budget ')",
    "identifier_words": f"select word, count(*) as uses, count(distinct symbol_id) as symbols from (select symbol_id, unnest(string_split(lower({_EXPAND.format('name')}), ' ')) as word from {_SYM} where name is not null) where word <> '' group by 1",
    "file_search_merged": f"""with src as (select file_id, content from chunks where chunk_kind = 'file'), {_bm25_sql('src', 'file_id', 'content', ['overlay'])},
 u as (select path, 0 as tier, 0.0::double as score from files where contains(lower(path), 'overlay') union all select path, 1, round(score, 6) from bm join files on k = file_id),
 b as (select *, row_number() over (partition by path order by tier, score desc) as rn from u)
 select path, tier, score from b where rn = 1 order by tier, score desc, length(path), path limit 40""",
    "exact_text_search": """with l as (select file_id, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as n from chunks where chunk_kind = 'file'),
 h as (select *, row_number() over (partition by file_id order by n) as rn from l where contains(lower(line), 'token budget'))
 select file_id, cast(n as integer) as line_no, trim(regexp_replace(line, '[\\r\\t]', ' ', 'g'), ' ') as excerpt from h where rn <= 3""",
    "file_lookup_ranked": "select file_id, path from files where path = 'queue' or contains(lower(path), 'queue') order by case when path = 'queue' then 0 else 1 end, length(path), path limit 1",
    "path_glob_filter": "select file_id, path from files where regexp_full_match(path, '(?:.*/)?src/[^/]*/[^/]*\\.ts') or regexp_full_match(path, '[^/]*/docs/.*')",
    "symbol_additive_rank": f"""with e as (select symbol_id, name, lower({_EXPAND.format('name')}) as x from {_SYM} where name is not null),
 s as (select symbol_id, name, cast(case when x = 'resolve snapshot' then 100 else 0 end + case when lower(name) = 'resolvesnapshot' then 90 else 0 end + case when contains(x, 'resolve snapshot') then 60 else 0 end + case when contains(x, 'resolve') then 10 else 0 end + case when contains(x, 'snapshot') then 10 else 0 end + case when contains(x, 'resolve') and contains(x, 'snapshot') then 20 else 0 end as double) as score from e)
 select * from s where score > 0 order by score desc, name, symbol_id limit 50""",
    "body_additive_rank": """with r as (select path, unnest(regexp_extract_all(content, '(?i)function\\s+([\\w.]+)\\s*\\(', 1)) as name, lower(content) as body from chunks join files using (file_id) where chunk_kind = 'file' and language = 'sql'),
 b as (select *, lower(regexp_replace(name, '^\\w+\\.', '')) as bare from r)
 select distinct path, name, cast(case when bare = 'track_branch_report' then 400 when contains(bare, 'branch') then 220 else 0 end + case when lower(name) = 'app.load_shard' then 320 else 0 end + case when contains(lower(name), 'shard') then 180 else 0 end + case when contains(body, 'group by 1') then 100 else 0 end as double) as score from b order by score desc, path, name limit 40""",
    "hot_index_rank": f"""with e as (select lower({_EXPAND.format('name')}) as entry, count(*) as uses from symbols where name is not null group by 1),
 s as (select entry, uses, cast(case when entry = 'load shard' then 100 else 0 end + case when contains(entry, 'load shard') then 60 else 0 end + case when list_contains(string_split(entry, ' '), 'load') then 10 else 0 end + case when list_contains(string_split(entry, ' '), 'shard') then 10 else 0 end as double) as score from e) select * from s where score > 0""",
    "cross_source_search": """with u as (select 'document' as origin, cast(doc_id as varchar) as key, lower(coalesce(text, '')) as t, 0 as extra, 0 as least_ from documents
 union all select 'symbol', cast(symbol_id as varchar), lower(coalesce(name, '')), 30, 30 from (select distinct symbol_id, name from symbols)
 union all select 'path', path, lower(path), case when starts_with(path, 'orchid-') then 15 else 0 end, 15 from files
 union all select 'message', part_id, lower(coalesce(json_extract_string(payload_json, '$.text'), '')), 0, 0 from (select distinct part_id, payload_json from harness_message_parts)),
 s as (select origin, key, least_, cast(case when contains(t, 'route') then 90 else 0 end + case when contains(t, 'map') then 90 else 0 end + case when contains(t, 'route') and contains(t, 'map') then 140 else 0 end + extra as double) as score from u),
 r as (select origin, key, score, cast(row_number() over (partition by origin order by score desc, key) as integer) as rank from s where score > least_) select * from r where rank <= 15""",
    "answer_recall": f"""with p as (select distinct part_id, message_id, json_extract_string(payload_json, '$.text') as text from harness_message_parts where kind = 'text'),
 m as (select part_id, message_id from p where text is not null and list_contains({_TOK.format('text')}, 'recall') and list_contains({_TOK.format('text')}, 'service') union select part_id, message_id from p where contains(lower(text), 'shared cache'))
 select part_id, message_id, (select count(*) from m) as total, (select count(*) from m) > 25 as truncated from m order by part_id limit 25""",
    "scout_rank": """with t as (select doc_id, source, lang, lower(coalesce(text, '')) as t from documents),
 s as (select doc_id, cast(case when contains(t, 'branch') then 2 else 0 end + case when contains(t, 'schema') then 2 else 0 end + case when contains(t, 'watcher') then 2 else 0 end + case when contains(t, 'error') then 3 when contains(t, 'wrong') then 2 else 1 end + case when source = 'runbooks' then 10 when source = 'faq' then 8 else 0 end + case when lang = 'en' then 1 else 0 end - case when length(t) < 100 then 8 else 0 end as double) as score from t)
 select * from s where score > 0 order by score desc, doc_id limit 50""",
    "context_rank": """select file_id, path, round(case when coalesce(is_generated, 0) = 1 then 0.3 else 0.8 end * 100 + case when language = 'typescript' then 20 when language = 'sql' then 12 else 5 end + case when contains(path, '/core/') then 70 else 0 end + case when contains(path, '/server/') then 55 else 0 end + case when line_count > 0 then 4 else 0 end
 + case when indexed_at is null or last_modified_at is null then -15 when indexed_at < last_modified_at then -35 else 0 end, 3)::double as score from files where is_deleted = 0 order by score desc, path limit 60""",
    "name_suggestions": f"""with e as (select distinct name, lower(name) as l, string_split(lower({_EXPAND.format('name')}), ' ') as w from symbols where name is not null and name <> ''),
 s as (select name, case when l = 'loadshard' then 100 when starts_with(l, 'loadshard') then 80 when contains(l, 'loadshard') then 60 when w[1] = 'load' then 40 when w[-1] = 'shard' then 30 else 0 end as score from e) select * from s where score > 0 order by score desc, name limit 25""",
    "tool_rank": """with c as (select tool, count(*) as calls from (select distinct part_id, json_extract_string(payload_json, '$.tool') as tool from harness_message_parts where kind = 'tool_call') where tool is not null group by 1)
 select tool, calls, cast(case when tool = 'file_search' then 120 when starts_with(tool, 'file') then 70 when contains(tool, 'search') then 35 else 0 end + case when contains(tool, 'symbol') then 40 else 0 end + case when contains(tool, 'map') then 40 else 0 end as double) as score from c""",
    "precedent_rank": """with r as (select s.kind, cast(case when s.kind = 'function' then 50 when s.kind = 'method' then 45 when s.kind = 'class' then 38 else 18 end + case when contains(path, '/core/') then 18 else 0 end - case when coalesce(is_generated, 0) = 1 then 8 else 0 end + case when starts_with(lower(s.name), 'resolve') then 12 else 0 end as double) as score
 from (select distinct symbol_id, file_id, kind, name from symbols) s join files using (file_id))
 select kind, case when score >= 60 then 'safe' when score >= 45 then 'partial' else 'weak' end as strength, count(*) as symbols, max(score) as best from r group by 1, 2""",
    "token_costs": "select source, cast(sum(ceil(length(coalesce(text, '')) / 4.0)) as bigint) as tokens, count(*) as documents from documents group by 1",
}
