"""Lookups, lists, joins and composed reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import contains_ci
from lodestrata.operators import corpus
from lodestrata.operators.rollups import window_filter
from lodestrata.operators.search import best_per_key
from lodestrata.operators.sections import heading_sections
from lodestrata.plans import codebase, findings
from lodestrata.sources import load_table
from lodestrata.sources.store import sarif_results


def file_list(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "files").filter("is_deleted = 0").select("file_id", "path", "language", "line_count")


def imports_of_files(spark: SparkSession, d: str) -> DataFrame:
    """Outgoing and incoming module edges of each module."""
    e = codebase.module_edges(spark, d)
    return e.groupBy(F.col("src").alias("module")).agg(F.count("*").alias("imports")).join(e.groupBy(F.col("dst").alias("module")).agg(F.count("*").alias("dependents")), "module", "full").select("module", F.coalesce("imports", F.lit(0)).alias("imports"), F.coalesce("dependents", F.lit(0)).alias("dependents"))


def fact_list(spark: SparkSession, d: str) -> DataFrame:
    rows = window_filter(load_table(spark, d, "harness_sessions").distinct(), status__in=["closed", "error"], updated_at__since="2025-03-01", tier=None)
    return rows.orderBy(F.col("updated_at").desc(), "status", "session_id").limit(100).select("session_id", "status")


def multi_column_search(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that hold a literal in any of four columns; wildcards mean themselves."""
    rows = load_table(spark, d, "harness_sessions").distinct()
    hit = None
    for c in ("title", "project_id", "active_model", "active_provider"):
        hit = contains_ci(F.col(c), "%") | contains_ci(F.col(c), "anchor") if hit is None else hit | contains_ci(F.col(c), "anchor")
    return rows.filter(hit).select("session_id", "title")


def json_membership(spark: SparkSession, d: str) -> DataFrame:
    """Sessions whose JSON list of fall-backs holds a model."""
    rows = load_table(spark, d, "harness_sessions").distinct()
    return rows.filter(F.array_contains(F.from_json("fallback_chain_json", "array<string>"), "quill-mini")).select("session_id", "active_model")


def null_safe_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = load_table(spark, d, "documents")
    return window_filter(rows, project_id__is=None).groupBy("source").agg(F.count("*").alias("documents"))


def locator_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Bare function names resolved to their qualified form: the first by name, with the number of candidates."""
    o = codebase.schema_object_list(spark, d).filter("object_type = 'function'").withColumn("bare", F.regexp_replace("name", r"^\w+\.", ""))
    return o.groupBy("bare").agg(F.min("name").alias("resolved"), F.count("*").alias("candidates"), F.sum("definitions").alias("definitions"))


def issue_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Findings of one rule and excerpt in one file are one issue: the first line holds."""
    rows = findings._findings(spark, d)
    return best_per_key(rows, ["rule", "path", "excerpt"], F.col("line_no")).groupBy("rule").agg(F.count("*").alias("issues"), F.max("line_no").alias("last_line"))


def foreign_keys_both_ways(spark: SparkSession, d: str) -> DataFrame:
    """Outbound and inbound references of each nation, appended without removing repeats."""
    c, s = load_table(spark, d, "customer"), load_table(spark, d, "supplier")
    out = c.select(F.col("c_nationkey").alias("nation"), F.lit("inbound").alias("direction"), F.lit("customer").alias("table_name")).unionByName(s.select(F.col("s_nationkey").alias("nation"), F.lit("inbound").alias("direction"), F.lit("supplier").alias("table_name"))).unionByName(load_table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.lit("outbound").alias("direction"), F.lit("region").alias("table_name")))
    return out.groupBy("nation", "direction", "table_name").agg(F.count("*").alias("references"))


def orphan_targets(spark: SparkSession, d: str) -> DataFrame:
    """Customers without any order."""
    return load_table(spark, d, "customer").join(load_table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("orphans"))


def sessions_without_messages(spark: SparkSession, d: str) -> DataFrame:
    s = load_table(spark, d, "harness_sessions").select("session_id", "status").distinct()
    return s.join(load_table(spark, d, "harness_messages").select("session_id"), "session_id", "left_anti").groupBy("status").agg(F.count("*").alias("sessions"))


def latest_state_per_trace(spark: SparkSession, d: str) -> DataFrame:
    """Sessions beside the newest message of each, where the scalar subquery of old becomes one row a key."""
    m = load_table(spark, d, "harness_messages").filter("session_id is not null").distinct()
    last = best_per_key(m.select("session_id", "message_id", "created_at", "ordinal"), ["session_id"], F.col("created_at").desc_nulls_last(), F.col("ordinal").desc(), F.col("message_id"))
    return load_table(spark, d, "harness_sessions").select("session_id", "status").distinct().join(last.select("session_id", "message_id"), "session_id", "left")


def usage_by_session_tier(spark: SparkSession, d: str) -> DataFrame:
    """Messages left-joined to their sessions: those of unknown sessions stay."""
    m = load_table(spark, d, "harness_messages").select("message_id", "session_id").distinct()
    s = load_table(spark, d, "harness_sessions").select("session_id", "tier", "active_model").distinct()
    return m.join(s, "session_id", "left").groupBy("tier", "active_model").agg(F.count("*").alias("messages"), F.count_distinct("session_id").alias("sessions"))


def overload_prefix_join(spark: SparkSession, d: str) -> DataFrame:
    """Table references met by functions of the same bare name: a prefix join as an equality of derived names."""
    refs = corpus.function_table_references(codebase._sql_texts(spark, d), ["path"]).select(F.regexp_replace("table_name", r"^\w+\.", "").alias("bare"), "function_name").distinct()
    defs = codebase.schema_object_list(spark, d).select(F.regexp_replace("name", r"^\w+\.", "").alias("bare"), "name", "object_type").distinct()
    return refs.join(defs, "bare").select("function_name", "name", "object_type")


def sarif_report(spark: SparkSession, d: str) -> DataFrame:
    """SARIF results of the errors, counted by what a reader would find in them."""
    r = sarif_results(findings._findings(spark, d))
    return r.groupBy(F.get_json_object("result", "$.ruleId").alias("rule"), F.get_json_object("result", "$.level").alias("level")).agg(F.count("*").alias("results"), F.max(F.get_json_object("result", "$.locations[0].physicalLocation.region.startLine").cast("int")).alias("last_line"))


def markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of the prose files by heading."""
    f = load_table(spark, d, "files").filter("path like '%.md'").select("file_id")
    rows = load_table(spark, d, "chunks").filter("chunk_kind = 'file'").join(f, "file_id").select("file_id", "content")
    return heading_sections(rows, "file_id", "content").select(F.col("key").alias("file_id"), "section_no", "title", "line_start", "line_end", F.length("content").alias("chars"))


def table_preflight(spark: SparkSession, d: str) -> DataFrame:
    """What a change of a table touches: columns, readers, files that name it, and a verdict."""
    n = codebase.table_neighbourhood(spark, d)
    u = codebase.schema_usages(spark, d).select(F.col("name").alias("table_name"), "files")
    j = n.join(u, "table_name", "left").withColumn("files", F.coalesce("files", F.lit(0)))
    risk = F.when(F.col("readers") + F.col("files") >= 3, "high").when(F.col("readers") + F.col("files") >= 1, "medium").otherwise("low")
    return j.groupBy(risk.alias("risk")).agg(F.count("*").alias("tables"), F.sum("columns").alias("columns"))


def error_trace(spark: SparkSession, d: str) -> DataFrame:
    """Error parts of messages with their sessions and the newest occurrence of each text."""
    p = load_table(spark, d, "harness_message_parts").filter("kind = 'error'").select("part_id", "message_id", "payload_json").distinct()
    m = load_table(spark, d, "harness_messages").select("message_id", "session_id", "created_at").distinct()
    return p.join(m, "message_id", "left").groupBy("payload_json").agg(F.count("*").alias("errors"), F.count_distinct("session_id").alias("sessions"), F.max("created_at").cast("string").alias("latest"))


def project_status(spark: SparkSession, d: str) -> DataFrame:
    """One row a workspace: files, stale files, documented exports and open findings."""
    space = F.element_at(F.split("path", "/"), 1).alias("workspace")
    f = load_table(spark, d, "files").filter("is_deleted = 0")
    base = f.groupBy(space).agg(F.count("*").alias("files"), F.count_if(F.col("last_modified_at") > F.col("indexed_at")).alias("stale"))
    open_ = findings._findings(spark, d).groupBy(space).agg(F.count("*").alias("findings"))
    return base.join(open_, "workspace", "left").select("workspace", "files", "stale", F.coalesce("findings", F.lit(0)).alias("findings"))


QUERIES = {f.__name__: f for f in (file_list, imports_of_files, fact_list, multi_column_search, json_membership, null_safe_filter, locator_resolution, issue_dedupe, foreign_keys_both_ways, orphan_targets, sessions_without_messages, latest_state_per_trace, usage_by_session_tier, overload_prefix_join, sarif_report, markdown_sections, table_preflight, error_trace, project_status)}

_C, _F = codebase, findings
_SQLP = f"{_C._TEXTS}, {_C._SQLT}, {_C._OBJ}, {_C._COLS}, {_C._FREF}"
ORACLES = {
    "markdown_sections": r"""with recursive md as (select file_id, content from chunks join files using (file_id) where chunk_kind = 'file' and path like '%.md' and content is not null and content <> ''),
 l0 as (select file_id, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as n, len(string_split(content, chr(10))) as total from md),
 l1 as (select * from l0 where not (n = total and line = '')),
 l2 as (select *, sum(case when regexp_matches(line, '^\s*(?:```|~~~)') then 1 else 0 end) over (partition by file_id order by n) % 2 = 1 as fenced, rtrim(line, chr(13)) as bare from l1),
 l3 as (select *, not fenced and regexp_matches(bare, '^#{1,6}\s+(.*?)\s*#*\s*$') as head from l2),
 l4 as (select *, sum(case when head then 1 else 0 end) over (partition by file_id order by n) as sec from l3),
 h as (select file_id, n, sec, length(regexp_extract(bare, '^(#{1,6})', 1)) as level, regexp_extract(bare, '^#{1,6}\s+(.*?)\s*#*\s*$', 1) as name from l4 where head),
 anc as (select p.file_id, p.sec, a.n, a.name from h p join h a on a.file_id = p.file_id and a.n <= p.n where a.n = p.n or a.level < (select min(k.level) from h k where k.file_id = p.file_id and k.n > a.n and k.n <= p.n)),
 titles as (select file_id, sec, string_agg(name, ' > ' order by n) as title from anc group by 1, 2),
 own as (select file_id, sec, n, line, row_number() over (partition by file_id, sec order by n) as i from l4),
 full_ as (select file_id, sec from own group by 1, 2 having count(*) filter (trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> '') > 0),
 g as (select file_id, sec, i, n, 1 as part, 1 as k, length(line) as chars from own where i = 1
  union all select o.file_id, o.sec, o.i, o.n, case when g.k >= 80 or g.chars + g.k + length(o.line) > 2200 then g.part + 1 else g.part end, case when g.k >= 80 or g.chars + g.k + length(o.line) > 2200 then 1 else g.k + 1 end, case when g.k >= 80 or g.chars + g.k + length(o.line) > 2200 then 0 else g.chars end + length(o.line)
  from g join own o on o.file_id = g.file_id and o.sec = g.sec and o.i = g.i + 1),
 parts as (select file_id, sec, part, min(n) as line_start, max(n) as line_end, max(chars) + max(k) - 1 as chars from g join full_ using (file_id, sec) group by 1, 2, 3),
 named as (select *, count(*) over (partition by file_id, sec) as many from parts)
 select file_id, cast(row_number() over (partition by file_id order by line_start) - 1 as integer) as section_no, case when many > 1 then trim(coalesce(title, '') || ' (part ' || part || ')') else coalesce(title, '') end as title, cast(line_start as bigint) as line_start, cast(line_end as bigint) as line_end, cast(chars as integer) as chars
 from named left join titles using (file_id, sec)""",
    "file_list": "select file_id, path, language, line_count from files where is_deleted = 0",
    "imports_of_files": f"with {_C._PRE}, a as (select src as module, count(*) as imports from mods group by 1), b as (select dst as module, count(*) as dependents from mods group by 1) select module, coalesce(imports, 0) as imports, coalesce(dependents, 0) as dependents from a full join b using (module)",
    "fact_list": "select session_id, status from (select distinct * from harness_sessions) where status in ('closed', 'error') and updated_at >= '2025-03-01' order by updated_at desc, status, session_id limit 100",
    "multi_column_search": "select session_id, title from (select distinct * from harness_sessions) where contains(lower(title), '%') or contains(lower(title), 'anchor') or contains(lower(project_id), 'anchor') or contains(lower(active_model), 'anchor') or contains(lower(active_provider), 'anchor')",
    "json_membership": "select session_id, active_model from (select distinct * from harness_sessions) where json_contains(fallback_chain_json, '\"quill-mini\"')",
    "null_safe_filter": "select source, count(*) as documents from documents where project_id is null group by 1",
    "locator_resolution": f"with {_SQLP}, o as (select name, regexp_replace(name, '^\\w+\\.', '') as bare, count(*) as n from objs where object_type = 'function' group by 1, 2) select bare, min(name) as resolved, count(*) as candidates, cast(sum(n) as bigint) as definitions from o group by 1",
    "issue_dedupe": f"with {_F._FIND}, i as (select rule, fingerprint, min(line_no) as l from found group by 1, 2) select rule, count(*) as issues, cast(max(l) as integer) as last_line from i group by 1",
    "foreign_keys_both_ways": "select nation, direction, table_name, count(*) as references from (select c_nationkey as nation, 'inbound' as direction, 'customer' as table_name from customer union all select s_nationkey, 'inbound', 'supplier' from supplier union all select n_nationkey, 'outbound', 'region' from nation) group by 1, 2, 3",
    "orphan_targets": "select c_mktsegment, count(*) as orphans from customer where not exists (select 1 from orders where o_custkey = c_custkey) group by 1",
    "sessions_without_messages": "select status, count(*) as sessions from (select distinct session_id, status from harness_sessions) s where not exists (select 1 from harness_messages m where m.session_id = s.session_id) group by 1",
    "latest_state_per_trace": "with m as (select distinct session_id, message_id, created_at, ordinal from harness_messages where session_id is not null qualify row_number() over (partition by session_id order by created_at desc nulls last, ordinal desc, message_id) = 1) select session_id, status, message_id from (select distinct session_id, status from harness_sessions) left join m using (session_id)",
    "usage_by_session_tier": "select tier, active_model, count(*) as messages, count(distinct m.session_id) as sessions from (select distinct message_id, session_id from harness_messages) m left join (select distinct session_id, tier, active_model from harness_sessions) s on m.session_id = s.session_id group by 1, 2",
    "overload_prefix_join": f"with {_SQLP}, r as (select function_name, regexp_replace(table_name, '^\\w+\\.', '') as bare from refs group by 1, 2), o as (select distinct name, object_type, regexp_replace(name, '^\\w+\\.', '') as bare from objs) select function_name, name, object_type from r join o using (bare)",
    "sarif_report": f"with {_F._FIND} select rule, case severity when 'error' then 'error' when 'warning' then 'warning' else 'note' end as level, count(*) as results, cast(max(line_no) as integer) as last_line from found group by 1, 2",
    "table_preflight": f"""with {_SQLP}, c as (select table_name, count(distinct column_name) as columns from cols group by 1), r as (select table_name, count(distinct function_name) as readers from refs group by 1),
 o as (select name, min(path) as defined_in, regexp_replace(name, '^\\w+\\.', '') as bare from objs where object_type = 'table' group by 1), w as (select path, unnest(list_distinct(regexp_extract_all(lower(content), '[a-z_][a-z0-9_]*'))) as bare from texts), u as (select name as table_name, count(*) as files from w join o using (bare) where path <> defined_in group by 1),
 j as (select table_name, coalesce(columns, 0) as columns, coalesce(readers, 0) + coalesce(files, 0) as n from (c full join r using (table_name)) left join u using (table_name)) select case when n >= 3 then 'high' when n >= 1 then 'medium' else 'low' end as risk, count(*) as tables, cast(sum(columns) as bigint) as columns from j group by 1""",
    "error_trace": f"select payload_json, count(*) as errors, count(distinct session_id) as sessions, {_F._STAMP.format('max(created_at)')} as latest from (select distinct part_id, message_id, payload_json from harness_message_parts where kind = 'error') left join (select distinct message_id, session_id, created_at from harness_messages) using (message_id) group by 1",
    "project_status": f"with {_F._FIND}, g as (select split_part(path, '/', 1) as workspace, count(*) as findings from found group by 1), b as (select split_part(path, '/', 1) as workspace, count(*) as files, count(*) filter (last_modified_at > indexed_at) as stale from files where is_deleted = 0 group by 1) select workspace, files, stale, coalesce(findings, 0) as findings from b left join g using (workspace)",
}
