"""Fact, finding and rule queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.keys import fingerprint
from lodestrata.functions.text import contains_ci, matches_glob
from lodestrata.operators.facts import assertion_verdict, confidence, lifecycle, packet_confidence, replace_for_source, rule_findings, rule_memory, upsert, with_ack_status, without_acknowledged
from lodestrata.operators.search import best_per_key
from lodestrata.runtime import spread, stored_table
from lodestrata.sources import load_table, table_path

RULES = {"open-note": ("warning", "TODO|FIXME|XXX"), "long-line": ("info", "^.{160,}$"), "loose-import": ("error", r'^import .* from "\.\./[a-z]+"'), "unused-rule": ("info", "never_to_be_found_anywhere")}
CUT = "2025-04-01 00:00:00"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    f = load_table(spark, d, "files").select("file_id", "path", "last_modified_at", "indexed_at", "is_deleted")
    return load_table(spark, d, "chunks").filter("chunk_kind = 'file'").select("file_id", "content").join(f, "file_id")


def _findings(spark: SparkSession, d: str) -> DataFrame:
    """The stored findings of the last scan: made once, as long as the texts stay the same."""
    inputs = [table_path(d, "chunks"), table_path(d, "files")]
    return stored_table(spark, "findings", inputs, lambda: rule_findings(spread(_texts(spark, d)), "path", "content", RULES))


def _prior(spark: SparkSession, d: str) -> DataFrame:
    """What an earlier scan, before the cut, left behind."""
    old = _texts(spark, d).filter(F.coalesce(F.col("last_modified_at") < F.lit(CUT).cast("timestamp_ntz"), F.lit(True)))
    before = load_table(spark, d, "files").filter(F.coalesce(F.col("last_modified_at") < F.lit(CUT).cast("timestamp_ntz"), F.lit(True))).select("path")
    rows = _findings(spark, d).join(before, "path", "left_semi").select("fingerprint", "path", "severity").dropDuplicates(["fingerprint"])
    gone = old.filter("last_modified_at is null").select(fingerprint(F.lit("open-note"), F.col("path"), F.lit("// TODO")).alias("fingerprint"), "path", F.lit("warning").alias("severity"))
    deleted = load_table(spark, d, "files").filter("is_deleted = 1").select(fingerprint(F.lit("open-note"), F.col("path"), F.lit("// FIXME")).alias("fingerprint"), "path", F.lit("warning").alias("severity"))
    status = F.when(F.col("severity") == "info", "suppressed").when(F.col("path").contains("/test/"), "resolved").otherwise("active")
    return rows.unionByName(gone).unionByName(deleted).withColumn("status", status).select("fingerprint", "path", "status")


def _acks(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d).filter("path like '%/scripts/%' or path like '%/docs/%'").select("fingerprint")


def finding_scope(spark: SparkSession, d: str) -> DataFrame:
    """Findings whose rule, path or excerpt holds a text, below one folder of a workspace."""
    rows = _findings(spark, d)
    text = contains_ci(F.col("rule"), "import") | contains_ci(F.col("path"), "import") | contains_ci(F.col("excerpt"), "import")
    return rows.filter(text & matches_glob(F.col("path"), "orchid-*/**")).groupBy("rule").agg(F.count("*").alias("findings"), F.min("path").alias("first_path"))


def rule_finding_counts(spark: SparkSession, d: str) -> DataFrame:
    return _findings(spark, d).groupBy("rule", "severity").agg(F.count("*").alias("findings"), F.count_distinct("path").alias("files"), F.count_distinct("fingerprint").alias("fingerprints"), F.min("fingerprint").alias("first_fingerprint"))


def finding_list(spark: SparkSession, d: str) -> DataFrame:
    """The page of findings, errors first; the status is derived before the limit."""
    rows = with_ack_status(_findings(spark, d).withColumn("status", F.lit("active")), _acks(spark, d), "fingerprint")
    order = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return rows.filter("status = 'active'").orderBy(order, "path", "line_no", "rule").limit(100).select("rule", "severity", "path", "line_no")


def findings_minus_acks(spark: SparkSession, d: str) -> DataFrame:
    return without_acknowledged(_findings(spark, d), _acks(spark, d), "fingerprint").groupBy("rule").agg(F.count("*").alias("open_findings"))


def finding_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """After a scan of all files but the notes: findings of deleted files are resolved as those that went away."""
    files = load_table(spark, d, "files").select("path", "is_deleted")
    present = files.filter("is_deleted = 0 and path not like '%/docs/%'").select("path")
    scanned = present.unionByName(files.filter("is_deleted = 1").select("path"))
    produced = _findings(spark, d).join(scanned, "path", "left_semi").select("fingerprint", "path")
    return lifecycle(_prior(spark, d), produced, scanned, "fingerprint", "path").groupBy("status", F.coalesce("event", F.lit("-")).alias("event")).agg(F.count("*").alias("findings"), F.min("fingerprint").alias("first_fingerprint"))


def rule_memory_report(spark: SparkSession, d: str) -> DataFrame:
    rows = with_ack_status(_findings(spark, d).withColumn("status", F.lit("active")), _acks(spark, d), "fingerprint")
    return rule_memory(rows, list(RULES))


def evidence_confidence(spark: SparkSession, d: str) -> DataFrame:
    fresh = F.when(F.col("indexed_at").isNull() | F.col("last_modified_at").isNull(), "unknown").when(F.col("last_modified_at") > F.col("indexed_at"), "stale").otherwise("fresh")
    rows = with_ack_status(_findings(spark, d).withColumn("status", F.lit("active")), _acks(spark, d), "fingerprint").join(load_table(spark, d, "files").select("path", "indexed_at", "last_modified_at"), "path")
    return rows.groupBy(confidence(F.col("severity"), fresh, F.col("status")).alias("confidence")).agg(F.count("*").alias("findings"))


def packet_confidences(spark: SparkSession, d: str) -> DataFrame:
    f = load_table(spark, d, "files")
    c = packet_confidence(F.coalesce(F.col("line_count") < 20, F.lit(False)), F.col("sha256").isNull(), F.col("is_generated") == 1, F.col("language").isNull(), F.coalesce(F.col("last_modified_at") > F.col("indexed_at"), F.lit(True)))
    return f.groupBy(c.alias("confidence")).agg(F.count("*").alias("files"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    s = load_table(spark, d, "harness_sessions").distinct()
    return s.select(F.col("project_id").alias("project"), F.coalesce("tier", F.lit("?")).alias("overlay"), F.coalesce("active_provider", F.lit("?")).alias("source"), F.coalesce("status", F.lit("?")).alias("kind"), F.coalesce("active_model", F.lit("?")).alias("subject"), "session_id", "updated_at")


def fact_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The newest fact of each five-part key after an upsert of later facts."""
    f = _facts(spark, d)
    cut = F.lit("2025-06-01").cast("timestamp_ntz")
    keys = ["project", "overlay", "source", "kind", "subject"]
    one = lambda x: best_per_key(x, keys, F.col("updated_at").desc_nulls_last(), F.col("session_id"))
    merged = upsert(one(f.filter(F.coalesce(F.col("updated_at") < cut, F.lit(True)))), one(f.filter(F.col("updated_at") >= cut)), keys, "updated_at")
    return merged.select("project", "overlay", "source", "kind", "subject", "session_id")


def fact_replace(spark: SparkSession, d: str) -> DataFrame:
    """Facts after those of the sources seen since a date were replaced."""
    f = _facts(spark, d)
    cut = F.lit("2025-09-01").cast("timestamp_ntz")
    out = replace_for_source(f.filter(F.coalesce(F.col("updated_at") < cut, F.lit(True))), f.filter(F.col("updated_at") >= cut), ["project", "source"])
    return out.groupBy("project", "source").agg(F.count("*").alias("facts"), F.min("updated_at").cast("string").alias("oldest"))


def open_loops(spark: SparkSession, d: str) -> DataFrame:
    """Active findings, stale files and failed sessions in one list of groups."""
    a = _findings(spark, d).groupBy(F.lit("active_finding").alias("loop"), F.col("rule").alias("reason")).agg(F.count("*").alias("items"))
    b = load_table(spark, d, "files").filter("is_deleted = 0 and last_modified_at > indexed_at").groupBy(F.lit("stale_fact").alias("loop"), F.coalesce("language", F.lit("?")).alias("reason")).agg(F.count("*").alias("items"))
    c = load_table(spark, d, "harness_sessions").distinct().filter("status = 'error'").groupBy(F.lit("failed_run").alias("loop"), F.coalesce("tier", F.lit("?")).alias("reason")).agg(F.count("*").alias("items"))
    return a.unionByName(b).unionByName(c)


def open_loops_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """The groups with a map of counts by reason."""
    m = open_loops(spark, d).groupBy("loop").agg(F.sum("items").alias("items"), F.sort_array(F.collect_list(F.concat_ws("=", "reason", "items"))).alias("by_kind"))
    return m.select("loop", "items", F.array_join("by_kind", ";").alias("by_kind"))


def duplicate_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Texts stored more than once, by content hash."""
    docs = load_table(spark, d, "documents").filter("text is not null and text <> ''")
    return docs.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


def structural_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Functions of one canonical name in several files of a workspace."""
    f = load_table(spark, d, "files").select("file_id", F.element_at(F.split("path", "/"), 1).alias("workspace"))
    s = load_table(spark, d, "symbols").filter("kind = 'function' and name is not null").select("file_id", F.lower(F.regexp_replace("name", "_", "")).alias("canonical")).distinct()
    return s.join(f, "file_id").groupBy("workspace", "canonical").agg(F.count("*").alias("files"), F.min("file_id").alias("first_file")).filter("files > 1")


def conventions(spark: SparkSession, d: str) -> DataFrame:
    """Naming conventions derived in several ways; of each, the derivation with the highest confidence."""
    s = load_table(spark, d, "symbols").filter("name is not null").select("symbol_id", "kind", "name").distinct()
    style = F.when(F.col("name").rlike("^[a-z]+(?:[A-Z][a-z0-9]*)*$"), "camel").when(F.col("name").rlike("^[A-Z]"), "pascal").when(F.col("name").contains("_"), "snake").otherwise("other")
    by_kind = s.groupBy("kind", style.alias("style")).agg(F.count("*").alias("n"))
    total = by_kind.groupBy("kind").agg(F.sum("n").alias("t"))
    scored = by_kind.join(total, "kind").select(F.concat_ws(":", F.lit("naming"), "kind").alias("convention"), "style", F.round(F.col("n") / F.col("t"), 4).alias("confidence"))
    return best_per_key(scored, ["convention"], F.col("confidence").desc(), F.col("style"))


def applicability(spark: SparkSession, d: str) -> DataFrame:
    """How well a convention applies to a file: 100 / 90 / 70 / 55 / 45."""
    f = load_table(spark, d, "files")
    score = F.when(F.col("path").contains("/core/"), 100).when(F.col("path").contains("/server/"), 90).when(F.col("language") == "typescript", 70).when(F.col("path").contains("/src/"), 55).otherwise(45)
    return f.groupBy(score.alias("score")).agg(F.count("*").alias("files"))


def eval_assertions(spark: SparkSession, d: str) -> DataFrame:
    """Assertions over the texts of messages: verdicts by kind."""
    p = load_table(spark, d, "harness_message_parts").filter("kind = 'text'").select("part_id", F.get_json_object("payload_json", "$.text").alias("text")).distinct()
    kinds = [("includes", "branch"), ("excludes", "budget"), ("equals", "ok")]
    verdicts = [assertion_verdict(F.lit(k), F.lit(e), F.col("text")).alias(k) for k, e in kinds]
    return p.select(*verdicts).groupBy(*(k for k, _ in kinds)).agg(F.count("*").alias("cases"))


def usefulness_grades(spark: SparkSession, d: str) -> DataFrame:
    """Sessions graded by points: full from 3, or 2 with a follow-up; partial from 1."""
    m = load_table(spark, d, "harness_messages").filter("session_id is not null").select("session_id", "message_id", F.lower(F.trim("role")).alias("role")).distinct()
    g = m.groupBy("session_id").agg(F.count_if(F.col("role") == "tool").alias("tools"), F.count_if(F.col("role") == "user").alias("asked"), F.count_if(F.col("role") == "assistant").alias("told"))
    points = F.when(F.col("tools") >= 3, 2).when(F.col("tools") >= 1, 1).otherwise(0) + F.when(F.col("told") > F.col("asked"), 1).otherwise(0)
    grade = F.when((points >= 3) | ((F.col("asked") > 1) & (points >= 2)), "full").when(points >= 1, "partial").otherwise("no")
    return g.groupBy(grade.alias("grade")).agg(F.count("*").alias("sessions"))


def pattern_matches(spark: SparkSession, d: str) -> DataFrame:
    """Calls of one shape with their captures, fingerprinted by place."""
    rows = _texts(spark, d).select("path", F.posexplode(F.split("content", "\n")).alias("pos", "line")).select("path", "pos", F.regexp_extract("line", r"await (\w+)\(\{ (\w+): (\w+), (\w+) \}\)", 1).alias("callee"), F.regexp_extract("line", r"await (\w+)\(\{ (\w+): (\w+), (\w+) \}\)", 2).alias("argument")).filter("callee <> ''")
    return rows.select("callee", "argument", fingerprint(F.col("path"), F.col("pos"), F.col("callee")).alias("f")).groupBy("argument").agg(F.count("*").alias("matches"), F.count_distinct("callee").alias("callees"), F.min("f").alias("first_fingerprint"))


QUERIES = {f.__name__: f for f in (finding_scope, rule_finding_counts, finding_list, findings_minus_acks, finding_lifecycle, rule_memory_report, evidence_confidence, packet_confidences, fact_upsert, fact_replace, open_loops, open_loops_by_kind, duplicate_artifacts, structural_duplicates, conventions, applicability, eval_assertions, usefulness_grades, pattern_matches)}

_FP = "sha256(concat_ws(chr(31), {0}))"
_STAMP = "rtrim(rtrim(strftime({0}, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.')"
_RULESQL = " union all ".join(f"select path, last_modified_at, line, line_no, '{n}' as rule, '{sev}' as severity from lines where regexp_matches(line, '{pat}')" for n, (sev, pat) in RULES.items())
_FIND = f"""texts as (select file_id, path, content, last_modified_at, indexed_at, is_deleted from chunks join files using (file_id) where chunk_kind = 'file'),
 lines as (select path, last_modified_at, unnest(string_split(replace(content, chr(13), ''), chr(10))) as line, generate_subscripts(string_split(replace(content, chr(13), ''), chr(10)), 1) as line_no from texts),
 found as (select path, last_modified_at, line_no, rule, severity, {_FP.format("'s' || rule, 's' || path, 's' || trim(replace(line, chr(9), ' '), ' ')")} as fingerprint from ({_RULESQL})),
 acks as (select distinct fingerprint from found where path like '%/scripts/%' or path like '%/docs/%')"""
_PRIORSQL = f"""prior as (select fingerprint, path, case when severity = 'info' then 'suppressed' when contains(path, '/test/') then 'resolved' else 'active' end as status from (
 select fingerprint, any_value(path) as path, any_value(severity) as severity from found where coalesce(last_modified_at < '{CUT}', true) group by 1
 union all select {_FP.format("'sopen-note', 's' || path, 's// TODO'")}, path, 'warning' from texts where last_modified_at is null
 union all select {_FP.format("'sopen-note', 's' || path, 's// FIXME'")}, path, 'warning' from files where is_deleted = 1))"""
_LOOPS = f"""loops as (select 'active_finding' as loop, rule as reason, count(*) as items from found group by 2 union all select 'stale_fact', coalesce(language, '?'), count(*) from files where is_deleted = 0 and last_modified_at > indexed_at group by 2
 union all select 'failed_run', coalesce(tier, '?'), count(*) from (select distinct * from harness_sessions) where status = 'error' group by 2)"""
_FACTS = "f as (select distinct project_id as project, coalesce(tier, '?') as overlay, coalesce(active_provider, '?') as source, coalesce(status, '?') as kind, coalesce(active_model, '?') as subject, session_id, updated_at from harness_sessions)"
ORACLES = {
    "finding_scope": f"with {_FIND} select rule, count(*) as findings, min(path) as first_path from found f where starts_with(path, 'orchid-') and (contains(lower(rule), 'import') or contains(lower(path), 'import') or exists (select 1 from lines l where l.path = f.path and l.line_no = f.line_no and contains(lower(l.line), 'import'))) group by 1",
    "rule_finding_counts": f"with {_FIND} select rule, severity, count(*) as findings, count(distinct path) as files, count(distinct fingerprint) as fingerprints, min(fingerprint) as first_fingerprint from found group by 1, 2",
    "finding_list": f"with {_FIND} select rule, severity, path, cast(line_no as integer) as line_no from found where fingerprint not in (select fingerprint from acks) order by case severity when 'error' then 0 when 'warning' then 1 else 2 end, path, line_no, rule limit 100",
    "findings_minus_acks": f"with {_FIND} select rule, count(*) as open_findings from found where fingerprint not in (select fingerprint from acks) group by 1",
    "finding_lifecycle": f"""with {_FIND}, {_PRIORSQL}, scanned as (select path from files where is_deleted = 1 or path not like '%/docs/%' and is_deleted = 0), n as (select fingerprint, any_value(path) as path from found where path in (select path from scanned) group by 1),
 j as (select coalesce(n.fingerprint, p.fingerprint) as fingerprint, coalesce(n.path, p.path) as path, p.status as old, n.fingerprint is not null as produced from prior p full join n on p.fingerprint = n.fingerprint),
 e as (select *, case when produced and old is null then 'created' when produced and old = 'resolved' then 'reopened' when produced then 'updated' when old = 'active' and path in (select path from scanned) then 'resolved' end as event from j)
 select case when produced and old = 'suppressed' then 'suppressed' when produced then 'active' when event = 'resolved' then 'resolved' else old end as status, coalesce(event, '-') as event, count(*) as findings, min(fingerprint) as first_fingerprint from e group by 1, 2""",
    "rule_memory_report": f"with {_FIND}, c as (select rule, count(*) filter (fingerprint not in (select fingerprint from acks)) as active, count(*) filter (fingerprint in (select fingerprint from acks)) as acknowledged, cast(max(line_no) as integer) as last_line from found group by 1) select v.rule, coalesce(active, 0) as active, 0::bigint as resolved, coalesce(acknowledged, 0) as acknowledged, last_line from (values ('open-note'), ('long-line'), ('loose-import'), ('unused-rule')) v(rule) left join c using (rule)",
    "evidence_confidence": f"""with {_FIND}, x as (select round(least(1.0, greatest(0.1, case severity when 'error' then 0.92 when 'warning' then 0.82 else 0.68 end - case when f.indexed_at is null or f.last_modified_at is null then 0.4 when f.last_modified_at > f.indexed_at then 0.25 else 0 end - case when fingerprint in (select fingerprint from acks) then 0.15 else 0 end)), 4)::double as confidence from found join files f using (path)) select confidence, count(*) as findings from x group by 1""",
    "packet_confidences": "select round(least(0.99, greatest(0.05, 0.9 - case when coalesce(line_count < 20, false) then 0.25 else 0 end - case when sha256 is null then 0.2 else 0 end - case when is_generated = 1 then 0.3 else 0 end - case when language is null then 0.2 else 0 end - case when coalesce(last_modified_at > indexed_at, true) then 0.25 else 0 end)), 4)::double as confidence, count(*) as files from files group by 1",
    "fact_upsert": f"with {_FACTS} select project, overlay, source, kind, subject, session_id from (select *, row_number() over (partition by project, overlay, source, kind, subject order by updated_at desc nulls last, session_id) as rn from f) where rn = 1",
    "fact_replace": f"with {_FACTS}, n as (select * from f where updated_at >= '2025-09-01'), o as (select * from f where coalesce(updated_at < '2025-09-01', true)) select project, source, count(*) as facts, {_STAMP.format('min(updated_at)')} as oldest from (select * from n union all select o.* from o where not exists (select 1 from n where n.project = o.project and n.source = o.source)) group by 1, 2",
    "open_loops": f"with {_FIND}, {_LOOPS} select * from loops",
    "open_loops_by_kind": f"with {_FIND}, {_LOOPS} select loop, cast(sum(items) as bigint) as items, string_agg(reason || '=' || items, ';' order by reason || '=' || items) as by_kind from loops group by 1",
    "duplicate_artifacts": "select sha256(text) as content_hash, count(*) as copies, min(doc_id) as first_doc from documents where text is not null and text <> '' group by 1 having count(*) > 1",
    "structural_duplicates": "select workspace, canonical, count(*) as files, min(file_id) as first_file from (select distinct file_id, lower(replace(name, '_', '')) as canonical from symbols where kind = 'function' and name is not null) join (select file_id, split_part(path, '/', 1) as workspace from files) using (file_id) group by 1, 2 having count(*) > 1",
    "conventions": """with s as (select kind, case when regexp_matches(name, '^[a-z]+(?:[A-Z][a-z0-9]*)*$') then 'camel' when regexp_matches(name, '^[A-Z]') then 'pascal' when contains(name, '_') then 'snake' else 'other' end as style from (select distinct symbol_id, kind, name from symbols where name is not null)),
 c as (select kind, style, round(count(*) / sum(count(*)) over (partition by kind), 4)::double as confidence from s group by 1, 2) select 'naming:' || kind as convention, style, confidence from c qualify row_number() over (partition by kind order by confidence desc, style) = 1""",
    "applicability": "select case when contains(path, '/core/') then 100 when contains(path, '/server/') then 90 when language = 'typescript' then 70 when contains(path, '/src/') then 55 else 45 end as score, count(*) as files from files group by 1",
    "eval_assertions": """with p as (select distinct part_id, json_extract_string(payload_json, '$.text') as text from harness_message_parts where kind = 'text')
 select case when text is null then 'errored' when contains(lower(text), 'branch') then 'pass' else 'miss' end as includes, case when text is null then 'errored' when contains(lower(text), 'budget') then 'miss' else 'pass' end as excludes, case when text is null then 'errored' when text = 'ok' then 'pass' when contains(lower(text), 'ok') then 'partial' else 'miss' end as equals, count(*) as cases from p group by 1, 2, 3""",
    "usefulness_grades": """with m as (select distinct session_id, message_id, lower(trim(role)) as role from harness_messages where session_id is not null), g as (select session_id, count(*) filter (role = 'tool') as tools, count(*) filter (role = 'user') as asked, count(*) filter (role = 'assistant') as told from m group by 1),
 p as (select *, case when tools >= 3 then 2 when tools >= 1 then 1 else 0 end + case when told > asked then 1 else 0 end as points from g) select case when points >= 3 or (asked > 1 and points >= 2) then 'full' when points >= 1 then 'partial' else 'no' end as grade, count(*) as sessions from p group by 1""",
    "pattern_matches": f"""with l as (select path, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) - 1 as pos from chunks join files using (file_id) where chunk_kind = 'file'),
 m as (select path, pos, regexp_extract(line, 'await (\\w+)\\(\\{{ (\\w+): (\\w+), (\\w+) \\}}\\)', 1) as callee, regexp_extract(line, 'await (\\w+)\\(\\{{ (\\w+): (\\w+), (\\w+) \\}}\\)', 2) as argument from l)
 select argument, count(*) as matches, count(distinct callee) as callees, min({_FP.format("'s' || path, 's' || pos, 's' || callee")}) as first_fingerprint from m where callee <> '' group by 1""",
}
