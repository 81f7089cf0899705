"""Queries over histories of runs, answers and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import token_estimate
from lodestrata.operators.diff import keyed_diff, merge_versions
from lodestrata.operators.history import TRUST_RANK, budget_prefix, comparable_pairs, latest, retained_tail, skipping_budget, trend, trust_states
from lodestrata.operators.search import ranked
from lodestrata.sources import load_table


# The order of symbol kinds in a file, and the priority of any other kind.
KIND_PRIORITY = {"class": 100, "interface": 95, "type": 90, "function": 85, "method": 80, "arrow_function": 70, "enum": 65, "variable": 40, "property": 20}
OTHER_KIND = 10
BUDGET = 2500


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"), "o_orderdate", "o_orderpriority")


def _as_of(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "orders").agg(F.max("o_orderdate").alias("as_of"))


def latest_run_per_source(spark: SparkSession, d: str) -> DataFrame:
    e = load_table(spark, d, "events")
    return latest(e, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


def comparable_run_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = comparable_pairs(_orders(spark, d), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"])
    return pairs.select("o_custkey", "o_orderkey", "previous_o_orderkey", "o_orderstatus_changed", "o_orderpriority_changed")


def _trust(spark: SparkSession, d: str) -> DataFrame:
    # as_of is one row: the latest date of all runs
    rows = _orders(spark, d).join(F.broadcast(_as_of(spark, d)))
    return trust_states(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderdate", F.col("o_orderstatus") == F.col("nb_o_orderstatus"), (F.col("o_orderstatus") == "F") & (F.col("nb_o_orderstatus") == "O"), F.col("o_totalprice") >= 5000, F.col("as_of"))


def trust_state(spark: SparkSession, d: str) -> DataFrame:
    return _trust(spark, d).select("o_custkey", "o_orderkey", "position", "trust_state")


def trust_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _trust(spark, d).groupBy("trust_state", "o_orderstatus").agg(F.count("*").alias("runs"), F.count_distinct("o_custkey").alias("targets"))


def answer_surface_rank(spark: SparkSession, d: str) -> DataFrame:
    """Base rank by trust state, less 10 for a severe diagnostic; weak answers are set back."""
    base = F.create_map(*(F.lit(x) for kv in TRUST_RANK.items() for x in kv))
    penalty = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 10).otherwise(0)
    rows = _trust(spark, d).withColumn("answer_rank", base[F.col("trust_state")] - penalty)
    weak = F.col("trust_state").isin("stale", "contradicted", "insufficient") | ((F.col("trust_state") == "aging") & (penalty > 0))
    return rows.groupBy("answer_rank", weak.alias("deemphasised")).agg(F.count("*").alias("answers"))


def health_trend(spark: SparkSession, d: str) -> DataFrame:
    return trend(_orders(spark, d), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") != "F")


def issue_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Priority, 25 for follow-ups, less the recency index within the latest 200 runs."""
    newest = ranked(_orders(spark, d), F.col("o_orderdate").desc(), F.col("o_orderkey"), limit=200, name="recency")
    priority = F.when(F.col("o_orderpriority") == "1-URGENT", 700).when(F.col("o_orderpriority") == "2-HIGH", 600).when(F.col("o_orderpriority") == "3-MEDIUM", 520).otherwise(420)
    scored = newest.withColumn("score", priority + F.when(F.col("o_orderstatus") == "O", 25).otherwise(0) - (F.col("recency") - 1))
    return ranked(scored, F.col("score").desc(), F.col("o_orderkey"), limit=40).select("o_orderkey", "score", "rank", (F.col("rank") == 1).alias("current_focus"))


def context_budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    docs = load_table(spark, d, "documents").filter("source is not null").select("source", "doc_id", F.greatest(F.lit(1).cast("long"), token_estimate(F.col("text"))).alias("cost"), F.length(F.coalesce("text", F.lit(""))).alias("score"))
    # each item costs 1 at least, so that no more of a source than the budget can fit
    top = ranked(docs, F.col("score").desc(), F.col("doc_id"), within=["source"], limit=BUDGET, name="place")
    return budget_prefix(top, ["source"], [F.col("score").desc(), F.col("doc_id")], "cost", BUDGET).select("source", "doc_id", "cost", "running_cost")


def repo_map_budget(spark: SparkSession, d: str) -> DataFrame:
    """Ranked symbols of the largest files packed into a budget, with headers as the fall-back."""
    s = load_table(spark, d, "symbols").filter("line_start is not null").select("symbol_id", "file_id", "kind", "export_name", "line_start", F.coalesce("signature_text", F.lit("")).alias("sig")).distinct()
    kind = F.when(F.col("kind") == "class", 0).when(F.col("kind") == "interface", 1).when(F.col("kind") == "function", 2).otherwise(3)
    top = ranked(s, F.col("export_name").isNull(), kind, F.col("line_start"), F.col("symbol_id"), within=["file_id"], limit=12)
    out = skipping_budget(top.select("file_id", "rank", (F.length("sig") + 20).alias("cost"), F.lit(15).alias("header")), ["file_id"], "rank", "cost", "header", 200)
    return out.select("file_id", F.size("full").alias("full_items"), F.size("headers").alias("header_items"), "used")


def session_tail_compaction(spark: SparkSession, d: str) -> DataFrame:
    m = load_table(spark, d, "harness_messages").filter("session_id is not null").select("session_id", "message_id", "ordinal", "role").distinct().withColumn("tokens", token_estimate(F.concat_ws(" ", "message_id", "role")))
    tail = retained_tail(m, ["session_id"], ["ordinal", "message_id"], "tokens", 400)
    return tail.groupBy("session_id").agg(F.count_if("archive").alias("archived"), F.count("*").alias("messages"), F.max("total_tokens").alias("tokens"))


def symbol_topk_per_file(spark: SparkSession, d: str) -> DataFrame:
    """Exported symbols first, then by the priority of their kind and their line."""
    s = load_table(spark, d, "symbols").select("symbol_id", "file_id", "kind", "export_name", "line_start").distinct()
    priority = F.coalesce(F.create_map(*(F.lit(x) for kv in KIND_PRIORITY.items() for x in kv))[F.coalesce("kind", F.lit("?"))], F.lit(OTHER_KIND))
    return ranked(s, F.col("export_name").isNull(), priority.desc(), F.col("line_start").asc_nulls_last(), F.col("symbol_id"), within=["file_id"], limit=3).select("file_id", "symbol_id", "rank")


def as_of_verification(spark: SparkSession, d: str) -> DataFrame:
    """Of each user and source, whether the last success covers the last change."""
    e = load_table(spark, d, "events")
    runs = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("verified_at"), F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("changed_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))
    state = F.when(F.col("last_type") == "error", "failed").when(F.col("verified_at").isNull(), "unknown").when(F.col("changed_at") > F.col("verified_at"), "stale").otherwise("fresh")
    return runs.select("user_id", state.alias("state"))


def verification_overall(spark: SparkSession, d: str) -> DataFrame:
    counts = as_of_verification(spark, d).agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("failed", "stale", "unknown", "fresh")))
    return counts.withColumn("overall", F.when(F.col("failed") > 0, "failed").when(F.col("stale") > 0, "stale").when(F.col("unknown") > 0, "unknown").otherwise("fresh"))


def _overlay(spark: SparkSession, d: str, committed: bool) -> DataFrame:
    """Two overlays of the file index: what was indexed, and the working tree after its last changes."""
    f = load_table(spark, d, "files").select("path", "language", "sha256", "is_deleted", "indexed_at", "last_modified_at")
    if committed:
        return f.filter(F.coalesce(F.col("indexed_at") >= F.lit("2025-02-01").cast("timestamp_ntz"), F.lit(True))).select("path", "language", "sha256")
    newer = F.coalesce(F.col("last_modified_at") > F.col("indexed_at"), F.lit(False))
    return f.filter("is_deleted = 0").select("path", F.when(newer, F.lit(None).cast("string")).otherwise(F.col("language")).alias("language"), F.when(F.col("last_modified_at") >= F.lit("2025-05-01").cast("timestamp_ntz"), F.concat("sha256", F.lit("x"))).otherwise(F.col("sha256")).alias("sha256"))


def overlay_diff(spark: SparkSession, d: str) -> DataFrame:
    return keyed_diff(_overlay(spark, d, True), _overlay(spark, d, False), ["path"], ["language", "sha256"])


def overlay_diff_summary(spark: SparkSession, d: str) -> DataFrame:
    return overlay_diff(spark, d).groupBy("status", "changed_columns").agg(F.count("*").alias("paths"))


def schema_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two descriptions of each file's symbols merged field by field."""
    s = load_table(spark, d, "symbols").filter("name is not null").select("file_id", "kind", "name").distinct()
    def side(kinds):  # noqa: ANN001
        return s.filter(F.col("kind").isin(*kinds)).groupBy("file_id").agg(F.min("name").alias("first_name"), F.max("name").alias("last_name"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    m = merge_versions(side(["function", "class"]), side(["method", "class", "interface"]), ["file_id"], ["first_name"], ["last_name"], ["kinds"])
    return m.select("file_id", "first_name", "last_name", F.array_join("kinds", ",").alias("kinds"))


def evidence_set_diff(spark: SparkSession, d: str) -> DataFrame:
    """Tools that a session used in its first and second half: kept, dropped and new."""
    p = load_table(spark, d, "harness_message_parts").filter("kind = 'tool_call'").select("message_id", F.get_json_object("payload_json", "$.tool").alias("tool")).distinct()
    m = load_table(spark, d, "harness_messages").filter("session_id is not null").select("session_id", "message_id", "ordinal").distinct()
    rows = p.join(m, "message_id").withColumn("half", (F.col("ordinal") >= 10).cast("int"))
    sets = rows.groupBy("session_id").agg(F.collect_set(F.when(F.col("half") == 0, F.col("tool"))).alias("a"), F.collect_set(F.when(F.col("half") == 1, F.col("tool"))).alias("b"))
    join = lambda c: F.array_join(F.array_sort(c), ",")
    return sets.select("session_id", join(F.array_intersect("a", "b")).alias("kept"), join(F.array_except("a", "b")).alias("dropped"), join(F.array_except("b", "a")).alias("added"))


def layout_order(spark: SparkSession, d: str) -> DataFrame:
    """Items by layout zone (start, middle, end), stable within a zone."""
    n = load_table(spark, d, "nation")
    zone = F.when(F.col("n_regionkey") == 2, "start").when(F.col("n_regionkey") == 4, "end").otherwise("middle")
    rows = n.select("n_name", "n_nationkey", zone.alias("zone"))
    # places go on from zone to zone: three counts instead of one global sort
    counts = rows.agg(*(F.count_if(F.col("zone") == z).alias(z) for z in ("start", "middle")))
    before = F.when(F.col("zone") == "start", 0).when(F.col("zone") == "middle", F.col("start")).otherwise(F.col("start") + F.col("middle"))
    within = ranked(rows, F.col("n_nationkey"), within=["zone"], name="nth").join(F.broadcast(counts))
    return within.select("n_name", "zone", (F.col("nth") + before).cast("int").alias("place"))


def page_with_total(spark: SparkSession, d: str) -> DataFrame:
    """A page of the matching rows beside their number."""
    rows = load_table(spark, d, "harness_sessions").distinct().filter("status = 'error'").select("session_id", "created_at")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.col("created_at").desc_nulls_last(), "session_id").limit(20).join(F.broadcast(total)).select("session_id", "total", (F.col("total") > 20).alias("truncated"))


QUERIES = {f.__name__: f for f in (latest_run_per_source, comparable_run_pairs, trust_state, trust_clusters, answer_surface_rank, health_trend, issue_ranking, context_budget_prefix, repo_map_budget, session_tail_compaction, symbol_topk_per_file, as_of_verification, verification_overall, overlay_diff, overlay_diff_summary, schema_merge, evidence_set_diff, layout_order, page_with_total)}

_O = "o as (select o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) as price, o_orderdate, o_orderpriority, (select max(o_orderdate) from orders) as as_of from orders)"
_T = f"""with {_O}, w as (select *, row_number() over x - 1 as position, lead(o_orderstatus) over x as older_status, lag(o_orderstatus) over x as newer_status from o window x as (partition by o_custkey order by o_orderdate desc, o_orderkey desc)),
 t as (select *, case when position > 0 then case when o_orderstatus = 'F' and newer_status = 'O' then 'contradicted' else 'superseded' end when price < 5000 then 'insufficient' when date_diff('day', o_orderdate, as_of) >= 90 then 'stale' when date_diff('day', o_orderdate, as_of) >= 30 then 'aging' when older_status is not null and older_status <> o_orderstatus then 'changed' else 'stable' end as trust_state from w)"""
_OVER = """a as (select path, language, sha256 from files where coalesce(indexed_at >= '2025-02-01', true)),
 b as (select path, case when coalesce(last_modified_at > indexed_at, false) then null else language end as language, case when last_modified_at >= '2025-05-01' then sha256 || 'x' else sha256 end as sha256 from files where is_deleted = 0),
 j as (select coalesce(a.path, b.path) as path, a.path is not null as l, b.path is not null as r, a.language is distinct from b.language as lc, a.sha256 is distinct from b.sha256 as sc from a full join b on a.path = b.path),
 diff as (select path, case when not l then 'only_right' when not r then 'only_left' when lc or sc then 'changed' else 'same' end as status, case when l and r then concat_ws(',', case when lc then 'language' end, case when sc then 'sha256' end) else '' end as changed_columns from j)"""
_VERIFY = """v as (select user_id, max(ts) filter (event_type = 'purchase') as vt, max(ts) filter (event_type = 'signup') as ct, arg_max(event_type, (ts, event_id)) as last from events group by 1),
 s as (select user_id, case when last = 'error' then 'failed' when vt is null then 'unknown' when ct > vt then 'stale' else 'fresh' end as state from v)"""
ORACLES = {
    "repo_map_budget": """with recursive s as (select distinct symbol_id, file_id, kind, export_name, line_start, coalesce(signature_text, '') as sig from symbols where line_start is not null),
 r as (select file_id, length(sig) + 20 as c, row_number() over (partition by file_id order by export_name is null, case kind when 'class' then 0 when 'interface' then 1 when 'function' then 2 else 3 end, line_start, symbol_id) as rk from s qualify rk <= 12),
 w as (select distinct file_id, 0::bigint as rk, 0::bigint as used, 0 as f, 0 as h from r
 union all select w.file_id, r.rk, w.used + case when r.c <= 200 - w.used then r.c when 15 <= 200 - w.used then 15 else 0 end, w.f + case when r.c <= 200 - w.used then 1 else 0 end, w.h + case when r.c > 200 - w.used and 15 <= 200 - w.used then 1 else 0 end from w join r on r.file_id = w.file_id and r.rk = w.rk + 1)
 select file_id, f as full_items, h as header_items, used from w qualify row_number() over (partition by file_id order by rk desc) = 1""",
    "latest_run_per_source": "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) where rn = 1",
    "comparable_run_pairs": "with p as (select *, lag(o_orderkey) over w as prev, lag(o_orderstatus) over w as ps, lag(o_orderpriority) over w as pp from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)) select o_custkey, o_orderkey, prev as previous_o_orderkey, o_orderstatus is distinct from ps as o_orderstatus_changed, o_orderpriority is distinct from pp as o_orderpriority_changed from p where prev is not null",
    "trust_state": f"{_T} select o_custkey, o_orderkey, cast(position as integer) as position, trust_state from t",
    "trust_clusters": f"{_T} select trust_state, o_orderstatus, count(*) as runs, count(distinct o_custkey) as targets from t group by 1, 2",
    "answer_surface_rank": f"{_T}, p as (select *, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 10 else 0 end as pen from t) select case trust_state when 'stable' then 100 when 'changed' then 90 when 'aging' then 80 when 'stale' then 60 when 'superseded' then 50 when 'insufficient' then 40 else 20 end - pen as answer_rank, trust_state in ('stale', 'contradicted', 'insufficient') or (trust_state = 'aging' and pen > 0) as deemphasised, count(*) as answers from p group by 1, 2",
    "health_trend": """with r as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders), n as (select *, count(*) over (partition by o_custkey) as n from r where rn <= 8),
 h as (select o_custkey, max(n) as runs, round(avg(cast(o_orderstatus <> 'F' as int)) filter (rn <= ceil(n / 2.0)), 4) as recent_rate, round(avg(cast(o_orderstatus <> 'F' as int)) filter (rn > ceil(n / 2.0)), 4) as prior_rate from n group by 1)
 select *, case when runs < 4 then 'unknown' when recent_rate > prior_rate then 'improving' when recent_rate < prior_rate then 'declining' else 'steady' end as direction from h""",
    "issue_ranking": """with n as (select *, row_number() over (order by o_orderdate desc, o_orderkey) as recency from orders qualify recency <= 200),
 s as (select o_orderkey, case o_orderpriority when '1-URGENT' then 700 when '2-HIGH' then 600 when '3-MEDIUM' then 520 else 420 end + case when o_orderstatus = 'O' then 25 else 0 end - (recency - 1) as score from n)
 select o_orderkey, cast(score as integer) as score, cast(row_number() over (order by score desc, o_orderkey) as integer) as rank, row_number() over (order by score desc, o_orderkey) = 1 as current_focus from s qualify rank <= 40""",
    "context_budget_prefix": """with t as (select source, doc_id, greatest(1, cast(ceil(length(coalesce(text, '')) / 4.0) as bigint)) as cost, length(coalesce(text, '')) as score from documents where source is not null), p as (select *, row_number() over (partition by source order by score desc, doc_id) as rn from t),
 c as (select *, sum(cost) over (partition by source order by rn) as running_cost from p) select source, doc_id, cost, cast(running_cost as bigint) as running_cost from c where rn = 1 or running_cost <= 2500""",
    "session_tail_compaction": """with m as (select distinct session_id, message_id, ordinal, role from harness_messages where session_id is not null), t as (select *, ceil(length(concat_ws(' ', message_id, role)) / 4.0) as tok from m),
 w as (select *, sum(tok) over (partition by session_id) as total, row_number() over (partition by session_id order by ordinal desc, message_id desc) as rn from t)
 select session_id, count(*) filter (total >= 240 and rn > 4) as archived, count(*) as messages, cast(max(total) as bigint) as tokens from w group by 1""",
    "symbol_topk_per_file": "with s as (select distinct symbol_id, file_id, kind, export_name, line_start from symbols) select file_id, symbol_id, cast(row_number() over (partition by file_id order by export_name is null, case kind when 'class' then 100 when 'interface' then 95 when 'type' then 90 when 'function' then 85 when 'method' then 80 when 'variable' then 40 else 10 end desc, line_start nulls last, symbol_id) as integer) as rank from s qualify rank <= 3",
    "as_of_verification": f"with {_VERIFY} select * from s",
    "verification_overall": f"with {_VERIFY}, c as (select count(*) filter (state = 'failed') as failed, count(*) filter (state = 'stale') as stale, count(*) filter (state = 'unknown') as unknown, count(*) filter (state = 'fresh') as fresh from s) select *, case when failed > 0 then 'failed' when stale > 0 then 'stale' when unknown > 0 then 'unknown' else 'fresh' end as overall from c",
    "overlay_diff": f"with {_OVER} select *, case status when 'changed' then 0 when 'only_right' then 1 when 'only_left' then 2 else 3 end as display_order from diff",
    "overlay_diff_summary": f"with {_OVER} select status, changed_columns, count(*) as paths from diff group by 1, 2",
    "schema_merge": """with s as (select distinct file_id, kind, name from symbols where name is not null), e as (select file_id, min(name) as f, max(name) as l from s where kind in ('function', 'class') group by 1), i as (select file_id, min(name) as f, max(name) as l from s where kind in ('method', 'class', 'interface') group by 1),
 k as (select file_id, string_agg(distinct kind, ',' order by kind) as kinds from s where kind in ('function', 'class', 'method', 'interface') group by 1)
 select file_id, coalesce(e.f, i.f) as first_name, coalesce(i.l, e.l) as last_name, kinds from e full join i using (file_id) join k using (file_id)""",
    "evidence_set_diff": """with r as (select distinct session_id, tool, ordinal >= 10 as late from (select distinct message_id, json_extract_string(payload_json, '$.tool') as tool from harness_message_parts where kind = 'tool_call') join (select distinct session_id, message_id, ordinal from harness_messages where session_id is not null) using (message_id)),
 g as (select session_id, tool, bool_or(not late) as a, bool_or(late) as b from r group by 1, 2)
 select session_id, coalesce(string_agg(tool, ',' order by tool) filter (a and b), '') as kept, coalesce(string_agg(tool, ',' order by tool) filter (a and not b), '') as dropped, coalesce(string_agg(tool, ',' order by tool) filter (b and not a), '') as added from g group by 1""",
    "layout_order": "with z as (select n_name, n_nationkey, case n_regionkey when 2 then 'start' when 4 then 'end' else 'middle' end as zone from nation) select n_name, zone, cast(row_number() over (order by case zone when 'start' then 0 when 'middle' then 1 else 2 end, n_nationkey) as integer) as place from z",
    "page_with_total": "with r as (select distinct session_id, created_at, status, updated_at, title, tier, project_id, parent_id, active_provider, active_model, fallback_chain_json, harness_version from harness_sessions where status = 'error') select session_id, (select count(*) from r) as total, (select count(*) from r) > 20 as truncated from r order by created_at desc nulls last, session_id limit 20",
}
