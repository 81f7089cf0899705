"""Telemetry, usage, acknowledgement, benchmark and readiness rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.rollups import grouping_sets, index_percentile, pivot_counts, rate, window_filter, zero_filled
from lodestrata.sources import load_table

KINDS = ["click", "error", "purchase", "refund", "signup", "view"]


def _events(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "events")


def _graded(spark: SparkSession, d: str) -> DataFrame:
    grade = F.when(F.col("value") >= 60, "full").when(F.col("value") >= 20, "partial").otherwise("no")
    return _events(spark, d).withColumn("grade", grade).withColumn("family", F.get_json_object("props", "$.k").cast("int") % 3)


def telemetry_window_count(spark: SparkSession, d: str) -> DataFrame:
    rows = window_filter(_events(spark, d), ts__since="2024-01-05", ts__until="2024-01-20", event_type__in=["view", "click", "error"], user_id=None)
    return rows.agg(F.count("*").alias("events"), F.min("ts").cast("string").alias("first_ts"), F.count_distinct("user_id").alias("users"))


def telemetry_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return zero_filled(_events(spark, d).groupBy("event_type").agg(F.count("*").alias("events")), "event_type", KINDS, ["events"])


def telemetry_by_kind_family(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark, d).groupBy("event_type", "family", "grade").agg(F.count("*").alias("events"))


def telemetry_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return grouping_sets(_graded(spark, d), [[], ["event_type"], ["event_type", "family"], ["grade"]], {"events": "count(*)"})


def feedback_grade_pivot(spark: SparkSession, d: str) -> DataFrame:
    return pivot_counts(_graded(spark, d), ["event_type"], F.col("grade"), {"full_count": "full", "partial_count": "partial", "no_count": "no"})


def promotion_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Helpful, follow-up and low-noise rates, null where there is nothing to divide by."""
    g = _graded(spark, d).groupBy("user_id").agg(F.count("*").alias("eligible"), F.count_if(F.col("grade") == "full").alias("full_count"), F.count_if(F.col("grade") == "partial").alias("partial_count"), F.count_if(F.col("event_type") == "purchase").alias("followed"), F.count_if(F.col("event_type") == "error").alias("noisy"), F.count_if(F.col("event_type") == "click").alias("asked"))
    return g.select("user_id", "eligible", rate(F.col("full_count") + F.col("partial_count"), F.col("eligible")).alias("helpful_rate"), rate(F.col("followed"), F.col("asked")).alias("follow_up_rate"), rate(F.col("eligible") - F.col("noisy"), F.col("eligible")).alias("low_noise_rate"))


def ack_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Acknowledgements by category, with the distinct subjects; the null group is kept."""
    docs = load_table(spark, d, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("acks"), F.count_distinct(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("fingerprints"), F.count_if(F.col("lang").isNull()).alias("without_lang"), F.count_distinct("project_id").alias("projects"))


def ack_by_status(spark: SparkSession, d: str) -> DataFrame:
    s = load_table(spark, d, "harness_sessions").distinct()
    return grouping_sets(s, [["status"], ["tier"], ["project_id"]], {"sessions": "count(*)", "latest": "cast(max(updated_at) as string)"})


def usage_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Usage by two keys, each, and both, in one pass; amounts in whole micro units."""
    calls = load_table(spark, d, "lineitem").filter("l_returnflag <> 'R'").selectExpr("l_returnflag as provider", "l_linestatus as model", "cast(l_quantity as bigint) as tokens", "cast(round(l_extendedprice * (1 - l_discount) * 1000) as bigint) as cost", "l_shipdate")
    return grouping_sets(calls, [["provider"], ["model"], ["provider", "model"]], {"calls": "count(*)", "tokens": "sum(tokens)", "cost": "sum(cost)", "first_use": "cast(min(l_shipdate) as string)", "last_use": "cast(max(l_shipdate) as string)"})


def call_costs(spark: SparkSession, d: str) -> DataFrame:
    """Cost of calls from token counts and prices, null unless positive."""
    rows = load_table(spark, d, "lineitem")
    uncached = F.greatest(F.lit(0.0), F.col("l_quantity") - F.floor(F.col("l_quantity") * F.col("l_discount") * 5))
    cached = F.floor(F.col("l_quantity") * F.col("l_discount") * 5)
    cost = (uncached * 300 + cached * 30 + F.col("l_linenumber") * 1500).cast("long")  # whole micro units
    return rows.select("l_suppkey", F.when(cost > 0, cost).alias("cost")).groupBy("l_suppkey").agg(F.count("cost").alias("priced"), F.sum("cost").alias("cost"))


def rolling_cost(spark: SparkSession, d: str) -> DataFrame:
    """Cost since a cutoff, 0 where there is none."""
    line = load_table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")).filter("l_shipdate >= timestamp_ntz'1998-06-01 00:00:00'")
    orders = load_table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return orders.join(line, orders.o_orderkey == line.l_orderkey, "left").groupBy("o_orderpriority").agg(F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"), F.count("l_orderkey").alias("calls"))


def run_summary_fanout(spark: SparkSession, d: str) -> DataFrame:
    """Runs joined to cases and assertions: distinct counts undo the fan-out."""
    c = load_table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    o = load_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    li = load_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    rows = c.join(o, c.c_custkey == o.o_custkey, "left").join(li, o.o_orderkey == li.l_orderkey, "left")
    return rows.groupBy("c_mktsegment").agg(F.count_distinct("c_custkey").alias("suites"), F.count_distinct("o_orderkey").alias("cases"), F.count_distinct(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("failed_cases"), F.count("l_linenumber").alias("assertions"), F.count_if(F.col("l_returnflag") == "R").alias("failed_assertions"))


def eval_family_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Scores (pass 3, partial 2, miss 1, else 0) of a run against its baseline."""
    score = F.when(F.col("value") >= 60, 3).when(F.col("value") >= 30, 2).when(F.col("value") >= 10, 1).otherwise(0)
    e = _events(spark, d).withColumn("score", score)
    now = e.filter("ts >= timestamp_ntz'2024-01-16 00:00:00'").groupBy("user_id").agg(F.sum("score").alias("new_score"), F.count("*").alias("new_n"))
    old = e.filter("ts < timestamp_ntz'2024-01-16 00:00:00'").groupBy("user_id").agg(F.sum("score").alias("old_score"), F.count("*").alias("old_n"))
    verdict = F.when(F.col("old_score").isNull(), "new").when(F.col("new_score") > F.col("old_score"), "improved").when(F.col("new_score") < F.col("old_score"), "regressed").when(F.col("new_n") != F.col("old_n"), "drift").otherwise("unchanged")
    return now.join(old, "user_id", "left").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("families"), F.sum("new_score").alias("new_score"), F.coalesce(F.sum("old_score"), F.lit(0)).alias("old_score"))


def freshness_summary(spark: SparkSession, d: str) -> DataFrame:
    """Files by freshness state, with the overall state: dirty before unknown before fresh."""
    f = load_table(spark, d, "files")
    state = F.when(F.col("is_deleted") == 1, "deleted").when(F.col("indexed_at").isNull() | F.col("last_modified_at").isNull(), "unknown").when(F.col("last_modified_at") > F.col("indexed_at"), "dirty").otherwise("fresh")
    counts = f.select(state.alias("state"), "indexed_at").agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("fresh", "dirty", "unknown", "deleted")), F.max("indexed_at").cast("string").alias("latest"))
    return counts.withColumn("overall", F.when(F.col("dirty") > 0, "dirty").when(F.col("unknown") > 0, "unknown").otherwise("fresh"))


def freshness_sample(spark: SparkSession, d: str) -> DataFrame:
    """Twenty files, the ones that are not fresh first."""
    f = load_table(spark, d, "files").filter("is_deleted = 0")
    stale = F.coalesce(F.col("last_modified_at") > F.col("indexed_at"), F.lit(True))
    return f.select("path", stale.alias("stale")).orderBy(F.col("stale").desc(), "path").limit(20)


def freshness_policy(spark: SparkSession, d: str) -> DataFrame:
    """Of four policies, only the one that allows labelled stale items keeps them, and counts them."""
    f = load_table(spark, d, "files").filter("is_deleted = 0").select("file_id", F.coalesce(F.col("last_modified_at") <= F.col("indexed_at"), F.lit(False)).alias("fresh"))
    policies = spark.createDataFrame([("drop_stale",), ("require_fresh",), ("refresh_first",), ("allow_stale_labeled",)], "policy string")
    return f.agg(F.count_if("fresh").alias("fresh"), F.count_if(~F.col("fresh")).alias("stale")).join(F.broadcast(policies)).select("policy", (F.col("fresh") + F.when(F.col("policy") == "allow_stale_labeled", F.col("stale")).otherwise(0)).alias("kept"), F.when(F.col("policy") == "allow_stale_labeled", F.col("stale")).otherwise(0).alias("labeled"))


def readiness_report(spark: SparkSession, d: str) -> DataFrame:
    """One metric a row with target and status."""
    e, m = _events(spark, d), load_table(spark, d, "harness_messages")
    parts = [
        e.agg(F.lit("events").alias("metric"), F.count("*").cast("double").alias("value"), F.lit(5000.0).alias("target")),
        e.agg(F.lit("error_rate").alias("metric"), F.round(F.count_if(F.col("event_type") == "error") / F.count("*"), 4).alias("value"), F.lit(0.5).alias("target")),
        m.agg(F.lit("messages").alias("metric"), F.count_distinct("message_id").cast("double").alias("value"), F.lit(100000.0).alias("target")),
        load_table(spark, d, "symbols").agg(F.lit("symbols").alias("metric"), F.count_distinct("symbol_id").cast("double").alias("value"), F.lit(1000.0).alias("target")),
    ]
    status = F.when(F.col("value") >= F.col("target"), "ready").when(F.col("value") >= F.col("target") / 2, "collecting").otherwise("blocked")
    return reduce(DataFrame.unionByName, parts).withColumn("status", status)


def index_scan_stats(spark: SparkSession, d: str) -> DataFrame:
    names = ("files", "chunks", "symbols", "documents", "harness_messages", "harness_message_parts", "harness_embeddings")
    return reduce(DataFrame.unionByName, (load_table(spark, d, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("row_count")) for t in names))


def p95_latency(spark: SparkSession, d: str) -> DataFrame:
    return index_percentile(_events(spark, d), ["event_type"], "value", 0.95)


def symbol_name_lists(spark: SparkSession, d: str) -> DataFrame:
    """Names of each file's classes and interfaces, joined in order."""
    s = load_table(spark, d, "symbols").filter("kind in ('class', 'interface') and name is not null").select("file_id", "name").distinct()
    return s.groupBy("file_id").agg(F.expr("listagg(name, ' ') within group (order by name)").alias("names"))


def confidence_labels(spark: SparkSession, d: str) -> DataFrame:
    """Histogram over all labels, those without rows included."""
    s = load_table(spark, d, "symbols").distinct()
    label = F.when(F.col("line_start").isNull() & F.col("signature_text").isNull(), "unknown").when(F.col("line_start").isNull(), "inferred").when(F.col("signature_text").isNull(), "partial").when(F.col("export_name").isNotNull(), "verified").otherwise("observed")
    return zero_filled(s.groupBy(label.alias("label")).agg(F.count("*").alias("symbols")), "label", ["verified", "observed", "partial", "inferred", "stale", "conflicting", "unknown"], ["symbols"])


def tool_usage_counts(spark: SparkSession, d: str) -> DataFrame:
    """Calls and last use of each tool, and the ordinal a next call would get."""
    parts = load_table(spark, d, "harness_message_parts").filter("kind = 'tool_call'").select("part_id", "message_id", "ordinal", F.get_json_object("payload_json", "$.tool").alias("tool")).distinct()
    msgs = load_table(spark, d, "harness_messages").select("message_id", "created_at").distinct()
    return parts.join(msgs, "message_id", "left").groupBy("tool").agg(F.count_distinct("part_id").alias("calls"), F.max("created_at").cast("string").alias("last_used"), (F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).alias("next_ordinal"))


QUERIES = {f.__name__: f for f in (telemetry_window_count, telemetry_by_kind, telemetry_by_kind_family, telemetry_grouping_sets, feedback_grade_pivot, promotion_metrics, ack_rollup, ack_by_status, usage_rollup, call_costs, rolling_cost, run_summary_fanout, eval_family_deltas, freshness_summary, freshness_sample, freshness_policy, readiness_report, index_scan_stats, p95_latency, symbol_name_lists, confidence_labels, tool_usage_counts)}

_G = "(select *, case when value >= 60 then 'full' when value >= 20 then 'partial' else 'no' end as grade, cast(json_extract_string(props, '$.k') as int) % 3 as family from events)"
_STAMP = "rtrim(rtrim(strftime({0}, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.')"
ORACLES = {
    "telemetry_window_count": f"select count(*) as events, {_STAMP.format('min(ts)')} as first_ts, count(distinct user_id) as users from events where ts >= '2024-01-05' and ts <= '2024-01-20' and event_type in ('view', 'click', 'error')",
    "telemetry_by_kind": "select k as event_type, count(event_id) as events from (values ('click'), ('error'), ('purchase'), ('refund'), ('signup'), ('view')) v(k) left join events on event_type = k group by 1",
    "telemetry_by_kind_family": f"select event_type, family, grade, count(*) as events from {_G} group by all",
    "telemetry_grouping_sets": f"select case when grouping(event_type) = 1 and grouping(grade) = 1 then 0 when grouping(grade) = 0 then 3 when grouping(family) = 1 then 1 else 2 end as grouping, event_type, family, grade, count(*) as events from {_G} group by grouping sets ((), (event_type), (event_type, family), (grade))",
    "feedback_grade_pivot": f"select event_type, count(*) filter (grade = 'full') as full_count, count(*) filter (grade = 'partial') as partial_count, count(*) filter (grade = 'no') as no_count, count(*) as total from {_G} group by 1",
    "promotion_metrics": f"select user_id, count(*) as eligible, round(count(*) filter (grade <> 'no') / count(*), 4) as helpful_rate, round(count(*) filter (event_type = 'purchase') / nullif(count(*) filter (event_type = 'click'), 0), 4) as follow_up_rate, round(count(*) filter (event_type <> 'error') / count(*), 4) as low_noise_rate from {_G} group by 1",
    "ack_rollup": "select source, count(*) as acks, count(distinct sha256(coalesce(text, ''))) as fingerprints, count(*) filter (lang is null) as without_lang, count(distinct project_id) as projects from documents group by 1",
    "ack_by_status": f"select case when grouping(status) = 0 then 0 when grouping(tier) = 0 then 1 else 2 end as grouping, status, tier, project_id, count(*) as sessions, {_STAMP.format('max(updated_at)')} as latest from (select distinct * from harness_sessions) group by grouping sets ((status), (tier), (project_id))",
    "usage_rollup": f"select case when grouping(model) = 1 then 0 when grouping(provider) = 1 then 1 else 2 end as grouping, provider, model, count(*) as calls, cast(sum(tokens) as bigint) as tokens, cast(sum(cost) as bigint) as cost, {_STAMP.format('min(l_shipdate)')} as first_use, {_STAMP.format('max(l_shipdate)')} as last_use from (select l_returnflag as provider, l_linestatus as model, cast(l_quantity as bigint) as tokens, cast(round(l_extendedprice * (1 - l_discount) * 1000) as bigint) as cost, l_shipdate from lineitem where l_returnflag <> 'R') group by grouping sets ((provider), (model), (provider, model))",
    "call_costs": "with c as (select l_suppkey, cast(trunc(greatest(0, l_quantity - floor(l_quantity * l_discount * 5)) * 300 + floor(l_quantity * l_discount * 5) * 30 + l_linenumber * 1500) as bigint) as cost from lineitem) select l_suppkey, count(*) filter (cost > 0) as priced, cast(sum(cost) filter (cost > 0) as bigint) as cost from c group by 1",
    "rolling_cost": "select o_orderpriority, cast(coalesce(sum(cents), 0) as bigint) as cents, count(l_orderkey) as calls from orders left join (select l_orderkey, cast(round(l_extendedprice * 100) as bigint) as cents from lineitem where l_shipdate >= '1998-06-01') on o_orderkey = l_orderkey group by 1",
    "run_summary_fanout": "select c_mktsegment, count(distinct c_custkey) as suites, count(distinct o_orderkey) as cases, count(distinct o_orderkey) filter (o_orderstatus = 'F') as failed_cases, count(l_linenumber) as assertions, count(*) filter (l_returnflag = 'R') as failed_assertions from customer left join orders on c_custkey = o_custkey left join lineitem on o_orderkey = l_orderkey group by 1",
    "eval_family_deltas": """with e as (select *, case when value >= 60 then 3 when value >= 30 then 2 when value >= 10 then 1 else 0 end as score from events),
 n as (select user_id, sum(score) as ns, count(*) as nn from e where ts >= '2024-01-16' group by 1), o as (select user_id, sum(score) as os, count(*) as n_old from e where ts < '2024-01-16' group by 1)
 select case when os is null then 'new' when ns > os then 'improved' when ns < os then 'regressed' when nn <> n_old then 'drift' else 'unchanged' end as verdict, count(*) as families, cast(sum(ns) as bigint) as new_score, cast(coalesce(sum(os), 0) as bigint) as old_score from n left join o using (user_id) group by 1""",
    "freshness_summary": f"""with s as (select *, case when is_deleted = 1 then 'deleted' when indexed_at is null or last_modified_at is null then 'unknown' when last_modified_at > indexed_at then 'dirty' else 'fresh' end as state from files),
 c as (select count(*) filter (state = 'fresh') as fresh, count(*) filter (state = 'dirty') as dirty, count(*) filter (state = 'unknown') as unknown, count(*) filter (state = 'deleted') as deleted, {_STAMP.format('max(indexed_at)')} as latest from s)
 select *, case when dirty > 0 then 'dirty' when unknown > 0 then 'unknown' else 'fresh' end as overall from c""",
    "freshness_sample": "select path, coalesce(last_modified_at > indexed_at, true) as stale from files where is_deleted = 0 order by stale desc, path limit 20",
    "freshness_policy": "with c as (select count(*) filter (coalesce(last_modified_at <= indexed_at, false)) as fresh, count(*) filter (not coalesce(last_modified_at <= indexed_at, false)) as stale from files where is_deleted = 0) select p as policy, fresh + case when p = 'allow_stale_labeled' then stale else 0 end as kept, case when p = 'allow_stale_labeled' then stale else 0 end as labeled from c, (values ('drop_stale'), ('require_fresh'), ('refresh_first'), ('allow_stale_labeled')) v(p)",
    "readiness_report": """with m as (select 'events' as metric, cast(count(*) as double) as value, 5000.0::double as target from events union all select 'error_rate', round(count(*) filter (event_type = 'error') / count(*), 4), 0.5 from events
 union all select 'messages', count(distinct message_id), 100000.0 from harness_messages union all select 'symbols', count(distinct symbol_id), 1000.0 from symbols)
 select *, case when value >= target then 'ready' when value >= target / 2 then 'collecting' else 'blocked' end as status from m""",
    "index_scan_stats": " union all ".join(f"select '{t}' as table_name, count(*) as row_count from {t}" for t in ("files", "chunks", "symbols", "documents", "harness_messages", "harness_message_parts", "harness_embeddings")),
    "p95_latency": "with s as (select event_type, list_sort(list(value)) as v from events where value is not null group by 1) select event_type, v[least(len(v), cast(floor(len(v) * 0.95) as int) + 1)] as value, len(v) as n from s",
    "symbol_name_lists": "select file_id, string_agg(name, ' ' order by name) as names from (select distinct file_id, name from symbols where kind in ('class', 'interface') and name is not null) group by 1",
    "confidence_labels": """with s as (select case when line_start is null and signature_text is null then 'unknown' when line_start is null then 'inferred' when signature_text is null then 'partial' when export_name is not null then 'verified' else 'observed' end as label from (select distinct * from symbols))
 select v.label, count(s.label) as symbols from (values ('verified'), ('observed'), ('partial'), ('inferred'), ('stale'), ('conflicting'), ('unknown')) v(label) left join s using (label) group by 1""",
    "tool_usage_counts": f"""with p as (select distinct part_id, message_id, ordinal, json_extract_string(payload_json, '$.tool') as tool from harness_message_parts where kind = 'tool_call')
 select tool, count(distinct part_id) as calls, {_STAMP.format('max(created_at)')} as last_used, coalesce(max(ordinal), -1) + 1 as next_ordinal from p left join (select distinct message_id, created_at from harness_messages) using (message_id) group by 1""",
}
