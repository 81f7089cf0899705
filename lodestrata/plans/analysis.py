"""Schema snapshots, database edges, guard checks and context packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.keys import fingerprint
from lodestrata.functions.text import contains_ci, token_estimate
from lodestrata.operators import context, graph, guards, schema
from lodestrata.operators.facts import lifecycle
from lodestrata.operators.history import budget_prefix
from lodestrata.operators.search import ranked
from lodestrata.operators.text_index import index_bm25
from lodestrata.plans import codebase, lexical, router
from lodestrata.plans.findings import _FIND, _FP
from lodestrata.runtime import stored_table
from lodestrata.sources import load_table, table_path

ROUTES = ("**/routes/*.ts", "**/routes/*.tsx", "**/api/src/*.ts", "**/api/src/*.tsx")
PUBLIC = ("**/routes/read-*.ts",)
CUT = "2025-04-01 00:00:00"
BUDGET = 1500


def _inputs(d: str) -> list[str]:
    return [table_path(d, "chunks"), table_path(d, "files")]


def _ir(spark: SparkSession, d: str) -> DataFrame:
    return stored_table(spark, "schema-ir", _inputs(d), lambda: schema.schema_ir(codebase._sql_texts(spark, d)))


def schema_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The schema that all SQL texts state together, by kind of fact."""
    return _ir(spark, d).groupBy("kind").agg(F.count("*").alias("facts"), F.count_distinct("name").alias("names"), F.min("name").alias("first_name"))


def schema_snapshot_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return schema.schema_fingerprint(_ir(spark, d))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return stored_table(spark, "database-edges", _inputs(d), lambda: schema.database_edges(codebase._sql_texts(spark, d), codebase._texts(spark, d)))


def database_edge_counts(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy("kind", "exact").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


def rpc_neighbourhoods(spark: SparkSession, d: str) -> DataFrame:
    """Callers, tables and policies around each function of the database."""
    return schema.rpc_neighbourhood(_edges(spark, d))


def flow_map(spark: SparkSession, d: str) -> DataFrame:
    """The way from a module over what it defines to a table, step by step, with the kind of each node and where the kind changes."""
    space = F.element_at(F.split("path", "/"), 1)
    own = F.concat(F.lit("module:"), F.concat_ws("/", space, F.regexp_extract("path", r"([a-z]+)(?:\.[a-z]+)+$", 1)))
    home = codebase.corpus.schema_objects(codebase._sql_texts(spark, d), ["path"]).filter("object_type = 'function'").select(own.alias("src"), F.concat(F.lit("function:"), "name").alias("dst"))
    touches = _edges(spark, d).filter("kind = 'touches'").select(F.concat(F.lit("function:"), "src").alias("src"), F.concat(F.lit("table:"), "dst").alias("dst"))
    imports = codebase.module_edges(spark, d).select(F.concat(F.lit("module:"), "src").alias("src"), F.concat(F.lit("module:"), "dst").alias("dst"))
    # the ends of the question: two names come to the driver
    start = home.join(touches.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").agg(F.min("src")).first()[0]
    target = touches.join(home.filter(F.col("src") == F.lit(start)).select(F.col("dst").alias("src")), "src", "left_semi").agg(F.max("dst")).first()[0]
    path = graph.shortest_path(home.unionByName(touches).unionByName(imports), start or "", target or "", 6)
    steps = path.select(F.posexplode(F.split("path", ">")).alias("step", "node")).filter("node <> ''").withColumn("kind", F.element_at(F.split("node", ":"), 1))
    before = steps.select((F.col("step") + 1).alias("step"), F.col("kind").alias("from_kind"))
    return steps.join(before, "step", "left").select("step", "node", "kind", F.coalesce(F.col("kind") != F.col("from_kind"), F.lit(False)).alias("boundary"))


def _guarded(spark: SparkSession, d: str) -> DataFrame:
    found = lambda: guards.as_findings(guards.guard_findings(codebase._texts(spark, d), route_globs=ROUTES, public_globs=PUBLIC))
    return stored_table(spark, "guard-findings", _inputs(d), found)


def guard_checks(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the checks before a commit by code."""
    return _guarded(spark, d).groupBy("code", "severity").agg(F.count("*").alias("findings"), F.min("path").alias("first_path"))


def _stale_usages(spark: SparkSession, d: str) -> DataFrame:
    """Files that name a table which was changed after the file was indexed."""
    objects = codebase.corpus.schema_objects(codebase._sql_texts(spark, d), ["path"]).filter("object_type = 'table'").groupBy("name").agg(F.min("path").alias("home")).withColumn("bare", F.regexp_replace("name", r"^\w+\.", ""))
    used = codebase.corpus.usages(codebase._texts(spark, d), objects.select("name", "bare"), ["path"]).join(objects.select("name", "home"), "name").filter("path <> home")
    f = load_table(spark, d, "files")
    late = used.join(f.select("path", "indexed_at"), "path").join(f.select(F.col("path").alias("home"), F.col("last_modified_at").alias("changed_at")), "home").filter("changed_at > indexed_at")
    code = F.lit("schema.stale_usage")
    return late.select(fingerprint(code, F.col("path"), F.col("name")).alias("fingerprint"), "path", code.alias("code")).distinct()


def programmatic_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Guard findings and stale usages of the source files merged into what an earlier refresh left, with a row for the run."""
    produced = _guarded(spark, d).select("fingerprint", "path", "code").unionByName(_stale_usages(spark, d))
    f = load_table(spark, d, "files").filter("is_deleted = 0")
    scope = f.filter(F.col("path").rlike(r"\.(?:tsx?|sql)$")).select("path")
    old = f.filter(F.col("last_modified_at") < F.lit(CUT).cast("timestamp_ntz")).select("path")
    gone = old.select(fingerprint(F.lit(guards.RULES[2]), F.col("path"), F.lit("useState")).alias("fingerprint"), "path")
    prior = produced.join(old, "path", "left_semi").select("fingerprint", "path").unionByName(gone).withColumn("status", F.lit("active"))
    after = lifecycle(prior, produced.join(scope, "path", "left_semi"), scope, "fingerprint", "path")
    events = after.groupBy(F.coalesce("event", F.lit("kept")).alias("event"), "status").agg(F.count("*").alias("findings"))
    run = scope.agg(F.lit("run").alias("event"), F.lit("succeeded").alias("status"), F.count("*").alias("findings"))
    return events.unionByName(run)


def run_cache_states(spark: SparkSession, d: str) -> DataFrame:
    """Whether the last run of each user and type may still be used, half an hour after it ended."""
    e = load_table(spark, d, "events")
    last = e.groupBy("user_id", "event_type").agg(F.max("ts").alias("finished_at"))
    now = e.agg(F.max("ts").alias("now"))
    return last.join(F.broadcast(now)).groupBy(guards.run_cache(F.col("finished_at"), F.col("now")).alias("state")).agg(F.count("*").alias("runs"))


def risk_rules(spark: SparkSession, d: str) -> DataFrame:
    """Risks of what users ask, with TypeScript files as the selected context."""
    found = router._questions(spark, d).select("part_id", F.explode(context.detected_risks(F.col("text"), F.array(F.lit("ts"), F.lit("tsx")))).alias("r"))
    return found.groupBy("r.code", "r.severity", "r.confidence").agg(F.count("*").alias("questions"), F.min("part_id").alias("first_part"))


def _routes(spark: SparkSession, d: str) -> DataFrame:
    return codebase.corpus.routes(load_table(spark, d, "files").filter("is_deleted = 0"), codebase._texts(spark, d))


def route_search(spark: SparkSession, d: str) -> DataFrame:
    """Routes ranked for a path that need not be whole."""
    return context.route_scores(_routes(spark, d), "/match-lease").orderBy(F.col("score").desc(), "pattern", "route_key").limit(20).select("route_key", "pattern", "score")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    f = load_table(spark, d, "files").filter("is_deleted = 0")
    fixed = lambda df, name, key, score: df.select(F.lit(name).alias("provider"), key.alias("key"), F.lit(score).alias("score"), token_estimate(key).alias("cost"))
    symbols = load_table(spark, d, "symbols").select("file_id", "name").distinct().join(f.select("file_id", "path"), "file_id")
    objects = _ir(spark, d).filter("kind in ('table', 'function')").select("name").distinct()
    texts = index_bm25(spark, lexical.content_index(spark, d), ["overlay"], "file_id").join(f.select("file_id", "path"), "file_id")
    open_ = _guarded(spark, d).select("path").distinct()
    changed = f.filter("last_modified_at > indexed_at")
    return context.candidates(
        fixed(f.filter(contains_ci(F.col("path"), "overlay")), "paths", F.col("path"), 70.0),
        fixed(symbols.filter(contains_ci(F.col("name"), "overlay")), "symbols", F.concat_ws("#", "path", "name"), 60.0),
        fixed(context.route_scores(_routes(spark, d), "overlay"), "routes", F.col("route_key"), 65.0),
        fixed(objects.filter(contains_ci(F.col("name"), "overlay")), "schema", F.col("name"), 55.0),
        texts.select(F.lit("texts").alias("provider"), F.col("path").alias("key"), F.round(30 + F.col("score"), 4).alias("score"), token_estimate(F.col("path")).alias("cost")),
        fixed(open_.filter(contains_ci(F.col("path"), "overlay")), "findings", F.col("path"), 75.0),
        fixed(changed.filter(contains_ci(F.col("path"), "overlay")), "changes", F.col("path"), 72.0),
    )


def context_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What seven providers offer for a word, each thing once by its best score."""
    return _candidates(spark, d).groupBy("provider").agg(F.count("*").alias("candidates"), F.min("key").alias("first_key"), F.max("score").alias("best"))


def context_packet(spark: SparkSession, d: str) -> DataFrame:
    """The best candidates that fit into a budget of tokens."""
    paid = _candidates(spark, d).withColumn("cost", F.greatest(F.lit(1).cast("long"), "cost")).withColumn("packet", F.lit(1))
    # each costs 1 at least: no more than the budget can fit
    top = ranked(paid, F.col("score").desc(), F.col("key"), limit=BUDGET, name="place")
    return budget_prefix(top, ["packet"], [F.col("score").desc(), F.col("key")], "cost", BUDGET).select("key", "provider", "score", "running_cost")


QUERIES = {f.__name__: f for f in (schema_snapshot, schema_snapshot_fingerprint, database_edge_counts, rpc_neighbourhoods, flow_map, guard_checks, programmatic_refresh, run_cache_states, risk_rules, route_search, context_candidates, context_packet)}

_C = codebase
_BARE = r"regexp_replace(regexp_replace(content, '(?s)/\*.*?\*/', ' ', 'g'), '--[^\n]*', ' ', 'g')"
_IR = rf"""pks as (select lower(regexp_extract(t, '(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.]+)', 1)) as name, lower(trim(unnest(regexp_extract_all(t, '(?i)[(,]\s*(\w+)\s[^,()]*?\bprimary\s+key\b', 1)))) as member
 from (select unnest(regexp_extract_all({_BARE}, '(?i)(create\s+table\s+(?:if\s+not\s+exists\s+)?[\w.]+\s*\([^;]*\))\s*;', 1)) as t from sqlt)),
 ir as (select object_type as kind, name, '' as member, '' as detail from objs union select 'column', table_name, column_name, data_type from cols union select 'primary_key', name, member, '' from pks)"""
_BASE = f"{_C._TEXTS}, {_C._SQLT}, {_C._OBJ}, {_C._COLS}, {_C._FREF}"
_EDGES = rf"""fn as (select name, regexp_replace(name, '^\w+\.', '') as bare from objs where object_type = 'function' group by 1), homes as (select distinct name, path from objs where object_type = 'function'),
 words as (select path, unnest(list_distinct(regexp_extract_all(lower(content), '[a-z_][a-z0-9_]*'))) as bare from texts),
 edges as (select path as src, name as dst, 'calls_rpc' as kind, false as exact from words join fn using (bare) where not exists (select 1 from homes h where h.name = fn.name and h.path = words.path) union select function_name, table_name, 'touches', false from refs)"""
_GLOB = r"(?:^(?:.*/)?routes/[^/]*\.tsx?$|^(?:.*/)?api/src/[^/]*\.tsx?$)"
_GUARD = rf"""guard as (select path, 'git.unprotected_route' as code, 'guards checked: auth.getUser, withAuth' as evidence from texts where regexp_matches(path, '{_GLOB}') and not regexp_matches(path, '^(?:.*/)?routes/read-[^/]*\.ts$') and not regexp_matches({_BARE.replace("'--[^\n]*', ' ', 'g'", "'(?m)^[ \\t]*//[^\\n]*$', '', 'g'")}, '(?:withAuth|auth\.getUser)\s*\('))"""
_RISK = " union all ".join(
    f"select part_id, '{code}' as code, '{severity}' as severity, round(least(0.92, 0.44 + case when m then 0.18 else 0 end + least(n, 3) * 0.1), 2)::double as confidence from (select part_id, "
    + " + ".join(f"cast(contains(low, '{t}') as integer)" for t in triggers)
    + " as n, ("
    + " or ".join(f"regexp_matches(' ' || low || ' ', '[^a-z0-9_](?:{'|'.join(context.FAMILY_WORDS[i])})[^a-z0-9_]')" for i in intents)
    + ") as m from l) where (m or n > 0)"
    for code, (triggers, intents, severity, files) in context.RISK_RULES.items()
    if not files or {"ts", "tsx"} & set(files)
)
_CAND = f"""live as (select * from files where is_deleted = 0), tok as (select file_id, content from chunks where chunk_kind = 'file'), {lexical._bm25_sql('tok', 'file_id', 'content', ['overlay'])},
 cand0 as (select 'paths' as provider, path as key, 70.0::double as score from live where contains(lower(path), 'overlay')
 union all select distinct 'symbols', path || '#' || name, 60.0 from symbols join live using (file_id) where contains(lower(name), 'overlay')
 union all select 'routes', route_key, 65.0 from routes where contains(lower(route_key || ' ' || framework || ' ' || path), 'overlay')
 union all select distinct 'schema', name, 55.0 from ir where kind in ('table', 'function') and contains(lower(name), 'overlay')
 union all select 'texts', path, round(30 + score, 4) from bm join live on k = file_id
 union all select distinct 'findings', path, 75.0 from guard where contains(lower(path), 'overlay')
 union all select 'changes', path, 72.0 from live where last_modified_at > indexed_at and contains(lower(path), 'overlay')),
 cand as (select *, greatest(1, cast(ceil(length(key) / 4.0) as bigint)) as cost from cand0 qualify row_number() over (partition by key order by score desc, provider) = 1)"""
_ALL = f"with {_BASE}, {_C._ROUTES}, {_IR}, {_GUARD}, {_CAND}"
ORACLES = {
    "diff_impact_findings": rf"""with recursive {_FIND}, {_C._IMP}, {_C._MOD}, ch as (select distinct split_part(path, '/', 1) || '/' || regexp_extract(path, '([a-z]+)(?:\.[a-z]+)+$', 1) as node from files where last_modified_at > indexed_at and is_deleted = 0 and path like '%.sql'),
 {_C._walk_sql('select node from ch', 'select dst as src, src as dst from mods', 2)}, a as (select split_part(path, '/', 1) || '/' || regexp_extract(path, '([a-z]+)(?:\.[a-z]+)+$', 1) as node, count(*) as n, count(*) filter (severity = 'error') as e from found group by 1)
 select depth, count(*) as modules, cast(coalesce(sum(n), 0) as bigint) as findings, cast(coalesce(sum(e), 0) as bigint) as errors from walk left join a using (node) group by 1""",
    "schema_snapshot": f"with {_BASE}, {_IR} select kind, count(*) as facts, count(distinct name) as names, min(name) as first_name from ir group by 1",
    "schema_snapshot_fingerprint": f"""with {_BASE}, {_IR}, h as (select sha256(concat_ws(chr(31), kind, name, member, detail)) as h from ir), b as (select left(h, 2) as b, count(*) as n, sha256(string_agg(h, '' order by h)) as d from h group by 1)
 select cast(coalesce(sum(n), 0) as bigint) as facts, sha256(coalesce(string_agg(d, '' order by b), '')) as fingerprint from b""",
    "database_edge_counts": f"with {_BASE}, {_EDGES} select kind, exact, count(*) as edges, count(distinct src) as sources, count(distinct dst) as targets from edges group by 1, 2",
    "rpc_neighbourhoods": f"""with {_BASE}, {_EDGES}, a as (select dst as function_name, count(*) as callers from edges where kind = 'calls_rpc' group by 1), b as (select src as function_name, count(*) as tables from edges where kind = 'touches' group by 1)
 select function_name, coalesce(callers, 0) as callers, coalesce(tables, 0) as tables, 0::bigint as policies from a full join b using (function_name)""",
    "flow_map": rf"""with {_BASE}, home as (select distinct split_part(path, '/', 1) || '/' || regexp_extract(path, '([a-z]+)(?:\.[a-z]+)+$', 1) as m, name as f from objs where object_type = 'function'), t as (select distinct function_name as f, table_name as t from refs),
 s as (select min(m) as m from home where f in (select f from t)), g as (select max(t) as t from t where f in (select f from home where m = (select m from s))), v as (select min(f) as f from home join t using (f) where m = (select m from s) and t = (select t from g))
 select 0 as step, 'module:' || m as node, 'module' as kind, false as boundary from s where m is not null union all select 1, 'function:' || f, 'function', true from v where f is not null union all select 2, 'table:' || t, 'table', true from g where t is not null""",
    "guard_checks": f"with {_BASE}, {_GUARD} select code, 'critical' as severity, count(*) as findings, min(path) as first_path from guard group by 1",
    "programmatic_refresh": f"""with {_BASE}, {_GUARD}, live as (select * from files where is_deleted = 0), o as (select name, min(path) as home, regexp_replace(name, '^\\w+\\.', '') as bare from objs where object_type = 'table' group by 1),
 w as (select path, unnest(list_distinct(regexp_extract_all(lower(content), '[a-z_][a-z0-9_]*'))) as bare from texts), st as (select distinct w.path, name from w join o using (bare) join files f on f.path = w.path join files h on h.path = o.home where w.path <> home and h.last_modified_at > f.indexed_at),
 produced as (select {_FP.format("'s' || code, 's' || path, 's' || evidence")} as fp, path from guard union select {_FP.format("'sschema.stale_usage', 's' || path, 's' || name")}, path from st),
 old as (select path from live where last_modified_at < '{CUT}'), scope as (select path from live where regexp_matches(path, '\\.(?:tsx?|sql)$')),
 prior as (select * from produced where path in (select path from old) union all select {_FP.format("'sgit.server_uses_client_hook', 's' || path, 'suseState'")}, path from old),
 n as (select * from produced where path in (select path from scope)),
 e as (select case when n.fp is not null and p.fp is null then 'created' when n.fp is not null then 'updated' when p.path in (select path from scope) then 'resolved' else 'kept' end as event from prior p full join n on p.fp = n.fp)
 select event, case when event = 'resolved' then 'resolved' else 'active' end as status, count(*) as findings from e group by 1, 2 union all select 'run', 'succeeded', count(*) from scope""",
    "run_cache_states": "with l as (select user_id, event_type, max(ts) as f from events group by 1, 2) select case when (select max(ts) from events) - f > interval '30 minutes' then 'stale' else 'fresh' end as state, count(*) as runs from l group by 1",
    "risk_rules": f"with {router._Q}, l as (select part_id, lower(coalesce(text, '')) as low from q), r as ({_RISK}) select code, severity, confidence, count(*) as questions, min(part_id) as first_part from r group by 1, 2, 3",
    "route_search": f"""with {_C._TEXTS}, {_C._ROUTES}, p as (select route_key, substr(route_key, position(' ' in route_key) + 1) as pattern, lower(substr(route_key, position(' ' in route_key) + 1) || ' ' || route_key || ' ' || framework || ' ' || path) as hay from routes),
 s as (select route_key, pattern, cast(case when lower(pattern) = '/match-lease' then 100 else 0 end + case when lower(route_key) = '/match-lease' then 90 else 0 end + case when contains(hay, '/match-lease') then 60 else 0 end + 40 as double) as score from p where contains(hay, '/match-lease') or (contains(hay, 'match') and contains(hay, 'lease')))
 select * from s order by score desc, pattern, route_key limit 20""",
    "context_candidates": f"{_ALL} select provider, count(*) as candidates, min(key) as first_key, max(score) as best from cand group by 1",
    "context_packet": f"{_ALL}, p as (select *, row_number() over (order by score desc, key) as rn from cand), c as (select *, sum(cost) over (order by rn) as running_cost from p) select key, provider, score, cast(running_cost as bigint) as running_cost from c where rn = 1 or running_cost <= {BUDGET}",
}
