"""Queries over extracted structure and the graphs derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import corpus, graph
from lodestrata.operators.search import ranked
from lodestrata.runtime import stored_table
from lodestrata.sources import load_table, table_path

#: A module that every size of the data has.
HOT = "orchid-00000"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    files = load_table(spark, d, "files").select("file_id", "path", "language")
    return load_table(spark, d, "chunks").filter("chunk_kind = 'file'").select("file_id", "content").join(files, "file_id")


def _sql_texts(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).filter(F.col("path").endswith(".sql"))


def _imports(spark: SparkSession, d: str) -> DataFrame:
    return corpus.import_records(_texts(spark, d), ["file_id", "path"])


def import_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _imports(spark, d).groupBy("kind", "type_only").agg(F.count("*").alias("imports"), F.count_distinct("file_id").alias("files"), F.sum(F.size("names")).alias("names"))


def exported_kinds(spark: SparkSession, d: str) -> DataFrame:
    return corpus.exported_symbols(_texts(spark, d), ["file_id"]).groupBy("kind").agg(F.count("*").alias("exports"), F.count_distinct("name").alias("names"))


def route_table(spark: SparkSession, d: str) -> DataFrame:
    return corpus.routes(load_table(spark, d, "files").filter("is_deleted = 0"), _texts(spark, d)).select("route_key", "framework", "path")


def schema_object_list(spark: SparkSession, d: str) -> DataFrame:
    return corpus.schema_objects(_sql_texts(spark, d), ["path"]).groupBy("object_type", "name").agg(F.count("*").alias("definitions"), F.min("path").alias("first_path"))


def schema_columns(spark: SparkSession, d: str) -> DataFrame:
    return corpus.table_columns(_sql_texts(spark, d), ["file_id"]).groupBy("table_name", "column_name", "data_type").agg(F.count("*").alias("definitions"))


def function_tables(spark: SparkSession, d: str) -> DataFrame:
    return corpus.function_table_references(_sql_texts(spark, d), ["path"]).groupBy("function_name").agg(F.count_distinct("table_name").alias("tables"), F.min("table_name").alias("first_table"))


def schema_usages(spark: SparkSession, d: str) -> DataFrame:
    """Files that name a table of the schema, the defining files apart."""
    objects = corpus.schema_objects(_sql_texts(spark, d), ["path"]).filter("object_type = 'table'").groupBy("name").agg(F.min("path").alias("defined_in")).withColumn("bare", F.regexp_replace("name", r"^\w+\.", ""))
    used = corpus.usages(_texts(spark, d), objects.select("name", "bare"), ["path"])
    return used.join(objects.select("name", "defined_in"), "name").filter("path <> defined_in").groupBy("name").agg(F.count("*").alias("files"), F.min("path").alias("first_path"))


def live_search(spark: SparkSession, d: str) -> DataFrame:
    return corpus.live_text_search(_texts(spark, d), "path", "token budget", matches=None, files=None).select("path", "line_no", F.length(F.trim(F.regexp_replace("line", r"\r", ""))).alias("width"))


def semantic_unit_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.semantic_units(load_table(spark, d, "chunks")).groupBy("kind").agg(F.count("*").alias("units"), F.min("unit_id").alias("first_unit"))


def module_edges(spark: SparkSession, d: str) -> DataFrame:
    """The stored graph of modules, derived once as long as the texts stay the same."""
    return stored_table(spark, "module-edges", [table_path(d, "chunks"), table_path(d, "files")], lambda: derived_module_edges(spark, d))


def derived_module_edges(spark: SparkSession, d: str) -> DataFrame:
    """Dependencies between modules: a workspace and the last word of a file's or import's name."""
    rows = _imports(spark, d).filter("kind in ('relative', 'package')")
    space = F.element_at(F.split("path", "/"), 1)
    own = F.regexp_extract("path", r"([a-z]+)(?:\.[a-z]+)+$", 1)
    to = F.regexp_extract("specifier", r"([a-z]+)(?:/index)?(?:\.js)?$", 1)
    pairs = rows.select(F.concat_ws("/", space, own).alias("src"), F.concat_ws("/", space, to).alias("dst"), own.alias("o"), to.alias("t")).filter("o <> '' and t <> ''")
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("imports"))


def value_edges(spark: SparkSession, d: str) -> DataFrame:
    """Module edges with at least one import that is not of types only."""
    rows = _imports(spark, d).filter("kind in ('relative', 'package') and not type_only")
    space = F.element_at(F.split("path", "/"), 1)
    own, to = F.regexp_extract("path", r"([a-z]+)(?:\.[a-z]+)+$", 1), F.regexp_extract("specifier", r"([a-z]+)(?:/index)?(?:\.js)?$", 1)
    return rows.select(F.concat_ws("/", space, own).alias("src"), F.concat_ws("/", space, to).alias("dst"), own.alias("o"), to.alias("t")).filter("o <> '' and t <> ''").select("src", "dst").distinct()


def reverse_closure(spark: SparkSession, d: str) -> DataFrame:
    """All that depends on a module in the end, imports of types apart."""
    return graph.reachable(graph.reverse(value_edges(spark, d)), _seed(spark, "mosaic-00001/chunk")).select("node", "depth")


def diff_impact_findings(spark: SparkSession, d: str) -> DataFrame:
    """The modules that depend on changed ones within two steps, with the active findings of their files, by distance."""
    from lodestrata.plans import findings

    module = F.concat_ws("/", F.element_at(F.split("path", "/"), 1), F.regexp_extract("path", r"([a-z]+)(?:\.[a-z]+)+$", 1))
    changed = load_table(spark, d, "files").filter("last_modified_at > indexed_at and is_deleted = 0 and path like '%.sql'").select(module.alias("node"))
    walk = graph.reachable(graph.reverse(module_edges(spark, d)), changed, 2)
    active = findings._findings(spark, d).groupBy(module.alias("node")).agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "error").alias("e"))
    return walk.join(active, "node", "left").groupBy("depth").agg(F.count("*").alias("modules"), F.coalesce(F.sum("n"), F.lit(0)).alias("findings"), F.coalesce(F.sum("e"), F.lit(0)).alias("errors"))


def import_hotspots(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(module_edges(spark, d)).orderBy(F.col("total").desc(), F.col("fan_in").desc(), "node").limit(40)


def centrality_rank(spark: SparkSession, d: str) -> DataFrame:
    """Twice the inbound and once the outbound degree, the focus first."""
    c = graph.degrees(module_edges(spark, d)).withColumn("score", F.round(F.col("centrality") + F.when(F.col("node") == f"{HOT}/channel", 1_000_000).otherwise(0), 1))
    return ranked(c, F.col("score").desc(), F.col("node"), limit=30).select("node", "score", "rank")


def _seed(spark: SparkSession, *nodes: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in nodes], "node string")


def graph_khop(spark: SparkSession, d: str) -> DataFrame:
    """Everything within two steps of two modules, with the distance."""
    return graph.reachable(module_edges(spark, d), _seed(spark, "mosaic-00001/probe", "quarry-00007/lease"), 2)


def reverse_impact(spark: SparkSession, d: str) -> DataFrame:
    """What depends on a module, directly or over one other."""
    return graph.reachable(graph.reverse(module_edges(spark, d)), _seed(spark, "mosaic-00001/chunk"), 2, with_path=True).filter("depth > 0").select("node", "depth", F.array_join("path", "<").alias("via"))


def graph_shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """The shortest way from one module to another over all edges, however often imported."""
    return graph.shortest_path(module_edges(spark, d), "mosaic-00001/probe", "mosaic-00001/tenant")


def reachability_closure(spark: SparkSession, d: str) -> DataFrame:
    """All that a module leads to in the end."""
    return graph.reachable(module_edges(spark, d), _seed(spark, "meadow-00009/shard")).select("node", "depth")


def module_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.strongly_connected(module_edges(spark, d))


def module_short_cycles(spark: SparkSession, d: str) -> DataFrame:
    e = module_edges(spark, d)
    return graph.short_cycles(e, graph.strongly_connected(e))


def event_transition_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Cycles of event types that users pass through, over transitions seen often enough."""
    from pyspark.sql.window import Window

    e = load_table(spark, d, "events")
    steps = e.select(F.col("event_type").alias("src"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("dst")).filter("dst is not null")
    return graph.short_cycles(steps.groupBy("src", "dst").agg(F.count("*").alias("n")).filter("n >= 20"))


def graph_edge_counts(spark: SparkSession, d: str) -> DataFrame:
    """The whole graph from its sources, merged by source, target and kind with the set of evidence."""
    sym = load_table(spark, d, "symbols").select("symbol_id", "file_id", "name", "kind", "metadata_json").distinct()
    files = load_table(spark, d, "files").select("file_id", "path")
    msgs = load_table(spark, d, "harness_messages").select("message_id", "parent_id", "session_id").distinct()
    ends = lambda df, s, t, kind, ev, exact=True: df.select(F.col(s).cast("string").alias("src"), F.col(t).cast("string").alias("dst"), F.lit(kind).alias("kind"), F.lit(ev).alias("evidence"), F.lit(exact).alias("exact")).filter("src is not null and dst is not null")
    parts = [
        ends(sym.join(files, "file_id"), "path", "symbol_id", "declares", "index"),
        ends(sym.withColumn("owner", F.concat_ws("#", "file_id", F.get_json_object("metadata_json", "$.parent"))).filter("owner like '%#%'"), "owner", "symbol_id", "contains", "metadata"),
        ends(module_edges(spark, d), "src", "dst", "imports", "text", False),
        ends(msgs, "session_id", "message_id", "holds", "log"),
        ends(msgs, "parent_id", "message_id", "answers", "log"),
        ends(corpus.function_table_references(_sql_texts(spark, d), ["path"]), "function_name", "table_name", "reads", "sql", False),
    ]
    return graph.merge_edges(*parts).groupBy("kind", "evidence", "exact").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"))


def where_used(spark: SparkSession, d: str) -> DataFrame:
    """Definitions, imports and text references of one name."""
    name = "loadShard"
    definitions = load_table(spark, d, "symbols").filter(F.col("name") == name).select("symbol_id", "file_id").distinct().join(load_table(spark, d, "files").select("file_id", "path"), "file_id").select("path", F.lit("definition").alias("use"))
    imports = _imports(spark, d).filter(F.array_contains("names", name)).select("path", F.lit("import").alias("use"))
    stripped = F.regexp_replace(F.regexp_replace("content", r'"[^"\n]*"', '""'), r"'[^'\n]*'", "''")
    refs = _texts(spark, d).filter(F.array_contains(F.regexp_extract_all(stripped, F.lit(r"\w+"), F.lit(0)), name)).select("path", F.lit("text").alias("use"))
    return definitions.unionByName(imports).unionByName(refs).distinct()


def import_edge_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Imported names joined to the file that exports them, resolved or not."""
    space = F.element_at(F.split("path", "/"), 1)
    wanted = _imports(spark, d).select(space.alias("space"), "path", F.explode("names").alias("name"))
    exports = load_table(spark, d, "symbols").filter("export_name is not null").select("file_id", F.col("export_name").alias("name")).join(load_table(spark, d, "files").select("file_id", "path"), "file_id")
    # one exporter a name and workspace, so that a frequent name is no product of its uses and definitions
    one = exports.groupBy(space.alias("space"), "name").agg(F.min("path").alias("target"))
    j = wanted.join(one, ["space", "name"], "left")
    return j.groupBy("space").agg(F.count("*").alias("names"), F.count_if(F.col("target").isNotNull()).alias("resolved"), F.count_if(F.col("target").isNull()).alias("unresolved"))


def file_detail(spark: SparkSession, d: str) -> DataFrame:
    """Files with preview, symbols and imports."""
    t = _texts(spark, d)
    sym = load_table(spark, d, "symbols").select("symbol_id", "file_id").distinct().groupBy("file_id").agg(F.count("*").alias("symbols"))
    imp = _imports(spark, d).groupBy("file_id").agg(F.count("*").alias("imports"))
    return t.join(sym, "file_id", "left").join(imp, "file_id", "left").select("file_id", F.length(F.substring("content", 1, 400)).alias("preview_chars"), F.coalesce("symbols", F.lit(0)).alias("symbols"), F.coalesce("imports", F.lit(0)).alias("imports"))


def file_content(spark: SparkSession, d: str) -> DataFrame:
    """Each file's text: its ``file`` chunk, else its other chunks in order of lines."""
    c = load_table(spark, d, "chunks")
    g = c.groupBy("file_id").agg(F.max(F.when(F.col("chunk_kind") == "file", F.col("content"))).alias("whole"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("chunk_kind") != "file", F.struct("line_start", "chunk_id", "content")))), lambda x: x["content"]), "\n").alias("pieces"))
    return g.select("file_id", F.sha2(F.coalesce("whole", "pieces"), 256).alias("digest"))


def table_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """For each table: the functions that read it, the files that define it and the columns it has."""
    sql = _sql_texts(spark, d)
    reads = corpus.function_table_references(sql, ["path"]).groupBy("table_name").agg(F.count_distinct("function_name").alias("readers"))
    cols = corpus.table_columns(sql, ["path"]).groupBy("table_name").agg(F.count_distinct("column_name").alias("columns"), F.count_distinct("path").alias("definitions"))
    return cols.join(reads, "table_name", "full").select("table_name", F.coalesce("columns", F.lit(0)).alias("columns"), F.coalesce("definitions", F.lit(0)).alias("definitions"), F.coalesce("readers", F.lit(0)).alias("readers"))


def route_context(spark: SparkSession, d: str) -> DataFrame:
    """Routes with the modules that they lead to within two steps."""
    space = F.element_at(F.split("path", "/"), 1)
    own = F.concat_ws("/", space, F.regexp_extract("path", r"([a-z]+)(?:\.[a-z]+)+$", 1))
    r = route_table(spark, d).select("route_key", own.alias("src"))
    e = module_edges(spark, d).select("src", "dst")
    one = r.join(e, "src").select("route_key", F.col("dst").alias("module")).distinct()
    two = one.join(e, one.module == e.src).select("route_key", F.col("dst").alias("module"))
    return one.unionByName(two).distinct().groupBy("route_key").agg(F.count("*").alias("modules"))


def tenant_audit(spark: SparkSession, d: str) -> DataFrame:
    """Tables with or without a tenant column, by whether functions read them."""
    t = corpus.table_columns(_sql_texts(spark, d), ["path"]).groupBy("table_name").agg(F.max(F.col("column_name").contains("tenant")).alias("has_tenant"))
    reads = corpus.function_table_references(_sql_texts(spark, d), ["path"]).select("table_name").distinct().withColumn("read", F.lit(True))
    j = t.join(reads, "table_name", "left")
    finding = F.when(F.col("has_tenant") & F.col("read").isNotNull(), "direct").when(F.col("has_tenant"), "weak").otherwise("none")
    return j.groupBy(finding.alias("finding")).agg(F.count("*").alias("tables"))


def flow_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Modules two steps from a seed by kind of step, with the distinct kinds on the way."""
    walk = graph.reachable(module_edges(spark, d), _seed(spark, "mosaic-00001/probe"), 2, with_path=True)
    return walk.select("node", F.size("path").alias("steps"), F.when(F.col("depth") == 0, "entry").when(F.col("depth") == 1, "near").otherwise("far").alias("boundary"))


def change_plan(spark: SparkSession, d: str) -> DataFrame:
    """The modules of a change and up to six direct dependents of each, in order."""
    e = module_edges(spark, d)
    targets = graph.reachable(e, _seed(spark, "mosaic-00001/probe"), 1).select(F.col("node").alias("dst"))
    deps = e.filter("src <> dst").join(targets, "dst").select("dst", "src").distinct()
    return graph.capped(deps, ["dst"], 6, F.col("src")).select(F.col("dst").alias("module"), F.col("src").alias("dependent"), "place", "total")


def diff_impact(spark: SparkSession, d: str) -> DataFrame:
    """How many modules hold generated files, and how many depend on those within two steps, by distance."""
    gen = load_table(spark, d, "files").filter("is_generated = 1 and is_deleted = 0").select(F.concat_ws("/", F.element_at(F.split("path", "/"), 1), F.regexp_extract("path", r"([a-z]+)(?:\.[a-z]+)+$", 1)).alias("node"))
    walk = graph.reachable(graph.reverse(module_edges(spark, d)), gen, 2)
    return walk.groupBy("depth").agg(F.count("*").alias("modules"))


QUERIES = {f.__name__: f for f in (import_kinds, exported_kinds, route_table, schema_object_list, schema_columns, function_tables, schema_usages, live_search, semantic_unit_counts, module_edges, import_hotspots, centrality_rank, graph_khop, reverse_impact, graph_shortest_path, reachability_closure, module_components, module_short_cycles, event_transition_cycles, graph_edge_counts, where_used, import_edge_resolution, file_detail, file_content, table_neighbourhood, route_context, tenant_audit, flow_boundaries, change_plan, diff_impact, reverse_closure, diff_impact_findings)}

_TEXTS = "texts as (select file_id, path, language, content from chunks join files using (file_id) where chunk_kind = 'file')"
_SQLT = "sqlt as (select * from texts where path like '%.sql')"
_IMP = r"""imp as (select file_id, path, s, regexp_extract(s, '["'']([^"'']+)["'']$', 1) as specifier, list_filter(list_transform(string_split(regexp_extract(s, '\{([^}]*)\}', 1), ','), lambda x: trim(x)), lambda x: x <> '') as names,
 s like 'export%' as re, regexp_matches(s, '^(import|export)\s+type\s') as type_only from (select file_id, path, unnest(regexp_extract_all(content, '(?:^|\n)\s*((?:import|export)\s+(?:type\s+)?(?:[\w*$]+\s*,?\s*)?(?:\{[^}]*\})?(?:\*\s+as\s+\w+)?\s*from\s+["''][^"''\n]+["''])', 1)) as s from texts)),
 imports as (select *, case when re then 'reexport' when specifier like '.%' then 'relative' when specifier like '@/%' or specifier like '~/%' then 'alias' else 'package' end as kind from imp)"""
_MOD = r"""mods as (select split_part(path, '/', 1) || '/' || o as src, split_part(path, '/', 1) || '/' || t as dst, count(*) as imports from (select path, regexp_extract(path, '([a-z]+)(?:\.[a-z]+)+$', 1) as o, regexp_extract(specifier, '([a-z]+)(?:/index)?(?:\.js)?$', 1) as t from imports where kind in ('relative', 'package')) where o <> '' and t <> '' group by 1, 2)"""
_PRE = f"{_TEXTS}, {_IMP}, {_MOD}"
_COLS = r"""tabs as (select path, unnest(regexp_extract_all(content, '(?i)(create\s+table\s+(?:if\s+not\s+exists\s+)?[\w.]+\s*\([^;]*\))\s*;', 1)) as t from sqlt),
 cols as (select path, lower(regexp_extract(t, '(?i)exists\s+([\w.]+)|table\s+([\w.]+)', 1)) as table_name, split_part(c, ' ', 1) as column_name, split_part(c, ' ', 2) as data_type from (select path, t, unnest(regexp_extract_all(t, '\n\s+(\w+ \w+)', 1)) as c from tabs))"""
_FREF = r"""bods as (select path, unnest(regexp_extract_all(content, '(?is)(create\s+or\s+replace\s+function\s+[\w.]+.*?\$\$.*?\$\$)', 1)) as b from sqlt),
 refs as (select distinct path, function_name, case when contains(t, '.') then t else 'public.' || t end as table_name from (select path, lower(regexp_extract(b, '(?i)function\s+([\w.]+)', 1)) as function_name, unnest(regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(b, '(?s)/\*.*?\*/', ' ', 'g'), '--[^\n]*', ' ', 'g'), '''[^'']*''', '''''', 'g')), '\b(?:from|join|update|insert\s+into|delete\s+from)\s+([a-z_][\w.]*)', 1)) as t from bods) where t not in ('select', 'lateral', 'unnest', 'values', 'only', 'set', 'where', 'as', 'on', 'the'))"""
_OBJ = r"""objs as (select path, lower(regexp_extract(x, '^(\w+)', 1)) as object_type, lower(replace(regexp_extract(x, '([\w."]+)$', 1), '"', '')) as name from (select path, unnest(regexp_extract_all(content, '(?i)\bcreate\s+(?:or\s+replace\s+)?((?:table|view|materialized\s+view|type|function)\s+(?:if\s+not\s+exists\s+)?[\w."]+)', 1)) as x from sqlt))"""
_DEG = """e as (select distinct src, dst from mods where src <> dst), deg as (select node, cast(sum(i) as bigint) as fan_in, cast(sum(o) as bigint) as fan_out from (select src as node, 0 as i, 1 as o from e union all select dst, 1, 0 from e) group by 1)"""
_ROUTES = r"""r0 as (select '/' || regexp_replace(regexp_extract(path, '/routes/(.*)$', 1), '\.(?:ts|tsx|js|jsx|mjs|cjs)$', '') as pattern, 'pages' as framework, 2 as priority, path from files where is_deleted = 0 and regexp_matches(path, '\.(?:ts|tsx|js|jsx|mjs|cjs)$') and contains(path, '/routes/')
 union all select '/api/' || regexp_replace(regexp_extract(path, '/api/src/(.*)$', 1), '\.(?:ts|tsx|js|jsx|mjs|cjs)$', ''), 'handlers', 3, path from files where is_deleted = 0 and regexp_matches(path, '\.(?:ts|tsx|js|jsx|mjs|cjs)$') and contains(path, '/api/src/')
 union all select unnest(regexp_extract_all(content, '\b(?:app|router)\.(?:get|post|put|delete|patch)\(\s*["''](/[^"'']*)["'']', 1)), 'calls', 1, path from texts),
 routes as (select split_part(path, '/', 1) || ' ' || pattern as route_key, framework, path from r0 qualify row_number() over (partition by split_part(path, '/', 1) || ' ' || pattern order by priority desc, path) = 1)"""


def _walk_sql(seeds: str, edges: str, depth: int | None) -> str:
    bound = f"where w.depth < {depth}" if depth is not None else ""
    return f"w as (select node, 0 as depth from ({seeds}) union select e.dst, w.depth + 1 from w join ({edges}) e on w.node = e.src {bound}), walk as (select node, cast(min(depth) as integer) as depth from w group by 1)"


def _seeds_sql(*nodes: str) -> str:
    return " union all ".join(f"select '{n}' as node" for n in nodes)


_VIA = """lv1 as (select m.src as node, 'mosaic-00001/chunk' as p from mods m where m.dst = 'mosaic-00001/chunk' and m.src <> m.dst group by 1),
 lv2 as (select m.src as node, min(l.node) as p from mods m join lv1 l on m.dst = l.node where m.src not in (select node from lv1) and m.src <> 'mosaic-00001/chunk' group by 1)"""
ORACLES = {
    "reverse_closure": rf"""with recursive {_TEXTS}, {_IMP}, mods as (select distinct split_part(path, '/', 1) || '/' || o as src, split_part(path, '/', 1) || '/' || t as dst from (select path, regexp_extract(path, '([a-z]+)(?:\.[a-z]+)+$', 1) as o, regexp_extract(specifier, '([a-z]+)(?:/index)?(?:\.js)?$', 1) as t from imports where kind in ('relative', 'package') and not type_only) where o <> '' and t <> ''),
 {_walk_sql(_seeds_sql('mosaic-00001/chunk'), 'select dst as src, src as dst from mods', 40)} select node, depth from walk""",
    "import_kinds": f"with {_TEXTS}, {_IMP} select kind, type_only, count(*) as imports, count(distinct file_id) as files, cast(sum(len(names)) as bigint) as names from imports group by 1, 2",
    "exported_kinds": f"with {_TEXTS}, x as (select unnest(regexp_extract_all(content, '(?:^|\\n)export\\s+(?:default\\s+)?(?:async\\s+)?((?:function|class|interface|const|let|enum|type)\\s+\\w+)', 1)) as d from texts) select regexp_extract(d, '^(\\w+)', 1) as kind, count(*) as exports, count(distinct regexp_extract(d, '(\\w+)$', 1)) as names from x group by 1",
    "route_table": f"with {_TEXTS}, {_ROUTES} select route_key, framework, path from routes",
    "schema_object_list": f"with {_TEXTS}, {_SQLT}, {_OBJ} select object_type, name, count(*) as definitions, min(path) as first_path from objs group by 1, 2",
    "schema_columns": f"with {_TEXTS}, {_SQLT}, {_COLS} select table_name, column_name, data_type, count(*) as definitions from cols group by 1, 2, 3",
    "function_tables": f"with {_TEXTS}, {_SQLT}, {_FREF} select function_name, count(distinct table_name) as tables, min(table_name) as first_table from refs group by 1",
    "schema_usages": f"""with {_TEXTS}, {_SQLT}, {_OBJ}, o as (select name, min(path) as defined_in, regexp_replace(name, '^\\w+\\.', '') as bare from objs where object_type = 'table' group by 1),
 u as (select path, unnest(list_distinct(regexp_extract_all(lower(content), '[a-z_][a-z0-9_]*'))) as bare from texts) select name, count(*) as files, min(path) as first_path from u join o using (bare) where path <> defined_in group by 1""",
    "live_search": """with l as (select file_id, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as n from chunks where chunk_kind = 'file')
 select path, cast(n as integer) as line_no, length(trim(replace(line, chr(13), ''), ' ')) as width from l join files using (file_id) where contains(lower(line), 'token budget')""",
    "semantic_unit_counts": """with u as (select distinct case when chunk_kind = 'symbol' then 'code' else 'doc' end as kind, 'su_' || sha256(concat_ws(chr(31), case when chunk_kind = 'symbol' then 'code' else 'doc' end, cast(file_id as varchar), sha256(content))) as unit_id from chunks where content is not null) select kind, count(*) as units, min(unit_id) as first_unit from u group by 1""",
    "module_edges": f"with {_PRE} select src, dst, imports from mods",
    "import_hotspots": f"with {_PRE}, {_DEG} select node, fan_in, fan_out, fan_in + fan_out as total, round(2.0 * fan_in + fan_out + 0.1, 1)::double as centrality from deg order by total desc, fan_in desc, node limit 40",
    "centrality_rank": f"with {_PRE}, {_DEG}, c as (select node, round(2.0 * fan_in + fan_out + 0.1 + case when node = '{HOT}/channel' then 1000000 else 0 end, 1)::double as score from deg) select node, score, cast(row_number() over (order by score desc, node) as integer) as rank from c order by score desc, node limit 30",
    "graph_khop": f"with recursive {_PRE}, {_walk_sql(_seeds_sql('mosaic-00001/probe', 'quarry-00007/lease'), 'select src, dst from mods', 2)} select node, depth from walk",
    "reverse_impact": f"with {_PRE}, {_VIA} select node, 1 as depth, p || '<' || node as via from lv1 union all select node, 2, 'mosaic-00001/chunk<' || p || '<' || node from lv2",
    "graph_shortest_path": f"""with recursive {_PRE}, {_walk_sql(_seeds_sql('mosaic-00001/probe'), 'select src, dst from mods', 12)}, par as (select c.node, min(p.node) as p from walk c join mods m on m.dst = c.node join walk p on p.node = m.src and p.depth = c.depth - 1 group by 1),
 back as (select node, node as path from walk where node = 'mosaic-00001/tenant' union all select par.p, par.p || '>' || back.path from back join par using (node)), hit as (select depth from walk where node = 'mosaic-00001/tenant')
 select (select count(*) from hit) > 0 as found, (select depth from hit) as hops, (select path from back where node = 'mosaic-00001/probe') as path,
 case when (select count(*) from hit) > 0 then 'found' when (select max(depth) from walk) >= 12 then 'depth_exceeded' else 'disconnected' end as reason""",
    "reachability_closure": f"with recursive {_PRE}, {_walk_sql(_seeds_sql('meadow-00009/shard'), 'select src, dst from mods', 40)} select node, depth from walk",
    "module_components": f"""with recursive {_PRE}, e as (select src, dst from mods), r as (select src, dst from e union select r.src, e.dst from r join e on r.dst = e.src)
 select a.src as node, least(a.src, min(a.dst)) as component from r a join r b on a.src = b.dst and a.dst = b.src group by a.src""",
    "module_short_cycles": f"""with {_PRE}, e as (select src, dst from mods where src <> dst)
 select a.src || '>' || a.dst as cycle, 2 as length from e a join e b on a.dst = b.src and b.dst = a.src where a.src < a.dst
 union all select a.src || '>' || a.dst || '>' || b.dst, 3 from e a join e b on a.dst = b.src join e c on b.dst = c.src and c.dst = a.src where a.src < a.dst and a.src < b.dst""",
    "event_transition_cycles": """with s as (select event_type as src, lead(event_type) over (partition by user_id order by ts, event_id) as dst from events), e as (select src, dst from s where dst is not null and src <> dst group by 1, 2 having count(*) >= 20)
 select a.src || '>' || a.dst as cycle, 2 as length from e a join e b on a.dst = b.src and b.dst = a.src where a.src < a.dst
 union all select a.src || '>' || a.dst || '>' || b.dst, 3 from e a join e b on a.dst = b.src join e c on b.dst = c.src and c.dst = a.src where a.src < a.dst and a.src < b.dst""",
    "graph_edge_counts": f"""with {_PRE}, {_SQLT}, {_FREF}, s as (select distinct symbol_id, file_id, name, kind, metadata_json from symbols), m as (select distinct message_id, parent_id, session_id from harness_messages),
 u as (select path as src, cast(symbol_id as varchar) as dst, 'declares' as kind, 'index' as evidence, true as exact from s join files using (file_id)
 union select file_id || '#' || json_extract_string(metadata_json, '$.parent'), cast(symbol_id as varchar), 'contains', 'metadata', true from s where json_extract_string(metadata_json, '$.parent') is not null
 union select src, dst, 'imports', 'text', false from mods union select session_id, message_id, 'holds', 'log', true from m where session_id is not null union select parent_id, message_id, 'answers', 'log', true from m where parent_id is not null
 union select function_name, table_name, 'reads', 'sql', false from refs)
 select kind, evidence, exact, count(*) as edges, count(distinct src) as sources from u group by 1, 2, 3""",
    "where_used": f"""with {_TEXTS}, {_IMP} select distinct path, 'definition' as use from symbols join files using (file_id) where name = 'loadShard' union select path, 'import' from imports where list_contains(names, 'loadShard')
 union select path, 'text' from texts where list_contains(regexp_extract_all(regexp_replace(regexp_replace(content, '"[^"\\n]*"', '""', 'g'), '''[^''\\n]*''', '''''', 'g'), '\\w+'), 'loadShard')""",
    "import_edge_resolution": f"""with {_TEXTS}, {_IMP}, n as (select split_part(path, '/', 1) as space, unnest(names) as name from imports), o as (select split_part(path, '/', 1) as space, export_name as name, min(path) as target from symbols join files using (file_id) where export_name is not null group by 1, 2)
 select space, count(*) as names, count(target) as resolved, count(*) - count(target) as unresolved from n left join o using (space, name) group by 1""",
    "file_detail": f"""with {_TEXTS}, {_IMP} select t.file_id, length(substr(content, 1, 400)) as preview_chars, coalesce(s, 0) as symbols, coalesce(i, 0) as imports from texts t left join (select file_id, count(distinct symbol_id) as s from symbols group by 1) using (file_id) left join (select file_id, count(*) as i from imports group by 1) using (file_id)""",
    "file_content": "select file_id, sha256(coalesce(max(content) filter (chunk_kind = 'file'), string_agg(content, chr(10) order by line_start nulls first, chunk_id) filter (chunk_kind <> 'file'))) as digest from chunks group by 1",
    "table_neighbourhood": f"""with {_TEXTS}, {_SQLT}, {_COLS}, {_FREF}, c as (select table_name, count(distinct column_name) as columns, count(distinct path) as definitions from cols group by 1), r as (select table_name, count(distinct function_name) as readers from refs group by 1)
 select table_name, coalesce(columns, 0) as columns, coalesce(definitions, 0) as definitions, coalesce(readers, 0) as readers from c full join r using (table_name)""",
    "route_context": f"""with {_PRE}, {_ROUTES}, r as (select route_key, split_part(path, '/', 1) || '/' || regexp_extract(path, '([a-z]+)(?:\\.[a-z]+)+$', 1) as src from routes), e as (select src, dst from mods),
 one as (select route_key, dst as module from r join e using (src)), u as (select * from one union select route_key, dst from one join e on module = src) select route_key, count(*) as modules from u group by 1""",
    "tenant_audit": f"""with {_TEXTS}, {_SQLT}, {_COLS}, {_FREF}, t as (select table_name, bool_or(contains(column_name, 'tenant')) as h from cols group by 1) select case when h and table_name in (select table_name from refs) then 'direct' when h then 'weak' else 'none' end as finding, count(*) as tables from t group by 1""",
    "flow_boundaries": f"with recursive {_PRE}, {_walk_sql(_seeds_sql('mosaic-00001/probe'), 'select src, dst from mods', 2)} select node, depth + 1 as steps, case depth when 0 then 'entry' when 1 then 'near' else 'far' end as boundary from walk",
    "change_plan": f"""with {_PRE}, t as (select 'mosaic-00001/probe' as dst union select dst from mods where src = 'mosaic-00001/probe'), x as (select distinct dst, src from mods join t using (dst) where src <> dst), r as (select *, row_number() over (partition by dst order by src) as place, count(*) over (partition by dst) as total from x)
 select dst as module, src as dependent, cast(place as integer) as place, total from r where place <= 6""",
    "diff_impact": f"""with recursive {_PRE}, gen as (select distinct split_part(path, '/', 1) || '/' || regexp_extract(path, '([a-z]+)(?:\\.[a-z]+)+$', 1) as node from files where is_generated = 1 and is_deleted = 0), {_walk_sql('select node from gen', 'select dst as src, src as dst from mods', 2)} select depth, count(*) as modules from walk group by 1""",
}
