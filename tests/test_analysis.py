from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestrata.functions.text import expand_identifier, matches_glob
from lodestrata.operators import context, graph, guards, schema
from lodestrata.operators.history import in_order, retained_tail
from lodestrata.operators.search import bm25
from lodestrata.operators.text_index import bucket_of, build_index, index_bm25
from lodestrata.runtime import _scratch, settled, signature, stored_table, written

SQL = """
create table app.orders (id bigint primary key, owner_id bigint references app.users (id), state app.state);
create table app.lines (order_id bigint, line_no int, constraint lines_pk primary key (order_id, line_no));
create type app.state as enum ('open', 'it''s shut');
-- create policy ghost on app.orders for select;
create policy "Own Orders" on app.orders for select to authenticated using (owner_id = 1);
create policy everything on app.lines using (true);
create or replace trigger stamp before insert or update on app.orders for each row execute function app.stamp();
create or replace function app.load_orders() returns setof app.orders language sql as $$ select * from app.orders join app.lines on true $$;
"""
CODE = "const rows = await db.from('orders').select();\nconst more = await db.rpc(\"load_orders\", {});\n"


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def test_schema_facts(spark):
    t = texts(spark, ("a.sql", SQL), ("b.sql", None), ("c.sql", ""))
    assert sorted(map(tuple, schema.policies(t, []).collect())) == [("everything", "app.lines", "all", "public"), ("own orders", "app.orders", "select", "authenticated")]
    assert list(map(tuple, schema.triggers(t, []).collect())) == [("stamp", "app.orders", "before", "insert,update", "app.stamp")]
    assert sorted(map(tuple, schema.primary_keys(t, []).collect())) == [("app.lines", "line_no"), ("app.lines", "order_id"), ("app.orders", "id")]
    assert sorted(map(tuple, schema.enums(t, []).collect())) == [("app.state", 0, "open"), ("app.state", 1, "it''s shut")]


def test_snapshot_is_the_same_in_any_order_and_changes_with_the_schema(spark):
    one = schema.schema_fingerprint(schema.schema_ir(texts(spark, ("a.sql", SQL), ("b.sql", "create table x (a int);")))).first()
    two = schema.schema_fingerprint(schema.schema_ir(texts(spark, ("b.sql", "create table x (a int);"), ("z.sql", SQL), ("y.sql", SQL)))).first()
    three = schema.schema_fingerprint(schema.schema_ir(texts(spark, ("a.sql", SQL)))).first()
    assert one == two and one.fingerprint != three.fingerprint and one.facts == three.facts + 1
    assert schema.schema_fingerprint(schema.schema_ir(texts(spark, ("a.sql", "")))).first().facts == 0


def test_edges_and_neighbourhood(spark):
    sql, code = texts(spark, ("a.sql", SQL)), texts(spark, ("a.sql", SQL), ("app.ts", CODE), ("b.ts", "// load_orders is called elsewhere\n"))
    edges = {tuple(r) for r in schema.database_edges(sql, code).collect()}
    assert {("app.ts", "app.load_orders", "calls_rpc", True), ("b.ts", "app.load_orders", "calls_rpc", False), ("app.orders", "app.orders#own orders", "has_policy", True), ("app.orders#stamp", "app.stamp", "executes", True)} <= edges
    got = {r.function_name: (r.callers, r.tables, r.policies) for r in schema.rpc_neighbourhood(schema.database_edges(sql, code)).collect()}
    assert got == {"app.load_orders": (2, 2, 2)}
    calls = sorted(tuple(r) for r in schema.structured_calls(code, ["path"]).collect())
    assert [c[:4] for c in calls] == [("app.ts", "function", "load_orders", 2), ("app.ts", "table", "orders", 1)]


def test_guard_findings(spark):
    rows = [
        ("app/api/a/route.ts", "export const GET = () => 1;\n"),
        ("app/api/b/route.ts", "export const GET = async () => { await supabase.auth.getUser(); };\n"),
        ("app/api/c/route.ts", "// withAuth(x)\nexport const GET = () => 1;\n"),
        ("app/api/pub/route.ts", "export const GET = () => 1;\n"),
        ("ui/a.tsx", "'use client';\nimport { cookies } from 'next/headers';\nconst c = cookies ();\nuseState(1);\n"),
        ("ui/b.tsx", "// 'use client'\nimport React from 'react';\nconst [a] = React.useState(1);\n// useEffect()\n"),
        ("ui/c.js", "useState(1);\n"),
        ("ui/d.ts", None),
    ]
    got = sorted((r.code, r.path, r.line_no, r.evidence) for r in guards.guard_findings(texts(spark, *rows), public_globs=("app/api/pub/*",)).filter("path <> 'x'").collect())
    guard = "guards checked: auth.getUser, withAuth"
    assert sorted(got, key=str) == sorted(
        [
            ("git.unprotected_route", "app/api/a/route.ts", None, guard),
            ("git.unprotected_route", "app/api/c/route.ts", None, guard),
            ("git.client_uses_server_only", "ui/a.tsx", 2, "next/headers"),
            ("git.client_uses_server_only", "ui/a.tsx", 3, "cookies"),
            ("git.server_uses_client_hook", "ui/b.tsx", 3, "React.useState"),
        ],
        key=str,
    )
    assert guards.as_findings(guards.guard_findings(texts(spark, *rows))).count() == 6
    assert guards.guard_findings(texts(spark, *rows).limit(0)).count() == 0


def test_run_cache(spark):
    now = datetime(2025, 1, 1, 12)
    df = spark.createDataFrame([(now - timedelta(minutes=30), now), (now - timedelta(minutes=31), now), (None, now), (now + timedelta(hours=1), now)], "f timestamp, now timestamp")
    assert [r[0] for r in df.select(guards.run_cache(F.col("f"), F.col("now"))).collect()] == ["fresh", "stale", "unknown", "fresh"]


def test_risks(spark):
    df = spark.createDataFrame([("The session token of the user is lost", ["ts"]), ("what a day", ["sql"]), (None, ["ts"]), ("where is a similar example", [])], "t string, e array<string>")
    got = [[(x.code, x.severity, x.confidence) for x in r[0]] for r in df.select(context.detected_risks(F.col("t"), F.col("e"))).collect()]
    assert got[0][0] == ("auth_state_flow", "high", 0.92) and got[1] == got[2] == [] and got[3] == [("duplicate_pattern_possible", "low", 0.72)]


def test_routes_need_every_token_of_a_path(spark):
    df = spark.createDataFrame([("w /a/list", "/a/list", "pages", "a/list.ts"), ("w /list", "/list", "pages", "x/list.ts"), ("w /bb", "/bb", "pages", "bb.ts")], "route_key string, pattern string, framework string, path string")
    assert {r.pattern: r.score for r in context.route_scores(df, "/list").collect()} == {"/a/list": 70.0, "/list": 170.0}
    assert {r.pattern for r in context.route_scores(df, "list bb").collect()} == {"/a/list", "/list", "/bb"}


def test_index_answers_as_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(i, f"word{i % 7} the old reader" + " common" * (i % 3)) for i in range(300)] + [(900, None), (901, "")], "id long, text string")
    index = build_index(df, "id", F.col("text"), f"file://{tmp_path}/index")
    assert index.texts == 302 and bucket_of("common", index.buckets) < index.buckets
    for terms in (["common", "word3"], ["nothing"], ["the"]):
        want = {r.id: round(r.score, 9) for r in bm25(df, terms, F.col("text"), ["id"]).collect()}
        assert {r.id: round(r.score, 9) for r in index_bm25(spark, index, terms, "id").collect()} == want
    assert index_bm25(spark, index, [], "id").count() == 0
    plan = index_bm25(spark, index, ["common"], "id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    empty = build_index(df.limit(0), "id", F.col("text"), f"file://{tmp_path}/empty")
    assert index_bm25(spark, empty, ["common"], "id").count() == 0


def test_derived_tables_are_made_again_only_when_inputs_change(spark, tmp_path):
    path, made = f"file://{tmp_path}/in", []

    def build():
        made.append(1)
        return spark.read.parquet(path).selectExpr("count(*) as n")

    spark.range(5).write.parquet(path)
    before = signature(spark, [path])
    assert stored_table(spark, "n", [path], build).first().n == 5 and stored_table(spark, "n", [path], build).first().n == 5 and len(made) == 1
    spark.range(3).write.mode("append").parquet(path)
    assert signature(spark, [path]) != before and stored_table(spark, "n", [path], build).first().n == 8 and len(made) == 2


def test_short_cycles_of_hubs(spark):
    edges = [("hub", f"n{i:02}") for i in range(40)] + [(f"n{i:02}", f"n{i + 1:02}") for i in range(39)] + [(f"n{i:02}", "hub") for i in range(0, 40, 2)] + [("x", "hub"), ("hub", "hub")]
    df = spark.createDataFrame(edges, "src string, dst string")
    e = {(a, b) for a, b in edges if a != b}
    want = {">".join(c) for a, b in e for c in [(a, b)] if a < b and (b, a) in e} | {f"{a}>{b}>{c}" for a, b in e for b2, c in e if b2 == b and (c, a) in e and a < b and a < c}
    assert {r.cycle for r in graph.short_cycles(df).collect()} == want == {r.cycle for r in graph.short_cycles(df, graph.strongly_connected(df)).collect()}


def test_words_of_identifiers(spark):
    cases = {"parseHTTPResponse2xx": "parse HTTP Response 2 xx", "snake_case-name.ts": "snake case name ts", "__x": "x", "A": "A", "": "", "a::B/c\\d": "a B c d", "URLs": "UR Ls"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.e for r in rows.select("t", expand_identifier(F.col("t")).alias("e")).collect()} == cases


def test_order_over_ranges_of_a_hot_key(spark):
    import random

    rnd = random.Random(4)
    rows = [("hot" if i % 3 else None if i % 5 == 0 else f"k{i % 4}", rnd.randrange(10**6), i) for i in range(400)]
    for desc in (False, True):
        df = spark.createDataFrame(rows, "k string, at long, n long")
        order = [F.col(c).desc() if desc else F.col(c) for c in ("at", "n")]
        got = {r.n: (r["__position"], r["__prev"] and r["__prev"].n, r["__next"] and r["__next"].n) for r in in_order(df, ["k"], order).collect()}
        want = {}
        for k in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]), reverse=desc)
            for i, r in enumerate(own):
                want[r[2]] = (i + 1, own[i - 1][2] if i else None, own[i + 1][2] if i + 1 < len(own) else None)
        assert got == want
    assert in_order(df.limit(0), ["k"], order).count() == 0


def test_retained_tail(spark):
    df = spark.createDataFrame([("a", i, 100) for i in range(10)] + [("b", i, 1) for i in range(10)] + [(None, 1, 5)], "k string, at long, tokens long")
    rows = retained_tail(df.filter("k is not null"), ["k"], ["at"], "tokens", 400).collect()
    assert {(r.k, r.at) for r in rows if r.archive} == {("a", i) for i in range(6)} and len(rows) == 20


def test_glob_classes(spark):
    cases = [("src/a1.ts", "src/[a-c][0-9].ts", True), ("src/d1.ts", "src/[a-c][0-9].ts", False), ("src/x.ts", "src/[!a-c].ts", True), ("src/a.ts", "src/[!a-c].ts", False), ("a/b", "a[!x]b", False), ("a[b", "a[b", True), ("a[]b", "a[]b", True), ("x]", "[]]", False), ("^", "[^]", True)]
    for path, glob, want in cases:
        assert spark.range(1).select(matches_glob(F.lit(path), glob)).first()[0] is want, (path, glob)


def test_intermediate_tables_go_when_the_result_is_settled(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    spark.range(3).write.parquet(path)
    before = set(_scratch)
    df = settled(spark, "sum", lambda: written(spark.range(10), "one").join(stored_table(spark, "kept", [path], lambda: spark.read.parquet(path)), "id").agg(F.sum("id").alias("s")))
    assert df.first().s == 3
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(_scratch) - before}
    assert left == {"sum", "kept"}
