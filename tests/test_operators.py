import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from lodestrata.functions.keys import fingerprint
from lodestrata.functions.text import expand_identifier, glob_regex, has_all_prefixes, has_any_prefix, has_phrase, query_terms, token_estimate, tokens
from lodestrata.functions.vectors import cosine
from lodestrata.operators import corpus, facts, graph, history, rollups
from lodestrata.operators.diff import keyed_diff
from lodestrata.operators.search import bm25, postings, ranked, reciprocal_rank_fusion
from lodestrata.plans import codebase
from lodestrata.plans.router import plan_investigation, route_question, run_batch


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(1).alias("__x")).select(column.alias("r")).first().r


def test_tokens_and_predicates(spark):
    assert one(spark, tokens(F.col("t")), t="Load_Row, 2x É") == ["load_row", "2x"] and query_terms("A row, a ROW x2") == ["row", "x2"]
    assert one(spark, expand_identifier(F.col("t")), t="loadHTTPRow2_next.ts") == "load HTTP Row 2 next ts"
    found = tokens(F.lit("the token budget of rows"))
    assert one(spark, has_all_prefixes(found, ["tok", "row"])) and not one(spark, has_all_prefixes(found, ["tok", "zz"])) and not one(spark, has_all_prefixes(found, []))
    assert one(spark, has_any_prefix(found, ["zz", "bud"])) and not one(spark, has_any_prefix(found, []))
    assert one(spark, has_phrase(found, ["token", "budget"])) and not one(spark, has_phrase(found, ["budget", "token"]))
    assert one(spark, token_estimate(F.lit("12345"))) == 2 and one(spark, token_estimate(F.lit(None).cast("string"))) == 0
    assert glob_regex("**/a?.ts") == r"^(?:.*/)?a[^/]\.ts$"


def test_cosine_and_fingerprint(spark):
    v = lambda *x: F.array(*map(F.lit, map(float, x)))
    assert one(spark, cosine(v(1, 0), v(1, 1))) == pytest.approx(0.70710678) and one(spark, cosine(v(0, 0), v(1, 1))) == 0 and one(spark, cosine(v(1), v(1, 1))) is None
    assert one(spark, fingerprint(F.lit("a"), F.lit(None).cast("string"))) != one(spark, fingerprint(F.lit("a"), F.lit("")))


def test_search_cases(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, "b")], "id long, text string")
    assert {(r.term, r.id): r.tf for r in postings(df, "id", F.col("text")).collect()} == {("a", 1): 2, ("b", 1): 1, ("b", 3): 1}
    assert bm25(df, [], F.col("text"), ["id"]).count() == 0 and [r.id for r in bm25(df, ["a"], F.col("text"), ["id"]).collect()] == [1]
    with pytest.raises(ValueError):
        ranked(df, F.col("id"))
    lists = [spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int"), spark.createDataFrame([("y", 1)], "id string, rank int")]
    assert {r.id: round(r.score, 6) for r in reciprocal_rank_fusion(lists, "id").collect()} == {"x": round(1 / 61, 6), "y": round(1 / 62 + 1 / 61, 6)}


def test_filters_and_rollups(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "p"), ("a", 3, "p")], "k string, n int, p string")
    assert rollups.window_filter(df, k="a", n__since=2).count() == 1 and rollups.window_filter(df, k=None, p__is=None).count() == 1 and rollups.window_filter(df, k__in=["a"], n__until=1).count() == 1
    assert {r.k: r.c for r in rollups.zero_filled(df.groupBy("k").agg(F.count("*").alias("c")), "k", ["a", "z"], ["c"]).collect()} == {"a": 2, "z": 0}
    assert rollups.index_percentile(df, ["k"], "n", 0.95).filter("k = 'a'").first().value == 3
    assert one(spark, rollups.rate(F.lit(1), F.lit(0))) is None


def test_budget_folds(spark):
    df = spark.createDataFrame([("k", i, c, 3) for i, c in enumerate([50, 500, 40, 4], 1)], "k string, rank int, cost int, header int")
    r = history.skipping_budget(df, ["k"], "rank", "cost", "header", 100).first()
    assert (r.full, r.headers, r.used) == ([1, 3, 4], [2], 97)
    kept = history.budget_prefix(df, ["k"], [F.col("rank")], "cost", 100).collect()
    assert [r["rank"] for r in kept] == [1]
    assert [r["rank"] for r in history.budget_prefix(df.withColumn("cost", F.lit(1000)), ["k"], [F.col("rank")], "cost", 100).collect()] == [1]


def test_diff_with_nulls(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "q"), (3, "z", "r")], "k long, v string, w string")
    b = spark.createDataFrame([(1, "x", None), (2, "y", None), (4, "n", "s")], "k long, v string, w string")
    assert {r.k: (r.status, r.changed_columns) for r in keyed_diff(a, b, ["k"], ["v", "w"]).collect()} == {1: ("same", ""), 2: ("changed", "w"), 3: ("only_left", ""), 4: ("only_right", "")}


def test_graph_walks(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "x"), ("a", "b")], "src string, dst string")
    seed = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.depth for r in graph.reachable(e, seed).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4}
    assert graph.shortest_path(e, "a", "e").first().path == "a>b>c>d>e" and graph.shortest_path(e, "e", "a").first().reason == "disconnected" and graph.shortest_path(e, "a", "e", 2).first().reason == "depth_exceeded"
    assert {r.node: r.component for r in graph.strongly_connected(e).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x"}
    assert {r.cycle for r in graph.short_cycles(e).collect()} == {"a>b>c"}
    assert graph.strongly_connected(e.filter("src = 'd'")).count() == 0
    assert {r.node: (r.fan_in, r.fan_out) for r in graph.degrees(e).collect()}["c"] == (1, 2)


@pytest.mark.parametrize("imports", [1, 3, 7])
def test_shortest_path_over_edges_of_any_count(spark, tmp_path, imports):
    texts = {"probe": "import { a } from './lease'\n" * imports, "lease": "import { b } from './tenant'\n" * imports}
    files = [(i, f"mosaic-00001/src/{name}.ts", "typescript") for i, name in enumerate(texts)]
    spark.createDataFrame(files, "file_id long, path string, language string").write.parquet(str(tmp_path / "files.parquet"))
    spark.createDataFrame([(i, "file", x) for i, x in enumerate(texts.values())], "file_id long, chunk_kind string, content string").write.parquet(str(tmp_path / "chunks.parquet"))
    assert tuple(codebase.graph_shortest_path(spark, str(tmp_path)).first()) == (True, 2, "mosaic-00001/probe>mosaic-00001/lease>mosaic-00001/tenant", "found")
    assert differences(spark, connect(tmp_path), str(tmp_path), codebase.graph_shortest_path, codebase.ORACLES["graph_shortest_path"]) is None


def test_lifecycle_cases(spark):
    prior = spark.createDataFrame([("f1", "a", "active"), ("f2", "a", "active"), ("f3", "b", "active"), ("f4", "a", "resolved"), ("f5", "a", "suppressed")], "f string, s string, status string")
    new = spark.createDataFrame([("f1", "a"), ("f4", "a"), ("f5", "a"), ("f6", "a"), ("f6", "a")], "f string, s string")
    scope = spark.createDataFrame([("a",)], "s string")
    got = {r.f: (r.status, r.event) for r in facts.lifecycle(prior, new, scope, "f", "s").collect()}
    assert got == {"f1": ("active", "updated"), "f2": ("resolved", "resolved"), "f3": ("active", None), "f4": ("active", "reopened"), "f5": ("suppressed", "updated"), "f6": ("active", "created")}


def test_assertions(spark):
    v = lambda k, e, a, t=0.0: one(spark, facts.assertion_verdict(F.lit(k), F.lit(e), F.lit(a).cast("string"), t))
    assert [v("includes", "b", "aBc"), v("excludes", "b", "abc"), v("equals", "5", "6", 1), v("equals", "5", None), v("?", "a", "a")] == ["pass", "miss", "partial", "errored", "errored"]


def test_scan_and_chunks(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.ts").write_text("export function f() {\n  return 1;\n}\n")
    (tmp_path / "src" / "b.bin").write_bytes(b"\x00\xff")
    (tmp_path / "src" / "c.js").write_bytes(b"\xff\xfe")
    (tmp_path / "src" / "big.ts").write_text("x" * (corpus.MAX_FILE_BYTES + 1))
    (tmp_path / "node_modules" / "d.js").write_text("x")
    files = corpus.scan_tree(spark, f"file://{tmp_path}")
    row = files.collect()
    assert [(r.path, r.language, r.line_count) for r in row] == [("src/a.ts", "typescript", 3)]
    assert corpus.scan_tree(spark, f"file://{tmp_path}", ["src/zz.ts"]).count() == 0
    with pytest.raises(ValueError):
        corpus.scan_tree(spark, f"file://{tmp_path}", ["../x"])
    symbols = spark.createDataFrame([("src/a.ts", "f", 1, 2), ("src/a.ts", "g", None, 2)], "path string, name string, line_start long, line_end long")
    got = {(r.chunk_kind, r.name): r.content for r in corpus.chunk_files(files, symbols).collect()}
    assert got[("symbol", "f")] == "export function f() {\n  return 1;" and len(got) == 2


def test_extraction(spark):
    t = spark.createDataFrame([("a.ts", 'import type { A, B as C } from "./a";\nexport * from "../b.js";\nimport x from "pkg";\nexport const q = 1;\n'), ("n", None)], "path string, content string")
    rows = {(r.specifier, r.kind, r.type_only, tuple(r.names)) for r in corpus.import_records(t, ["path"]).collect()}
    assert rows == {("./a", "relative", True, ("A", "B as C")), ("../b.js", "reexport", False, ()), ("pkg", "package", False, ())}
    assert [(r.kind, r.name) for r in corpus.exported_symbols(t, ["path"]).collect()] == [("const", "q")]
    s = spark.createDataFrame([("a.sql", "-- from hidden\nselect 'from x' from app.t join U on 1=1; delete from only v")], "path string, content string")
    assert {r.table_name for r in corpus.table_references(s, ["path"]).collect()} == {"app.t", "public.u"}


def test_chunks_hold_whole_texts(spark, tmp_path):
    long = "\n".join(f"line {i} " + "x" * 50 for i in range(11_000))
    (tmp_path / "long.ts").write_text(long)
    assert len(long) > corpus.MAX_FILE_BYTES and corpus.scan_tree(spark, f"file://{tmp_path}").count() == 0
    files = corpus.scan_tree(spark, f"file://{tmp_path}", max_bytes=None)
    symbols = spark.createDataFrame([("long.ts", "f", 2, 10_000)], "path string, name string, line_start int, line_end int")
    got = {r.chunk_kind: r.content for r in corpus.chunk_files(files, symbols).collect()}
    assert got == {"file": long, "symbol": "\n".join(long.split("\n")[1:10_000])}


def test_router():
    assert route_question("Which file imports this?")[0] == "where_used" and route_question("hello") == ("free_form", 0.2)
    assert plan_investigation("is there an error", ["a", "b"]) == ["graph_shortest_path", "open_loops"] and plan_investigation("hello", []) == ["unsupported"]
    with pytest.raises(ValueError):
        run_batch({"where_used": None}, ["where_used", "drop_all"], None, "")
