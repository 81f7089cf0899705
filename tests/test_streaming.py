from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestrata.sources.store import SnapshotStore, append_operations, read_operations, sarif_document, sarif_file, sarif_results
from lodestrata.streaming.changes import affected, affected_nodes, apply_exactly_once, apply_to_store, change_sets, deduplicated, finding_lifecycle_stream, normalised_changes, refresh_scope, scoped_refresh, session_counts, windowed_counts

T0 = datetime(2025, 1, 1)
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def events(spark, seconds):
    return spark.createDataFrame([(i, T0 + timedelta(seconds=s), 1 + i % 2, "a" if i % 3 else "b", 1.0) for i, s in enumerate(seconds)], EVENTS)


def drain(df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def streamed(spark, tmp_path, df, parts=3):
    path = str(tmp_path / "in")
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_tumbling_stream_equals_batch(spark, tmp_path):
    df = events(spark, [*range(0, 3600, 37), 100_000])
    got = {(r.window_start, r.event_type): r.events for r in drain(windowed_counts(streamed(spark, tmp_path, df, 1), "ts", "event_type", "5 minutes", lateness="2 hours"), "tumbling").collect()}
    want = {(r.window_start, r.event_type): r.events for r in windowed_counts(df, "ts", "event_type", "5 minutes").collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) == len(want) - 1  # the last window stays open


def test_sessions_stream(spark, tmp_path):
    df = events(spark, [0, 2, 4, 60, 62, 100_000, 100_002])
    got = drain(session_counts(streamed(spark, tmp_path, df, 1), "ts", "user_id", "10 seconds", "1 hour"), "bursts").collect()
    want = session_counts(df, "ts", "user_id", "10 seconds").collect()
    assert {(r.user_id, r.burst_start) for r in got} <= {(r.user_id, r.burst_start) for r in want} and got


def test_duplicates_within_the_watermark(spark, tmp_path):
    df = events(spark, range(50)).unionByName(events(spark, range(50)))
    assert drain(deduplicated(streamed(spark, tmp_path, df), "event_id", "ts", "1 hour"), "deduped").count() == 50
    assert deduplicated(df, "event_id", "ts", "1 hour").count() == 50


def test_exactly_once_application(spark, tmp_path):
    df = events(spark, range(30))
    stream, seen, done = streamed(spark, tmp_path, df, 3), [], {2}
    apply_exactly_once(stream, lambda b, r: seen.append((r, b.count())), str(tmp_path / "ck"), done).awaitTermination()
    assert [r for r, _ in seen] == [1, 3] and done == {1, 2, 3}
    apply_exactly_once(stream, lambda b, r: seen.append((r, b.count())), str(tmp_path / "ck"), done).awaitTermination()
    assert len(seen) == 2


def test_lifecycle_state(spark, tmp_path):
    rows = [("f", 1, True), ("f", 2, True), ("f", 3, False), ("f", 4, True), ("g", 1, False), ("g", 2, True), ("f", 4, True)]
    df = spark.createDataFrame(rows, "fingerprint string, scan long, produced boolean")
    got = sorted((r.fingerprint, r.scan, r.event) for r in drain(finding_lifecycle_stream(streamed(spark, tmp_path, df, 1)), "lifecycle").collect())
    assert got == [("f", 1, "created"), ("f", 2, "updated"), ("f", 3, "resolved"), ("f", 4, "reopened"), ("g", 2, "created")]


def test_change_sets_close_by_gap_and_age(spark):
    df = events(spark, [0, 2, 4, 6, 100, 102, 104]).withColumn("user_id", F.lit(1))
    got = [(r.revision, r.events) for r in change_sets(df, ["user_id"], "ts", "event_id", 3, 5).orderBy("revision").collect()]
    assert got == [(1, 3), (2, 1), (3, 3)]


def test_refresh_scope_and_dependencies():
    assert refresh_scope(3) == ("paths", "path scoped") and refresh_scope(501)[0] == "full" and refresh_scope(1, schema_changed=True)[1] == "schema changed"
    assert affected_nodes({"b": ["a"], "c": ["b"], "d": []}, ["a"]) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        affected_nodes({"a": ["b"], "b": ["a"]}, ["a"])


def test_snapshot_store(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    first = store.replace(one)
    store.replace_keys(spark.createDataFrame([(2, "B"), (3, "c")], "k long, v string"), ["k"], spark.createDataFrame([(1, "x")], "k long, v string"))
    assert sorted(map(tuple, store.read().collect())) == [(2, "B"), (3, "c")] and store.read(first).count() == 2 and len(store.versions()) == 2
    calls = []

    def use(df):
        calls.append(df.count())
        if len(calls) == 1:
            store.replace(one)
        return calls[-1]

    assert store.stable_read(use) == 2 and len(calls) == 2


def test_operation_log_and_sarif(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    ops = spark.createDataFrame([(f"o{i}", "p", "index" if i % 2 else "scan", "info", "m", T0 + timedelta(seconds=i)) for i in range(6)], "operation_id string, project string, kind string, severity string, message string, at timestamp")
    append_operations(ops, path)
    append_operations(ops.limit(0), path)
    assert [r.operation_id for r in read_operations(spark, path, kind="index", since="2025-01-01 00:00:02", limit=1).collect()] == ["o5"]
    findings = spark.createDataFrame([("r", "warning", "a.ts", 3, "x \"y\"", "f")], "rule string, severity string, path string, line_no int, excerpt string, fingerprint string")
    assert '"ruleId":"r"' in sarif_results(findings).first().result
    sarif_document(findings, f"file://{tmp_path}/sarif")
    import glob
    import json

    text = "".join(open(p).read() for p in sorted(glob.glob(f"{tmp_path}/sarif/*/part-*.txt")))
    assert json.loads(text)["runs"][0]["results"][0]["level"] == "warning"


def rows_of(store):
    return sorted(map(tuple, store.read().collect()))


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    store.replace(spark.range(200).selectExpr("id as k", "'a' as v"), keys=["k"])
    before = store.manifest()["parts"]
    store.replace_keys(spark.createDataFrame([(7, "b")], "k long, v string"), ["k"])
    after = store.manifest()["parts"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(rows_of(store)) == 200 and (7, "b") in rows_of(store)
    store.mark_stale("sources changed")
    assert store.stale() == "sources changed"
    store.replace_keys(spark.createDataFrame([], "k long, v string"), ["k"], spark.range(200).withColumnRenamed("id", "k"))
    assert rows_of(store) == [] and store.stale() is None


def test_half_written_pointers_and_races(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    first = store.replace(spark.createDataFrame([(1, "a")], "k long, v string"), keys=["k"])
    (tmp_path / "store" / "CURRENT-000000002").write_text("v00")  # a writer that died
    assert store.current() == first and rows_of(store) == [(1, "a")]
    other = SnapshotStore(spark, f"file://{tmp_path}/store")
    inner, tried = store._write, []

    def slow(df, version, keys, partition_by=None):
        parts = inner(df, version, keys, partition_by)
        if not tried:
            tried.append(1)
            other.replace_keys(spark.createDataFrame([(2, "b")], "k long, v string"), ["k"])
        return parts

    store._write = slow
    store.replace_keys(spark.createDataFrame([(3, "c")], "k long, v string"), ["k"])
    assert rows_of(store) == [(1, "a"), (2, "b"), (3, "c")]


def test_a_killed_query_applies_no_batch_twice(spark, tmp_path):
    df = spark.createDataFrame([(i % 5, i) for i in range(30)], "k long, n long")
    stream, store = streamed(spark, tmp_path, df, 3), SnapshotStore(spark, f"file://{tmp_path}/store")
    inner, applied = store.replace_keys, []

    def dying(rows, keys, **kw):
        version = inner(rows, keys, **kw)
        applied.append(kw["revision"])
        if len(applied) == 2:
            raise RuntimeError("killed after the commit, before the batch was marked as done")
        return version

    store.replace_keys = dying
    with pytest.raises(Exception, match="killed"):
        apply_to_store(stream, store, ["k"], str(tmp_path / "ck"), "n").awaitTermination()
    fresh = SnapshotStore(spark, f"file://{tmp_path}/store")  # a new program knows only what is stored
    assert fresh.revision() == 2
    fresh.replace_keys = lambda rows, keys, **kw: applied.append(kw["revision"]) or SnapshotStore.replace_keys(fresh, rows, keys, **kw)
    apply_to_store(stream, fresh, ["k"], str(tmp_path / "ck"), "n").awaitTermination()
    assert applied == [1, 2, 3] and fresh.revision() == 3 and len(rows_of(fresh)) == 5


def test_scoped_refresh(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    texts = {"a": "1", "b": "2"}

    def scan(keys):
        df = spark.createDataFrame(list(texts.items()), "path string, text string")
        return df if keys is None else df.join(keys, "path", "left_semi")

    changes = lambda *rows: spark.createDataFrame(list(rows), "path string, deleted boolean")
    assert scoped_refresh(store, changes(), scan, ["path"]) == ("full", "never indexed")
    texts.update(a="9", b="8")
    assert scoped_refresh(store, changes(("a", False), ("b", True), ("zz", False)), scan, ["path"])[0] == "paths" and rows_of(store) == [("a", "9")]
    assert scoped_refresh(store, changes(("a", False)), scan, ["path"], schema_changed=True)[0] == "full" and len(rows_of(store)) == 2


def test_affected_nodes_as_tables(spark):
    deps = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "c"), ("x", "y")], "node string, needs string")
    seed = spark.createDataFrame([("a",)], "node string")
    assert sorted(map(tuple, affected(deps, seed).collect())) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    with pytest.raises(ValueError):
        affected(spark.createDataFrame([("a", "b"), ("b", "a")], "node string, needs string"), seed)


def test_sarif_is_one_file(spark, tmp_path):
    import json

    findings = spark.createDataFrame([("r", "warning", f"a{i}.ts", i, "x", f"f{i}") for i in range(20)], "rule string, severity string, path string, line_no int, excerpt string, fingerprint string").repartition(3)
    sarif_file(findings, f"file://{tmp_path}/out.sarif")
    results = json.loads((tmp_path / "out.sarif").read_text())["runs"][0]["results"]
    assert sorted(r["partialFingerprints"]["primary"] for r in results if r) == sorted(f"f{i}" for i in range(20))


def test_paths_of_changes_in_one_form(spark):
    df = spark.createDataFrame([(x,) for x in ("/r/a/b.ts", "./a//c.ts", "a\\d.ts", "/r/../x", "/else/x", None, "node_modules/x.js", "/r/a/./e.ts/", "")], "path string")
    got = [r.path for r in normalised_changes(df, "path", ("node_modules/**",), "/r/").collect()]
    assert got == ["a/b.ts", "a/c.ts", "a/d.ts", "a/e.ts"]
