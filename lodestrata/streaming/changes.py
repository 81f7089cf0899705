"""Change events as streams: windows, change sets with revisions, exactly-once application, lifecycles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from lodestrata.functions.text import matches_glob
from lodestrata.operators.graph import reachable
from lodestrata.operators.search import best_per_key
from lodestrata.runtime import written
from lodestrata.sources.store import SnapshotStore

DEBOUNCE, MAX_DELAY = "3 seconds", 60
MAX_PATHS = 500


def windowed_counts(events: DataFrame, time: str, key: str, size: str, slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Counts a tumbling or sliding window and key; on a stream, late rows count until the watermark passes."""
    marked = events.withWatermark(time, lateness) if events.isStreaming else events
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return marked.groupBy(w.alias("w"), key).agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "events", "value")


def session_counts(events: DataFrame, time: str, key: str, gap: str, lateness: str = "10 minutes") -> DataFrame:
    """Bursts of a key: rows less than ``gap`` apart."""
    marked = events.withWatermark(time, lateness) if events.isStreaming else events
    return marked.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), "events")


def deduplicated(events: DataFrame, key: str, time: str, lateness: str) -> DataFrame:
    """Each event once, however often it is delivered within the lateness."""
    if events.isStreaming:
        return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def normalised_changes(events: DataFrame, path: str, ignored: tuple[str, ...] = (), root: str | None = None) -> DataFrame:
    """Events with their path in one form: forward slashes, no ``.`` or empty segments, relative to ``root``.

    Paths that climb out of the root, lie outside of it, are null or match an ignored glob are left out; works on streams.
    """
    p = F.regexp_replace(F.regexp_replace(F.col(path), r"\\", "/"), r"(?:(?<=^)|(?<=/))(?:\./)+|(?<=/)/+", "")
    if root is not None:
        base = root.rstrip("/") + "/"
        p = F.when(p.startswith(base), F.substring(p, len(base) + 1, 1_000_000)).when(~p.startswith("/"), p)
    kept = events.withColumn(path, F.regexp_replace(p, "/+$", "")).filter(F.col(path).isNotNull() & (F.col(path) != "") & ~F.col(path).rlike(r"(?:^|/)\.\.(?:/|$)") & ~F.col(path).startswith("/"))
    for glob in ignored:
        kept = kept.filter(~matches_glob(F.col(path), glob))
    return kept


def change_sets(events: DataFrame, keys: list[str], time: str, tie: str, gap_seconds: float, max_seconds: float = MAX_DELAY) -> DataFrame:
    """Batch form of the micro-batches: events of a key closer than the gap form one change set, and a set older
    than ``max_seconds`` is closed at that age; sets are numbered as revisions from 1."""
    w = Window.partitionBy(*keys).orderBy(time, tie)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    rows = events.withColumn("__us", at).withColumn("__gap", F.col("__us") - F.lag("__us").over(w))
    burst = F.sum(F.when(F.col("__gap").isNull() | (F.col("__gap") > gap_seconds * 1e6), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__burst", burst).withColumn("__age", F.floor((F.col("__us") - F.min("__us").over(Window.partitionBy(*keys, "__burst"))) / int(max_seconds * 1e6)))
    sets = rows.groupBy(*keys, "__burst", "__age").agg(F.count("*").alias("events"), F.min(time).alias("first_at"), F.max(time).alias("last_at"))
    return sets.withColumn("revision", F.row_number().over(Window.partitionBy(*keys).orderBy("__burst", "__age"))).drop("__burst", "__age")


def refresh_scope(paths: int, schema_changed: bool = False, config_changed: bool = False, generated_changed: bool = False, deleted_with_dependents: bool = False, exports_changed: bool = False, indexed: bool = True, max_paths: int = MAX_PATHS) -> tuple[str, str]:
    """(``full`` or ``paths``, reason): whether a change set may be applied path by path."""
    reasons = ((not indexed, "never indexed"), (schema_changed, "schema changed"), (config_changed, "configuration changed"), (generated_changed, "generated sources changed"), (deleted_with_dependents, "deleted file has dependents"), (exports_changed, "exports changed"), (paths > max_paths, "too many paths"))
    return next((("full", why) for hit, why in reasons if hit), ("paths", "path scoped"))


def affected_nodes(dependencies: dict[str, list[str]], changed: list[str]) -> list[str]:
    """Calculation nodes to run again, in order of dependence; a cycle is an error."""
    users: dict[str, list[str]] = {}
    for node, needs in dependencies.items():
        for n in needs:
            users.setdefault(n, []).append(node)
    hit, todo = set(changed), list(changed)
    while todo:
        for u in users.get(todo.pop(), []):
            if u not in hit:
                hit.add(u)
                todo.append(u)
    order: list[str] = []
    left = set(hit)
    while left:
        ready = sorted(n for n in left if not any(m in left for m in dependencies.get(n, [])))
        if not ready:
            raise ValueError("calculation nodes depend on each other: " + ", ".join(sorted(left)))
        order += ready
        left -= set(ready)
    return order


def apply_exactly_once(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, applied: set[int] | None = None, max_files: int | None = None):  # noqa: ANN201
    """Starts a query that applies each micro-batch as one revision (its batch id plus 1).

    After a failure Spark repeats the last batch with the same id; a revision in ``applied`` is skipped, so that
    a repeated batch changes nothing.
    """
    done = set() if applied is None else applied

    def step(batch: DataFrame, batch_id: int) -> None:
        if batch_id + 1 in done:
            return
        apply(batch, batch_id + 1)
        done.add(batch_id + 1)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_to_store(stream: DataFrame, store: SnapshotStore, keys: list[str], checkpoint: str, time: str | None = None):  # noqa: ANN201
    """Applies each micro-batch to a keyed table exactly once, whatever fails when.

    The revision (batch id plus 1) is part of the version that the batch makes, and both become current with one pointer: a batch
    that is repeated after a failure finds its revision there and changes nothing.  Of several rows of a key in a batch the latest by ``time`` holds.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        if store.revision() >= batch_id + 1:
            return
        rows = best_per_key(batch, keys, F.col(time).desc()) if time else batch.dropDuplicates(keys)
        store.replace_keys(rows, keys, revision=batch_id + 1)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scoped_refresh(store: SnapshotStore, changes: DataFrame, scan: Callable[[DataFrame | None], DataFrame], keys: list[str], **signals: bool) -> tuple[str, str]:
    """Brings a table up to date after a change set, path by path where :func:`refresh_scope` allows it, else whole.

    ``changes`` has the keys and ``deleted``; ``scan`` gives the rows of the given keys, or all rows for None.  Returns the scope and its reason.
    """
    latest = changes.groupBy(*keys).agg(F.max("deleted").alias("deleted"))
    paths = latest.count()
    scope, reason = refresh_scope(paths, indexed=store.current() is not None, **signals)
    if scope == "full":
        store.replace(scan(None), keys=keys)
    elif paths:
        present = latest.filter("not deleted").select(*keys)
        store.replace_keys(scan(present), keys, latest.select(*keys))
    return scope, reason


def affected(dependencies: DataFrame, changed: DataFrame) -> DataFrame:
    """``node, depth`` of the calculation nodes to run again, from ``node, needs`` rows and changed nodes (column ``node``).

    ``depth`` is the longest way from a change, so that running by depth respects every dependence.  A cycle among them is an error.
    """
    edges = dependencies.select(F.col("needs").alias("src"), F.col("node").alias("dst")).distinct()
    reach = reachable(edges, changed)
    inside = written(edges.join(reach.select(F.col("node").alias("src")), "src").join(reach.select(F.col("node").alias("dst")), "dst").select("src", "dst"), "affected-edges")
    total, order, left = reach.count(), None, written(reach.select("node"), "affected-left")
    for depth in range(total + 1):
        waiting = inside.join(left.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        ready = written(left.join(waiting, "node", "left_anti").select("node", F.lit(depth).alias("depth")), "affected-ready")
        if not ready.head(1):
            if left.head(1):
                raise ValueError("calculation nodes depend on each other")
            break
        order = ready if order is None else order.unionByName(ready)
        left = written(left.join(ready.select("node"), "node", "left_anti"), "affected-left")
    return order if order is not None else reach


_STATE = "status string, scans int"
_EVENTS = "fingerprint string, event string, scan long"


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, scans = state.get if state.exists else (None, 0)
    rows = pd.concat(list(frames)).sort_values("scan").drop_duplicates("scan")
    out = []
    for scan, produced in zip(rows["scan"], rows["produced"]):
        scans += 1
        event = ("created" if status is None else "reopened" if status == "resolved" else "updated") if produced else ("resolved" if status == "active" else None)
        status = "active" if produced else ("resolved" if status == "active" else status)
        if event:
            out.append((key[0], event, scan))
    state.update((status, scans))
    yield pd.DataFrame(out, columns=["fingerprint", "event", "scan"])


def finding_lifecycle_stream(observations: DataFrame) -> DataFrame:
    """Events of findings from a stream of ``fingerprint, scan, produced`` rows, kept as keyed state."""
    return observations.groupBy("fingerprint").applyInPandasWithState(_advance, _EVENTS, _STATE, "append", GroupStateTimeout.NoTimeout)


def reusable_artifacts(wanted: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to compute, to tag): wanted ``content_hash, kind, extractor_version`` rows without and with a stored artifact.

    The anti join comes before the expensive extraction, which so runs once for each content.
    """
    key = ["content_hash", "kind", "extractor_version"]
    have = stored.select(*key).distinct()
    return wanted.join(have, key, "left_anti").dropDuplicates(key), wanted.join(have, key, "left_semi")
