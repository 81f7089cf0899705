"""Parent-child rows to full hierarchies by fragment contraction.

Method.  Rows are brought together by a *locality* key (for messages: the session and a block of
ordinals), so that most parents lie in the same partition as their children.  Each partition
contracts its parent chains on its own: every node learns the topmost node it reaches inside the
partition (its *fragment top*), the path from there, and the fragment's *exit* (the top's parent
outside the partition).  Fragments with an exit form a much smaller *quotient forest*, which is
solved by the same step, recursively.  Its solution is then joined back and the fragment paths are
expanded.  A cycle is either local (seen inside one partition) or global: a cycle of the quotient,
whose edges carry the original nodes they contracted.

Scale.  Each level is one shuffle of its nodes, and the quotient holds only links that leave a
fragment.  A task contracts ``HELD`` rows at a time (any set of nodes may be contracted on its own, sorting by the
locality key only brings kin together), and cuts fragments at ``LONGEST`` links, so that neither rows nor paths held grow
with the data.  A quotient above ``single_task_rows`` rows or ``SINGLE_TASK_IDS`` path entries is contracted again with keys that
bring random parent-child pairs together, which removes a quarter of the nodes or more at each level in
expectation; only below these bounds does one task finish it.  Nothing is collected to the driver
but counts.  No group is ever gathered whole: a hot session is cut into blocks by the locality key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.runtime import settled, shuffle_tasks, written

TREE, CYCLE, BELOW = 0, 1, 2
_FRAGMENT = "id string, hop array<string>, top string, exit string, lprefix array<string>, state int"
_ARROW = pa.schema([("id", pa.string()), ("hop", pa.list_(pa.string())), ("top", pa.string()), ("exit", pa.string()), ("lprefix", pa.list_(pa.string())), ("state", pa.int32())])
#: Rows that a task contracts at a time, links of a fragment's path, and path entries that one task may finish.
HELD, LONGEST, SINGLE_TASK_IDS = 50_000, 256, 4_000_000
#: Rows that one task finishes however long their paths are, and path entries in a batch that leaves a task.
FEW_ROWS, _IDS_OUT = 1000, 100_000


def contract(ids: list, parents: list, hops: list, pre: list, longest: int | None = None) -> Iterator[tuple]:
    """Contracts the chains of a set of nodes.

    ``hops[i]`` holds the original ids that the link from node ``i`` to its parent stands for.
    Yields ``(index, top index, exit, local prefix, state)``; the exit is None unless the node is
    a top with a parent that is not in the set, or is cut off ``longest`` links below a top.  Each node is settled once.
    """
    at = {x: i for i, x in enumerate(ids)}
    n = len(ids)
    up = [at.get(p, -1) if p is not None and not f else -1 for p, f in zip(parents, pre)]
    top = [-1] * n
    state = [TREE] * n
    below = [0] * n  # links to the top
    for i in range(n):
        if top[i] >= 0:
            continue
        chain, j = [], i
        while j >= 0 and top[j] == -1:
            top[j] = -2  # on the chain that is being walked
            chain.append(j)
            j = up[j]
        if j >= 0 and top[j] == -2:  # the chain runs into itself
            k = chain.index(j)
            for x in chain[k:]:
                top[x], state[x] = x, CYCLE
            for x in chain[:k]:
                top[x], state[x] = x, BELOW
            continue
        for x in reversed(chain):
            above = up[x]
            if above < 0:
                top[x], state[x] = chain[-1], BELOW if pre[x] else TREE
            elif state[above] != TREE:
                top[x], state[x] = x, BELOW
            elif longest and below[above] + 1 >= longest:
                top[x] = x
            else:
                top[x], below[x] = top[above], below[above] + 1
    for i in range(n):
        if state[i] != TREE:
            yield i, i, None, [], state[i]
            continue
        parts, j = [], i
        while j != top[i]:
            parts.append(hops[j])
            j = up[j]
        prefix = [x for hop in reversed(parts) for x in hop]
        yield i, top[i], parents[i] if top[i] == i and not pre[i] else None, prefix, TREE


def _contract_batches(longest: int | None, paths: bool):
    """The contraction of one task's rows, ``HELD`` at a time where fragments may be cut; without ``paths``, no prefixes."""

    def flush(ids: list, parents: list, hops: list, pre: list) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[] for _ in range(6)]
        size = 0
        for i, top, out, prefix, state in contract(ids, parents, hops, pre, longest):
            for column, value in zip(rows, (ids[i], hops[i], ids[top], out, prefix if paths else [], state)):
                column.append(value)
            size += 4 + len(hops[i]) + (len(prefix) if paths else 0)
            if size >= _IDS_OUT:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _ARROW)], schema=_ARROW)
                rows, size = [[] for _ in range(6)], 0
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _ARROW)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        for b in batches:
            for column, name in zip(held, ("id", "parent", "hop", "pre")):
                column += b.column(name).to_pylist()
            if longest and len(held[0]) >= HELD:
                yield from flush(*held)
                held = [[], [], [], []]
        if held[0]:
            yield from flush(*held)

    return run


def _solve(nodes: DataFrame, keys: list[Column], tasks: int, level: int, single_task_rows: int, paths: bool) -> tuple[DataFrame, DataFrame]:
    """(id, root, prefix, state) of each node, and the original ids that lie on cycles; without ``paths`` only the latter hold."""
    placed = nodes.repartition(tasks, *keys).sortWithinPartitions(*keys) if tasks > 1 else nodes.coalesce(1)
    # a task that finishes alone cuts nothing, and needs prefixes only for paths
    work = _contract_batches(LONGEST, True) if tasks > 1 else _contract_batches(None, paths)
    frag = written(placed.select("id", "parent", "hop", "pre").mapInArrow(work, _FRAGMENT), f"fragments-{level}")
    cycles = frag.filter(F.col("state") == CYCLE).select(F.explode("hop").alias("id"))
    alone = frag.select("id", F.when(F.col("state") == TREE, F.col("top")).alias("root"), F.col("lprefix").alias("prefix"), "state")
    if tasks == 1:
        return alone, cycles

    # written, so that its true size is known: as a small side it is broadcast and the fragments are not shuffled
    tops = written(frag.filter(F.col("exit").isNotNull()).select("id", "exit", "hop"), f"exits-{level}")
    # a semi join may broadcast its right side, so that only the fragments' ends are shuffled
    ends = frag.join(tops.select(F.col("exit").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("exit"), F.col("top").alias("q_parent"), F.col("lprefix").alias("q_prefix"), F.col("state").alias("q_state"))
    linked = tops.join(ends, "exit", "left").select(
        "id",
        F.when(F.col("q_state") == TREE, F.col("q_parent")).alias("parent"),
        F.when(F.col("q_state") == TREE, F.concat("q_prefix", "hop")).otherwise(F.array().cast("array<string>")).alias("hop"),
        F.coalesce(F.col("q_state") != TREE, F.lit(False)).alias("pre"),
    )
    quotient = written(linked, f"quotient-{level}")
    ends_here = quotient.filter("parent is not null").select(F.col("parent").alias("id")).distinct().join(quotient.select("id"), "id", "left_anti")
    quotient = quotient.unionByName(ends_here.select("id", F.lit(None).cast("string").alias("parent"), F.array().cast("array<string>").alias("hop"), F.lit(False).alias("pre")))
    size, entries = quotient.agg(F.count("*"), F.coalesce(F.sum(F.size("hop")), F.lit(0))).first()
    if not size:
        return alone, cycles
    few = size <= min(single_task_rows, FEW_ROWS) or (size <= single_task_rows and entries <= SINGLE_TASK_IDS)
    heads = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(2)) == 1
    pair = F.when(heads(F.col("parent")) & ~heads(F.col("id")), F.col("parent")).otherwise(F.col("id"))
    solved, more = _solve(quotient, [pair], 1 if few else max(2, -(-size // single_task_rows)), level + 1, single_task_rows, paths)
    if not paths:
        return alone, cycles.unionByName(more)
    solved = solved.select(F.col("id").alias("top"), F.col("root").alias("s_root"), F.col("prefix").alias("s_prefix"), F.col("state").alias("s_state"))
    joined = frag.join(solved, "top", "left")
    outer_cycle = F.coalesce(F.col("s_state"), F.lit(TREE)) != TREE
    full = joined.select(
        "id",
        F.when((F.col("state") == TREE) & ~outer_cycle, F.coalesce("s_root", "top")).alias("root"),
        F.when(F.col("s_prefix").isNull(), F.col("lprefix")).otherwise(F.concat("s_prefix", "lprefix")).alias("prefix"),
        F.when((F.col("state") == TREE) & outer_cycle, F.lit(BELOW)).otherwise(F.col("state")).alias("state"),
    )
    return full, cycles.unionByName(more)


def _nodes(df: DataFrame, id_col: str, parent_col: str, locality: list[Column]) -> tuple[DataFrame, list[Column]]:
    """One row per id (repeats and conflicts resolved) with its locality keys."""
    keyed = df.select(
        F.col(id_col).cast("string").alias("id"), F.col(parent_col).cast("string").alias("parent"), F.xxhash64(*locality).alias("key") if locality else F.xxhash64(F.col(id_col)).alias("key")
    ).filter("id is not null")
    # min over a struct keeps the row whole; a non-null parent wins over a null one
    one = keyed.groupBy("id").agg(F.min(F.struct(F.col("parent").isNull().alias("n"), "parent", "key")).alias("r"))
    nodes = one.select("id", "r.parent", F.when(F.col("r.parent").isNull(), F.array().cast("array<string>")).otherwise(F.array("r.parent")).alias("hop"), F.lit(False).alias("pre"), "r.key")
    return nodes, [F.col("key")]


def resolve_hierarchy(df: DataFrame, id_col: str, parent_col: str, locality: list[Column] | None = None, tasks: int | None = None, single_task_rows: int = 200_000) -> DataFrame:
    """One row per node: ``id, root_id, depth, path, state``.

    ``path`` runs from the root to the node itself and ``depth`` counts its links (a root has 0).
    ``state`` is ``tree``, ``cycle`` (its own ancestor) or ``below_cycle``; for the last two,
    root, depth and path are null.

    Defined cases: a parent that is null or has no row makes the node a root; exact repeats count
    once; of rows that share an id but differ, the one with the smallest non-null parent
    holds; rows with a null id cannot be nodes and are left out; an empty input gives an empty
    result.  Only the named columns are read, so extra columns with any name do no harm.
    """
    nodes, keys = _nodes(df, id_col, parent_col, locality or [])
    solved, cycles = _solve(nodes, keys, max(2, tasks or shuffle_tasks(df.sparkSession)), 0, single_task_rows, True)
    marked = solved.join(cycles.distinct().withColumn("on_cycle", F.lit(True)), "id", "left")
    tree = F.col("state") == TREE
    path = F.concat(F.col("prefix"), F.array("id"))
    return marked.select(
        "id",
        F.col("root").alias("root_id"),
        F.when(tree, F.size(path) - 1).alias("depth"),
        F.when(tree, path).alias("path"),
        F.when(tree, F.lit("tree")).when(F.col("on_cycle"), F.lit("cycle")).otherwise(F.lit("below_cycle")).alias("state"),
    )


def cycle_members(df: DataFrame, id_col: str, parent_col: str, locality: list[Column] | None = None, tasks: int | None = None, single_task_rows: int = 200_000) -> DataFrame:
    """The ids (column ``id``) that are their own ancestors; cases as in :func:`resolve_hierarchy`."""
    nodes, keys = _nodes(df, id_col, parent_col, locality or [])
    spark = df.sparkSession
    return settled(spark, "cycle-members", lambda: _solve(nodes, keys, max(2, tasks or shuffle_tasks(spark)), 0, single_task_rows, False)[1].distinct())


def descendants(resolved: DataFrame) -> DataFrame:
    """``ancestor_id, descendant_id, distance`` for all pairs of a resolved hierarchy.

    Exploded from each node's own path, so that a root with very many descendants is never one row
    or one task.  Nodes on or below cycles have no path and do not occur.
    """
    return resolved.filter("path is not null").select("id", "depth", F.posexplode("path").alias("pos", "ancestor_id")).filter(F.col("pos") < F.col("depth")).select("ancestor_id", F.col("id").alias("descendant_id"), (F.col("depth") - F.col("pos")).alias("distance"))
