import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators.hierarchy import TREE, contract, cycle_members, descendants, resolve_hierarchy


def brute(pairs):
    parent = {}
    for i, p in pairs:
        if i is not None and (i not in parent or parent[i] is None or (p is not None and p < parent[i])):
            parent[i] = p
    out = {}
    for i in parent:
        seen, x = [], i
        while x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        if x in seen:
            out[i] = ("cycle" if x == i else "below_cycle", None)
        else:
            out[i] = ("tree", list(reversed(seen)))
    return out


def check(spark, pairs, **kw):
    df = spark.createDataFrame(pairs, "message_id string, parent_id string")
    want = brute(pairs)
    rows = resolve_hierarchy(df, "message_id", "parent_id", **kw).collect()
    assert len(rows) == len(want)
    for r in rows:
        state, path = want[r.id]
        assert (r.state, r.path, r.root_id, r.depth) == (state, path, path and path[0], path and len(path) - 1), r
    assert {r.id for r in cycle_members(df, "message_id", "parent_id", **kw).collect()} == {i for i, (s, _) in want.items() if s == "cycle"}


def test_cases(spark):
    check(spark, [("a", None), ("b", "a"), ("b", "a"), ("c", "b"), ("d", "missing"), ("e", "e"), ("f", "e"), ("g", "h"), ("h", "g"), ("i", "g"), (None, "a"), ("k", "d")])


def test_empty(spark):
    check(spark, [])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_and_cycles_recursion(spark, seed):
    rnd = random.Random(seed)
    n = 200
    pairs = [(f"n{i}", None if rnd.random() < 0.05 else f"n{rnd.randrange(n + 5)}") for i in range(n)]
    # a bound this small forces several distributed levels before one task may finish
    check(spark, pairs, tasks=4, single_task_rows=60)


def test_long_chain_over_blocks(spark):
    pairs = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(400)]
    df = spark.createDataFrame([(i, p, int(i[1:])) for i, p in pairs], "message_id string, parent_id string, ordinal long")
    rows = {r.id: r for r in resolve_hierarchy(df, "message_id", "parent_id", [F.floor(F.col("ordinal") / 16)]).collect()}
    assert rows["n399"].depth == 399 and rows["n399"].root_id == "n0" and rows["n7"].path == [f"n{i}" for i in range(8)]


def test_descendants_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", None, "x", 1), ("b", "a", "y", 2), ("c", "b", None, 3)], "message_id string, parent_id string, id string, state int")
    got = {tuple(r) for r in descendants(resolve_hierarchy(df, "message_id", "parent_id")).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def test_fragments_are_cut_and_joined_again(spark):
    # one locality key, chains longer than a fragment may be, and a cycle with a tail of that kind
    n = 900
    pairs = [(f"n{i:04}", f"n{i - 1:04}" if i else None) for i in range(n)] + [(f"c{i:04}", f"c{(i - 1) % n:04}") for i in range(n)] + [(f"t{i:04}", f"t{i - 1:04}" if i else "c0003") for i in range(600)]
    check(spark, pairs, locality=[F.lit(1)])


def test_contraction_of_any_subset():
    ids, parents = ["b", "c", "d", "e"], ["a", "b", "c", "d"]
    hops = [[p] for p in parents]
    got = {ids[i]: (ids[t], out, prefix, state) for i, t, out, prefix, state in contract(ids, parents, hops, [False] * 4, 2)}
    assert got == {"b": ("b", "a", [], TREE), "c": ("b", None, ["b"], TREE), "d": ("d", "c", [], TREE), "e": ("d", None, ["d"], TREE)}
