"""Property graphs as edge tables: derivation, bounded and unbounded traversal, components, degrees.

Edges are ``src, dst`` with whatever else.  Traversals keep a frontier and a visited set, both written to the
shared folder at each level, so that a level costs one join of the frontier with the edges and the
lineage stays one level deep.  The driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.search import best_per_key
from lodestrata.runtime import written


def merge_edges(*parts: DataFrame) -> DataFrame:
    """One row an edge ``src, dst, kind``, with the sorted set of its evidence; exact if any evidence is."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("src", "dst", "kind").agg(F.array_join(F.sort_array(F.collect_set("evidence")), ",").alias("evidence"), F.max("exact").alias("exact"))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(c for c in edges.columns if c not in ("src", "dst")))


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, with_path: bool = False) -> DataFrame:
    """``node, depth`` (and ``path``) of the nodes reached from the seeds (column ``node``), each at its least depth.

    Of several shortest paths, the one whose last step comes from the smallest node is kept.  Without
    ``max_depth`` the walk ends when a level is empty.
    """
    links = edges.select("src", "dst").distinct()
    extra = [F.array("node").alias("path")] if with_path else []
    visited = frontier = written(seeds.select("node").distinct().select("node", F.lit(0).alias("depth"), *extra), "walk-0")
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        steps = frontier.join(links, frontier.node == links.src).select(F.col("dst").alias("node"), F.col("src").alias("by"), *(["path"] if with_path else []))
        fresh = steps.join(visited.select("node"), "node", "left_anti")
        if with_path:
            new = best_per_key(fresh, ["node"], F.col("by")).select("node", F.lit(depth).alias("depth"), F.concat("path", F.array("node")).alias("path"))
        else:
            new = fresh.select("node").distinct().select("node", F.lit(depth).alias("depth"))
        frontier = written(new, f"walk-{depth}")
        if not frontier.head(1):
            break
        visited = visited.unionByName(frontier)
    return visited


def shortest_path(edges: DataFrame, source: str, target: str, max_depth: int = 12) -> DataFrame:
    """One row: ``found, hops, path, reason`` (``disconnected`` or ``depth_exceeded`` where none is found)."""
    spark = edges.sparkSession
    walk = reachable(edges, spark.createDataFrame([(source,)], "node string"), max_depth, with_path=True)
    best = walk.agg(F.max(F.when(F.col("node") == target, F.struct("depth", "path"))).alias("b"), F.max("depth").alias("deepest"))
    reason = F.when(F.col("b").isNotNull(), "found").when(F.col("deepest") >= max_depth, "depth_exceeded").otherwise("disconnected")
    return best.select(F.col("b").isNotNull().alias("found"), F.col("b.depth").alias("hops"), F.array_join("b.path", ">").alias("path"), reason.alias("reason"))


def degrees(edges: DataFrame) -> DataFrame:
    """``node, fan_in, fan_out, total, centrality`` over distinct edges between different nodes."""
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    # one aggregation of both ends instead of two that are joined
    ends = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return sums.withColumn("total", F.col("fan_in") + F.col("fan_out")).withColumn("centrality", F.round(2.0 * F.col("fan_in") + F.col("fan_out") + 0.1, 1))


def strongly_connected(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node) of the nodes that lie on cycles, self-loops included.

    Nodes without a way in or out are peeled off first.  Then, round by round, the smallest name spreads
    forwards until nothing changes; the nodes that reach its owner backwards, within the same name, are the
    owner's component and leave the graph.  Every round settles at least one component of each part.
    """
    e = written(edges.select("src", "dst").distinct(), "scc-edges")
    loops = e.filter("src = dst").select(F.col("src").alias("node"))
    e = e.filter("src <> dst")
    found: DataFrame | None = None
    while True:
        before = -1
        while True:  # peel
            size = e.count()
            if size in (0, before):
                break
            before = size
            e = written(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"), "scc-peeled")
        if not size:
            break
        colour = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("c", F.col("node"))
        colour, changed = written(colour, "scc-colour"), 1
        while changed:
            offers = e.join(colour.withColumnsRenamed({"node": "src"}), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("offer"))
            step = written(colour.join(offers, "node", "left").select("node", F.least("c", "offer").alias("n"), F.col("c").alias("old")), "scc-colour")
            changed = step.filter("n <> old").count()
            colour = step.select("node", F.col("n").alias("c"))
        inside = e.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst").filter("cs = cd").select("src", "dst")
        inside = written(inside, "scc-inside")
        back = reachable(reverse(inside), colour.filter("node = c").select("node"))
        part = written(back.select("node").join(colour, "node").select("node", F.col("c").alias("component")), "scc-part")
        sized = part.join(part.groupBy("component").count().filter("count > 1").select("component"), "component", "left_semi").select("node", "component")
        found = sized if found is None else found.unionByName(sized)
        gone = part.select("node")
        e = written(e.join(gone.withColumnsRenamed({"node": "src"}), "src", "left_anti").join(gone.withColumnsRenamed({"node": "dst"}), "dst", "left_anti").select("src", "dst"), "scc-rest")
    alone = loops.distinct().select("node", F.col("node").alias("component"))
    return alone if found is None else found.unionByName(alone.join(found.select("node"), "node", "left_anti"))


def short_cycles(edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """Cycles of two and three nodes as ``cycle``, each once, from its smallest node on.

    With ``components`` (of :func:`strongly_connected`) edges that lead out of one are left aside, as no cycle has any.
    Each cycle of three is found from its node of least degree: of a hub's edges only those to other hubs
    are paired, so that the pairs of edges stay within the edges times their root.
    """
    e = edges.filter("src <> dst").select("src", "dst").distinct()
    if components is not None:
        e = e.join(components.select(F.col("node").alias("src"), F.col("component").alias("__c")), "src").join(components.select(F.col("node").alias("dst"), F.col("component").alias("__d")), "dst").filter("__c = __d").select("src", "dst")
    e = written(e, "cycle-edges")
    degree = e.select(F.col("src").alias("node")).union(e.select("dst")).groupBy("node").agg(F.count("*").alias("n"))
    rank = F.struct("n", "node")
    o = e.join(degree.select(F.col("node").alias("src"), rank.alias("rs")), "src").join(degree.select(F.col("node").alias("dst"), rank.alias("rd")), "dst")
    two = e.alias("a").join(e.alias("b"), (F.col("a.dst") == F.col("b.src")) & (F.col("b.dst") == F.col("a.src"))).filter(F.col("a.src") < F.col("a.dst")).select(F.array("a.src", "a.dst").alias("nodes"))
    # x -> y and z -> x, with x the node of least rank, closed by y -> z
    out = o.filter("rs < rd").select(F.col("src").alias("x"), F.col("dst").alias("y"))
    into = o.filter("rd < rs").select(F.col("dst").alias("x"), F.col("src").alias("z"))
    open_ = out.join(into, "x").filter("y <> z")
    found = open_.join(e.select(F.col("src").alias("y"), F.col("dst").alias("z")), ["y", "z"])
    first = F.least("x", "y", "z")
    nodes = F.when(first == F.col("x"), F.array("x", "y", "z")).when(first == F.col("y"), F.array("y", "z", "x")).otherwise(F.array("z", "x", "y"))
    return two.unionByName(found.select(nodes.alias("nodes"))).select(F.array_join("nodes", ">").alias("cycle"), F.size("nodes").alias("length"))


def capped(df: DataFrame, keys: list[str], limit: int, *order: Column) -> DataFrame:
    """The first rows of each key for a report, with the full count beside them."""
    from lodestrata.operators.search import ranked

    total = df.groupBy(*keys).agg(F.count("*").alias("total"))
    return ranked(df, *order, within=keys, name="place", limit=limit).join(total, keys)
