"""Problem 3: hierarchies of message rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.hierarchy import cycle_members, descendants, resolve_hierarchy
from lodestrata.sources import load_table

#: Ordinals of one session that share a partition: a session of any size is cut into such blocks.
ORDINAL_BLOCK = 2048


def _input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "harness_messages").select("message_id", "parent_id", "session_id", "ordinal")


def _locality() -> list:
    return [F.col("session_id"), F.floor(F.col("ordinal") / ORDINAL_BLOCK)]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycle_members(_input(spark, sf_dir), "message_id", "parent_id", _locality()).select(F.col("id").alias("message_id"))


def p3_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_hierarchy(_input(spark, sf_dir), "message_id", "parent_id", _locality())
    return found.select(F.col("id").alias("message_id"), F.col("root_id").alias("root_message_id"), "depth", F.concat_ws("/", "path").alias("path"), "state")


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(resolve_hierarchy(_input(spark, sf_dir), "message_id", "parent_id", _locality()))


QUERIES = {"p3_found": p3_found, "p3_hierarchy": p3_hierarchy, "p3_descendants": p3_descendants}

_ROWS = "nodes as (select message_id as id, min(parent_id) as parent from harness_messages where message_id is not null group by 1)"
_WALK = f"""with recursive {_ROWS},
 walk as (select n.id, cast(0 as integer) as depth, n.id as root, n.id as path from nodes n left join nodes p on n.parent = p.id where p.id is null
          union all select n.id, w.depth + 1, w.root, w.path || '/' || n.id from walk w join nodes n on n.parent = w.id)"""
_CLOSE = f"""with recursive {_ROWS},
 peel as (select id from nodes where parent is null or parent not in (select id from nodes)
          union select n.id from peel p join nodes n on n.parent = p.id),
 knot as (select * from nodes where id not in (select id from peel)),
 reach as (select id, parent as up from knot union select r.id, k.parent from reach r join knot k on r.up = k.id)"""

ORACLES = {
    "p3_found": f"{_CLOSE} select distinct id as message_id from reach where id = up",
    "p3_hierarchy": f"""{_CLOSE}, walk as (select n.id, cast(0 as integer) as depth, n.id as root, n.id as path from nodes n left join nodes p on n.parent = p.id where p.id is null
          union all select n.id, w.depth + 1, w.root, w.path || '/' || n.id from walk w join nodes n on n.parent = w.id)
 select id as message_id, root as root_message_id, depth, path, 'tree' as state from walk
 union all select id, null, null, '', case when id in (select id from reach where id = up) then 'cycle' else 'below_cycle' end from knot""",
    "p3_descendants": f"{_WALK}, up as (select id as descendant_id, parent as ancestor_id, cast(1 as integer) as distance from nodes where parent in (select id from nodes) and id in (select id from walk) union all select u.descendant_id, n.parent, u.distance + 1 from up u join nodes n on u.ancestor_id = n.id where n.parent in (select id from nodes)) select ancestor_id, descendant_id, distance from up",
}
