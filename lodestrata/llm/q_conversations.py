"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.conversations import conversations, judged_sessions
from lodestrata.sources import load_table


def _tables(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [load_table(spark, sf_dir, t) for t in ("harness_sessions", "harness_messages", "harness_message_parts")]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_sessions(*_tables(spark, sf_dir)).filter("broken").select("session_id")


def p6_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(*_tables(spark, sf_dir))


QUERIES = {"p6_found": p6_found, "p6_conversations": p6_conversations}

_FOUND = r"""
with said as (select distinct message_id, part_id, ordinal as part_ordinal, json_extract_string(payload_json, '$.text') as text from harness_message_parts where kind = 'text'),
spoken as (select distinct message_id from said where regexp_matches(text, '[^\s\p{Z}]')),
m as (select distinct session_id, message_id, parent_id, ordinal, case when lower(trim(role)) in ('user', 'assistant', 'system', 'tool') then lower(trim(role)) end as role,
      message_id in (select message_id from spoken) as spoken from harness_messages where session_id is not null),
s as (select distinct session_id from harness_sessions where session_id is not null union select session_id from m),
marks as (select *, case when role = 'user' then 'u' when role = 'assistant' and spoken then 'a' end as mark from m),
nexts as (select session_id, mark, lead(mark) over (partition by session_id order by ordinal) as nxt from marks where mark is not null),
openers as (select session_id, arg_min(coalesce(role, '?'), ordinal) as opener from m where role is null or role <> 'system' group by 1),
found as (
 select session_id from s where session_id not in (select session_id from harness_sessions where session_id is not null)
 union select session_id from s where session_id not in (select session_id from m where role in ('user', 'assistant') and spoken)
 union select session_id from m group by session_id, ordinal having count(distinct message_id) > 1
 union select session_id from m group by session_id having count(distinct ordinal) <> max(ordinal) + 1
 union select session_id from m where role is null
 union select session_id from s where session_id not in (select session_id from openers where opener = 'user')
 union select m.session_id from m left join m p on m.session_id = p.session_id and m.parent_id = p.message_id where m.parent_id is not null and (p.ordinal is null or p.ordinal >= m.ordinal)
 union select session_id from nexts where mark = 'u' and (nxt is null or nxt = 'u'))
"""
ORACLES = {
    "p6_found": f"{_FOUND} select session_id from found",
    "p6_conversations": f"""{_FOUND}, t as (select * from said where regexp_matches(text, '[^\\s\\p{{Z}}]'))
 select m.session_id, m.ordinal, m.message_id, m.role, t.part_ordinal, t.text from m left join t on m.message_id = t.message_id where m.session_id not in (select session_id from found)""",
}
