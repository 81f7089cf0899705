import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestrata.llm.conversations import closed_blocks, conversations, judged_sessions, message_log, replayed

T0 = datetime(2025, 1, 1)
MESSAGES = "message_id string, session_id string, parent_id string, role string, ordinal long, created_at timestamp_ntz, extra string"
PARTS = "part_id string, message_id string, kind string, ordinal long, payload_json string"
SESSIONS = "session_id string, role string"


def frames(spark, sessions, known):
    """sessions: {id: [(ordinal, role, text, parent offset or id)]}"""
    rows, parts = [], []
    for s, turns in sessions.items():
        for k, (ordinal, role, text, parent) in enumerate(turns):
            rows.append((f"{s}-{k}", s, parent, role, ordinal, None if k % 3 == 2 else T0 + timedelta(hours=30 * k), "x"))
            if text is not None:
                parts.append((f"p{s}-{k}", f"{s}-{k}", "text", 0, json.dumps({"text": text})))
    rows += rows[:2]  # delivered twice
    parts += parts[:2]
    return spark.createDataFrame([(k, None) for k in known] + [(None, "x")], SESSIONS), spark.createDataFrame(rows, MESSAGES), spark.createDataFrame(parts, PARTS)


GOOD = [(0, " System", None, None), (1, "USER", "hi", "{s}-0"), (2, "tool", None, "{s}-1"), (3, "assistant ", "ho", "{s}-2"), (4, "user", "and", None), (5, "assistant", "so", "{s}-4")]


def fill(turns, s):
    return [(o, r, t, p and p.format(s=s)) for o, r, t, p in turns]


CASES = {
    "good": GOOD,
    "noreply": GOOD[:5],
    "blankreply": [*GOOD[:5], (5, "assistant", " \t\n", None)],
    "gap": [*GOOD[:4], (5, "user", "x", None), (6, "assistant", "y", None)],
    "twice": [*GOOD, (5, "assistant", "z", None)],
    "role": [*GOOD, (6, "bot", "z", None)],
    "nullrole": [*GOOD, (6, None, "z", None)],
    "opener": [(0, "assistant", "z", None), (1, "user", "a", None), (2, "assistant", "b", None)],
    "onlysystem": [(0, "system", "z", None)],
    "parentafter": [(0, "user", "a", "{s}-1"), (1, "assistant", "b", None)],
    "parentaway": [(0, "user", "a", None), (1, "assistant", "b", "good-0")],
    "parentself": [(0, "user", "a", None), (1, "assistant", "b", "{s}-1")],
    "overtaken": [(0, "user", "a", None), (1, "user", "b", None), (2, "assistant", "c", None)],
    "nullordinal": [*GOOD, (None, "tool", None, None)],
    "unknown": GOOD,
}


@pytest.mark.parametrize("block", [2, 2048])
def test_cases(spark, block):
    data = {s: fill(t, s) for s, t in CASES.items()}
    sessions, messages, parts = frames(spark, data, [*(s for s in CASES if s != "unknown"), "empty"])
    got = {r.session_id: r.broken for r in judged_sessions(sessions, messages, parts, block=block).collect()}
    assert got == {**{s: s != "good" for s in CASES}, "empty": True}


def test_turns_and_empty(spark):
    sessions, messages, parts = frames(spark, {"good": fill(GOOD, "good"), None: fill(GOOD, "n")}, ["good"])
    rows = conversations(sessions, messages, parts).orderBy("ordinal").collect()
    assert [(r.ordinal, r.role, r.text) for r in rows] == [(0, "system", None), (1, "user", "hi"), (2, "tool", None), (3, "assistant", "ho"), (4, "user", "and"), (5, "assistant", "so")]
    assert judged_sessions(sessions.limit(0), messages.limit(0), parts.limit(0)).count() == 0


def test_silence_splits_windows_but_loses_no_turn(spark):
    _, messages, parts = frames(spark, {"good": fill(GOOD, "good")}, [])
    blocks = closed_blocks(message_log(messages, parts)).collect()
    assert len(blocks) > 1 and sum(len(b.turns) for b in blocks) == len(GOOD)


def long_log(spark, n=60):
    """Sessions one after another; the last message of every third comes ten days late, every seventh has no time."""
    data = {f"s{i:02}": fill(GOOD if i % 4 else GOOD[:5], f"s{i:02}") for i in range(n)}
    _, messages, parts = frames(spark, data, [])
    start = F.make_timestamp(F.lit(2025), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("timestamp_ntz")
    i, k = F.substring("session_id", 2, 9).cast("int"), F.split("message_id", "-")[1].cast("int")
    late = F.when((i % 3 == 0) & (k == 4), F.expr("interval '10' day")).otherwise(F.expr("interval '0' day"))
    times = F.when((i % 7 == 0) & (k == 1), F.lit(None)).otherwise(start + F.make_dt_interval(hours=i * 6, mins=k) + late)
    return data, messages.withColumn("created_at", times), parts


def test_windows_close_before_the_end_and_late_rows_reopen_them(spark):
    data, messages, parts = long_log(spark)
    blocks, early = replayed(message_log(messages, parts), slices=5)
    rows = blocks.collect()
    assert early > len(data) / 2  # the watermark, not the end marker, closed them
    assert len({r.session_id for r in rows}) == len(data) < len(rows)
    assert sum(r.n for r in rows) == sum(len(t) for t in data.values())


def test_late_rows_over_batches_change_no_verdict(spark):
    data, messages, parts = long_log(spark)
    sessions = spark.createDataFrame([(s, None) for s in data], SESSIONS)
    got = {r.session_id: r.broken for r in judged_sessions(sessions, messages, parts, slices=5).collect()}
    assert got == {s: int(s[1:]) % 4 == 0 for s in data}


def test_a_watermark_behind_the_whole_log(spark):
    data, messages, parts = long_log(spark, 20)
    blocks, early = replayed(message_log(messages, parts), lateness=None)
    assert early == 0 and sum(r.n for r in blocks.collect()) == sum(len(t) for t in data.values())
