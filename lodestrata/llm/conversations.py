"""Conversations rebuilt from message rows (problem 6), on keyed streaming state.

The enriched messages form a log that a streaming query reads slice by slice in the order of event time, so many rows
a trigger that a micro-batch is bounded.  Its state, in RocksDB, is keyed by session and block of ordinals;
session windows over the event time buffer what arrives late.  When the watermark, which follows the newest event at a distance
of ``lateness``, passes the end of a window - the conversation has been silent for ``timeout`` - the stream validates its turns,
emits the verdict and drops the state.  An end marker closes what is still open.

A conversation that goes on after its window was closed comes out once more; the few such blocks are validated again from
all their turns.  The blocks of one session are then composed: each tells its turn count, first speaker, and whether
its last user still waits for a reply, so that a session of any size is never gathered in one task.  Only flags pass
through the state, never texts.  Rows without a time come last.  Should the store of the log not keep the order of its slices, so that the
watermark drops rows, the replay is done again with a watermark behind the whole log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.runtime import delete_path, new_path, settled, shuffle_tasks

ROLES = ("system", "user", "assistant", "tool")
#: Ordinals of one session that share a state key.
BLOCK = 2048
#: Silence after which a conversation counts as closed.
TIMEOUT = "1 day"
#: How far the watermark stays behind the newest event, micro-batches at least, and rows in one at most.
LATENESS, SLICES, BATCH_ROWS = "1 hour", 4, 5_000_000
_STATE = {
    "spark.sql.streaming.numRecentProgressUpdates": "10000",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
_NOT_BLANK = r"[^\s\p{Z}\x1c-\x1f\x85]"
_WRITTEN = "session_id string, ordinal long, block long, role int, spoken boolean, linked boolean, twice boolean, event_time timestamp"


def text_parts(parts: DataFrame) -> DataFrame:
    """``message_id, part_id, part_ordinal, text`` of the parts of kind text whose text is not blank."""
    said = parts.filter("kind = 'text' and message_id is not null").select("message_id", "part_id", F.col("ordinal").alias("part_ordinal"), F.get_json_object("payload_json", "$.text").alias("text"))
    return said.filter(F.col("text").rlike(_NOT_BLANK))


def clean_role() -> F.Column:
    """The role, trimmed and in lower case; null where it is none of :data:`ROLES`."""
    role = F.lower(F.regexp_replace("role", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(role.isin(*ROLES), role)


def message_log(messages: DataFrame, parts: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per session and ordinal, with what the validation needs to know.

    Rows without a session are left out.  Exact repeats fold to one row; two different messages with
    one ordinal fold to one row with ``twice`` set, however many they are.
    """
    rows = messages.filter("session_id is not null").select("session_id", "message_id", "parent_id", "ordinal", clean_role().alias("role"), F.col("created_at").cast("timestamp").alias("event_time"))
    spoken = text_parts(parts).select("message_id").distinct().withColumn("spoken", F.lit(True))
    parents = rows.groupBy("session_id", F.col("message_id").alias("parent_id")).agg(F.max("ordinal").alias("parent_ordinal"))
    code = F.expr("case role " + " ".join(f"when '{r}' then {i}" for i, r in enumerate(ROLES)) + " end")
    linked = F.col("parent_id").isNull() | F.coalesce(F.col("parent_ordinal") < F.col("ordinal"), F.lit(False))
    joined = rows.join(parents, ["session_id", "parent_id"], "left").join(spoken, "message_id", "left")
    facts = joined.select("session_id", "ordinal", "message_id", code.alias("role"), F.coalesce("spoken", F.lit(False)).alias("spoken"), linked.alias("linked"), "event_time")
    one = facts.groupBy("session_id", "ordinal").agg(
        F.min("message_id").alias("lo"),
        F.max("message_id").alias("hi"),
        F.max(F.col("message_id").isNull()).alias("nameless"),
        F.count("*").alias("n"),
        F.min_by(F.struct("role", "spoken", "linked"), F.col("message_id")).alias("r"),
        F.min("linked").alias("linked"),
        F.max("event_time").alias("event_time"),
    )
    twice = (F.col("lo") != F.col("hi")) | (F.col("nameless") & (F.col("n") > 1))
    return one.select(
        "session_id", "ordinal", F.coalesce(F.floor(F.col("ordinal") / block), F.lit(-1)).cast("long").alias("block"), F.col("r.role").cast("int").alias("role"), F.coalesce("r.spoken", F.lit(False)).alias("spoken"), "linked", F.coalesce(twice, F.lit(False)).alias("twice"), "event_time"
    )


def _judged(blocks: DataFrame) -> DataFrame:
    """The facts of each block by which its session is judged, from its ``turns``."""
    # one pass over the turns: (first role that is not system, first user or answer, a user waits, a user was passed over)
    told = F.expr("""aggregate(turns,
        named_struct('opener', cast(null as int), 'lead', cast(null as int), 'waits', false, 'passed', false),
        (a, t) -> named_struct(
            'opener', coalesce(a.opener, if(t.role = 0, null, coalesce(t.role, -1))),
            'lead', coalesce(a.lead, if(t.role = 1 or (t.role = 2 and t.spoken), t.role, null)),
            'waits', case when t.role = 1 then true when t.role = 2 and t.spoken then false else a.waits end,
            'passed', a.passed or (coalesce(t.role = 1, false) and a.waits)))""")
    return blocks.withColumn("turns", F.array_sort("turns")).select(
        "session_id",
        "block",
        F.size("turns").cast("long").alias("n"),
        F.array_max(F.expr("transform(turns, t -> t.ordinal)")).alias("hi"),
        F.expr("exists(turns, t -> t.twice or t.role is null or not t.linked or t.ordinal is null or t.ordinal < 0)").alias("bad"),
        F.expr("exists(turns, t -> t.spoken and t.role in (1, 2))").alias("said"),
        told.alias("told"),
        "turns",
    )


_CLOSED = (
    "session_id string, block long, n long, hi long, bad boolean, said boolean, told struct<opener: int, lead: int, waits: boolean, passed: boolean>,"
    " turns array<struct<ordinal: long, role: int, spoken: boolean, linked: boolean, twice: boolean>>"
)


def _drain(spark: SparkSession, blocks: DataFrame, out: str, state: str) -> tuple[int, int]:
    """Runs the stream over what its source holds now; the rows that the watermark dropped, and the windows it closed."""
    before = {name: spark.conf.get(name, None) for name in _STATE}
    try:
        for name, value in _STATE.items():
            spark.conf.set(name, value)
        query = blocks.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        done = [o for p in query.recentProgress for o in p.stateOperators]
        return sum(o.numRowsDroppedByWatermark for o in done), sum(o.numRowsRemoved for o in done)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def _in_order(spark: SparkSession, path: str) -> None:
    """Gives the files of a folder times in the order of their names, which is the order in which a stream takes them."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [f for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")]
    if not files:
        return
    first = min(f.getModificationTime() for f in files) - 1000 * len(files)
    for i, f in enumerate(sorted(files, key=lambda f: f.getPath().getName())):
        fs.setTimes(f.getPath(), first + 1000 * i, -1)


def replayed(log: DataFrame, timeout: str = TIMEOUT, lateness: str | None = LATENESS, times: DataFrame | None = None, slices: int = SLICES) -> tuple[DataFrame, int]:
    """Replays a message log through keyed streaming state: the facts and ``turns`` of closed windows, and how many closed before the log's end.

    A block whose messages lie more than ``timeout`` apart comes out in several rows.  ``times`` may name a cheaper table with
    the log's ``event_time``.
    """
    spark: SparkSession = log.sparkSession
    source, out, state = (new_path(spark, f"conversations-{x}") for x in ("log", "closed", "state"))
    micros = F.unix_micros("event_time")
    rows, first, last, marks = (times if times is not None else log).agg(F.count("*"), F.min("event_time"), F.max("event_time"), F.percentile_approx(micros, [i / 1024 for i in range(1, 1024)], 10_000)).first()
    slices = min(1024, max(slices, -(-rows // BATCH_ROWS)))
    edges = sorted({marks[i * 1024 // slices - 1] for i in range(1, slices)}) if marks else []
    width = shuffle_tasks(spark)
    last_text = f"timestamp '{last:%Y-%m-%d %H:%M:%S.%f}'" if last else "timestamp '1970-01-02 00:00:00'"
    timed = log.withColumn("event_time", F.coalesce("event_time", F.expr(last_text)))
    nth = F.expr(f"size(filter(array({', '.join(f'{e}L' for e in edges)}), e -> e < unix_micros(event_time)))") if edges else F.lit(0)
    timed.repartitionById(width * (len(edges) + 1), (nth * width + F.pmod(F.xxhash64("session_id", "block"), F.lit(width))).cast("int")).write.parquet(source)
    _in_order(spark, source)
    span = f"{int((last - first).total_seconds()) + 1 if last else 1} seconds"
    turn = F.struct("ordinal", "role", "spoken", "linked", "twice")

    def run(delay: str) -> tuple[int, int]:
        stream = spark.readStream.schema(_WRITTEN).option("maxFilesPerTrigger", width).parquet(source)
        blocks = _judged(stream.withWatermark("event_time", delay).groupBy("session_id", "block", F.session_window("event_time", timeout)).agg(F.collect_list(turn).alias("turns")))
        dropped, closed = _drain(spark, blocks, out, state)
        # the log is closed: a row after everything lifts the watermark over the end of all windows
        end = f"{last_text} + interval '{delay}' + interval '{timeout}' + interval '1 day'"
        marker = (F.lit(None).cast(kind).alias(name) if name != "event_time" else F.expr(end).alias(name) for name, kind in (c.split() for c in _WRITTEN.split(", ")))
        spark.range(1).select(*marker).coalesce(1).write.mode("append").parquet(source)
        return dropped + _drain(spark, blocks, out, state)[0], closed

    dropped, closed = run(lateness or span)
    if dropped:
        for path in (out, state):
            delete_path(spark, path)
        _, closed = run(span)
    delete_path(spark, source)
    delete_path(spark, state)
    return spark.read.schema(_CLOSED).parquet(out).filter("session_id is not null"), closed


def closed_blocks(log: DataFrame, **options) -> DataFrame:
    """The closed windows of :func:`replayed`."""
    return replayed(log, **options)[0]


def session_verdicts(closed: DataFrame) -> DataFrame:
    """``session_id, broken`` of each session with messages, composed from its closed blocks."""
    again = closed.groupBy("session_id", "block").count().filter("count > 1").select("session_id", "block")
    reopened = closed.join(again, ["session_id", "block"], "left_semi").groupBy("session_id", "block").agg(F.flatten(F.collect_list("turns")).alias("turns"))
    facts = closed.join(again, ["session_id", "block"], "left_anti").drop("turns").unionByName(_judged(reopened).drop("turns"))
    # from the last block to the first: the lead of the nearest later block that has one
    later = Window.partitionBy("session_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    chained = facts.withColumn("next_lead", F.last("told.lead", ignorenulls=True).over(later))
    unanswered = F.col("told.passed") | (F.col("told.waits") & F.coalesce(F.col("next_lead") != 2, F.lit(True)))
    sums = chained.groupBy("session_id").agg(
        F.sum("n").alias("n"), F.max("hi").alias("hi"), F.max("bad").alias("bad"), F.max("said").alias("said"), F.max(unanswered).alias("unanswered"), F.min_by("told.opener", F.when(F.col("told.opener").isNotNull(), F.col("block"))).alias("opener")
    )
    broken = F.coalesce(F.col("bad"), F.lit(True)) | ~F.col("said") | F.col("unanswered") | F.coalesce(F.col("opener") != 1, F.lit(True)) | F.coalesce(F.col("n") != F.col("hi") + 1, F.lit(True))
    return sums.select("session_id", broken.alias("broken"))


def judged_sessions(sessions: DataFrame, messages: DataFrame, parts: DataFrame, block: int = BLOCK, **options) -> DataFrame:
    """``session_id, broken`` of every session named in either table.

    A session is broken if it has no row in ``sessions`` or no message, nobody speaks in it, an
    ordinal is missing, null, negative or held by two messages, a role is unknown, a parent is not
    an earlier message of it, it is not opened by the user, or a user gets no reply.  Null sessions
    are none; missing times count as the log's last time; empty tables give an empty result.
    """
    times = messages.filter("session_id is not null").select(F.col("created_at").cast("timestamp").alias("event_time"))
    # the closed windows go as soon as the verdicts, a row a session, are written
    verdicts = settled(messages.sparkSession, "verdicts", lambda: session_verdicts(closed_blocks(message_log(messages, parts, block), times=times, **options)))
    known = sessions.filter("session_id is not null").select("session_id").distinct().withColumn("known", F.lit(True))
    return known.join(verdicts, "session_id", "full").select("session_id", (F.col("known").isNull() | F.coalesce("broken", F.lit(True))).alias("broken"))


def conversations(sessions: DataFrame, messages: DataFrame, parts: DataFrame, **options) -> DataFrame:
    """The turns of whole conversations: ``session_id, ordinal, message_id, role, part_ordinal, text``.

    One row per text part, or one with null text for a message without any; sort by session, ordinal
    and part ordinal to read.  Nothing is gathered, so that no conversation or message is too long.
    """
    good = judged_sessions(sessions, messages, parts, **options).filter("not broken").select("session_id")
    turns = messages.filter("session_id is not null").select("session_id", "ordinal", "message_id", clean_role().alias("role")).distinct()
    said = text_parts(parts).distinct()
    return turns.join(good, "session_id", "left_semi").join(said, "message_id", "left").select("session_id", "ordinal", "message_id", "role", "part_ordinal", "text")
