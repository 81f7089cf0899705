"""Batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources import load_table
from lodestrata.streaming.changes import change_sets, reusable_artifacts, session_counts, windowed_counts


def _events(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "events").withColumn("value", F.round(F.col("value") * 100).cast("long")).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    out = windowed_counts(_events(spark, d), "ts", "event_type", "1 day")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "events", "value")


def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    out = windowed_counts(_events(spark, d), "ts", "event_type", "12 hours", "6 hours")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", "events")


def session_bursts(spark: SparkSession, d: str) -> DataFrame:
    out = session_counts(_events(spark, d), "ts", "user_id", "4 hours")
    return out.groupBy("user_id").agg(F.count("*").alias("bursts"), F.max("events").alias("largest"))


def change_set_revisions(spark: SparkSession, d: str) -> DataFrame:
    sets = change_sets(_events(spark, d), ["user_id"], "ts", "event_id", 3600, 7200)
    return sets.select("user_id", "revision", "events", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss").alias("first_at"))


def artifact_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Contents of later documents that need an extraction, and those that are stored already."""
    docs = load_table(spark, d, "documents").filter("text is not null").select(F.sha2("text", 256).alias("content_hash"), F.lit("tokens").alias("kind"), F.lit(1).alias("extractor_version"), "updated_at")
    cut = F.lit("2025-06-01").cast("timestamp_ntz")
    new, tagged = reusable_artifacts(docs.filter(F.col("updated_at") >= cut), docs.filter(F.coalesce(F.col("updated_at") < cut, F.lit(True))))
    return new.agg(F.lit("compute").alias("action"), F.count("*").alias("artifacts")).unionByName(tagged.agg(F.lit("tag").alias("action"), F.count("*").alias("artifacts")))


QUERIES = {f.__name__: f for f in (tumbling_counts, sliding_counts, session_bursts, change_set_revisions, artifact_reuse)}
ORACLES = {
    "tumbling_counts": "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as events, cast(sum(cast(round(value * 100) as bigint)) as bigint) as value from events group by 1, 2",
    "sliding_counts": "select strftime(time_bucket(interval '6 hours', ts, timestamp '1970-01-01') - to_hours(o), '%Y-%m-%d %H') as hour, event_type, count(*) as events from events, (values (0), (6)) s(o) group by 1, 2",
    "session_bursts": "with g as (select *, ts - lag(ts) over (partition by user_id order by ts) as gap from events), b as (select *, sum(case when gap is null or gap >= interval '4 hours' then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as burst from g), c as (select user_id, burst, count(*) as n from b group by 1, 2) select user_id, count(*) as bursts, max(n) as largest from c group by 1",
    "change_set_revisions": """with g as (select *, epoch_us(ts) as us from events), l as (select *, us - lag(us) over w as gap from g window w as (partition by user_id order by ts, event_id)),
 b as (select *, sum(case when gap is null or gap > 3600000000 then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as burst from l),
 a as (select *, (us - min(us) over (partition by user_id, burst)) // 7200000000 as age from b), s as (select user_id, burst, age, count(*) as events, min(ts) as f from a group by 1, 2, 3)
 select user_id, cast(row_number() over (partition by user_id order by burst, age) as integer) as revision, events, strftime(f, '%Y-%m-%d %H:%M:%S') as first_at from s""",
    "artifact_reuse": """with n as (select sha256(text) as h from documents where text is not null and updated_at >= '2025-06-01'), o as (select sha256(text) as h from documents where text is not null and coalesce(updated_at < '2025-06-01', true))
 select 'compute' as action, count(distinct h) as artifacts from n where h not in (select h from o) union all select 'tag', count(*) from n where h in (select h from o)""",
}
