"""Facts, findings, rules and their lifecycle as relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.keys import fingerprint
from lodestrata.operators.search import best_per_key

FACT_KEY = ["project", "overlay", "source", "kind", "subject"]


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key; on equal versions the incoming row holds."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    return best_per_key(both, keys, F.col(version).desc_nulls_last(), F.col("__new").desc()).drop("__new")


def replace_for_source(existing: DataFrame, incoming: DataFrame, scope: list[str]) -> DataFrame:
    """Drops the rows of every scope that the incoming rows speak of, and adds those."""
    return existing.join(incoming.select(*scope).distinct(), scope, "left_anti").unionByName(incoming)


def rule_findings(texts: DataFrame, key: str, content: str, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """``rule, severity, line_no, excerpt, fingerprint`` of the lines that match any rule's pattern.

    The rules are a fixed list of the caller; all are tested in one pass over the lines.
    """
    lines = texts.select(key, F.posexplode(F.split(F.regexp_replace(content, "\r", ""), "\n")).alias("pos", "line"))
    hits = F.filter(F.array(*(F.when(F.col("line").rlike(p), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, (s, p) in rules.items())), lambda x: x.isNotNull())
    rows = lines.select(key, (F.col("pos") + 1).alias("line_no"), F.trim(F.translate("line", "\t", " ")).alias("excerpt"), F.explode(hits).alias("h")).select(key, "line_no", "excerpt", "h.rule", "h.severity")
    return rows.withColumn("fingerprint", fingerprint(F.col("rule"), F.col(key), F.col("excerpt")))


def lifecycle(prior: DataFrame, produced: DataFrame, scope: DataFrame, key: str, subject: str) -> DataFrame:
    """State and event of each finding after a scan.

    ``prior`` has the key, subject and ``status``; ``produced`` key and subject; ``scope`` the subjects that were
    scanned.  A finding produced again is ``updated`` (``reopened`` if it was resolved), a new one ``created``; an active
    one of a scanned subject that was not produced is ``resolved``; all others keep their state without an event.
    """
    p = prior.select(key, F.col(subject).alias("__ps"), F.col("status").alias("__old"))
    n = produced.select(key, F.col(subject).alias("__ns")).dropDuplicates([key]).withColumn("__produced", F.lit(True))
    s = scope.select(F.col(subject)).distinct().withColumn("__scanned", F.lit(True))
    j = p.join(n, key, "full").withColumn(subject, F.coalesce("__ns", "__ps")).join(s, subject, "left")
    event = F.when(F.col("__produced") & F.col("__old").isNull(), "created").when(F.col("__produced") & (F.col("__old") == "resolved"), "reopened").when(F.col("__produced"), "updated").when((F.col("__old") == "active") & F.col("__scanned"), "resolved")
    status = F.when(F.col("__produced") & F.coalesce(F.col("__old") == "suppressed", F.lit(False)), "suppressed").when(F.col("__produced"), "active").when(event == "resolved", "resolved").otherwise(F.col("__old"))
    return j.select(key, subject, status.alias("status"), event.alias("event"))


def confidence(severity: Column, fresh: Column, status: Column) -> Column:
    """0.92 / 0.82 / 0.68 by severity, less 0 / 0.25 / 0.4 by freshness and 0 / 0.15 / 0.3 by status, within 0.1 and 1."""
    base = F.when(severity == "error", 0.92).when(severity == "warning", 0.82).otherwise(0.68)
    stale = F.when(fresh == "fresh", 0.0).when(fresh == "stale", 0.25).otherwise(0.4)
    less = F.when(status == "active", 0.0).when(status == "acknowledged", 0.15).otherwise(0.3)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.1), base - stale - less)), 4)


def packet_confidence(thin: Column, missing: Column, drift: Column, unknown: Column, stale: Column) -> Column:
    """0.9 less 0.25, 0.2, 0.3, 0.2 and 0.25 for what is thin, missing, drifting, unknown and stale, within 0.05 and 0.99."""
    less = reduce(lambda a, b: a + b, (F.when(c, w).otherwise(0.0) for c, w in ((thin, 0.25), (missing, 0.2), (drift, 0.3), (unknown, 0.2), (stale, 0.25))))
    return F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.05), 0.9 - less)), 4)


def without_acknowledged(findings: DataFrame, acks: DataFrame, key: str) -> DataFrame:
    return findings.join(acks.select(key).distinct(), key, "left_anti")


def with_ack_status(findings: DataFrame, acks: DataFrame, key: str) -> DataFrame:
    """Active findings that are acknowledged get that status, before any limit is applied."""
    seen = acks.select(key).distinct().withColumn("__ack", F.lit(True))
    return findings.join(seen, key, "left").withColumn("status", F.when(F.col("__ack") & (F.col("status") == "active"), "acknowledged").otherwise(F.col("status"))).drop("__ack")


def rule_memory(findings: DataFrame, rules: list[str]) -> DataFrame:
    """Counts of each rule by status with the latest row, known rules without findings included."""
    known = findings.sparkSession.createDataFrame([(r,) for r in rules], "rule string")
    counts = findings.groupBy("rule").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("active", "resolved", "acknowledged")), F.max("line_no").alias("last_line"))
    return known.join(counts, "rule", "full").select("rule", *(F.coalesce(s, F.lit(0)).alias(s) for s in ("active", "resolved", "acknowledged")), "last_line")


def assertion_verdict(kind: Column, expected: Column, actual: Column, tolerance: float = 0.0) -> Column:
    """``pass``, ``partial``, ``miss`` or ``errored`` of an assertion includes / excludes / equals (numbers within a tolerance)."""
    found = F.lower(actual).contains(F.lower(expected))
    close = F.abs(F.try_to_number(actual, F.lit("999999999")) - F.try_to_number(expected, F.lit("999999999"))) <= tolerance
    verdict = F.when(kind == "includes", F.when(found, "pass").otherwise("miss")).when(kind == "excludes", F.when(found, "miss").otherwise("pass")).when(kind == "equals", F.when(actual == expected, "pass").when(F.coalesce(close, found), "partial").otherwise("miss"))
    return F.when(actual.isNull() | expected.isNull(), "errored").otherwise(F.coalesce(verdict, F.lit("errored")))
