"""The question router, intents and the choice of plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources import load_table

#: Ordered rules: the first whose pattern is found gives the operator and the confidence.
ROUTES = (
    (r"\b(who|what|which)\b.*\b(calls?|uses?|imports?)\b", "where_used", 0.9),
    (r"\b[\w/-]+\.(ts|tsx|js|jsx|sql|py)\b", "file_detail", 0.85),
    (r"\b(path|route) (from|between)\b|\bconnect", "graph_shortest_path", 0.8),
    (r"\b(table|schema|column|migration)\b", "schema_usages", 0.75),
    (r"\b(error|fail(s|ed|ure)?|broken)\b", "open_loops", 0.7),
    (r"\b(why|should|how)\b", "cross_source_search", 0.5),
)
FALLBACK = ("free_form", 0.2)
#: Words that speak for an intent family.
INTENTS = {"search": "find|search|where|which", "change": "change|replace|rewrite|merge", "verify": "check|compare|verify|count", "explain": "why|reason|because|how"}
#: Operators that only read; anything else is refused in a batch.
READ_ONLY = frozenset(["where_used", "file_detail", "graph_shortest_path", "schema_usages", "open_loops", "cross_source_search"])


def routed(text: Column) -> tuple[Column, Column]:
    """(operator, confidence) of a question by the ordered rules."""
    low = F.lower(F.coalesce(text, F.lit("")))
    tool, sure = None, None
    for pattern, name, confidence in ROUTES:
        hit = low.rlike(pattern)
        tool = F.when(hit, name) if tool is None else tool.when(hit, name)
        sure = F.when(hit, confidence) if sure is None else sure.when(hit, confidence)
    return tool.otherwise(FALLBACK[0]), sure.otherwise(FALLBACK[1])


def route_question(question: str) -> tuple[str, float]:
    """The same rules for a single question, without a job."""
    import re

    return next(((name, c) for p, name, c in ROUTES if re.search(p, question.lower())), FALLBACK)


def plan_investigation(question: str, endpoints: list[str], steps: int = 3) -> list[str]:
    """Operators to run in order: a path for two ends, neighbours for one, then the router's choice if it is sure."""
    plan = ["graph_shortest_path"] if len(endpoints) >= 2 else ["graph_khop"] if endpoints else []
    if "tenant" in question.lower():
        plan.append("tenant_audit")
    if any(w in question.lower() for w in ("health", "trend", "state of")):
        plan.append("health_trend")
    name, confidence = route_question(question)
    if confidence >= 0.7 and name not in plan:
        plan.append(name)
    return plan[:steps] or ["unsupported"]


def run_batch(queries: dict[str, Callable], names: list[str], spark: SparkSession, sf_dir: str, read_only: frozenset = READ_ONLY) -> dict[str, DataFrame]:
    """Several operators in turn; a name that is unknown or may write refuses the whole batch."""
    refused = [n for n in names if n not in queries or n not in read_only]
    if refused:
        raise ValueError(f"not allowed in a batch: {', '.join(refused)}")
    return {n: queries[n](spark, sf_dir) for n in names}


def _questions(spark: SparkSession, d: str) -> DataFrame:
    p = load_table(spark, d, "harness_message_parts").filter("kind = 'text'").select("part_id", "message_id", F.get_json_object("payload_json", "$.text").alias("text")).distinct()
    m = load_table(spark, d, "harness_messages").filter(F.lower(F.trim("role")) == "user").select("message_id").distinct()
    return p.join(m, "message_id", "left_semi")


def ask_router(spark: SparkSession, d: str) -> DataFrame:
    tool, sure = routed(F.col("text"))
    return _questions(spark, d).groupBy(tool.alias("tool"), sure.alias("confidence")).agg(F.count("*").alias("questions"), F.min("part_id").alias("first_part"))


def intent_families(spark: SparkSession, d: str) -> DataFrame:
    """The family with the most signals of each question, with confidence min(0.95, 0.4 + 0.13 n)."""
    low = F.lower(F.coalesce("text", F.lit("")))
    scores = [F.struct(F.size(F.regexp_extract_all(low, F.lit(rf"\b(?:{p})\w*"), F.lit(0))).alias("n"), F.lit(-i).alias("first"), F.lit(k).alias("family")) for i, (k, p) in enumerate(INTENTS.items())]
    best = F.greatest(*scores)
    rows = _questions(spark, d).select("part_id", best.alias("b"))
    confidence = F.round(F.least(F.lit(0.95), 0.4 + 0.13 * F.col("b.n")), 2)
    return rows.groupBy(F.when(F.col("b.n") > 0, F.col("b.family")).otherwise("none").alias("family"), confidence.alias("confidence")).agg(F.count("*").alias("questions"))


QUERIES = {f.__name__: f for f in (ask_router, intent_families)}

_Q = "q as (select distinct part_id, message_id, json_extract_string(payload_json, '$.text') as text from harness_message_parts where kind = 'text' and message_id in (select message_id from harness_messages where lower(trim(role)) = 'user'))"
_CASE = lambda i: "case " + " ".join(f"when regexp_matches(lower(coalesce(text, '')), '{r[0]}') then {r[i] if i == 2 else chr(39) + r[i] + chr(39)}" for r in ROUTES)
_N = {k: rf"len(regexp_extract_all(lower(coalesce(text, '')), '\b(?:{p})\w*'))" for k, p in INTENTS.items()}
ORACLES = {
    "ask_router": f"with {_Q} select {_CASE(1)} else 'free_form' end as tool, cast({_CASE(2)} else 0.2 end as double) as confidence, count(*) as questions, min(part_id) as first_part from q group by 1, 2",
    "intent_families": f"""with {_Q}, c as (select {', '.join(f'{v} as {k}' for k, v in _N.items())} from q), b as (select *, greatest({', '.join(_N)}) as n from c)
 select case when n = 0 then 'none' {' '.join(f"when {k} = n then '{k}'" for k in _N)} end as family, cast(round(least(0.95, 0.4 + 0.13 * n), 2) as double) as confidence, count(*) as questions from b group by 1, 2""",
}
