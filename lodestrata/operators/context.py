"""Parts of a context packet: intents, risks, the route ranker, candidates and their budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import query_terms, weighted
from lodestrata.operators.search import best_per_key

# Words that speak for an intent, and the risk rules: triggers, intents, severity and file endings (none: any file).
FAMILY_WORDS = {
    "debug_route": ("route", "api", "endpoint", "callback", "handler", "page", "server action"),
    "debug_type_contract": ("type", "interface", "contract", "schema", "prop", "props", "generic"),
    "debug_auth_state": ("auth", "session", "login", "logout", "user", "jwt", "token", "permission"),
    "debug_database_usage": ("db", "database", "table", "rpc", "rls", "sql", "migration", "schema", "policy"),
    "debug_ui_behavior": ("ui", "component", "hydration", "render", "client", "useeffect", "state", "hook"),
    "implement_feature": ("add", "build", "implement", "feature", "create", "support"),
    "review_change": ("review", "audit", "regression", "diff", "risk"),
    "find_precedent": ("similar", "precedent", "example", "pattern", "where else"),
}
RISK_RULES = {
    "type_contract_mismatch": (("type", "interface", "contract", "props", "user type", "session type"), ("debug_type_contract",), "medium", ("ts", "tsx")),
    "auth_state_flow": (("auth", "session", "login", "logout", "token", "user"), ("debug_auth_state",), "high", ()),
    "hydration_boundary": (("hydration", "hydration mismatch", "flash", "useeffect", "date", "math.random", "window"), ("debug_ui_behavior",), "medium", ("tsx", "jsx")),
    "server_client_boundary": (("use client", "use server", "server action", "client component", "server component"), ("debug_route", "debug_ui_behavior"), "medium", ("ts", "tsx")),
    "rls_policy_gap": (("rls", "policy", "tenant", "supabase", "public role", "service role"), ("debug_database_usage",), "high", ()),
    "schema_migration_drift": (("migration", "schema", "database type", "generated type", "db type", "sql"), ("debug_database_usage", "debug_type_contract"), "medium", ()),
    "duplicate_pattern_possible": (("precedent", "similar", "pattern", "copy", "duplicate", "another route", "another component"), ("find_precedent", "implement_feature"), "low", ()),
}
SEVERITY = {"high": 4, "medium": 3, "low": 2, "info": 1}


def _hits(low: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, (low.contains(w).cast("int") for w in words))


def _whole_word(low: Column, words: tuple[str, ...]) -> Column:
    return low.rlike("(?<![a-z0-9_])(?:" + "|".join(words) + ")(?![a-z0-9_])")


def detected_risks(request: Column, endings: Column) -> Column:
    """An array of ``code, severity, confidence`` of the rules that a request meets, the most severe and sure first.

    A rule is met if its files are among the endings of the candidates' paths, and its triggers or intents in the request.
    """
    low = F.lower(F.coalesce(request, F.lit("")))
    rules = []
    for code, (triggers, intents, severity, files) in RISK_RULES.items():
        meant = reduce(lambda a, b: a | b, (_whole_word(low, FAMILY_WORDS[i]) for i in intents))
        n = _hits(low, triggers)
        placed = F.arrays_overlap(endings, F.array(*map(F.lit, files))) if files else F.lit(True)
        sure = F.round(F.least(F.lit(0.92), 0.44 + F.when(meant, 0.18).otherwise(0.0) + F.least(n, F.lit(3)) * 0.1), 2)
        rules.append(F.when(placed & (meant | (n > 0)), F.struct(F.lit(-SEVERITY[severity]).alias("order"), (-sure).alias("less"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), sure.alias("confidence"))))
    return F.transform(F.array_sort(F.filter(F.array(*rules), lambda r: r.isNotNull())), lambda r: F.struct(r["code"].alias("code"), r["severity"].alias("severity"), r["confidence"].alias("confidence")))


def route_scores(routes: DataFrame, query: str) -> DataFrame:
    """Routes with a score: pattern 100, key 90, phrase 60, 10 for each token, 20 for all of several.

    A query that looks like a path needs its phrase or all of its tokens.
    """
    low = " ".join(query.lower().split())
    terms = query_terms(low)
    hay = F.lower(F.concat_ws(" ", "pattern", "route_key", "framework", "path"))
    found = [hay.contains(t) for t in terms]
    phrase = hay.contains(low)
    every = reduce(lambda a, b: a & b, found) if found else F.lit(False)
    score = weighted((F.lower("pattern") == low, 100), (F.lower("route_key") == low, 90), (phrase, 60), *((f, 10) for f in found), (every if len(terms) > 1 else F.lit(False), 20))
    like_path = low.startswith("/") or low.split(" ", 1)[0] in ("any", "get", "post", "put", "patch", "delete", "head", "options") and " /" in low
    score = F.when(phrase | every, score).otherwise(F.lit(0.0)) if like_path else score
    return routes.withColumn("score", score).filter("score > 0")


def candidates(*providers: DataFrame) -> DataFrame:
    """``provider, key, score, cost`` of all providers, each key once by its highest score."""
    every = reduce(DataFrame.unionByName, (p.select("provider", "key", F.col("score").cast("double").alias("score"), "cost") for p in providers))
    return best_per_key(every, ["key"], F.col("score").desc(), F.col("provider"))
