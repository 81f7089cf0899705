"""Checks of source files before a commit, and their refresh as findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.keys import fingerprint
from lodestrata.functions.text import glob_regex

# What counts as a guard, as code of the server alone, and as a hook of the client.
AUTH_GUARDS = ("auth.getUser", "withAuth")
SERVER_IMPORTS = ("next/headers", "next/cache", "server-only")
SERVER_CALLS = ("unstable_cache", "revalidatePath", "revalidateTag", "cookies", "headers")
CLIENT_HOOKS = ("useState", "useEffect", "useRef")
ROUTE_GLOBS = ("app/api/**/route.ts", "app/api/**/route.tsx", "pages/api/**/*.ts", "pages/api/**/*.tsx")
RULES = ("git.unprotected_route", "git.client_uses_server_only", "git.server_uses_client_hook")
_CALL = r"([\w$]+(?:\s*\.\s*[\w$]+)*)\s*\("


def _any_glob(path: Column, globs: tuple[str, ...]) -> Column:
    return path.rlike("|".join(map(glob_regex, globs))) if globs else F.lit(False)


def _last(call: Column) -> Column:
    return F.element_at(F.split(call, r"\s*\.\s*"), -1)


def guard_findings(texts: DataFrame, path: str = "path", content: str = "content", route_globs: tuple[str, ...] = ROUTE_GLOBS, public_globs: tuple[str, ...] = (), auth_guards: tuple[str, ...] = AUTH_GUARDS, server_modules: tuple[str, ...] = ()) -> DataFrame:
    """``code, severity, path, line_no, evidence`` of TypeScript files.

    A route without a call of any guard, a client file (first statement ``"use client"``) that imports a server module or calls a server
    function, and any other file that calls a client hook.  Commented lines do not count; one row for each place.
    """
    source = texts.filter(F.col(path).rlike(r"\.tsx?$")).select(path, content)
    bare = F.regexp_replace(F.regexp_replace(F.col(content), r"(?s)/\*.*?\*/", " "), r"(?m)^\s*//[^\n]*$", "")
    calls = F.transform(F.regexp_extract_all(bare, F.lit(_CALL), F.lit(1)), lambda c: F.regexp_replace(c, r"\s", ""))
    guarded = F.exists(calls, lambda c: c.isin(*auth_guards) | _last(c).isin(*auth_guards) | c.endswith(".auth.getUser"))
    open_route = _any_glob(F.col(path), route_globs) & ~_any_glob(F.col(path), public_globs) & ~guarded
    unprotected = source.filter(open_route).select(F.lit(RULES[0]).alias("code"), F.lit("critical").alias("severity"), path, F.lit(None).cast("int").alias("line_no"), F.lit("guards checked: " + ", ".join(sorted(auth_guards))).alias("evidence"))
    client = bare.rlike(r"""^\s*(?:["']use strict["'];?\s*)?["']use client["']""")
    # only files that name anything of interest are cut into lines
    words = "|".join((*SERVER_IMPORTS, *SERVER_CALLS, *CLIENT_HOOKS, *server_modules))
    lines = source.filter(F.col(content).rlike(words)).select(path, client.alias("client"), F.posexplode(F.split(content, "\n")).alias("pos", "line")).filter(~F.col("line").rlike(r"^\s*(?://|\*|/\*)"))
    modules = F.filter(F.regexp_extract_all("line", F.lit(r"""(?:from|import)\s*\(?\s*["']([^"']+)["']"""), F.lit(1)), lambda m: m.isin(*SERVER_IMPORTS, *server_modules))
    named = F.transform(F.regexp_extract_all("line", F.lit(_CALL), F.lit(1)), lambda c: F.regexp_replace(c, r"\s", ""))
    server = F.filter(named, lambda c: _last(c).isin(*SERVER_CALLS))
    hooks = F.filter(named, lambda c: _last(c).isin(*CLIENT_HOOKS))
    found = F.when(F.col("client"), F.transform(F.concat(modules, server), lambda e: F.struct(F.lit(RULES[1]).alias("code"), F.lit("critical").alias("severity"), e.alias("evidence")))).otherwise(F.transform(hooks, lambda e: F.struct(F.lit(RULES[2]).alias("code"), F.lit("high").alias("severity"), e.alias("evidence"))))
    placed = lines.select(path, (F.col("pos") + 1).alias("line_no"), F.explode(found).alias("f")).select("f.code", "f.severity", path, "line_no", "f.evidence")
    return unprotected.unionByName(placed)


def as_findings(found: DataFrame, path: str = "path") -> DataFrame:
    """Guard findings with the key of the finding store; places of one rule and evidence in a file are one finding."""
    rows = found.groupBy("code", "severity", path, "evidence").agg(F.min("line_no").alias("line_no"), F.count("*").alias("places"))
    return rows.withColumn("fingerprint", fingerprint(F.col("code"), F.col(path), F.col("evidence")))


def run_cache(finished: Column, now: Column, stale_after_ms: int = 30 * 60 * 1000) -> Column:
    """``fresh``, ``stale`` or, without a time, ``unknown``: whether a diagnostic run may still be used."""
    age = F.greatest(F.lit(0), F.unix_millis(now.cast("timestamp")) - F.unix_millis(finished.cast("timestamp")))
    return F.when(finished.isNull(), "unknown").when(age > stale_after_ms, "stale").otherwise("fresh")
