"""What SQL texts say of a database, as relations: keys, enums, policies, triggers, and the edges between them.

All extractors are built-in expressions over texts; comments are blanked first, so that what is switched off does not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import corpus


def without_comments(text: Column) -> Column:
    """SQL with comments blanked."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")


def _named(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, '"', ""))


def policies(texts: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """``policy_name, table_name, command, role`` of row policies; without a clause, the command is ``all`` and the role ``public``."""
    found = F.explode(F.regexp_extract_all(without_comments(F.col(content)), F.lit(r"(?is)(create\s+policy\s[^;]*);"), F.lit(1)))
    p = texts.select(*keep, found.alias("p"))
    part = lambda pattern, default: F.coalesce(F.nullif(_named(F.regexp_extract("p", pattern, 1)), F.lit("")), F.lit(default))
    return p.select(*keep, part(r'(?i)policy\s+("[^"]+"|[\w.]+)', "?").alias("policy_name"), part(r'(?i)\son\s+([\w."]+)', "?").alias("table_name"), part(r"(?i)\sfor\s+(\w+)", "all").alias("command"), part(r"(?i)\sto\s+([\w, ]+?)\s*(?:using|with|$)", "public").alias("role"))


def triggers(texts: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """``trigger_name, table_name, timing, events, function_name`` of triggers."""
    t = texts.select(*keep, F.explode(F.regexp_extract_all(without_comments(F.col(content)), F.lit(r"(?is)(create\s+(?:or\s+replace\s+)?(?:constraint\s+)?trigger\s[^;]*);"), F.lit(1))).alias("t"))
    part = lambda pattern: _named(F.regexp_extract("t", pattern, 1))
    events = F.array_join(F.array_sort(F.regexp_extract_all(F.lower(F.regexp_extract("t", r"(?is)(?:before|after|instead\s+of)\s+(.*?)\son\s", 1)), F.lit(r"\b(insert|update|delete|truncate)\b"), F.lit(1))), ",")
    return t.select(*keep, part(r"(?i)trigger\s+([\w.\"]+)").alias("trigger_name"), part(r'(?is)\son\s+([\w."]+)').alias("table_name"), part(r"(?i)\b(before|after|instead\s+of)\b").alias("timing"), events.alias("events"), part(r"(?i)execute\s+(?:function|procedure)\s+([\w.\"]+)").alias("function_name"))


def primary_keys(texts: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """``table_name, column_name`` of keys declared with a column or for the table."""
    tables = texts.select(*keep, F.explode(F.regexp_extract_all(without_comments(F.col(content)), F.lit(r"(?i)(create\s+table\s+(?:if\s+not\s+exists\s+)?[\w.]+\s*\([^;]*\))\s*;"), F.lit(1))).alias("t"))
    name = F.lower(F.regexp_extract("t", r"(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.]+)", 1))
    inline = F.regexp_extract_all("t", F.lit(r"(?i)[(,]\s*(\w+)\s[^,()]*?\bprimary\s+key\b"), F.lit(1))
    whole = F.split(F.regexp_extract("t", r"(?i)[(,]\s*(?:constraint\s+\w+\s+)?primary\s+key\s*\(([^)]*)\)", 1), r"\s*,\s*")
    column = F.explode(F.filter(F.array_distinct(F.concat(inline, whole)), lambda c: (F.trim(c) != "") & ~F.lower(c).isin("constraint", "primary")))
    return tables.select(*keep, name.alias("table_name"), column.alias("column_name")).withColumn("column_name", F.lower(F.trim("column_name")))


def enums(texts: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """``enum_name, position, value``."""
    e = texts.select(*keep, F.explode(F.regexp_extract_all(without_comments(F.col(content)), F.lit(r"(?is)(create\s+type\s+[\w.\"]+\s+as\s+enum\s*\([^)]*\))"), F.lit(1))).alias("e"))
    return e.select(*keep, _named(F.regexp_extract("e", r"(?i)type\s+([\w.\"]+)", 1)).alias("enum_name"), F.posexplode(F.regexp_extract_all("e", F.lit(r"'((?:''|[^'])*)'"), F.lit(1))).alias("position", "value"))


def structured_calls(texts: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """``kind, name, line_no, excerpt`` of ``.from("table")`` (``table``) and ``.rpc("function")`` (``function``) calls."""
    lines = texts.filter(F.col(content).rlike(r"\.(?:from|rpc)\s*\(")).select(*keep, F.posexplode(F.split(content, "\n")).alias("pos", "line"))
    hit = F.explode(F.regexp_extract_all("line", F.lit(r"(\.(?:from|rpc)\s*\(\s*['\"`][\w.]+)"), F.lit(1)))
    rows = lines.select(*keep, (F.col("pos") + 1).alias("line_no"), F.trim(F.translate("line", "\t\r", "  ")).alias("excerpt"), hit.alias("h"))
    return rows.select(*keep, F.when(F.col("h").startswith(".rpc"), "function").otherwise("table").alias("kind"), F.lower(F.regexp_extract("h", r"([\w.]+)$", 1)).alias("name"), "line_no", "excerpt")


def schema_ir(texts: DataFrame) -> DataFrame:
    """The schema as sorted facts: ``kind, name, member, detail``, each once whatever number of files states it."""
    row = lambda df, kind, name, member, detail: df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(member).cast("string").alias("member") if member else F.lit("").alias("member"), F.col(detail).cast("string").alias("detail") if detail else F.lit("").alias("detail"))
    objects = corpus.schema_objects(texts, [])
    parts = [
        objects.select(F.col("object_type").alias("kind"), "name", F.lit("").alias("member"), F.lit("").alias("detail")),
        row(corpus.table_columns(texts, []), "column", "table_name", "column_name", "data_type"),
        row(primary_keys(texts, []), "primary_key", "table_name", "column_name", None),
        row(enums(texts, []), "enum", "enum_name", "value", "position"),
        row(policies(texts, []), "policy", "table_name", "policy_name", "command"),
        row(triggers(texts, []), "trigger", "table_name", "trigger_name", "function_name"),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.distinct()


def schema_fingerprint(ir: DataFrame) -> DataFrame:
    """``facts, fingerprint``: SHA-256 over the hashes of 256 buckets of facts, so that no task holds them all."""
    h = F.sha2(F.concat_ws("\x1f", "kind", "name", "member", "detail"), 256)
    buckets = ir.select(h.alias("h")).groupBy(F.substring("h", 1, 2).alias("b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("d"))
    return buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("facts"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ""), 256).alias("fingerprint"))


def database_edges(sql_texts: DataFrame, texts: DataFrame, path: str = "path") -> DataFrame:
    """``src, dst, kind, exact`` between files, functions, tables, policies and triggers.

    ``calls_rpc`` is a guess by the function's name in a file, unless the file calls it by ``.rpc``.
    """
    functions = corpus.schema_objects(sql_texts, [path]).filter("object_type = 'function'")
    homes = functions.select("name", path).distinct()
    named = functions.groupBy("name").agg(F.min(path).alias("__home")).withColumn("bare", F.regexp_replace("name", r"^\w+\.", ""))
    guessed = corpus.usages(texts, named.select("name", "bare"), [path]).join(homes, ["name", path], "left_anti").select(F.col(path).alias("src"), F.col("name").alias("dst"), F.lit("calls_rpc").alias("kind"), F.lit(False).alias("exact"))
    calls = structured_calls(texts, [path]).filter("kind = 'function'").join(named.select(F.col("bare").alias("__bare"), F.col("name").alias("full")), F.regexp_replace("name", r"^\w+\.", "") == F.col("__bare"))
    exact = calls.select(F.col(path).alias("src"), F.col("full").alias("dst"), F.lit("calls_rpc").alias("kind"), F.lit(True).alias("exact"))
    reads = corpus.function_table_references(sql_texts, [path]).select(F.col("function_name").alias("src"), F.col("table_name").alias("dst"), F.lit("touches").alias("kind"), F.lit(False).alias("exact"))
    guards = policies(sql_texts, []).select(F.col("table_name").alias("src"), F.concat_ws("#", "table_name", "policy_name").alias("dst"), F.lit("has_policy").alias("kind"), F.lit(True).alias("exact"))
    t = triggers(sql_texts, [])
    fires = t.select(F.col("table_name").alias("src"), F.concat_ws("#", "table_name", "trigger_name").alias("dst"), F.lit("has_trigger").alias("kind"), F.lit(True).alias("exact"))
    runs = t.select(F.concat_ws("#", "table_name", "trigger_name").alias("src"), F.col("function_name").alias("dst"), F.lit("executes").alias("kind"), F.lit(True).alias("exact"))
    every = guessed.unionByName(exact).unionByName(reads).unionByName(guards).unionByName(fires).unionByName(runs)
    return every.groupBy("src", "dst", "kind").agg(F.max("exact").alias("exact"))


def rpc_neighbourhood(edges: DataFrame) -> DataFrame:
    """``function_name, callers, tables, policies`` of each function, from :func:`database_edges`.

    Counts come before the joins, so that a function with many callers and tables is no product of both.
    """
    callers = edges.filter("kind = 'calls_rpc'").groupBy(F.col("dst").alias("function_name")).agg(F.count("*").alias("callers"))
    touched = edges.filter("kind = 'touches'").select(F.col("src").alias("function_name"), F.col("dst").alias("table_name"))
    guards = edges.filter("kind = 'has_policy'").groupBy(F.col("src").alias("table_name")).agg(F.count("*").alias("p"))
    tables = touched.join(guards, "table_name", "left").groupBy("function_name").agg(F.count("*").alias("tables"), F.coalesce(F.sum("p"), F.lit(0)).alias("policies"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return callers.join(tables, "function_name", "full").select("function_name", zero("callers"), zero("tables"), zero("policies"))
