"""Extraction of structure from source texts, with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import contains_ci
from lodestrata.operators.search import best_per_key

# Languages by file suffix, directories that a scan skips, and the size above which a file is not read.
LANGUAGES = {"ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "mjs": "esm", "cjs": "commonjs", "sql": "sql", "md": "markdown", "json": "json", "yml": "yaml", "yaml": "yaml", "css": "css", "py": "python"}
SKIPPED_DIRS = ("node_modules", ".git", "dist", "build", "out", "coverage", ".next", "vendor")
MAX_FILE_BYTES = 512 * 1024
# Words that may follow from, join, into or update in SQL but name no table.
SQL_WORDS = ("select", "lateral", "unnest", "values", "only", "set", "where", "as", "on", "the")


def detect_language(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))[suffix]


def scan_tree(spark, root: str, paths: list[str] | None = None, max_bytes: int | None = MAX_FILE_BYTES) -> DataFrame:  # noqa: ANN001
    """``path, language, sha256, size_bytes, line_count, content`` of the source files below a root.

    Skipped directories, files above ``max_bytes`` (None: no bound) and files that are no UTF-8 text are left out.  With
    ``paths``, only those are kept; a path that climbs out of the root is refused.
    """
    if paths is not None and any(p.startswith("/") or ".." in p.split("/") for p in paths):
        raise ValueError("paths must stay below the root")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.removeprefix("file://").rstrip("/") + "/"
    path = F.expr(f"substring(path, instr(path, '{base}') + {len(base)})")
    rows = (raw if max_bytes is None else raw.filter(F.col("length") <= max_bytes)).select(path.alias("path"), "content", F.col("length").alias("size_bytes"))
    skipped = "(^|/)(" + "|".join(s.replace(".", r"\.") for s in SKIPPED_DIRS) + ")/"
    rows = rows.filter(~F.col("path").rlike(skipped) & detect_language(F.col("path")).isNotNull() & F.is_valid_utf8(F.col("content").cast("string")))
    if paths is not None:
        wanted = spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "path string")
        rows = rows.join(wanted, "path", "left_semi")
    text = F.col("content").cast("string")
    lines = F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when(text.endswith("\n"), 0).otherwise(1))
    return rows.select("path", detect_language(F.col("path")).alias("language"), F.sha2("content", 256).alias("sha256"), "size_bytes", lines.cast("long").alias("line_count"), text.alias("content"))


def chunk_files(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """One ``file`` chunk a file and one ``symbol`` chunk a symbol, each with its whole text: ``path, chunk_kind, name, line_start, line_end, content``."""
    whole = files.select("path", F.lit("file").alias("chunk_kind"), F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(1).cast("long").alias("line_start"), F.col("line_count").cast("long").alias("line_end"), "content")
    placed = symbols.filter("line_start >= 1 and line_end >= line_start").select("path", "name", F.col("line_start").cast("long"), F.col("line_end").cast("long"))
    cut = files.select("path", F.split("content", "\n").alias("lines")).join(placed, "path")
    own = cut.select("path", F.lit("symbol").alias("chunk_kind"), "name", "line_start", "line_end", F.array_join(F.slice("lines", F.col("line_start").cast("int"), (F.col("line_end") - F.col("line_start") + 1).cast("int")), "\n").alias("content"))
    return whole.unionByName(own)


def import_records(texts: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """One row an import: ``specifier, names, kind`` (relative, alias or package; re-exports apart), ``type_only``."""
    statement = r"(?:^|\n)\s*((?:import|export)\s+(?:type\s+)?(?:[\w*$]+\s*,?\s*)?(?:\{[^}]*\})?(?:\*\s+as\s+\w+)?\s*from\s+[\"'][^\"'\n]+[\"'])"
    rows = texts.select(*keep, F.explode(F.regexp_extract_all(content, F.lit(statement), F.lit(1))).alias("statement"))
    spec = F.regexp_extract("statement", r"[\"']([^\"']+)[\"']$", 1)
    kind = F.when(F.col("statement").startswith("export"), "reexport").when(spec.startswith("."), "relative").when(spec.startswith("@/") | spec.startswith("~/"), "alias").otherwise("package")
    names = F.filter(F.transform(F.split(F.regexp_extract("statement", r"\{([^}]*)\}", 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select(*keep, spec.alias("specifier"), names.alias("names"), kind.alias("kind"), F.col("statement").rlike(r"^(import|export)\s+type\s").alias("type_only"))


def exported_symbols(texts: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """``kind, name`` of declarations that a module exports."""
    pattern = r"(?:^|\n)export\s+(?:default\s+)?(?:async\s+)?((?:function|class|interface|const|let|enum|type)\s+\w+)"
    rows = texts.select(*keep, F.explode(F.regexp_extract_all(content, F.lit(pattern), F.lit(1))).alias("d"))
    return rows.select(*keep, F.regexp_extract("d", r"^(\w+)", 1).alias("kind"), F.regexp_extract("d", r"(\w+)$", 1).alias("name"))


def routes(files: DataFrame, texts: DataFrame) -> DataFrame:
    """``route_key, pattern, framework, path``: handler files, page files and calls on a router; of several
    definitions of one key, the one with the highest priority holds."""
    stem = r"\.(?:ts|tsx|js|jsx|mjs|cjs)$"
    code = files.filter(F.col("path").rlike(stem))
    pages = code.filter(F.col("path").rlike("/routes/")).select(F.concat(F.lit("/"), F.regexp_replace(F.regexp_extract("path", "/routes/(.*)$", 1), stem, "")).alias("pattern"), F.lit("pages").alias("framework"), F.lit(2).alias("priority"), "path")
    handlers = code.filter(F.col("path").rlike("/api/src/")).select(F.concat(F.lit("/api/"), F.regexp_replace(F.regexp_extract("path", "/api/src/(.*)$", 1), stem, "")).alias("pattern"), F.lit("handlers").alias("framework"), F.lit(3).alias("priority"), "path")
    calls = texts.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"\b(?:app|router)\.(?:get|post|put|delete|patch)\(\s*[\"'](/[^\"']*)[\"']"), F.lit(1))).alias("pattern")).select("pattern", F.lit("calls").alias("framework"), F.lit(1).alias("priority"), "path")
    every = pages.unionByName(handlers).unionByName(calls).withColumn("route_key", F.concat_ws(" ", F.element_at(F.split("path", "/"), 1), "pattern"))
    return best_per_key(every, ["route_key"], F.col("priority").desc(), F.col("path")).select("route_key", "pattern", "framework", "path")


def schema_objects(texts: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """``object_type, name`` of tables, views, types and functions that SQL texts create."""
    pattern = r"(?i)\bcreate\s+(?:or\s+replace\s+)?((?:table|view|materialized\s+view|type|function)\s+(?:if\s+not\s+exists\s+)?[\w.\"]+)"
    rows = texts.select(*keep, F.explode(F.regexp_extract_all(content, F.lit(pattern), F.lit(1))).alias("d"))
    return rows.select(*keep, F.lower(F.regexp_extract("d", r"^(\w+)", 1)).alias("object_type"), F.lower(F.regexp_replace(F.regexp_extract("d", r"([\w.\"]+)$", 1), '"', "")).alias("name"))


def table_columns(texts: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """``table_name, column_name, data_type`` of created tables."""
    tables = texts.select(*keep, F.explode(F.regexp_extract_all(content, F.lit(r"(?i)(create\s+table\s+(?:if\s+not\s+exists\s+)?[\w.]+\s*\([^;]*\))\s*;"), F.lit(1))).alias("t"))
    cols = tables.select(*keep, F.lower(F.regexp_extract("t", r"(?i)exists\s+([\w.]+)|table\s+([\w.]+)", 1)).alias("table_name"), F.explode(F.regexp_extract_all("t", F.lit(r"\n\s+(\w+ \w+)"), F.lit(1))).alias("c"))
    return cols.select(*keep, "table_name", F.split("c", " ")[0].alias("column_name"), F.split("c", " ")[1].alias("data_type"))


def table_references(texts: DataFrame, keep: list[str], content: str = "content", schema: str = "public") -> DataFrame:
    """Distinct ``table_name`` that SQL bodies read or write; comments and strings do not count."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(content, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " "), r"'[^']*'", "''")
    hit = F.explode(F.regexp_extract_all(F.lower(bare), F.lit(r"\b(?:from|join|update|insert\s+into|delete\s+from)\s+([a-z_][\w.]*)"), F.lit(1)))
    rows = texts.select(*keep, hit.alias("t")).filter(~F.col("t").isin(*SQL_WORDS))
    return rows.select(*keep, F.when(F.col("t").contains("."), F.col("t")).otherwise(F.concat(F.lit(schema + "."), F.col("t"))).alias("table_name")).distinct()


def function_table_references(texts: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """``function_name, table_name`` of the bodies of SQL functions."""
    bodies = texts.select(*keep, F.explode(F.regexp_extract_all(content, F.lit(r"(?is)(create\s+or\s+replace\s+function\s+[\w.]+.*?\$\$.*?\$\$)"), F.lit(1))).alias("b"))
    named = bodies.select(*keep, F.lower(F.regexp_extract("b", r"(?i)function\s+([\w.]+)", 1)).alias("function_name"), "b")
    return table_references(named, [*keep, "function_name"], "b")


def usages(texts: DataFrame, objects: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """Files that name a schema object: texts are cut into distinct words, which meet the objects by equality.

    ``objects`` has ``name`` and ``bare`` (the last part of the name, lower case).  A word that many files hold costs
    one row a file, never a product of files and objects.
    """
    words = texts.select(*keep, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(content), F.lit(r"[a-z_][a-z0-9_]*"), F.lit(0)))).alias("bare"))
    return words.join(objects, "bare").select(*keep, "name")


def live_text_search(texts: DataFrame, key: str, needle: str, content: str = "content", matches: int | None = 500, files: int | None = 200) -> DataFrame:
    """``key, line_no, line`` of the lines that contain a fixed string, within the caps of a report or, with None, all of them."""
    hits = texts.filter(contains_ci(F.col(content), needle))
    hits = hits if files is None else hits.orderBy(key).limit(files)
    lines = hits.select(key, F.posexplode(F.split(content, "\n")).alias("pos", "line")).filter(contains_ci(F.col("line"), needle))
    found = lines.select(key, (F.col("pos") + 1).alias("line_no"), "line")
    return found if matches is None else found.orderBy(key, "line_no").limit(matches)


def semantic_units(chunks: DataFrame) -> DataFrame:
    """``unit_id, owner, kind, content`` with ids from the content, one row a unit."""
    kind = F.when(F.col("chunk_kind") == "symbol", "code").otherwise("doc")
    rows = chunks.select(kind.alias("kind"), F.col("file_id").cast("string").alias("owner"), "content").filter("content is not null")
    unit = F.concat(F.lit("su_"), F.sha2(F.concat_ws("\x1f", "kind", "owner", F.sha2("content", 256)), 256))
    return rows.withColumn("unit_id", unit).dropDuplicates(["unit_id"])
