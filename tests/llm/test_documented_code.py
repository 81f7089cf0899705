import pytest

from lodestrata.llm.documented_code import C_LIKE, HASH, RUST, SHARP, SQL, Islands, code_of, comment_run, description, documented_functions, find_declaration, grammar_for, pairs_of, word_count


def doc(text, at=None, g=C_LIKE):
    lines = text.split("\n")
    return description(comment_run(lines, len(lines) - 1 if at is None else at, g))


@pytest.mark.parametrize(
    "text, want",
    [
        ("/** Reads all open files. */\nfunction f() {", "Reads all open files."),
        ("/**\n * Reads all\n * open files.\n * @param x the thing\n *   runs on here\n */\nfunction f() {", "Reads all\nopen files."),
        ("/**\n * @description Keeps the older copy.\n */\n@Cached({\n  ttl: 5,\n})\nasync f() {", "Keeps the older copy."),
        ("// Reads all open files.\n\nfunction f() {", ""),
        ("// TODO: describe what this does and why\nfunction f() {", ""),
        ("// Compara todo el historial de nuevo.\nfunction f() {", "Compara todo el historial de nuevo."),
        ("// Reads the budget;\n// then hands over (if it can).\nfunction f() {", "Reads the budget;\nthen hands over (if it can)."),
        ("/* Copyright (c) 2025 the authors.\n   All the words of the notice. */\nfunction f() {", ""),
        ("// eslint-disable-next-line no-param-reassign\nfunction f() {", ""),
        ("// return load(old) ?? null;\n// }\nfunction f() {", ""),
        ("// ==== helpers and small things ====\nfunction f() {", ""),
        ("//#region inner parts of this\nfunction f() {", ""),
        ("/** {@inheritDoc} */\nfunction f() {", ""),
        ("// Description goes here when there is time.\nfunction f() {", ""),
        ("const a = 1; // counts all the rows\nfunction f() {", ""),
    ],
)
def test_descriptions(text, want):
    assert doc(text) == want


def test_other_grammars():
    assert doc("-- Counts the open rows.\ncreate function f()", g=SQL) == "Counts the open rows."
    assert doc("# Counts the open rows.\n@cached\ndef f():", g=HASH) == "Counts the open rows."
    assert code_of("def f():\n    a\n\n    b\nc".split("\n"), 0, None, HASH) == "def f():\n    a\n\n    b"
    assert code_of("function f(a = {}) {\n  // }\n  s = '}';\n}\nrest".split("\n"), 0, None, C_LIKE) == "function f(a = {}) {\n  // }\n  s = '}';\n}"
    assert code_of("create function f()\nas $$\n select 1;\n$$;\nx".split("\n"), 0, None, SQL) == "create function f()\nas $$\n select 1;\n$$;"


def test_declaration_from_line_or_signature():
    lines = ["// x", "function  f( a ) {", "}", "function f( a ) {", "}", "function g() {"]
    sq = ["".join(x.split()).casefold() for x in lines]
    assert find_declaration(lines, sq, "f", None, 3, "function f(a) {") == 1
    assert find_declaration(lines, sq, "f", 5, None, "function f(a) {") == 3
    assert find_declaration(lines, sq, "f", 2, None, None) == 1
    assert find_declaration(lines, sq, "g", 99, None, "function g…") == 5
    assert find_declaration(lines, sq, "zz", None, None, None) is None
    assert word_count("Reads the two rows") == 4 and word_count("// 12 -- 3") == 0


def test_operator_handles_dirt(spark):
    files = spark.createDataFrame([(1, "a.ts", None, "z"), (2, None, None, None), (3, "c.sql", "sql", None)], "file_id long, path string, language string, symbols string")
    text = "/** Reads all open files. */\r\nfunction f() {\r\n}\r\n"
    chunks = spark.createDataFrame([(1, "file", text, 1), (2, "file", None, 2), (3, "file", "", None), (1, "symbol", "x", 3), (None, "file", text, 4)], "file_id long, chunk_kind string, content string, symbol_id long")
    rows = [(10, 1, "f", "function", 2, 3, None), (10, 1, "f", "function", 2, 3, None), (11, 2, "f", "method", 1, 2, "f"), (12, 3, None, "function", None, None, None), (13, 1, "v", "variable", 2, 2, None), (14, None, "f", "function", 2, 2, None)]
    symbols = spark.createDataFrame(rows, "symbol_id long, file_id long, name string, kind string, line_start long, line_end long, signature_text string")
    got = documented_functions(files, chunks, symbols).collect()
    assert [(r.symbol_id, r.file_id, r.code, r.description) for r in got] == [(10, 1, "function f() {\n}", "Reads all open files.")]
    assert documented_functions(files.limit(0), chunks.limit(0), symbols.limit(0)).count() == 0


@pytest.mark.parametrize("entries", [5, 40, 400])
def test_decorator_of_any_length(entries):
    text = "/** Keeps the older copy. */\n@Cached({\n" + "".join(f"  key{i}: {i},\n" for i in range(entries)) + "})\nasync f() {"
    assert doc(text) == "Keeps the older copy."


def test_bodies_with_regular_expressions_and_templates():
    text = "function f(s) {\n  if (/[}]/.test(s) || /}/.test(s)) { return `}${s}\n}`; }\n  return s / 2 / 3;\n}\nrest"
    assert code_of(text.split("\n"), 0, None, C_LIKE) == text[: -len("\nrest")]
    sql = "create function f()\nreturns int as $body$\n select '}'; -- $$\n$body$ language sql;\ncreate function g() as $$ select 1; $$;"
    assert code_of(sql.split("\n"), 0, None, SQL) == sql[: sql.index("\ncreate function g")]
    # no body: the next function's is not taken
    assert code_of("drop function f();\ncreate function g() as $$ select 1; $$;".split("\n"), 0, None, SQL) == "drop function f();"


@pytest.mark.parametrize(
    "path, text",
    [
        ("a.cs", "/// Reads all open files.\n[Obsolete(\"old [\")]\npublic int F() {"),
        ("a.java", "/** Reads all open files. */\n@Timed(value = \"}{\",\n  extra = 1)\npublic int f() {"),
        ("a.rs", "/// Reads all open files.\n#[inline]\nfn f<'a>(x: &'a str) {"),
        ("a.php", "# Reads all open files.\n#[Pure]\nfunction f() {"),
        ("a.cpp", "// Reads all open files.\n[[nodiscard]]\nint f() {"),
    ],
)
def test_annotations_of_families(path, text):
    assert doc(text, g=grammar_for(path, None)) == "Reads all open files."


def test_text_in_strings_is_no_comment():
    assert doc("const s = `\n// Reads all open files.\n`;\nfunction f() {") == ""
    assert doc("x = \"\"\"\n# Reads all open files.\n\"\"\"\ndef f():", g=HASH) == ""
    assert doc("let a = [\n  1]\nfunction f() {") == ""


def test_one_pass_serves_all_functions_of_a_file():
    text = "".join(f"/** Counts the rows of part {i}. */\nfunction f{i}() {{\n  return '}}';\n}}\n" for i in range(50))
    symbols = [{"symbol_id": i, "name": f"f{i}", "line_start": 4 * i + 2, "line_end": None, "signature_text": None} for i in range(50)]
    got = list(pairs_of(text, "a.ts", None, symbols))
    assert [g[2] for g in got] == [f"function f{i}() {{\n  return '}}';\n}}" for i in range(50)]
    assert [g[0] for g in pairs_of(text, "a.ts", None, symbols, with_code=False)] == list(range(50))
    assert Islands([""], RUST).text == "" and SHARP.decorators == ("[",)
