import base64
import random

import pytest

from lodestrata.llm.handwritten import family_of, layout_verdict, nesting, source_classes, verdict

HAND = """import { load } from "./load.js";

// writes the banner that marks generated output
export function render(rows, options) {
  const head = "// AUTO-GENERATED FILE. DO NOT EDIT.\\n";
  const query = "select first_name, last_name, street, city from people_of_the_town where owner_id = ? and scope = ? and deleted_at is null order by last_name, first_name limit 100";
  for (const row of rows) {
    options.push({ row, query });
  }
  return head + options.join("\\n");
}
"""
RND = random.Random(3)
NUMBERS = "module.exports = [\n" + "\n".join("  " + ", ".join(str(RND.randrange(10**5)) for _ in range(12)) + "," for _ in range(10)) + "\n];\n"
BLOB = "export const blob = \"" + base64.b64encode(RND.randbytes(600)).decode() + "\";\n"
MINIFIED = "".join(f"function {a}({b},{c}){{return {b}&&{c}.push({a})||null}}var {b}{c}=[{a},1];" for a in "abcdef" for b in "ghi" for c in "jkl") + "\n//# sourceMappingURL=x.js.map\n"
NUMBERED = "\n".join(f"export interface Part{i}Message {{\n  field_1?: string;\n  field_2?: number;\n}}\n" for i in range(4))


@pytest.mark.parametrize(
    "text, path, want",
    [
        (HAND, "a/src/gen/x.ts", None),
        (HAND, "a/vendor/x.min.js", None),
        ("// Code generated by tool v1.2. DO NOT EDIT.\n" + HAND, "a/src/x.ts", "generated"),
        ("/*\n * Copyright (c) 2025 us\n */\n\n/* Automatisch erzeugt aus x.yaml, nicht von Hand ändern. */\nlet a = 1;\n", "a/x.js", "generated"),
        ("/***/ 73:\n/***/ ((__unused_module, __exports, __x_require__) => {\n" + HAND + "/***/ })\n", "a/x.js", "bundled"),
        ('"use strict";\nObject.defineProperty(exports, "__esModule", { value: true });\n' + HAND, "a/x.js", "compiled"),
        ("(function (root, factory) {\n  if (typeof module === \"object\" && module.exports) module.exports = factory(); else root.Lib = factory();\n})(this, function () {\n" + HAND + "});\n", "a/utils/x.js", "vendored"),
        ("/*! tool v1.2.3 | (c) the Tool contributors | free */\n" + HAND, "a/x.js", "vendored"),
        (MINIFIED, "a/src/x.js", "minified"),
        (NUMBERS, "a/src/x.js", "data"),
        (BLOB, "a/src/x.js", "data"),
        ("\n".join(f"insert into t values ({i}, '{i * 7919:x}', true);" for i in range(20)), "a/db/x.sql", "data"),
        ("create table t (\n  id bigint primary key\n);\ninsert into t values (1);\n", "a/db/x.sql", None),
        (NUMBERED, "a/src/x.ts", "generated"),
        ("a:\n  row_0: 12\n  row_1: 13\n  row_2: 14\n", "a/x.yml", None),
        ("# Notes\n\nNever edit this by hand, it is said.\n", "a/x.md", None),
        (".a-1{margin:0;color:#fff}" * 60, "a/x.css", "minified"),
        (".a {\n  margin: 0;\n}\n", "a/x.css", None),
        (None, "a.js", None),
        ("", "a.js", None),
        (" \n", None, None),
        (HAND, None, None),
    ],
)
def test_verdicts(text, path, want):
    found = verdict(text, path)
    assert (found and found[0]) == want, found


def test_families():
    assert family_of("a.SQL", None) == "sql" and family_of(None, "CSS ") == "style" and family_of("a/b.ts", "sql") == "code" and family_of(None, None) == "code"


def test_operator(spark):
    files = spark.createDataFrame([(1, "a.js", None, "x"), (2, None, None, None)], "file_id long, path string, language string, class string")
    chunks = spark.createDataFrame([(1, "file", NUMBERS), (2, "file", HAND), (3, "file", MINIFIED), (1, "symbol", "x"), (None, "file", NUMBERS), (4, "file", None), (5, "file", "")], "file_id long, chunk_kind string, content string")
    got = {r.file_id: r["class"] for r in source_classes(files, chunks).collect()}
    assert got == {1: "data", 2: "handwritten", 3: "minified", 4: "handwritten", 5: "handwritten"}
    assert source_classes(files.limit(0), chunks.limit(0)).count() == 0


@pytest.mark.parametrize("head", ["// Created by Alice\n", "/* Do not edit the cache directly; call invalidate(). */\n", "// The generator client was generated by hand\n", "// never edit this without asking\n"])
def test_comments_of_people(head):
    assert verdict(head + HAND, "a/src/x.ts") is None


def layout(text, family="code"):
    found = layout_verdict(text, text.split("\n"), family)
    return found and found[0]


WRAPPED = "(function (root, factory) {\n  root.Lib = factory();\n})(this, function () {\n" + HAND + "const rows = [1];\nfunction last() {\n  return rows;\n}\n});\n"
PACKED = "var __step = (self && self.__step) || function (t, n) { return new (n || (n = Promise))(function (ok) { ok(t()); }); };\n"


def test_layout_alone():
    assert layout(HAND) is None
    assert layout(WRAPPED) == "vendored"
    assert layout("load(7, function (module) {\n" + WRAPPED.split("{\n", 2)[2]) == "bundled"
    assert layout(PACKED + HAND) == "compiled"
    assert layout(MINIFIED) == "minified" and layout("x" * 40 + ";" + MINIFIED.replace("\n", "")) == "minified"
    assert layout(NUMBERED) == "generated"
    assert layout("export const rows = [\n" + "".join(f'  {{ key: "k{i % 7}", rank: {i}, label: "of it" }},\n' for i in range(400)) + "];\n") == "data"
    assert layout("export const words = [\n" + "".join(f'  "{a}{b}word", "{b}{a}",\n' for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz") + "];\n") == "data"
    # a few rows of constants in hand-written code are none
    assert layout(HAND + "".join(f"export const limit{i} = {i * 7};\n" for i in range(100))) is None


def test_nesting():
    assert nesting("const a = /[{(]/;\nfunction f() {\n  return '}';\n}\n")["wrapped"] == 0
    assert nesting("wrap(function () {\nlet a = 1;\nlet b = `\nx {\n`;\n})\n")["wrapped"] > 0.6
    assert nesting("function f() {\n/* { */\n  a();\n}\n")["wrapped"] == 0
    assert nesting("")["margin"] == 0


def test_marks_below_a_long_licence():
    text = "/*\n" + " * words of the licence\n" * 90 + " */\nmodule.exports = typeof define === 'function' && define.amd ? define(make) : make();\n"
    assert verdict(text, "a/x.js")[0] == "vendored"
