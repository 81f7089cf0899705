"""Source files that nobody wrote by hand in this project (problem 5): generated, compiled, bundled or
minified output, copies of third-party libraries, and data stored as code.

The text decides, by statistics of its layout against thresholds per language family: longest and mean line, white space,
letters and digits, density of literals, long encoded runs, length of names; how few line shapes it is made of, how long runs of
one shape are, and whether blocks are numbered in sequence; how much of what stands at the margin is nested in brackets, as
in modules that a tool has wrapped without indenting them; and how deep brackets nest on one line, as in helpers
that compilers add.  Only where the layout says nothing do marks count: what tools write above their output, and the heads of
libraries.  Paths and flags alone decide nothing: they only choose the family.

Scale: one narrow pass over the texts.  A file's row is decided by its own text; no shuffle but the join
with the file's path, whose side is one small row per file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.runtime import shuffle_tasks


@dataclass(frozen=True)
class Thresholds:
    """Where layout stops looking hand-written, for one language family."""

    mean_line: float  # characters a line, with little white space: minified
    longest_line: int  # a single line of this length with as little white space, in a text that it makes up half of: minified
    least_space: float  # share of white space below which long lines are minified
    name_length: float  # mean length of names below which code is squeezed
    literal_share: float  # characters in numbers and hash-like strings: data
    encoded_run: int  # characters of one run without a break: data
    least_words: float  # share of letters and digits below which a long run is symbols or escapes: data
    shape_share: float  # distinct line shapes to lines, where blocks and members are numbered: generated
    shape_run: int  # lines of one shape below each other that make up most of a text: data
    string_share: float  # share of a text in short string literals: data


# Thresholds per family, tuned on the layout of common sources.
FAMILIES = {
    "code": Thresholds(140, 1500, 0.085, 2.6, 0.45, 300, 0.35, 0.75, 300, 0.75),
    "sql": Thresholds(400, 4000, 0.06, 2.0, 0.60, 400, 0.3, 0.0, 200, 1.1),
    "style": Thresholds(200, 3000, 0.05, 1.5, 0.70, 600, 0.3, 0.0, 10_000, 1.1),
    "config": Thresholds(100_000, 10**9, 0.0, 0.0, 1.1, 4000, 0.0, 0.0, 10**9, 1.1),
    "notes": Thresholds(100_000, 10**9, 0.0, 0.0, 1.1, 4000, 0.0, 0.0, 10**9, 1.1),
}
_SUFFIX = {"sql": "sql", "css": "style", "scss": "style", "less": "style", "json": "config", "yml": "config", "yaml": "config", "toml": "config", "ini": "config", "xml": "config", "env": "config", "md": "notes", "mdx": "notes", "txt": "notes", "rst": "notes"}
_LANGUAGE = {"sql": "sql", "css": "style", "scss": "style", "json": "config", "yaml": "config", "toml": "config", "markdown": "notes", "text": "notes"}


def family_of(path: str | None, language: str | None) -> str:
    suffix = (path or "").rsplit(".", 1)[-1].lower() if "." in (path or "") else ""
    return _SUFFIX.get(suffix) or (_LANGUAGE.get((language or "").strip().lower(), "code") if not suffix else "code")


# What generators say of their output, in the corpus languages; who made it or that it is not to be touched alone says nothing.
_BANNER = re.compile(
    r"\bauto-?generated (?!by hand)|\bautomatically (?:generated|created|produced|written) (?:by|from|file|code|at|on|\W|$)|^\W*(?:code|file|output) generated (?:by|from|with)\b(?! hand)|(?:^|\W)@generated\b|^\W*do not (?:edit|modify)\W*$|\bgenerated\b.{0,80}\bdo not (?:edit|modify)\b|<auto-?generated|\b(?:AUTO-?GENERATED)\b|\bmachine-written\b"
    r"|\b(?:produced|emitted|compiled|transpiled|bundled) (?:by|with) \S+ v?\d[\d.]*\b|\bautomatisch (?:erzeugt|generiert|erstellt) (?:aus|von|mit|durch)|généré automatiquement|automatiquement généré|generado automáticamente|automáticamente generado",
    re.I | re.M,
)
_BUNDLE = re.compile(r"^\s*/\*{3}/|__\w+_require__|__\w*unused_?\w*(?:module|exports)|^\s*//+\s*bundle (?:end|start)|\bwebpack(?:Jsonp|Chunk|Bootstrap)|\bparcelRequire\b|\bSystem\.register\(\[|^\s*define\(\[", re.M)
_COMPILED = re.compile(r"^\s*Object\.defineProperty\(exports,\s*[\"']__esModule[\"']|^\s*var __\w+\s*=\s*\(?this && this\.__\w+|^\s*\"use strict\";\s*\n\s*exports\.__esModule|\b_interopRequire(?:Default|Wildcard)\b|\btslib_\d\.", re.M)
_LIBRARY = re.compile(r"\(function\s*\(\s*(?:root|global|window|\w)\s*,\s*(?:factory|\w)\s*\)\s*\{[\s\S]{0,400}?(?:module\.exports|define\.amd|root\.\w+\s*=\s*factory)|typeof exports === ['\"]object['\"] && typeof module|typeof define === ['\"]function['\"] && define\.amd")
_LIBRARY_HEAD = re.compile(r"^\s*(?:/\*!|//!)\s*\S+.{0,40}\bv?\d+\.\d+(?:\.\d+)?\b|^\W*\S+ v?\d+\.\d+\.\d+ - .{0,60}\b(?:library|build|https?:)", re.I | re.M)
_MAP = re.compile(r"^\s*(?://|/\*)[#@]\s*sourceMappingURL=", re.M)
_NUMBER = re.compile(r"(?<![\w$])-?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?![\w$])|[\"'][0-9a-fA-F]{6,}[\"']|[\"'][A-Za-z0-9+/_-]{24,}={0,2}[\"']")
_RUN = re.compile(r"[A-Za-z0-9+/=_\\-]{120,}")
_NAME = re.compile(r"(?<![\w$\"'.])[A-Za-z_$][\w$]*")
_KEYWORDS = frozenset("if else for while do return var let const function new this throw try catch void typeof in of null true false export import class extends static async await switch case break default from".split())
_INSERT = re.compile(r"^\s*(?:insert\s+into\b.*\bvalues\b|\(.*\)\s*[,;]\s*$|\\?copy\b|[^\t\n]*\t[^\t\n]*\t)", re.I)
# Plain strings without one of which the patterns above cannot match.
_BUNDLE_SIGNS = ("/***/", "__", "bundle ", "webpack", "parcelRequire", "System.register", "define(")
_COMPILED_SIGNS = ("__esModule", "this && this.", "_interopRequire", "tslib_")
_SPACES = re.compile(r"\s+")
_BRACKETS = re.compile(r"[,\[\](){}:;]+")
_ISLANDS = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|(?:(?<=[=(,:!&|?;]\s)|(?<=[=(,:!&|?;]))/(?![*/\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/|[{}()\[\]]|\n")
_LITERALS = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'")
_COMMENT = re.compile(r"^\s*(?://|/\*|\*|--|#(?!include|define|if|!/)|<!--)")
_SHAPE = [(re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`"), "s"), (re.compile(r"[A-Za-z_$][\w$]*"), "w"), (re.compile(r"\d+(?:\.\d+)?"), "0"), (re.compile(r"\s+"), " "), (re.compile(r"(?:w(?:<[w, ]*>)?(?:\[\])?)"), "w")]
_NUMBERED = re.compile(r"[A-Za-z_$]*?[A-Za-z_](\d+)(?=\b|[A-Z_])")


def head_comments(lines: list[str]) -> str:
    """The comments above the first line of code."""
    out, inside = [], False
    for line in lines:
        s = line.strip().lstrip("﻿")
        if inside:
            out.append(s)
            inside = "*/" not in s
        elif not s or s.startswith("#!"):
            continue
        elif _COMMENT.match(s):
            out.append(s)
            inside = s.startswith("/*") and "*/" not in s
        elif s in ('"use strict";', "'use strict';", "---"):
            continue
        else:
            break
    return "\n".join(out)


def shape_of(line: str) -> str:
    for pattern, sign in _SHAPE:
        line = pattern.sub(sign, line)
    return line.strip()


def _in_sequence(lines: list[str]) -> float:
    """Share of the lines whose first numbered name goes on from the one before, or starts at 0 or 1."""
    numbers = [int(m[1]) if (m := _NUMBERED.search(x)) and len(m[1]) < 7 else -9 for x in lines]
    return sum(b == a + 1 or 0 <= b <= 1 for a, b in zip([-1, *numbers], numbers)) / len(lines) if lines else 0.0


def density(text: str) -> dict:
    """White space, literals and encoded runs of a text, each by one search."""
    total = max(1, len(text))
    space = sum(map(len, _SPACES.findall(text)))
    runs = [len(x) for x in _RUN.findall(text)]
    return {
        "space": space / total,
        "literals": sum(map(len, _NUMBER.findall(text))) / max(1, total - space - sum(map(len, _BRACKETS.findall(text)))),
        "encoded": max(runs, default=0),
        "encoded_share": sum(runs) / total,
    }


def structure(body: list[str]) -> dict:
    """How the lines of code are shaped and numbered."""
    return {
        "openers": _in_sequence([x for x in body if not x[0].isspace() and x.rstrip().endswith("{")]),
        "members": _in_sequence([x for x in body if x[0].isspace()]),
    }


def nesting(text: str) -> dict:
    """How brackets and indentation go together; comments, strings and regular expressions do not count.

    ``wrapped``: share of the lines at the margin that stand inside brackets, in a text whose brackets are balanced.
    ``packed``: the deepest nesting opened and closed within one line of at least 80 characters.
    """
    depth, line_from, deepest, opened, packed = 0, 0, 0, 0, 0
    margin = inside = 0
    fresh, text_line = True, False  # whether the line starts here, and starts outside of a comment or string
    for m in _ISLANDS.finditer(text + "\n"):
        c = m[0]
        if fresh:
            first = text[line_from : line_from + 1]
            text_line = m.start() > line_from or c not in "}])\n" and not c.startswith(("/", "'", '"', "`"))
            if text_line and first and first not in " \t\r}])\n":
                margin += 1
                inside += depth > 0
            fresh, opened, deepest = False, 0, 0
        if c == "\n":
            if m.start() - line_from >= 80:
                packed = max(packed, deepest)
            line_from, fresh = m.end(), True
        elif c in "{([":
            depth += 1
            opened += 1
        elif c in "})]":
            depth -= 1
            deepest = max(deepest, opened)
            opened = max(0, opened - 1)
        elif "\n" in c:
            line_from = m.start() + c.rindex("\n") + 1
    return {"wrapped": inside / margin if margin and depth == 0 else 0.0, "packed": packed, "margin": margin}


def longest_run(shapes: list[str]) -> int:
    """Lines of one shape below each other, at most."""
    best = here = 0
    for a, b in zip([None, *shapes], shapes):
        here = here + 1 if a == b else 1
        best = max(best, here)
    return best


def mean_name(text: str) -> tuple[int, float]:
    """Number and mean length of the names in a text."""
    names = [x for x in _NAME.findall(text) if x not in _KEYWORDS]
    return len(names), sum(map(len, names)) / len(names) if names else 0.0


def shape_share(body: list[str]) -> float:
    """Distinct line shapes to lines."""
    return len({shape_of(x) for x in body}) / max(1, len(body))


def verdict(text: str | None, path: str | None = None, language: str | None = None) -> tuple[str, str] | None:
    """(class, reason) of a text that nobody wrote by hand, else None.

    Classes: ``generated``, ``bundled``, ``compiled``, ``minified``, ``vendored``, ``data``.
    Layout comes first, marks last; names and shapes are looked at only where other statistics ask for it.
    """
    if not text or not text.strip():
        return None
    family = family_of(path, language)
    lines = text.lstrip("\ufeff").split("\n")
    return layout_verdict(text, lines, family) or mark_verdict(text, lines, family)


def layout_verdict(text: str, lines: list[str], family: str) -> tuple[str, str] | None:
    """What the statistics of a text's layout say."""
    t, code = FAMILIES[family], family == "code"
    d = density(text)
    if d["encoded"] >= t.encoded_run and d["encoded_share"] > 0.4:
        return "data", "encoded run"
    full = [x for x in lines if x.strip()]
    mean_line, longest = sum(map(len, full)) / max(1, len(full)), max(map(len, full))
    if family in ("code", "style", "sql") and longest >= t.longest_line and longest > 0.5 * len(text):
        line = max(full, key=len)
        if sum(map(str.isalnum, line)) < t.least_words * len(line):
            return "data", "symbols"
        if sum(map(str.isspace, line)) < t.least_space * len(line):
            return "minified", "one long dense line"
    squeezed = code and d["space"] < 0.2 or family == "style" and d["space"] < 1.5 * t.least_space
    n_names, name = mean_name(text) if squeezed and (mean_line > t.mean_line or code and d["space"] < 0.12 or _MAP.search(text)) else (0, 0.0)
    if family in ("code", "style") and mean_line > t.mean_line and (d["space"] < t.least_space or (n_names and d["space"] < 1.5 * t.least_space and name < 1.5 * t.name_length)):
        return "minified", "long dense lines"
    if code and n_names >= 40 and name < t.name_length:
        return "minified", "squeezed names"
    body = [x for x in full if not _COMMENT.match(x)]
    if d["literals"] > t.literal_share and len(body) >= 3:
        return "data", "literals"
    if family == "sql" and len(body) >= 8 and sum(1 for x in body if _INSERT.match(x)) > 0.8 * len(body):
        return "data", "rows"
    if not code:
        return None
    if len(body) >= 4:
        s = structure(body)
        if s["openers"] > 0.8 and s["members"] > 0.4 and shape_share(body) < t.shape_share:
            return "generated", "few line shapes, numbered in sequence"
    n = nesting(text)
    if n["margin"] >= 3 and n["wrapped"] > 0.6:
        return ("vendored", "universal module around lines at the margin") if _LIBRARY.search(text) else ("bundled", "wrapper around lines at the margin")
    if n["packed"] >= 4 and (line := next((x for x in body if len(x) >= 80 and _packed(x)), None)):
        return "compiled", f"helper packed into a line: {line.strip()[:40]}"
    if len(body) >= t.shape_run:
        shapes = [shape_of(x) for x in body]
        if longest_run(shapes) >= max(t.shape_run, 0.9 * len(body)):
            return "data", "rows of one shape"
    quoted = [len(x) for x in _LITERALS.findall(text)] if text.count('"') + text.count("'") >= 400 else []
    if len(quoted) >= 200 and sum(quoted) > t.string_share * len(text) * (1 - d["space"]):
        return "data", "strings"
    return None


def _packed(line: str) -> bool:
    """Whether functions are nested in one line under very short names."""
    found = mean_name(_LITERALS.sub("", line))
    return line.count("{") >= 2 and nesting(line)["packed"] >= 4 and found[0] >= 6 and found[1] < 4.0


def mark_verdict(text: str, lines: list[str], family: str) -> tuple[str, str] | None:
    """What tools and authors say in the comments above any code, and the helpers and heads that tools leave."""
    comments = head_comments(lines)
    if m := _BANNER.search(comments):
        return "generated", f"banner: {m[0].strip()[:60]}"
    if family != "code":
        return None
    if any(x in text for x in _BUNDLE_SIGNS) and (m := _BUNDLE.search(text)) and not _in_string(text, m.start()):
        return "bundled", "module wrapper"
    if any(x in text for x in _COMPILED_SIGNS) and (m := _COMPILED.search(text)) and not _in_string(text, m.start()):
        return "compiled", "compiler helper"
    if ("factory" in text or "define" in text or "typeof" in text) and (m := _LIBRARY.search(text)) and not _in_string(text, m.start()):
        return "vendored", "universal module head"
    if _LIBRARY_HEAD.search(comments):
        return "vendored", "library banner"
    return None


def _in_string(text: str, at: int) -> bool:
    """Whether a position lies in a string literal of its own line."""
    start = text.rfind("\n", 0, at) + 1
    before = text[start:at]
    return any(before.count(q) % 2 for q in "\"'`")


_OUT = pa.schema([("file_id", pa.int64()), ("class", pa.string()), ("reason", pa.string())])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, classes, reasons = [], [], []
        for file_id, text, path, language in zip(*(b.column(i).to_pylist() for i in range(4))):
            found = verdict(text.decode("utf-8", "replace") if text is not None else None, path, language)
            ids.append(file_id)
            classes.append(found[0] if found else "handwritten")
            reasons.append(found[1] if found else None)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, classes, reasons), _OUT)], schema=_OUT)


def source_classes(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``file_id, class, reason`` of each file with a ``file`` chunk.

    Class is ``handwritten`` or one of those of :func:`verdict`; only hand-written files are to be kept.

    Defined cases: null, empty and blank texts are ``handwritten`` (nothing speaks against them); chunks
    without a row in ``files`` are judged as code; a null path or language means code; a file with
    several ``file`` chunks comes out once for each chunk; texts of any length are read whole; an empty table gives an empty result; extra columns are not read.
    """
    texts = chunks.filter((F.col("chunk_kind") == "file") & F.col("file_id").isNotNull()).select("file_id", F.col("content").cast("binary").alias("content"))
    # the join's own shuffle, in the session's number of partitions whatever the sizes: judging costs more than moving
    texts = texts.repartition(shuffle_tasks(texts.sparkSession), "file_id")
    rows = texts.join(files.select("file_id", "path", "language"), "file_id", "left").select("file_id", "content", "path", "language")
    return rows.mapInArrow(_judge, "file_id long, class string, reason string")
