"""Functions paired with their documentation (problem 4), by island grammars.

An island grammar names only what matters - comments, annotations, strings, regular expressions and brackets - and
lets the rest of the file pass as water.  There is one grammar per language family.  A file is passed over once: the
islands tell which lines are comments (and not text in a string that looks like one), where an annotation ends, and where
a body balances.  The declaration is found from the symbol's line and signature, of which one may be wrong; the run of
comments and annotations is read upwards from it, the body downwards.

Scale: the texts of files with functions and the functions of each file meet in one shuffle on
``file_id``; symbols are folded to one list per file before it (partial aggregation), so a file
costs one row on either side.  A list is as long as its file has functions, never longer.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.runtime import shuffle_tasks

#: A description must keep this many words.
LEAST_WORDS = 4


@dataclass(frozen=True)
class Grammar:
    """The islands of one language family."""

    line_comments: tuple[str, ...]
    block_comments: bool
    decorators: tuple[str, ...]
    body: str  # "braces", "indent" or "dollar"
    strings: str  # pattern of strings and regular expressions
    bodies: str = r"(?!)"  # pattern of bodies in quotes


_QUOTED = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
#: A slash begins a regular expression after an operator or an opening bracket, not after a value.
_REGEX = r"(?:(?<=[=(,:!&|?;{}\[]\s)|(?<=[=(,:!&|?;{}\[])|(?<=return\s))/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/"
_TRIPLE = r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\''
C_LIKE = Grammar(("//",), True, ("@",), "braces", rf"`(?:\\.|[^`\\])*`|{_QUOTED}|{_REGEX}")
CURLY = Grammar(("//",), True, ("@", "[["), "braces", rf"{_TRIPLE}|{_QUOTED}")
SHARP = Grammar(("//",), True, ("[",), "braces", rf'{_TRIPLE}|@"(?:""|[^"])*"|{_QUOTED}')
SQL = Grammar(("--",), True, (), "dollar", r"'(?:''|[^'])*'|\"[^\"\n]*\"", r"\$(?P<tag>\w*)\$[\s\S]*?\$(?P=tag)\$")
HASH = Grammar(("#",), False, ("@",), "indent", rf"{_TRIPLE}|{_QUOTED}")
RUST = Grammar(("//",), True, ("#[", "#!["), "braces", r'r#"[\s\S]*?"#|"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\\n])\'')
PHP = Grammar(("//", "#"), True, ("#[",), "braces", _QUOTED)
LUA = Grammar(("--",), False, (), "indent", _QUOTED)

# File suffixes and language names of each family.
_SUFFIX = {"sql": SQL, "py": HASH, "pyi": HASH, "rb": HASH, "sh": HASH, "bash": HASH, "yml": HASH, "yaml": HASH, "toml": HASH, "r": HASH, "ex": HASH, "exs": HASH, "rs": RUST, "php": PHP, "lua": LUA, "hs": LUA, "cs": SHARP, **dict.fromkeys(("java", "kt", "kts", "scala", "swift", "go", "c", "h", "cc", "cpp", "hpp"), CURLY)}
_LANGUAGE = {"sql": SQL, "python": HASH, "ruby": HASH, "shell": HASH, "bash": HASH, "yaml": HASH, "rust": RUST, "php": PHP, "lua": LUA, "haskell": LUA, "plpgsql": SQL, "csharp": SHARP, "c#": SHARP, **dict.fromkeys(("java", "kotlin", "scala", "swift", "go", "c", "c++", "cpp"), CURLY)}


def grammar_for(path: str | None, language: str | None) -> Grammar:
    """The path's suffix decides, then the language; C-like syntax is the default."""
    suffix = (path or "").rsplit(".", 1)[-1].lower() if "." in (path or "") else ""
    return _SUFFIX.get(suffix) or _LANGUAGE.get((language or "").strip().lower()) or C_LIKE


_SPACE = re.compile(r"\s+")


def _squeeze(s: str) -> str:
    return _SPACE.sub("", s).casefold()


class Squeezed(Sequence):
    """Lines without white space in lower case, squeezed when they are asked for."""

    def __init__(self, lines: list[str]) -> None:
        self.lines, self.known = lines, [None] * len(lines)

    def __len__(self) -> int:
        return len(self.lines)

    def __getitem__(self, i: int) -> str:
        if self.known[i] is None:
            self.known[i] = _squeeze(self.lines[i])
        return self.known[i]


@lru_cache(maxsize=32)
def _islands(g: Grammar, brackets: bool) -> re.Pattern:
    block = r"/\*[\s\S]*?(?:\*/|\Z)" if g.block_comments else r"(?!)"
    attribute = "".join(rf"(?!{re.escape(d[1:])})" for d in g.decorators if d.startswith("#") and "#" in g.line_comments)
    line = "|".join(re.escape(m) + (attribute if m == "#" else "") for m in g.line_comments)
    return re.compile(rf"(?P<block>{block})|(?P<line>(?:{line})[^\n]*)|(?P<body>{g.bodies})|(?P<text>{g.strings})" + (r"|(?P<bracket>[{}()\[\];])" if brackets or g.decorators else ""))


class Islands:
    """What one pass over a file finds: comments by line, brackets, and bodies in quotes."""

    def __init__(self, lines: list[str], g: Grammar, brackets: bool = True) -> None:
        self.text = "\n".join(lines)
        self.starts = [0]
        for x in lines:
            self.starts.append(self.starts[-1] + len(x) + 1)
        self.blocks: dict[int, tuple[int, int]] = {}  # last line: first line, whether nothing stands before or after
        self.line_comments: dict[int, int] = {}
        self.marks: list[int] = []
        self.signs: list[str] = []
        self.ends: list[int] = []
        for m in _islands(g, brackets).finditer(self.text):
            kind, at = m.lastgroup, m.start()
            if kind == "block":
                first, last = self.line_of(at), self.line_of(m.end() - 1)
                alone = not lines[first][: at - self.starts[first]].strip(_BLANK) and not lines[last][m.end() - self.starts[last] :].strip()
                self.blocks[last] = (first, alone and self.blocks.get(last, (0, True))[1])
            elif kind == "line":
                self.line_comments[self.line_of(at)] = at
            elif kind != "text":
                self.marks.append(at)
                self.signs.append("$" if kind == "body" else m[0])
                self.ends.append(m.end())

    def line_of(self, position: int) -> int:
        return bisect_right(self.starts, position) - 1

    def block_ending(self, line: int) -> int | None:
        """The first line of the block comment that ends on a line, if it stands alone."""
        first, alone = self.blocks.get(line, (0, False))
        return first if alone else None

    def is_comment(self, line: int, lines: list[str]) -> bool:
        """Whether a line is nothing but a line comment."""
        at = self.line_comments.get(line)
        return at is not None and not lines[line][: at - self.starts[line]].strip(_BLANK)

    def annotation_start(self, line: int, lines: list[str], g: Grammar) -> int | None:
        """The first line of the annotation whose brackets close on a line."""
        depth = 0
        k = bisect_left(self.marks, self.starts[line + 1]) - 1
        for j in range(line, -1, -1):
            s = lines[j].strip()
            if not s:
                return None
            while k >= 0 and self.marks[k] >= self.starts[j]:
                depth += (self.signs[k] in ")]}") - (self.signs[k] in "([{")
                k -= 1
            if any(s.startswith(d) for d in g.decorators):
                return j if depth == 0 else None
            if depth <= 0:
                return None
        return None


_BLANK = " \t\ufeff\r\x0b\x0c\xa0"


def find_declaration(lines: list[str], squeezed: list[str], name: str | None, line_start: int | None, line_end: int | None, signature: str | None) -> int | None:
    """The index of the declaration's line, or None if neither line nor signature leads to one.

    The signature is compared without white space and may be cut short; among several lines that
    it fits, a full match wins over a prefix and then the one nearest to ``line_start`` (or, if
    that is missing, the last one before ``line_end``).  Without a usable signature the line holds.
    """
    at = line_start - 1 if line_start is not None and 1 <= line_start <= len(lines) else None
    sig = _squeeze((signature or "").replace("…", "").rstrip(". ") if signature and signature.rstrip().endswith(("…", "...")) else (signature or ""))
    if len(sig) >= 3:
        if at is not None and squeezed[at].startswith(sig):
            return at
        fits = [i for i, s in enumerate(squeezed) if s.startswith(sig)]
        if not fits:
            fits = [i for i, s in enumerate(squeezed) if sig in s]
        if fits:
            whole = [i for i in fits if squeezed[i] == sig] or fits
            if line_start is not None:
                return min(whole, key=lambda i: (abs(i - (line_start - 1)), i))
            if line_end is not None:
                before = [i for i in whole if i < line_end]
                return before[-1] if before else whole[0]
            return whole[0]
    if at is not None:
        return at
    if name:
        word = re.compile(rf"(?<![\w$]){re.escape(name)}(?![\w$])\s*(\(|=|:|<)")
        return next((i for i, s in enumerate(lines) if word.search(s)), None)
    return None


def comment_run(lines: list[str], at: int, g: Grammar, islands: Islands | None = None) -> list[tuple[str, str]]:
    """The comment lines directly above line ``at`` in reading order, as (kind, bare text).

    Kind is ``line`` or the number of the block.  Annotations may stand in the run, blank lines end it.
    """
    islands = islands or Islands(lines, g)
    out: list[tuple[str, str]] = []
    i, block = at - 1, 0
    while i >= 0:
        s = lines[i].strip().lstrip("\ufeff")
        if not s:
            break
        if i in islands.blocks:
            j = islands.block_ending(i)
            if j is None:
                break
            block += 1
            text = "\n".join(x.strip().lstrip("\ufeff") for x in lines[j : i + 1])
            text = re.sub(r"^/\*+!?", "", text)
            text = re.sub(r"\*+/$", "", text)
            out += [(str(block), re.sub(r"^\s*\*+", "", x).strip()) for x in reversed(text.split("\n"))]
            i = j - 1
        elif islands.is_comment(i, lines):
            mark = next(m for m in g.line_comments if s.startswith(m))
            out.append(("line", re.sub(rf"^(?:{re.escape(mark)}|{re.escape(mark[0])})+!?", "", s).strip()))
            i -= 1
        elif g.decorators and (j := islands.annotation_start(i, lines, g)) is not None:
            i = j - 1
        else:
            break
    out.reverse()
    return out


# What makes a comment line no description.
_LICENCE = re.compile(r"copyright|\(c\)\s*\d{4}|©|\blicen[sc]ed?\b.*\b(under|see|mit|apache|bsd|gpl|mpl)\b|\bSPDX-|all rights reserved|\bpermission is hereby granted|\bwithout warranty\b|@licen[sc]e|@copyright|\b(MIT|BSD|Apache|GPL)[- ](\d\S* )?licen[sc]e", re.I)
_DIRECTIVE = re.compile(
    r"^(?:@?(?:ts-(?:ignore|expect-error|nocheck|check)|ts-[a-z-]+|jsx\w*|flow|noflow|vite-ignore|__PURE__|preserve|format|prettier|jest-environment)\b|[#@]__\w+__"
    r"|(?:eslint|tslint|jshint|jslint|jscs|stylelint|biome|rome|oxlint|prettier|dprint|istanbul|c8|v8|nyc|sonar|NOSONAR|noinspection|pylint|flake8|noqa|mypy|pyright|ruff|isort|yapf|fmt|type:\s*ignore|pragma|nolint|swiftlint|rubocop|sqlfluff|squawk|pgformatter|webpack\w*|rollup|deno-lint|deno-fmt|cspell|spell-?checker|codecov|coverage|global|globals|exported|lint|@formatter|clang-format|checkstyle|sourceMappingURL|sourceURL|vim?:|-\*-)"
    r"(?:[\s:=/-]|$))|^[/#]*\s*<(?:reference|amd-)|^[#@]\s*source(?:Mapping)?URL=|^\w+-(?:ignore|disable|enable)(?:-\w+)*\b|^!/",
    re.I,
)
_TODO = re.compile(r"^\W*(?:@?(?i:to[- ]?do)\b\s*[:(\]]|@todo\b|(?i:fixme|tbd|wip)\b|(?i:hack|bug|note to self)\s*[:(])|\b(?:TODO|FIXME|XXX+|TBD|WIP)\b")
_PLACEHOLDER = re.compile(
    r"^\W*(?:(?:no|missing|add|insert|write|put|enter|your|needs?|without|fill in|to be|some)\b.{0,40}\b(?:descriptions?|documentation|docs?|documented|comments?|summary|docstring|written|text)\b.{0,40}"
    r"|(?:descriptions?|documentation|docs?|comments?|summary|docstring|text)\b\s*(?:goes|comes|will|is|to|follows?|pending|missing|needed|here|coming|tba|not|should|of the (?:function|method))\b.{0,50}"
    r"|(?:please\s+)?document (?:me|this).{0,40}|(?:not (?:yet )?|un)documented.{0,30}|lorem ipsum.*|placeholder.*|auto-?generated (?:method|function|constructor)? ?stub.*|empty (?:block|comment|function).{0,20}|(?:foo|bar|baz)[\s,.]*(?:foo|bar|baz)?.{0,10}|(?:n/?a|none|nothing|coming soon|later|\?+|\.+)\W*)$",
    re.I,
)
_REGION = re.compile(r"^\W*#?(?:end)?region\b|^\W*#pragma\s+(?:end)?region|^\W*MARK\s*:|^\W*<editor-fold|^\W*</editor-fold", re.I)
_INHERIT = re.compile(r"\{?@inherit-?doc\}?", re.I)
_TAG = re.compile(r"^[@\\]([A-Za-z][\w-]*)\s*:?\s*(.*)$", re.S)
_KEPT_TAGS = {"description", "summary", "desc", "brief"}
_SEPARATOR = re.compile(r"^\W*([-=*#~_+])\1{2,}.*([-=*#~_+])\2{2,}\W*$")
_CODE = re.compile(
    r"[{}]\s*$|^(?=.*[()=\[\]{}<>]).*;\s*$|^(?:return|break|continue|pass)\b[\w\s.$]*;$|^[\])}]+[;,)]*$|=>"
    r"|^(?:if|for|while|switch|catch|elif)\s*\(|^(?:const|let|var|return|await|throw|new|delete|yield|case)\s+[\w$]+\s*(?:[({=<\[;]|\.\w)"
    r"|^(?:export|import|async|public|private|protected|static|def|fn|func|function\*?|class|interface|enum)\s+(?:[\w$]+\s+){0,3}[\w$]*\s*[({=<:]|^import\s+(?:[\w$*{}, ]+\s+from\s+)?['\"]|^from\s+[\w.]+\s+import\b"
    r"|^[\w$.\[\]]+\s*(?:[-+*/|&^%?]{0,3}=(?!=)|\+\+|--)\s*\S|^[\w$.]+\([^)]*\)\s*[;,.{]?$"
    r"|^(?i:select|insert\s+into|update|delete\s+from|create|alter|drop|grant)\s+[\w.*\", ]+(?i:\bfrom\b|\bset\b|\bvalues\b|\btable\b|\bto\b).*;\s*$|\bconsole\.\w+\(|^[\"'\w$-]+\s*:\s*[\w$\"'\[{(.-]+,?\s*$"
)
_WORD = re.compile(r"[^\W\d_](?:[\w'’-]*[^\W_])?")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")


def description(run: list[tuple[str, str]]) -> str:
    """What the comment lines say once marks, tags, directives, notes and code are taken away."""
    licensed = {kind for kind, text in run if kind != "line" and _LICENCE.search(text)}
    kept: list[str] = []
    in_tag: str | None = None
    for kind, text in run:
        text = _INHERIT.sub("", text).strip()
        if kind in licensed or _LICENCE.search(text):
            continue
        if not text or not re.search(r"\w", text):
            in_tag = None
            continue
        if _DIRECTIVE.search(text) or _REGION.search(text) or _SEPARATOR.search(text):
            continue
        if tag := _TAG.match(text):
            if tag[1].lower() not in _KEPT_TAGS:
                in_tag = kind
                continue
            in_tag, text = None, tag[2].strip()
        elif in_tag is not None and in_tag == kind != "line" and text[:1].islower():
            continue  # a tag's text runs on
        else:
            in_tag = None
        if _TODO.search(text) or _PLACEHOLDER.search(text) or _CODE.search(text):
            continue
        kept.append(text)
    return "\n".join(kept).strip()


def word_count(text: str) -> int:
    return sum(max(1, len(_CJK.findall(w)) // 2) for w in _WORD.findall(text))


def code_of(lines: list[str], at: int, line_end: int | None, g: Grammar, islands: Islands | None = None) -> str:
    """The declaration with its balanced body; where none balances, up to ``line_end``, else its line."""
    given = line_end if line_end is not None and at < line_end <= len(lines) else at + 1
    if g.body == "indent":
        indent = len(lines[at]) - len(lines[at].lstrip())
        end = at + 1
        for i in range(at + 1, len(lines)):
            if lines[i].strip():
                if len(lines[i]) - len(lines[i].lstrip()) <= indent and not lines[i].lstrip().startswith((")", "]")):
                    break
                end = i + 1
        return "\n".join(lines[at:end])
    islands = islands or Islands(lines, g)
    start = islands.starts[at]
    depth, parens, opened, quoted = 0, 0, False, False
    for k in range(bisect_left(islands.marks, start), len(islands.marks)):
        c = islands.signs[k]
        if c == "(":
            parens += 1
        elif c == ")":
            parens -= 1
        elif c == "$":
            quoted = True
        elif c == "{" and g.body == "braces" and not (parens and not opened):
            depth, opened = depth + 1, True
        elif c == "}" and opened:
            depth -= 1
            if depth == 0:
                return islands.text[start : islands.ends[k]]
        elif c == ";" and not opened and parens <= 0:
            return islands.text[start : islands.ends[k]]
    if quoted:
        last = next(k for k in range(bisect_left(islands.marks, start), len(islands.marks)) if islands.signs[k] == "$")
        return islands.text[start : islands.ends[last]]
    return "\n".join(lines[at:given])


def pairs_of(text: str | None, path: str | None, language: str | None, symbols: list[dict], with_code: bool = True) -> Iterator[tuple]:
    """(symbol_id, name, code, description) of each symbol of one file with real documentation."""
    if not text:
        return
    g = grammar_for(path, language)
    lines = [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]
    squeezed, islands = Squeezed(lines), Islands(lines, g, with_code)
    for s in symbols:
        at = find_declaration(lines, squeezed, s["name"], s["line_start"], s["line_end"], s["signature_text"])
        if at is None:
            continue
        said = description(comment_run(lines, at, g, islands))
        if word_count(said) >= LEAST_WORDS:
            yield s["symbol_id"], s["name"], code_of(lines, at, s["line_end"], g, islands) if with_code else None, said


_OUT = pa.schema([("symbol_id", pa.int64()), ("file_id", pa.int64()), ("name", pa.string()), ("code", pa.string()), ("description", pa.string())])


def _extract(with_code: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(5)]
            for file_id, text, path, language, symbols in zip(*(b.column(i).to_pylist() for i in range(5))):
                for symbol_id, name, code, said in pairs_of(text, path, language, symbols, with_code):
                    for column, value in zip(rows, (symbol_id, file_id, name, code, said)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _OUT)], schema=_OUT)

    return run


def documented_functions(files: DataFrame, chunks: DataFrame, symbols: DataFrame, with_code: bool = True) -> DataFrame:
    """``symbol_id, file_id, name, code, description`` of each documented function or method.

    Defined cases: symbols delivered twice count once (of differing rows with one id, the smallest by file, name, lines and signature);
    null or empty texts, symbols whose declaration is nowhere in the file, and files without
    a ``file`` chunk give no row; null line numbers and signatures are recovered from each other; a missing path
    or language means C-like syntax; extra columns are not read.
    """
    functions = symbols.filter(F.col("kind").isin("function", "method") & F.col("symbol_id").isNotNull()).select("symbol_id", "file_id", "name", F.col("line_start").cast("long"), F.col("line_end").cast("long"), "signature_text")
    # of differing rows with one id, the first in the order of their columns
    one = functions.groupBy("symbol_id").agg(F.min(F.struct("file_id", "name", "line_start", "line_end", "signature_text")).alias("s")).select("symbol_id", "s.*")
    per_file = one.groupBy("file_id").agg(F.collect_list(F.struct("symbol_id", "name", "line_start", "line_end", "signature_text")).alias("symbols"))
    texts = chunks.filter((F.col("chunk_kind") == "file") & F.col("content").isNotNull()).select("file_id", "content")
    about = files.select("file_id", "path", "language")
    # the join's own shuffle, in the session's number of partitions whatever the sizes: parsing costs more than moving
    texts = texts.repartition(shuffle_tasks(texts.sparkSession), "file_id")
    rows = texts.join(per_file, "file_id").join(about, "file_id", "left").select("file_id", "content", "path", "language", "symbols")
    return rows.mapInArrow(_extract(with_code), "symbol_id long, file_id long, name string, code string, description string")
