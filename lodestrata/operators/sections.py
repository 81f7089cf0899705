"""Prose files cut at their headings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_CHARS, MAX_LINES = 2200, 80
_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
_FENCE = re.compile(r"^\s*(```|~~~)")
_OUT = pa.schema([("key", pa.int64()), ("section_no", pa.int32()), ("title", pa.string()), ("line_start", pa.int64()), ("line_end", pa.int64()), ("content", pa.string())])


def sections(text: str, max_chars: int = MAX_CHARS, max_lines: int = MAX_LINES) -> Iterator[tuple[str, int, int, str]]:
    """(title, first line, last line, content); the title is the path of headings.

    A section beyond a limit is filled greedily by lines into parts, which are numbered in their titles; a
    single line longer than the limit is a part of its own.  Headings inside code fences are text.
    """
    stack: list[tuple[int, str]] = []
    start, own, fenced = 1, [], False

    def flush() -> Iterator[tuple[str, int, int, str]]:
        if not any(x.strip() for x in own):
            return
        title = " > ".join(t for _, t in stack)
        parts: list[list[str]] = [[]]
        for line in own:
            if parts[-1] and (len(parts[-1]) >= max_lines or sum(map(len, parts[-1])) + len(parts[-1]) + len(line) > max_chars):
                parts.append([])
            parts[-1].append(line)
        at = start
        for n, part in enumerate(parts, 1):
            yield (f"{title} (part {n})".strip() if len(parts) > 1 else title), at, at + len(part) - 1, "\n".join(part)
            at += len(part)

    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    for number, line in enumerate(lines, 1):
        if _FENCE.match(line):
            fenced = not fenced
        m = None if fenced else _HEADING.match(line.rstrip("\r"))
        if m:
            yield from flush()
            level = len(m[1])
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, m[2]))
            start, own = number, []
        own.append(line)
    yield from flush()


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(key, i, *s) for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if text for i, s in enumerate(sections(text))]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, _OUT)], schema=_OUT)


def heading_sections(df: DataFrame, key: str, content: str) -> DataFrame:
    """``key, section_no, title, line_start, line_end, content`` of prose texts; null and empty texts have none."""
    return df.selectExpr(f"cast({key} as bigint) as key", f"{content} as content").mapInArrow(_run, "key long, section_no int, title string, line_start long, line_end long, content string")
