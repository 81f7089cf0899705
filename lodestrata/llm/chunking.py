"""Oversized texts cut into overlapping pieces at natural boundaries (problem 1).

Content-defined chunking.  A rolling hash over the bytes marks *landmarks*; from the start of a piece, the
first landmark beyond the least size is taken and snapped to the nearest natural boundary: the edge of a
declaration if one lies in reach, else the end of a line.  As landmarks depend on the bytes around them
only, an edit moves the cuts next to it and the others fall where they fell before.  Only a line longer than
a quarter of the limit is ever cut inside, between characters, and only where no line ends in reach.

Scale: texts within the limits are dropped by a column expression before anything moves.  The others meet
the edges of their declarations, folded to a set of line numbers per file, in one shuffle on the file.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The limits of a piece, and the overlap that consecutive pieces share at most.
MAX_LINES, MAX_BYTES = 150, 6000
OVERLAP_LINES, OVERLAP_BYTES = 6, 1200
#: Share of the limit below which a piece is not ended.
LEAST = 0.4
#: One byte position in so many is a landmark; width of the hash in bytes.
SPACING, WIDTH = 512, 32

_GEAR = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=4).digest(), "little") for i in range(256)], dtype=np.uint32)
DECLARATION, LINE, INSIDE = 3, 2, 1
_CUTS = {DECLARATION: "declaration", LINE: "line", INSIDE: "inside", 0: "end"}


@dataclass(frozen=True)
class Limits:
    lines: int = MAX_LINES
    size: int = MAX_BYTES
    overlap_lines: int = OVERLAP_LINES
    overlap_bytes: int = OVERLAP_BYTES


def landmarks(data: np.ndarray) -> np.ndarray:
    """The byte positions after which a landmark stands."""
    h = np.zeros(len(data), dtype=np.uint32)
    mapped = _GEAR[data]
    for j in range(min(WIDTH, len(data))):
        h[j:] += mapped[: len(data) - j] << np.uint32(j)
    return np.flatnonzero(h >> np.uint32(16) < (1 << 16) // SPACING) + 1


def _boundaries(raw: bytes, data: np.ndarray, marks: np.ndarray, edges: set[int], limits: Limits) -> tuple[list[int], list[int], list[int]]:
    """(positions, kinds, lines before) of all places where a piece may begin or end, ascending."""
    ends = (np.flatnonzero(data == 10) + 1).tolist()
    if not ends or ends[-1] != len(raw):
        ends.append(len(raw))
    unit = max(4, limits.size // 4)
    positions, kinds, lines = [0], [LINE], [0]
    start = 0
    for number, end in enumerate(ends, 1):
        if end - start > unit:  # a long line: landmarks inside it, or else every unit, between characters
            at = start
            inner = marks[bisect_right(marks, start) : bisect_left(marks, end)]
            while end - at > unit:
                k = bisect_right(inner, at + unit // 2)
                cut = int(inner[k]) if k < len(inner) and inner[k] <= at + unit else at + unit
                while cut > at + 1 and raw[cut] & 0xC0 == 0x80:
                    cut -= 1
                positions.append(cut)
                kinds.append(INSIDE)
                lines.append(number - 1)
                at = cut
        positions.append(end)
        # an edge lies before the line after this one, or is the end of this one
        kinds.append(DECLARATION if number in edges else LINE)
        lines.append(number)
        start = end
    return positions, kinds, lines


def split_bytes(raw: bytes, edges: set[int], limits: Limits = Limits()) -> Iterator[dict]:
    """The pieces of a text.  ``edges`` holds the numbers of lines after which a declaration begins or ends."""
    if not raw:
        return
    data = np.frombuffer(raw, dtype=np.uint8)
    marks = landmarks(data).tolist()
    positions, kinds, lines = _boundaries(raw, data, marks, edges, limits)
    last = len(positions) - 1

    def line_of(i: int) -> int:
        """The 1-based number of the line in which position ``i`` begins."""
        return lines[i] + 1

    def end_line(i: int) -> int:
        return lines[i] if kinds[i] != INSIDE else lines[i] + 1

    def share(a: int, b: int) -> float:
        return max((positions[b] - positions[a]) / limits.size, (end_line(b) - line_of(a) + 1) / limits.lines)

    begin = fresh = 0  # where the piece begins, where its new text begins
    while True:
        if share(begin, last) <= 1:
            end = last
        else:
            least = fresh + 1
            while least < last and share(begin, least) < LEAST and share(begin, least + 1) <= 1:
                least += 1
            most = least
            while most < last and share(begin, most + 1) <= 1:
                most += 1
            reach = range(least, most + 1)
            k = bisect_left(marks, positions[least])
            mark = marks[k] if k < len(marks) and marks[k] <= positions[most] else None
            best = next((kind for kind in (DECLARATION, LINE) if any(kinds[i] == kind for i in reach)), INSIDE)
            if mark is None:
                end = max(i for i in reach if kinds[i] == best)
            else:
                end = min((i for i in reach if kinds[i] == best), key=lambda i: (abs(positions[i] - mark), i))
        yield {
            "byte_start": positions[begin],
            "byte_end": positions[end],
            "line_start": line_of(begin),
            "line_end": end_line(end),
            "overlap_bytes": positions[fresh] - positions[begin],
            "overlap_lines": end_line(fresh) - line_of(begin) + 1 if fresh > begin else 0,
            "cut": _CUTS[0 if end == last else kinds[end]],
            "piece": raw[positions[begin] : positions[end]],
        }
        if end == last:
            return
        # the next piece begins with the last lines of this one; inside a line only where none begins in reach
        back = [i for i in range(end - 1, begin, -1) if positions[end] - positions[i] <= limits.overlap_bytes and end_line(end) - line_of(i) + 1 <= limits.overlap_lines] if end - begin > 1 else []
        whole = [i for i in back if kinds[i] != INSIDE]
        fresh, begin = end, (min(whole) if whole else min(back) if back else end)
        if begin < fresh and share(begin, fresh + 1) > 1:  # too long to repeat before the next unit
            fits = [i for i in range(begin, fresh) if share(i, fresh + 1) <= 1]
            begin = min(fits) if fits else fresh


def oversized(content: Column, limits: Limits = Limits()) -> Column:
    """Whether a text has more lines or bytes than a piece may have; a last line end begins no line."""
    breaks = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    lines = breaks + F.when(content.endswith("\n") | (content == ""), 0).otherwise(1)
    return (F.octet_length(content) > limits.size) | (lines > limits.lines)


_OUT = pa.schema([("file_id", pa.int64()), ("piece_no", pa.int32()), *((n, pa.int64()) for n in ("byte_start", "byte_end", "line_start", "line_end", "overlap_bytes", "overlap_lines")), ("cut", pa.string()), ("piece", pa.string())])
_DDL = "file_id long, piece_no int, byte_start long, byte_end long, line_start long, line_end long, overlap_bytes long, overlap_lines long, cut string, piece string"


def _split(limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for file_id, raw, starts, ends in zip(*(b.column(i).to_pylist() for i in range(4))):
                edges = {n - 1 for n in starts or ()} | set(ends or ())
                for k, p in enumerate(split_bytes(raw, edges, limits)):
                    rows.append((file_id, k, *(p[f.name] for f in list(_OUT)[2:-1]), p["piece"].decode("utf-8", "replace")))
                    held += len(p["piece"])
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)

    return run


def split_oversized(chunks: DataFrame, symbols: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The pieces of each file whose ``file`` chunk exceeds the limits.

    ``file_id, piece_no, byte_start, byte_end, line_start, line_end, overlap_bytes, overlap_lines, cut, piece``:
    a piece is the text's UTF-8 bytes from ``byte_start`` to ``byte_end`` and lies within both limits, the pieces
    cover the text in order, and each begins with the stated overlap, a part of the piece before.
    ``cut`` says at what it ends: declaration, line, inside (of a long line) or end (of the text).

    Defined cases: null and empty texts and texts within the limits give no row; null, missing or
    wrong line numbers of symbols merely give no or other declaration edges; repeated symbols count once;
    an overlap is left out only where it would keep the next unit from fitting; extra columns are not read.
    """
    texts = chunks.filter((F.col("chunk_kind") == "file") & F.col("content").isNotNull() & F.col("file_id").isNotNull()).select("file_id", "content")
    large = texts.filter(oversized(F.col("content"), limits)).select("file_id", F.col("content").cast("binary").alias("content"))
    edges = symbols.filter("file_id is not null and (line_start is not null or line_end is not null)").groupBy("file_id").agg(F.collect_set(F.col("line_start").cast("long")).alias("starts"), F.collect_set(F.col("line_end").cast("long")).alias("ends"))
    return large.join(edges, "file_id", "left").select("file_id", "content", "starts", "ends").mapInArrow(_split(limits), _DDL)
