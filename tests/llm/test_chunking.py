import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm.chunking import Limits, split_bytes, split_oversized

LIMITS = Limits()


def n_lines(b):
    return b.count(b"\n") + (1 if b and not b.endswith(b"\n") else 0)


def check(raw, edges=frozenset(), limits=LIMITS):
    pieces = list(split_bytes(raw, set(edges), limits))
    covered = b""
    for k, p in enumerate(pieces):
        b = p["piece"]
        assert len(b) <= limits.size and n_lines(b) <= limits.lines
        assert raw[p["byte_start"] : p["byte_end"]] == b
        b.decode("utf-8")
        assert p["byte_start"] + p["overlap_bytes"] == len(covered)
        assert p["line_start"] == raw[: p["byte_start"]].count(b"\n") + 1
        assert p["line_end"] == p["line_start"] + n_lines(b) - 1
        assert p["overlap_lines"] == n_lines(b[: p["overlap_bytes"]])
        if k:
            assert p["overlap_bytes"] <= limits.overlap_bytes
        if p["cut"] in ("line", "declaration"):
            assert b.endswith(b"\n")
        covered += b[p["overlap_bytes"] :]
    assert covered == raw
    return pieces


def source(n, seed=1):
    rnd = random.Random(seed)
    return "".join("  " * rnd.randrange(3) + " ".join(rnd.choice(["load", "keep", "row", "née", "日本"]) for _ in range(rnd.randrange(1, 9))) + "\n" for _ in range(n)).encode()


def test_lines_and_declarations():
    raw = source(700)
    edges = set(range(20, 700, 20))
    pieces = check(raw, edges)
    assert len(pieces) > 4 and all(p["cut"] == "declaration" for p in pieces[:-1]) and all(p["overlap_bytes"] > 0 for p in pieces[1:])
    assert all(p["cut"] == "line" for p in check(raw)[:-1])


def test_edits_alter_only_neighbours():
    raw = source(3000)
    lines = raw.split(b"\n")
    lines.insert(1500, b"a new line of text in the middle")
    before, after = ({p["piece"] for p in check(x)} for x in (raw, b"\n".join(lines)))
    assert len(before - after) <= 4 and len(before) > 20


@pytest.mark.parametrize("raw", [b"x" * 50_000, "é".encode() * 9000, b"\n" * 1000, b"a\r\n" * 400, ("日本語" * 3000 + "\n").encode() + source(200), b"\xef\xbb\xbf" + source(200), source(151), b"y" * 6001 + b"\n", b"y" * 5999 + b"\n" + b"z" * 5999, b"", b"z"])
def test_special_texts(raw):
    check(raw)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 90), st.sampled_from(["a", "é", "😀", " b"])), max_size=60), st.booleans(), st.sets(st.integers(-2, 70)))
def test_any_text(parts, ended, edges):
    raw = ("\n".join(c * n for n, c in parts) + ("\n" if ended else "")).encode()
    check(raw, edges, Limits(7, 60, 2, 20))


def test_operator(spark):
    big = source(400).decode()
    chunks = spark.createDataFrame([(1, "file", big, "x"), (2, "file", "short", "y"), (3, "file", None, "z"), (4, "file", "", None), (5, "file", "a\n" * 150, None), (6, "file", "a\n" * 150 + "b", None), (1, "symbol", big, "x"), (None, "file", big, "x")], "file_id long, chunk_kind string, content string, piece string")
    symbols = spark.createDataFrame([(1, 20, 40), (1, 20, 40), (1, None, 60), (1, 9999, -5), (2, None, None), (None, 1, 2)], "file_id long, line_start long, line_end long")
    rows = split_oversized(chunks, symbols).collect()
    assert {r.file_id for r in rows} == {1, 6} and len([r for r in rows if r.file_id == 6]) >= 2
    assert split_oversized(chunks.limit(0), symbols.limit(0)).count() == 0
    assert split_oversized(chunks, symbols.limit(0)).count() >= len(rows) - 1
