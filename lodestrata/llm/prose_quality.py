"""Text statistics per document, and which texts are no natural prose (problem 9).

Layout decides how a text is read.  Three measures look at neighbouring lines: *vertical delimiter alignment* (the same
delimiters or gaps of blanks in the same columns, or the same delimiters in the same order around short fields), *periodicity
of indentation* and *autocorrelation of line lengths*, each of a block of lines.  Aligned lines, blocks that go in
cycles, item marks and runs of short lines are rows: each line stands for itself and must be a whole sentence
to count.  Other lines are joined to paragraphs and cut at sentence ends.  A sentence counts as running text by
ratios that know no language: words of letters only, symbols, vowels against runs of consonants, lengths
of words, repetition, punctuation.  The share of characters in such sentences decides.

Scale: one narrow pass; the characters of many texts are one numpy array, so that no Python runs per character,
word or line.  No shuffle, nothing depends on other documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.runtime import spread

# Frequent words, for the statistic common_word_share alone; no decision reads them.
COMMON = {
    "en": "the of and to a in is it that for on with as was be by at this are or from an not but have had has they their which",
    "de": "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie",
    "fr": "le la les de des du un une et est en que qui dans pour pas sur par au aux ce cette ces il elle se sa son avec plus",
    "es": "el la los las de del que y en un una es no se por con para al lo como más su sus ha si sin sobre este esta ya",
}

KINDS = ("empty", "prose", "list", "table", "code", "log", "junk")

# Classes of characters; everything from _VOWEL on is solid.
_SPACE, _BREAK, _VOWEL, _CONSONANT, _LETTER, _DIGIT, _END, _PLAIN, _MARK, _SYMBOL = range(10)
_ENDS = ".!?…。！？"
_PLAIN_MARKS = frozenset(",;:'\"()-–—«»¿¡’‘“”„‚、%&/")
_VOWELS = frozenset("aeiouyæœøıаеёиоуыэюяіїєўαεηιουω")
_BULLETS = "-*+•‣▪◦·–"
_CLOSING = "\"'”’»)]"
#: Characters in one numpy pass, and words in a stretch without a sentence end.
_PASS_CHARS, _CHUNK_WORDS = 1_000_000, 40
#: Characters of a text beyond which it is measured in segments of whole lines.
LONG_CHARS = 8_000_000
_GAP = 0x20

# Names of the kinds of lines in a text that is no prose.
_LOG = re.compile(r"\W*(?:\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\d\d:\d\d:\d\d|\d\d/\w{3}/\d{4}|\[\d+(?:\.\d+)?\])|\s*(?:DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|TRACE)\b[ :\]]|\s*at\s+\S+.*[:(]\d+|\s*File \".*\", line \d+|\s*Caused by:|\w+(?:Error|Exception):")
_CODE = re.compile(
    r".*[{};]\s*$|\s*[})\]]+[;,)]*\s*$|.*=>|\s*(?:const|let|var|import|export|return|if|for|while|else|try|catch|function|class|def|async|await|public|private|static|throw|switch|case)\b.*[({=;:]|\s*(?:select|insert|update|delete|create|alter|drop)\b.*\b(?:from|into|set|table|function|index|view|where|values)\b"
    r"|\s*[\w.$\[\]]+\s*[-+*/]?=[^=]|\s*[\w.$]+\([^)]*\)\s*;?$|\s*</?\w+[^>]*>|(?:@@|diff --git|index [0-9a-f]{6,}|\+\+\+|---)\s|\s*\"[^\"]+\"\s*:",
    re.I,
)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(class, lower case) of every code point of the basic plane."""
    classes, lower = np.full(0x10000, _SYMBOL, np.uint8), np.arange(0x10000, dtype=np.uint32)
    for code in range(0x10000):
        ch = chr(code)
        if ch == "\n":
            classes[code] = _BREAK
        elif ch.isspace():
            classes[code] = _SPACE
        elif ch in _ENDS:
            classes[code] = _END
        elif ch in _PLAIN_MARKS:
            classes[code] = _PLAIN
        elif ch.isdigit():
            classes[code] = _DIGIT
        elif ch.isalpha():
            low = ch.lower()
            if len(low) == 1:
                lower[code] = ord(low)
            spelt = code < 0x250 or 0x370 <= code < 0x530 or 0x1E00 <= code < 0x2000
            classes[code] = (_VOWEL if unicodedata.normalize("NFD", low)[0] in _VOWELS else _CONSONANT) if spelt else _LETTER
        elif unicodedata.combining(ch) or unicodedata.category(ch) in ("Mn", "Mc", "Me"):
            classes[code] = _MARK
    return classes, lower


@lru_cache(maxsize=1)
def _factors() -> np.ndarray:
    return np.random.default_rng(9).integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)


_OUT = [
    ("n_chars", pa.int64(), "long"),
    ("n_words", pa.int64(), "long"),
    ("n_lines", pa.int64(), "long"),
    *((n, pa.float64(), "double") for n in ("mean_word_length", "symbol_ratio", "digit_ratio", "ended_line_share", "common_word_share", "distinct_word_share", "length_autocorrelation", "indent_periodicity", "aligned_share", "prose_share")),
    ("kind", pa.string(), "string"),
]
_BREAKS = str.maketrans({c: "\n" for c in "\r\x0b\x0c\x85\u2028\u2029"} | {c: None for c in "\ufeff\u200b\xad"})


def _clean(text: str | None) -> str:
    t = text or ""
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
    return t.replace("\r\n", "\n").translate(_BREAKS)


def autocorrelation(values: np.ndarray) -> float:
    """The largest autocorrelation at lags 1 to 4; 1 for a constant series, 0 for fewer than 6 values."""
    if len(values) < 6:
        return 0.0
    v = values - values.mean()
    power = float(v @ v)
    if power < 1e-9:
        return 1.0
    return max(float(v[k:] @ v[:-k]) / power for k in range(1, 5))


def periodicity(indents: np.ndarray) -> float:
    """Share of lines whose indent repeats that of the line 1, 2 or 3 before, where any line is indented."""
    if len(indents) < 4 or not indents.any():
        return 0.0
    return max(float((indents[k:] == indents[:-k]).mean()) for k in range(1, 4))


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n)


def _cycles(lengths: np.ndarray, indents: np.ndarray, block: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(autocorrelation of line lengths, periodicity of indentation) of each block of lines, as the functions above."""
    n = np.bincount(block, minlength=blocks)
    v = lengths - (_sums(lengths, block, blocks) / np.maximum(n, 1))[block]
    power = _sums(v * v, block, blocks)
    indented = _sums(indents, block, blocks) > 0
    related, repeated = np.zeros(blocks), np.zeros(blocks)
    for k in range(1, 5):
        if len(v) <= k:
            break
        own = block[k:] == block[:-k]
        products = _sums(np.where(own, v[k:] * v[:-k], 0), block[k:], blocks)
        related = np.maximum(related, products / np.maximum(power, 1e-9))
        if k < 4:
            same = _sums(own & (indents[k:] == indents[:-k]), block[k:], blocks)
            repeated = np.maximum(repeated, same / np.maximum(n - k, 1))
    related[power < 1e-9] = 1.0
    return np.where(n >= 6, related, 0.0), np.where((n >= 4) & indented, repeated, 0.0)


def _aligned(codes: np.ndarray, classes: np.ndarray, columns: np.ndarray, line: np.ndarray, token_start: np.ndarray, n_tokens: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Which lines have their delimiters where a neighbouring line has its own.

    ``joined`` says of each line whether the next one belongs to the same text and neither is blank.
    """
    n_lines = len(n_tokens)
    # a gap is a tab or two blanks before a field, but not the blanks after a sentence
    before = token_start[token_start >= 2]
    tab = codes[before - 1] == 9
    wide = (classes[before - 1] == _SPACE) & (classes[before - 2] == _SPACE)
    gap = before[(tab | wide) & (line[before] == line[before - 2])]
    head = gap - 1  # the last solid character before the gap
    while True:
        blank = (classes[head] == _SPACE) & (head > 0)
        if not blank.any():
            break
        head = head - blank
    inside = (line[head] == line[gap]) & (classes[head] >= _VOWEL)
    spoken = (classes[head] == _END) | (classes[head] == _PLAIN)
    gap = gap[inside & (~spoken | (codes[gap - 1] == 9))]
    marks = np.flatnonzero(classes >= _END)
    marks = marks[classes[marks] != _MARK]
    at = np.concatenate([marks, gap])
    kind = np.concatenate([codes[marks].astype(np.int64), np.full(len(gap), _GAP, np.int64)])
    key = (line[at].astype(np.int64) << 36) | (np.minimum(columns[at], 0x7FFF).astype(np.int64) << 21) | kind
    order = np.argsort(key, kind="stable")
    key, kind, own = key[order], kind[order], line[at][order]
    events = np.bincount(own, minlength=n_lines)
    below = np.searchsorted(key, key + (1 << 36))
    met = (below < len(key)) & (key[np.minimum(below, len(key) - 1)] == key + (1 << 36)) if len(key) else np.zeros(0, bool)
    columns_met = _sums(met, own, n_lines)
    gaps_met = _sums(met & (kind == _GAP), own, n_lines)
    first = np.concatenate([[0], np.cumsum(events)])[:-1]
    place = np.arange(len(own)) - first[own]
    factor = _factors()[place % 4096]
    sequence = np.zeros(n_lines, np.uint64)
    np.add.at(sequence, own, kind.astype(np.uint64) * factor)
    fewer = np.minimum(events, np.append(events[1:], 0))
    more = np.maximum(n_tokens, np.append(n_tokens[1:], 0))
    by_column = ((columns_met >= 2) & (columns_met >= 0.5 * fewer)) | ((gaps_met >= 1) & (more <= 6 * (gaps_met + 1)))
    by_field = (sequence == np.append(sequence[1:], np.uint64(0))) & (events >= 2) & (more <= 3 * (events + 1))
    pair = joined & (by_column | by_field)
    return pair | np.concatenate([[False], pair[:-1]])


def _running(p: dict, strict: np.ndarray) -> np.ndarray:
    """Which pieces read like sentences of a human language; ``strict`` where the layout speaks for a row.

    Names with ``all_`` are sums over the piece's paragraph: single sentences are too short for them.
    """
    solid, words, letters = np.maximum(p["solid"], 1), np.maximum(p["words"], 1), np.maximum(p["letters"], 1)
    spelt = p["all_letters"] - p["all_other_letters"]
    # random letters have few vowels and long runs of consonants
    odd = p["all_consonant_pairs"] / np.maximum(p["all_pairs"], 1) - p["all_vowels"] / np.maximum(spelt, 1)
    shaped = odd <= 0.12 + 1.2 / np.sqrt(np.maximum(spelt, 1))
    # words put together without grammar are all short, or have no short ones and no marks between them
    heap = (p["all_words"] >= 8) & (p["all_long_words"] < 0.15 * p["all_words"])
    heap |= (p["all_words"] >= 10) & (p["all_stops"] == 0) & (p["all_short_words"] < 0.05 * p["all_words"])
    good = (p["word_letters"] >= 0.55 * solid) & (p["symbols"] <= 0.15 * solid) & (p["words"] >= 3) & shaped & ~heap
    good &= (p["single_letters"] <= 0.35 * words) & ((p["words"] < 5) | (p["distinct"] >= 0.3 * np.minimum(words, 2 * _CHUNK_WORDS)))
    good &= ~strict | ((p["words"] >= 5) & (p["word_letters"] >= 0.7 * solid) & (p["symbols"] <= 0.06 * solid) & (p["short_words"] >= 1))
    unspelt = p["other_letters"] > 0.6 * letters  # scripts without vowels or blanks between words
    return np.where(unspelt, (p["letters"] >= 8) & (p["letters"] >= 0.6 * p["solid"]) & (p["repeated"] <= 0.5 * letters), good)


def measure(texts: list[str | None], layout: bool = True) -> dict[str, np.ndarray]:
    """The statistics of :func:`text_quality` for a list of texts; without ``layout`` every line is read as prose."""
    cleaned = [_clean(t) for t in texts]
    pieces = [(i, s) for i, t in enumerate(cleaned) for s in (_segments(t) if len(t) > LONG_CHARS else (t,))]
    found = _measure_all([s for _, s in pieces], layout)
    if len(pieces) > len(texts):
        found = _merged(found, np.array([i for i, _ in pieces]), len(texts))
    del found["solid"]
    found["n_chars"] = np.array([len(t or "") for t in texts], np.int64)
    return found


def _segments(text: str) -> Iterator[str]:
    start = 0
    while start < len(text):
        stop = min(len(text), start + LONG_CHARS)
        if stop < len(text):
            stop = max(text.rfind("\n", start, stop), text.rfind(" ", start, stop) if text.rfind("\n", start, stop) < 0 else -1) + 1 or stop
        yield text[start:stop]
        start = stop


def _merged(found: dict[str, np.ndarray], owner: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """The statistics of texts from those of their segments, each weighed by what it is a share of."""
    out = {name: _sums(found[name], owner, n).astype(found[name].dtype) for name in ("n_words", "n_lines", "solid")}
    by = {"n_words": ("mean_word_length", "common_word_share", "distinct_word_share"), "n_lines": ("ended_line_share", "length_autocorrelation", "indent_periodicity"), "solid": ("symbol_ratio", "digit_ratio", "aligned_share", "prose_share")}
    for weight, names in by.items():
        for name in names:
            out[name] = _sums(found[name] * found[weight], owner, n) / np.maximum(out[weight], 1)
    largest = np.zeros(n, np.int64)
    other = np.where(found["kind"] == "prose", -1.0, found["solid"])
    for i in np.argsort(other, kind="stable"):
        largest[owner[i]] = i
    out["kind"] = np.where(out["solid"] == 0, "empty", np.where(out["prose_share"] >= 0.5, "prose", found["kind"][largest])).astype(object)
    return out


def _measure_all(cleaned: list[str], layout: bool) -> dict[str, np.ndarray]:
    out: dict[str, list[np.ndarray]] = {}
    start, texts = 0, cleaned
    if not texts:
        return {name: np.zeros(0) for name in ("solid", *(n for n, _, _ in _OUT))}
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(cleaned[stop]) <= _PASS_CHARS):
            size += len(cleaned[stop])
            stop += 1
        part = _measure_some(cleaned[start:stop], layout)
        for name, values in part.items():
            out.setdefault(name, []).append(values)
        start = stop
    return {name: np.concatenate(values) for name, values in out.items()}


def _measure_some(texts: list[str], layout: bool, flags: dict | None = None) -> dict[str, np.ndarray]:
    docs = len(texts)
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    table, lower = _tables()
    near = np.minimum(codes, 0xFFFF)
    classes = table[near]
    far = np.flatnonzero(codes > 0xFFFF)
    classes[far] = np.where((codes[far] >= 0x20000) & (codes[far] < 0x40000), _LETTER, _SYMBOL)
    low = np.where(codes > 0xFFFF, codes, lower[near])
    n = len(codes)
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    breaks = classes == _BREAK
    line = np.cumsum(breaks, dtype=np.int32) - breaks
    line_start = np.concatenate([[0], np.flatnonzero(breaks)[:-1] + 1])
    n_lines = len(line_start)
    doc_of_line = np.searchsorted(ends, line_start, side="right")
    columns = (np.arange(n) - line_start[line]).astype(np.int32)

    # tokens: runs of solid characters
    solid = classes >= _VOWEL
    token_start = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    token_end = np.flatnonzero(solid & ~np.concatenate([solid[1:], [False]]))
    n_tokens = len(token_start)
    stats: dict[str, np.ndarray] = {}
    if not n_tokens:
        zero = np.zeros(docs)
        stats = {name: zero.astype(np.int64) if kind == "long" else zero for name, _, kind in _OUT[:-1]}
        stats["kind"] = np.full(docs, "empty", dtype=object)
        stats["solid"] = zero
        return stats
    letter = (classes >= _VOWEL) & (classes <= _LETTER)
    vowel, consonant = classes == _VOWEL, classes == _CONSONANT
    symbol, digit = classes == _SYMBOL, classes == _DIGIT
    upper = letter & (low != codes)

    def per_token(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, token_start, dtype=np.int32)

    nothing = np.zeros(1, bool)
    follows = np.append(letter[1:], nothing)
    pair = letter & follows
    alnum = letter | digit
    inner = (classes >= _END) & (classes != _MARK) & np.append(alnum[1:], nothing) & np.concatenate([nothing, alnum[:-1]])
    inner &= ~np.isin(codes, [ord(c) for c in "'’-‐–"])
    camel = letter & ~upper & np.append(upper[1:], nothing)
    t = {
        "letters": per_token(letter),
        "vowels": per_token(vowel),
        "pairs": per_token(pair),
        "consonant_pairs": per_token(consonant & np.append(consonant[1:], nothing)),
        "other_letters": per_token(classes == _LETTER),
        "symbols": per_token(symbol),
        "repeated": per_token(letter & np.append(codes[1:] == codes[:-1], nothing)),
    }
    size = (token_end - token_start + 1).astype(np.int32)
    digits = per_token(digit)
    marks = per_token((classes >= _END) & (classes != _MARK))
    clean = (t["letters"] > 0) & (digits == 0) & (t["symbols"] == 0) & (per_token(inner) == 0) & (per_token(camel) == 0) & (size <= 40)
    # edges do not count: "word," and "word" are one
    spelt_at = np.flatnonzero(alnum)
    owner = np.searchsorted(token_start, spelt_at, side="right") - 1
    opening = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    at = np.flatnonzero(opening)
    place = np.arange(len(owner)) - np.repeat(at, np.diff(np.append(at, len(owner))))
    hashes = np.zeros(n_tokens, np.uint64)
    if len(at):
        hashes[owner[at]] = np.add.reduceat(low[spelt_at].astype(np.uint64) * _factors()[place % 4096], at)
    token_line = line[token_start]
    token_doc = doc_of_line[token_line]
    ended = classes[token_end] == _END
    closing = np.isin(codes[token_end], [ord(c) for c in _CLOSING]) & (size > 1)
    ended |= closing & (classes[np.maximum(token_end - 1, 0)] == _END)

    # lines
    line_tokens = np.bincount(token_line, minlength=n_lines)
    full = line_tokens > 0
    line_solid = np.bincount(line[solid], minlength=n_lines)
    first = np.concatenate([[0], np.cumsum(line_tokens)])[:-1]
    head = np.minimum(first, n_tokens - 1)
    indents = np.where(full, columns[token_start[head]], 0)
    last = np.minimum(first + np.maximum(line_tokens, 1) - 1, n_tokens - 1)
    widths = np.where(full, columns[token_end[last]] + 1, 0)
    joined = full & np.append(full[1:], False) & np.append(doc_of_line[1:] == doc_of_line[:-1], False)
    bullet = (size[head] == 1) & np.isin(codes[token_start[head]], [ord(c) for c in _BULLETS])
    dotted = np.isin(codes[token_end[head]], [ord("."), ord(")")]) & (marks[head] == 1) & (size[head] >= 2)
    numbered = dotted & ((digits[head] == size[head] - 1) & (size[head] <= 5) | (size[head] == 2) & (t["letters"][head] == 1))
    item = full & (line_tokens >= 2) & (bullet | numbered)
    aligned = _aligned(codes, classes, columns, line, token_start, line_tokens, joined)
    # numbers in the same fields of short lines
    nth = np.arange(n_tokens) - first[token_line]
    numbers = np.zeros(n_lines, np.int64)
    np.add.at(numbers, token_line[digits > 0], 1 << np.minimum(nth[digits > 0], 40))
    same = joined & (numbers > 0) & (numbers == np.append(numbers[1:], 0)) & (np.maximum(line_tokens, np.append(line_tokens[1:], 0)) <= 6)
    aligned |= same | np.concatenate([[False], same[:-1]])
    # statement ends below each other
    closed = full & np.isin(codes[token_end[last]], [ord(c) for c in ";{}"])
    same = joined & closed & np.append(closed[1:], False)
    aligned |= same | np.concatenate([[False], same[:-1]])
    # a block is a run of lines that are not blank
    opens = full & ~np.concatenate([[False], joined[:-1]])
    block = np.maximum(np.cumsum(opens) - 1, 0)
    blocks = int(block[-1]) + 1
    filled = np.flatnonzero(full)
    related, repeated = _cycles(widths[filled].astype(float), indents[filled].astype(float), block[filled], blocks)
    block_lines = np.maximum(np.bincount(block[filled], minlength=blocks), 1)
    short_share = _sums(line_tokens[filled] <= 3, block[filled], blocks) / block_lines
    moves = _sums(np.concatenate([[False], (indents[1:] != indents[:-1]) & joined[:-1]])[filled], block[filled], blocks) / block_lines
    lone = per_token(symbol | np.isin(codes, [ord("|"), ord("/"), ord(">")])) == size
    line_lone = np.bincount(token_line[lone], minlength=n_lines)
    cyclic = ((repeated >= 0.6) & (moves >= 0.25)) | ((related > 0.6) & (block_lines >= 8))
    listed = (block_lines >= 4) & (short_share > 0.6)
    fielded = (line_lone >= 3) & (line_lone >= 0.12 * line_tokens)
    listing = np.bincount(token_line[codes[token_end] == ord(";")], minlength=n_lines)
    fielded |= (listing >= 3) & (line_tokens <= 5 * (listing + 1))
    row = full & (aligned | item | cyclic[block] | listed[block] | fielded)
    if flags is not None:
        flags.update(aligned=aligned, item=item)
    if not layout:
        row = np.zeros(n_lines, bool)

    # pieces: sentences of paragraphs, or rows
    token_row = row[token_line]
    new_line = np.concatenate([[True], token_line[1:] != token_line[:-1]])
    new_block = np.concatenate([[True], (block[token_line[1:]] != block[token_line[:-1]]) | (token_doc[1:] != token_doc[:-1])])
    turn = np.concatenate([[True], token_row[1:] != token_row[:-1]])
    paragraph = np.cumsum(new_block | turn | (new_line & token_row)) - 1
    mark = np.zeros(n_tokens, bool)
    mark[first[item & row]] = True  # the marks of items are no words
    begin = np.concatenate([[True], paragraph[1:] != paragraph[:-1]])
    sentence = begin | np.concatenate([[False], ended[:-1] & ~mark[:-1]])
    cut = token_row & fielded[token_line] & (lone | (codes[token_end] == ord(";")))
    sentence |= np.concatenate([[False], cut[:-1]])  # the fields of a row
    wide = np.concatenate([[False], (token_start[1:] - token_end[:-1] > 2) | (codes[token_start[1:] - 1] == 9)])
    sentence |= wide & aligned[token_line] & token_row
    at = np.flatnonzero(sentence)
    since = np.arange(n_tokens) - np.repeat(at, np.diff(np.append(at, n_tokens)))
    lengths = np.repeat(np.diff(np.append(at, n_tokens)), np.diff(np.append(at, n_tokens)))
    sentence |= (lengths > 1.5 * _CHUNK_WORDS) & (since % _CHUNK_WORDS == 0)
    piece = np.cumsum(sentence) - 1
    pieces = int(piece[-1]) + 1
    piece_start = np.flatnonzero(sentence)
    kept = ~mark
    words = clean & kept
    p = {name: _sums(values * kept, piece, pieces) for name, values in t.items()}
    for name in ("letters", "vowels", "pairs", "consonant_pairs", "other_letters"):
        p[name] = _sums(t[name] * np.where(t["other_letters"] > 0, kept, words), piece, pieces)
    p["solid"] = _sums(size * kept, piece, pieces)
    p["words"] = _sums(words, piece, pieces)
    p["word_letters"] = _sums(t["letters"] * words, piece, pieces)
    p["long_words"] = _sums(words & (t["letters"] >= 5), piece, pieces)
    p["short_words"] = _sums(words & (t["letters"] <= 3), piece, pieces)
    p["single_letters"] = _sums(words & (t["letters"] == 1), piece, pieces)
    p["stops"] = _sums(words & (marks > 0), piece, pieces)
    order = np.lexsort((hashes, piece))
    changed = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (piece[order][1:] != piece[order][:-1])])
    p["distinct"] = _sums(changed, piece[order], pieces)
    of = paragraph[piece_start]
    paragraphs = int(paragraph[-1]) + 1
    for name in ("vowels", "pairs", "consonant_pairs", "letters", "other_letters", "words", "long_words", "short_words", "stops"):
        p["all_" + name] = _sums(p[name], of, paragraphs)[of]
    good = _running(p, token_row[piece_start])
    # a fragment too short to tell goes with its paragraph
    sure = _sums(p["solid"] * good, of, paragraphs) > 0.5 * _sums(p["solid"], of, paragraphs)
    good |= (p["words"] < 4) & sure[of] & ~token_row[piece_start]
    # a sentence counts three times at most in one text
    places = np.arange(n_tokens) - piece_start[piece]
    spelling = np.zeros(pieces, np.uint64)
    np.add.at(spelling, piece, hashes * _factors()[places % 4096])
    piece_doc = token_doc[piece_start]
    order = np.lexsort((np.arange(pieces), spelling, piece_doc))
    new = np.concatenate([[True], (spelling[order][1:] != spelling[order][:-1]) | (piece_doc[order][1:] != piece_doc[order][:-1])])
    starts = np.flatnonzero(new)
    nth = np.empty(pieces, np.int64)
    nth[order] = np.arange(pieces) - np.repeat(starts, np.diff(np.append(starts, pieces)))
    good &= (nth < 3) | (p["solid"] < 20)

    doc_solid = np.bincount(token_doc, weights=size, minlength=docs)
    safe = np.maximum(doc_solid, 1)
    doc_lines = np.bincount(doc_of_line[full], minlength=docs)
    doc_words = _sums(t["letters"] > 0, token_doc, docs)
    known = np.isin(hashes, _common_hashes())
    order = np.lexsort((hashes, token_doc))
    changed = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (token_doc[order][1:] != token_doc[order][:-1])])
    char_doc = token_doc.repeat(size)
    # the layout measures of a text are those of its blocks, weighed by their lines
    block_doc = doc_of_line[opens]
    weights = np.maximum(_sums(block_lines, block_doc, docs), 1)
    stats["n_words"] = doc_words.astype(np.int64)
    stats["n_lines"] = doc_lines.astype(np.int64)
    stats["mean_word_length"] = _sums(t["letters"], token_doc, docs) / np.maximum(doc_words, 1)
    stats["symbol_ratio"] = _sums((classes >= _END)[solid] & (classes != _MARK)[solid], char_doc, docs) / safe
    stats["digit_ratio"] = _sums(digit[solid], char_doc, docs) / safe
    stats["ended_line_share"] = _sums((ended[last] | closing[last] | (codes[token_end[last]] == ord(":")))[full], doc_of_line[full], docs) / np.maximum(doc_lines, 1)
    stats["common_word_share"] = _sums(known, token_doc, docs) / np.maximum(doc_words, 1)
    stats["distinct_word_share"] = _sums(changed & (t["letters"][order] > 0), token_doc[order], docs) / np.maximum(doc_words, 1)
    stats["length_autocorrelation"] = _sums(related * block_lines, block_doc, docs) / weights
    stats["indent_periodicity"] = _sums(repeated * block_lines, block_doc, docs) / weights
    stats["aligned_share"] = _sums(line_solid * aligned, doc_of_line, docs) / safe
    stats["prose_share"] = np.minimum(1.0, _sums(p["solid"] * good, piece_doc, docs) / safe)
    stats["solid"] = doc_solid
    stats["kind"] = _kinds(texts, stats, doc_solid, doc_of_line, full, aligned, item, line_solid)
    return stats


@lru_cache(maxsize=1)
def _common_hashes() -> np.ndarray:
    words = {w for text in COMMON.values() for w in text.split()}
    return np.array([sum(ord(c) * int(f) for c, f in zip(w, _factors())) & ((1 << 64) - 1) for w in words], np.uint64)


def _label(line: str, aligned: bool, item: bool) -> str:
    if not line.strip():
        return "blank"
    if _LOG.match(line):
        return "log"
    if _CODE.match(line) and not (aligned and "|" in line):
        return "code"
    return "table" if aligned else "item" if item else "text"


def _kinds(texts: list[str], stats: dict, doc_solid: np.ndarray, doc_of_line: np.ndarray, full: np.ndarray, aligned: np.ndarray, item: np.ndarray, line_solid: np.ndarray) -> np.ndarray:
    kinds = np.where(doc_solid == 0, "empty", "prose").astype(object)
    starts = np.searchsorted(doc_of_line, np.arange(len(texts)))
    for d in np.flatnonzero((doc_solid > 0) & (stats["prose_share"] < 0.5)):
        by: dict[str, int] = {}
        for i, line in enumerate(texts[d].split("\n"), int(starts[d])):
            label = _label(line, bool(aligned[i]), bool(item[i]))
            by[label] = by.get(label, 0) + int(line_solid[i])
        label, size = max(((k, by.get(k, 0)) for k in ("table", "code", "log", "item")), key=lambda x: x[1])
        if size >= 0.4 * doc_solid[d]:
            kinds[d] = "list" if label == "item" else label
        elif stats["n_lines"][d] >= 4 and stats["n_words"][d] < 6 * stats["n_lines"][d]:
            kinds[d] = "list"
        else:
            kinds[d] = "junk"
    return kinds


def label_lines(lines: list[str]) -> list[str]:
    """``blank``, ``table``, ``code``, ``log``, ``item`` or ``text`` for each line."""
    text = _clean("\n".join(lines))
    if not text.strip():
        return ["blank"] * len(lines)
    flags: dict[str, np.ndarray] = {}
    _measure_some([text], True, flags)
    return [_label(x, bool(a), bool(i)) for x, a, i in zip(text.split("\n"), flags["aligned"], flags["item"])]


def running(s: str, strict: bool = False) -> bool:
    """Whether a piece of text reads like sentences of a human language, ``strict`` as in a row of its own."""
    measured = measure([("- " if strict else "") + " ".join(s.split())])
    return bool(measured["prose_share"][0] >= 0.5)


def statistics(text: str | None) -> dict:
    """All statistics of one text; see :func:`text_quality` for their meaning."""
    return {name: values[0] if name == "kind" else values[0].item() for name, values in measure([text]).items()}


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = measure([x.decode("utf-8", "replace") if x is not None else None for x in b.column(b.num_columns - 1).to_pylist()]) if b.num_rows else {n: [] for n, _, _ in _OUT}
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(found[n], t) for n, t, _ in _OUT)], names=[*b.schema.names[:-1], *(n for n, _, _ in _OUT)])


def text_quality(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and the statistics of the text, one row per row of ``df``.

    ``n_chars``, ``n_words``, ``n_lines`` (not blank), ``mean_word_length``, ``symbol_ratio`` and ``digit_ratio``
    (of the characters other than white space), ``ended_line_share`` (lines that end in punctuation),
    ``common_word_share``, ``distinct_word_share``, ``length_autocorrelation`` and ``indent_periodicity`` (means over the
    lines of the blocks'), ``aligned_share`` (characters in lines whose delimiters are aligned with a neighbour's),
    ``prose_share`` (characters in running sentences) and ``kind``.

    Defined cases: null, empty and blank texts have zero everywhere and the kind ``empty``; bytes that are no
    UTF-8 count as U+FFFD; texts above ``LONG_CHARS`` are measured in segments whose statistics are put together; a sentence repeated in one text counts three times at most; repeated rows come
    out as often as they come in; an empty table gives an empty result; other columns are not read.
    """
    narrow = df.select(*keep, F.col(text_col).cast("binary").alias("__text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema.fields[:-1])
    return spread(narrow).mapInArrow(_measure, kept + ", ".join(f"{n} {t}" for n, _, t in _OUT))


def not_prose(measured: DataFrame) -> DataFrame:
    """The rows of :func:`text_quality` whose texts have less than half of their characters in running sentences."""
    return measured.filter((F.col("kind") != "empty") & (F.col("prose_share") < 0.5))
