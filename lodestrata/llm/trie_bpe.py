"""Token ids of a whole corpus under a public byte-level BPE vocabulary (problem 7).

The distinct words of a batch form a trie, which is walked depth first (in sorted order, each word
picks up at the prefix that it shares with the word before).  The state of a trie node is the *last
token* of the encoding of its prefix.  It follows from the states above alone: of the tokens that end
at the node, exactly one fits behind the last token of the prefix that remains, where two tokens
fit if BPE, given their bytes together, ends with the very same two.  So the encoding of a shared prefix
is computed once, and a word's ids are read off by stepping back from token to token.

Scale: one narrow pass over the texts, no shuffle; words already met by a worker are remembered in a
cache of bounded size, which changes the speed and never the result.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.runtime import spread

#: Fixed value: the split that the rank files of the public tokenizers go with.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where the public vocabulary lies on the driver, which sends it to the others; a parameter of all functions.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Remembered words and token pairs of one worker.
CACHE_ENTRIES = 400_000
_BATCH_TEXT_BYTES = 4_000_000


class TrieEncoder:
    """Encodes words by the last-token states of their prefixes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.token_id = ranks
        self.length = {i: len(b) for b, i in ranks.items()}
        # merges: each longer token from the pair that BPE forms it of
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.whole: set[bytes] = set()
        for b, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) == 1:
                self.whole.add(b)
            elif pair := self._pair(b, i):
                self.parts[i] = pair
                self.joined[pair] = i
                self.whole.add(b)
        self.tails = {b[k:] for b in self.whole for k in range(len(b))}
        self._fits: dict[tuple[int, int], bool] = {}
        self._known: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(WORD_PATTERN)

    def _pair(self, b: bytes, rank: int) -> tuple[int, int] | None:
        """The last merge of token ``b``, or None if BPE never makes it of its own bytes."""
        halves = [(l, r) for k in range(1, len(b)) if (l := self.token_id.get(b[:k], rank)) < rank and (r := self.token_id.get(b[k:], rank)) < rank]
        if len(halves) == 1:
            return halves[0]
        ids = [self.token_id[b[k : k + 1]] for k in range(len(b))]
        while len(ids) > 2:
            merges = [(m, k) for k in range(len(ids) - 1) if (m := self.joined.get((ids[k], ids[k + 1]))) is not None and m < rank]
            if not merges:
                return None
            m, k = min(merges)
            ids[k : k + 2] = [m]
        return (ids[0], ids[1]) if len(ids) == 2 else None

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens apart when their bytes stand together.

        Undoes the merges of both sides, newest first.  At each stage the tokens that touch must not
        form a merge older than the one undone last, for BPE would have made that one first.
        """
        key = (left, right)
        known = self._fits.get(key)
        if known is not None:
            return known
        bound = 1 << 60
        good = True
        while True:
            merged = self.joined.get((left, right))
            if merged is not None and merged < bound:
                good = False
                break
            from_left, from_right = self.parts.get(left), self.parts.get(right)
            if from_left and (left > right or not from_right):
                bound, left = left, from_left[1]
            elif from_right:
                bound, right = right + 1, from_right[0]
            else:
                break
        if len(self._fits) >= CACHE_ENTRIES:
            self._fits.clear()
        self._fits[key] = good
        return good

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """(word, ids) of distinct words, by one depth-first walk of their trie."""
        whole, tails, token_id, length, fits = self.whole, self.tails, self.token_id, self.length, self.fits
        last: list[int] = [-1]  # last[i]: the last token of the prefix of i bytes
        before = b""
        for word in sorted(words):
            shared, limit = 0, min(len(before), len(word))
            while shared < limit and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                ends, start = [], end - 1
                while start >= 0 and (tail := word[start:end]) in tails:
                    if tail in whole:
                        ends.append((start, token_id[tail]))
                    start -= 1
                for start, token in reversed(ends):
                    if start == 0 or fits(last[start], token):
                        last.append(token)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            ids, end = [], len(word)
            while end:
                ids.append(last[end])
                end -= length[last[end]]
            ids.reverse()
            before = word
            yield word, ids

    def encode(self, texts: list[str | None]) -> tuple[array, array]:
        """(offsets, ids) of all texts; null and empty texts have no ids."""
        split = [self.split.findall(t) if t else [] for t in texts]
        known = self._known
        new = {w for words in split for w in words if w not in known}
        if len(known) + len(new) > CACHE_ENTRIES:
            new = {w for words in split for w in words}
            known.clear()
        by_bytes = {w.encode("utf-8", "surrogatepass"): w for w in new}
        for b, ids in self.encode_words(by_bytes):
            known[by_bytes[b]] = tuple(ids)
        offsets, values = array("i", [0]), array("i")
        for words in split:
            for w in words:
                values.extend(known[w])
            offsets.append(len(values))
        return offsets, values


@lru_cache(maxsize=2)
def encoder(vocabulary: str = VOCABULARY) -> TrieEncoder:
    """The encoder of a rank file (a base64 token and its rank in each line); one per worker."""
    return TrieEncoder(ranks(vocabulary))


def ranks(vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    """The ranks of a vocabulary, from the copy that was sent to this node or, without one, from its own place."""
    try:
        sent = SparkFiles.get(os.path.basename(vocabulary))
    except Exception:  # no session in this process
        sent = ""
    with open(sent if sent and os.path.exists(sent) else vocabulary, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


def send_vocabulary(spark: SparkSession, vocabulary: str) -> None:
    """Sends the file to all nodes, once for each application."""
    key = (spark.sparkContext.applicationId, vocabulary)
    if key not in _sent and os.path.exists(vocabulary):
        spark.sparkContext.addFile(vocabulary)
        _sent.add(key)


_sent: set[tuple[str, str]] = set()


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of a bounded number of text bytes."""
    sizes = [len(x) if x is not None else 0 for x in batch.column(column).to_pylist()]
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > _BATCH_TEXT_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _run(vocabulary: str, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(vocabulary)
        for whole in batches:
            for b in _slices(whole, whole.num_columns - 1):
                texts = [x.decode("utf-8", "replace") if x is not None else None for x in b.column(b.num_columns - 1).to_pylist()]
                offsets, values = made.encode(texts)
                ends = pa.array(offsets, pa.int32())
                out = pa.compute.subtract(ends.slice(1), ends.slice(0, len(ends) - 1)) if counts else pa.ListArray.from_arrays(ends, pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], out], names=[*b.schema.names[:-1], "n_tokens" if counts else "ids"])

    return run


def _encoded(df: DataFrame, keep: list[str], text_col: str, vocabulary: str, counts: bool) -> DataFrame:
    send_vocabulary(df.sparkSession, vocabulary)
    narrow = df.select(*keep, F.col(text_col).cast("binary").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return spread(narrow).mapInArrow(_run(vocabulary, counts), f"{kept}{', ' if kept else ''}{'n_tokens int' if counts else 'ids array<int>'}")


def token_ids(df: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``ids`` (array of int), one row per row of ``df``, no special tokens.

    Defined cases: null and empty texts give an empty array; blank texts give the ids of their white
    space; bytes that are no UTF-8 count as U+FFFD; repeated rows come out as often as they come in;
    an empty table gives an empty result; columns not in ``keep`` are not read.  Texts may have any length.
    """
    return _encoded(df, keep, text_col, vocabulary, False)


def token_counts(df: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Like :func:`token_ids`, with the number of ids as ``n_tokens`` instead."""
    return _encoded(df, keep, text_col, vocabulary, True)


def _lengths(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ranks(vocabulary)
        sizes = np.zeros(max(known.values(), default=0) + 1, np.int64)
        for token, i in known.items():
            sizes[i] = len(token)
        for b in batches:
            lists = b.column(b.num_columns - 1)
            ends = np.concatenate([[0], np.cumsum(sizes[np.asarray(lists.flatten())])])
            bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ends[bounds[1:]] - ends[bounds[:-1]])], names=[*b.schema.names[:-1], "n_bytes"])

    return run


def encoded_bytes(encoded: DataFrame, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and ``n_bytes``: how many bytes the tokens of :func:`token_ids` stand for."""
    send_vocabulary(encoded.sparkSession, vocabulary)
    narrow = encoded.select(*keep, "ids")
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(_lengths(vocabulary), f"{kept}n_bytes long")
