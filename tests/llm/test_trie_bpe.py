import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm.trie_bpe import VOCABULARY, WORD_PATTERN, encoder, token_counts, token_ids

FILES = [VOCABULARY, VOCABULARY.replace("byte_bpe_50k", "byte_bpe_multi_50k")]


def plain(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


PLAIN = {p: plain(p) for p in FILES}


def same(texts, path=VOCABULARY):
    offsets, values = encoder(path).encode(texts)
    for i, t in enumerate(texts):
        assert list(values[offsets[i] : offsets[i + 1]]) == (PLAIN[path].encode_ordinary(t) if t else []), t


@pytest.mark.parametrize("path", FILES)
def test_random_bytes_and_letters(path):
    rnd = random.Random(5)
    alphabets = ["ab", "abcdefghijklmnopqrstuvwxyz", "eta oinshrdlu", " \t\n", "0123456789", "äöüßéèñ¿日本語한국어😀​﻿", "-=_#*/", "'sdtlrvem "]
    same(["".join(rnd.choice(rnd.choice(alphabets)) for _ in range(rnd.randrange(1, 200))) for _ in range(400)] + ["".join(rnd.choice(a) for _ in range(300)) for a in alphabets * 5], path)


def test_special_cases():
    same([None, "", " ", "\n\n ", "<|endoftext|>", "a" * 5000, " " * 3000, "naïve café", "𐍈𐍈", "\x00\x01"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(texts):
    same(texts)


def test_operator(spark):
    df = spark.createDataFrame([(1, "hello world", 7), (2, None, 8), (3, "", None), (3, "", None), (4, " \n", 9)], "doc_id long, text string, ids long")
    got = sorted((r.doc_id, r.ids) for r in token_ids(df, ["doc_id"]).collect())
    assert got == [(1, PLAIN[VOCABULARY].encode_ordinary("hello world")), (2, []), (3, []), (3, []), (4, PLAIN[VOCABULARY].encode_ordinary(" \n"))]
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts(df, ["doc_id"]).collect()) == [(1, 2), (2, 0), (3, 0), (3, 0), (4, len(got[4][1]))]
    assert token_ids(df.limit(0), ["doc_id"]).count() == 0
