import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tessellate.llm import queries
from tessellate.llm.bpe_replay import MergeReplay, Merges, decode, encode, read_ranks, replay_merges, tokenizer_data
from tessellate.llm.common import file_bytes, table
from tests.conftest import SF_SMALL
from tests.llm import edge


def library(name):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={},
                             mergeable_ranks=read_ranks(file_bytes(P.path(name))))


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_replay_equals_the_library(name):
    enc, replay = library(name), MergeReplay(tokenizer_data(P.path(name), P.PATTERN), entries=40)
    rng = random.Random(5)
    parts = ["a", "b", "ab", "aaaa", " ", "\n", "'s", "é", "12", ".", "!!", "日本", " ", "\x1c", "😀", "the", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(600)]
    for text, ids in zip(texts, replay.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(text)
        assert replay.decode(ids).decode() == text


def test_a_merge_that_enables_an_earlier_one_goes_first():
    # "abc" ranks before "ab": once "ab" is there, "ab" + "c" must merge before any other "ab"
    ranks = {b"abc": 0, b"ab": 1, b"ca": 2, **{bytes([b]): 3 + b for b in range(256)}}
    enc = tiktoken.Encoding("t", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    words = ["abcab", "ababc", "cabcab", "abab", "aabcc", "bca"]
    assert replay_merges([w.encode() for w in words], Merges(ranks)) == [enc.encode_ordinary(w) for w in words]


def test_query_matches_the_library(spark):
    enc = library("byte_bpe_50k.tiktoken")
    rows = {r["doc_id"]: r["text"] or "" for r in table(spark, SF_SMALL, "documents").collect()}
    for r in queries.op7_byte_bpe(spark, SF_SMALL).collect():
        ids = enc.encode_ordinary(rows[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(rows[r["doc_id"]].encode()).hexdigest()


def test_edge_rows_round_trip(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    rows = decode(encode(edge.docs(spark), path, P.PATTERN), path, P.PATTERN).collect()
    assert sorted(bytes(r["decoded"]).decode() for r in rows) == sorted(t[1] or "" for t in edge.DOCS)
    assert encode(edge.empty(spark), path, P.PATTERN).count() == 0


def test_whole_texts_are_never_kept():
    """Texts with odd space and texts without any space are one chunk each: encoded, not cached."""
    enc, replay = library("byte_bpe_50k.tiktoken"), MergeReplay(tokenizer_data(P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    texts = [f"a text {i} with a joiner \u200d and words enough to be a long one, longer than any word is" for i in range(50)]
    texts += ["無" * 200 + str(i) for i in range(50)] + ["plain words beside them"]
    for text, ids in zip(texts, replay.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(text)
    assert 0 < len(replay.cache) < 120 and max(map(len, replay.cache)) <= 64
    list(replay.encode(["plain"]))
    assert replay.passing == {}
