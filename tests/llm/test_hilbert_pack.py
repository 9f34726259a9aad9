import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessellate.llm import queries, word_bpe
from tessellate.llm.common import byte_blocks, file_bytes, table
from tessellate.llm.hilbert_pack import hilbert_index, pack, powers_of_two
from tests.conftest import SF_SMALL
from tests.llm import edge

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def library_ids(tok, text):
    return [*tok.encode(text or "", add_special_tokens=False).ids, 1]


def test_hilbert_index_walks_neighbouring_cells():
    points = np.array(list(itertools.product(range(8), repeat=3)))
    at = hilbert_index(points, bits=3)
    assert sorted(at.tolist()) == list(range(512))
    walk = points[np.argsort(at)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_powers_of_two():
    assert [powers_of_two(n) for n in (1, 6, 2047, 1024)] == [[1], [4, 2], [1 << b for b in range(10, -1, -1)], [1024]]


def check_pieces(pieces, ids_of, length):
    """ids_of: the ids of each row, by id (a list of equal rows for repeated ids)."""
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append(p)
    for parts in sequences.values():
        parts.sort(key=lambda p: p["offset"])
        at = 0
        for p in parts:
            assert p["offset"] == at
            at += p["length"]
        assert at == length or at & (at - 1) == 0  # no padding anywhere
        assert at <= length
    return sequences


def test_query_holds_every_id_once(spark, tok):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF_SMALL, "documents").collect()}
    pieces = queries.op10_hilbert_pack(spark, SF_SMALL).collect()
    check_pieces(pieces, None, 2048)
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    assert by_doc.keys() == texts.keys()
    for doc, parts in by_doc.items():
        ids = library_ids(tok, texts[doc])
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at:at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)


def test_edge_rows(spark, tok):
    pieces = pack(edge.docs(spark), PATH, end_id=1, length=64).collect()
    check_pieces(pieces, None, 64)
    assert sum(p["length"] for p in pieces) == sum(len(library_ids(tok, t[1])) for t in edge.DOCS)
    long = sorted((p for p in pieces if p["doc_id"] == 8), key=lambda p: p["start"])
    ids = np.concatenate([np.frombuffer(bytes(p["ids"]), "<u4") for p in long])
    assert ids.tolist() == library_ids(tok, edge.LONG)
    assert pack(edge.empty(spark), PATH, end_id=1).count() == 0


def test_similar_documents_lie_together(spark):
    a, b = "red green blue yellow colour paint brush canvas", "engine wheel motor gear piston valve axle clutch"
    rows = [(i, f"{a if i % 2 else b} {i}", "en", "s", 1, "k") for i in range(40)]
    pieces = pack(edge.docs(spark, rows).repartition(1), PATH, end_id=1, length=1 << 20).collect()
    order = [p["doc_id"] % 2 for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])) if p["start"] == 0]
    assert sum(x != y for x, y in zip(order, order[1:])) < 12


def encoded(ids, texts):
    flat, count = ids.encode(pa.array(texts, pa.string()))
    stop = np.cumsum(count)
    return [flat[a - n:a].tolist() for a, n in zip(stop.tolist(), count.tolist())]


def test_word_ids_equal_the_library(tok):
    """Every character of the alphabet cut here and a spread of all others, random
    texts of awkward characters, contractions, long words and special strings."""
    ids = word_bpe.WordIds(file_bytes(PATH))
    assert ids.known
    rng = random.Random(1)
    odd = ["Σ", "ς", "e\u0301", "\u0301", "é", "\u0130", "ı", "ß", "ŉ", "ſ", "\u212a", "²", "½", "ª", "×", "\x1c", "\x85", "\xa0", "\u200b",
           "\u200d", "\u2009", "’", "“", "–", "…", "€", "😀", "日", "<|endoftext|>", "<|"]
    easy = ["'s", "'S", "'LL", "'re", "'ve", "'t", "'d", "'m", "'l", "''", "'", "\r", "\n", "\t", " ", "  ", "\x0b", "\x00", "\x7f", "\x1b", "\x84",
            "a", "B", "zz", "ÿ", "9", "10", "²", ".", ",", "%%%", "-", "_", "é", "ª", "r", "s", "l", "e", "’", "€"]
    texts = ["".join(rng.choices(odd + easy, k=rng.randrange(25))) for _ in range(2000)]
    texts += ["".join(rng.choices(easy, k=rng.randrange(25))) for _ in range(8000)]
    texts += ["x" * k + " " + "ab" * k + "é" * k for k in range(1, 400, 9)]
    texts += [f"x{chr(c)}Y {chr(c)} {chr(c)}9" for c in range(0x110000) if not 0xd800 <= c < 0xe000 and (c < 0x2200 or c % 1013 == 0)]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert encoded(ids, texts) == want
    assert encoded(ids, ["", None, " \n", "a"]) == [[], [], [], tok.encode("a", add_special_tokens=False).ids]
    assert encoded(ids, []) == []


def test_another_tokenizer_is_asked_itself():
    other = P.path("byte_bpe_50k.json")
    ids = word_bpe.WordIds(file_bytes(other))
    assert not ids.known
    texts = ["Some text, 12 words.", "", "don't  stop"]
    assert encoded(ids, texts) == [Tokenizer.from_file(other).encode(t, add_special_tokens=False).ids for t in texts]


def test_byte_blocks_hold_every_row():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(lo, lo + n)), pa.array([("x" * (i % 9) if i % 5 else None) for i in range(n)], pa.string())],
                                          names=["i", "t"]) for lo, n in ((0, 7), (7, 0), (7, 40), (47, 1))]
    for size in (1, 10, 1000):
        got = list(byte_blocks(batches, 1, size))
        assert [i for b in got for i in b.column(0).to_pylist()] == list(range(48))
        assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= max(size, 8) for b in got)
    assert len(list(byte_blocks(batches, 1, 1000))) == 1 and list(byte_blocks([], 1, 5)) == []
