"""Byte-level BPE by replaying the merges over the distinct words of a corpus block.

The distinct pieces (pattern matches) of a block of texts are laid out as one
array of tokens.  An inverted index leads from each possible merge result to
the positions where its pair stands; merges are applied in rank order over all
words at once, and each application looks up only the two pairs it touched.
Every text is then the concatenation of its chunks' ids.  Decoding looks the
ids up in the vocabulary.

Nulls and empty texts have no ids and decode to the empty string.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ChunkTable, chunk_of, file_bytes, per_worker, slices, texts_to_python

CACHE_ENTRIES = 400_000


def read_ranks(rank_file: bytes) -> dict[bytes, int]:
    """token bytes -> rank from a file of ``base64 rank`` lines."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines())}


class Merges:
    """The pairs of tokens that may merge, by the ranks of their results."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.pairs: dict[int, int] = {}  # left id << 32 | right id -> rank of the merged token
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.first = np.full((257, 257), -1, np.int64)  # rank of two adjacent bytes; 256 ends a word
        for x in range(256):
            for y in range(256):
                self.first[x, y] = ranks.get(bytes([x, y]), -1)


def replay_merges(words: list[bytes], merges: Merges) -> list[list[int]]:
    """Ids of each word: all merges applied in rank order over all words,
    leftmost first within a word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.full(int(lengths.sum()) + len(words) + 1, 256, np.int64)  # an end before and after each word
    starts = np.cumsum(lengths + 1) - lengths
    inside = np.ones(len(letters), bool)
    inside[0] = False
    inside[starts + lengths] = False
    letters[inside] = np.frombuffer(b"".join(words), np.uint8)
    rank_at = np.full(len(letters), -1, np.int64)
    rank_at[:-1] = merges.first[letters[:-1], letters[1:]]
    token = np.where(letters < 256, merges.single[np.minimum(letters, 255)], -1).tolist()
    order = np.argsort(rank_at, kind="stable")
    order = order[np.searchsorted(rank_at[order], 0):]
    ranks, cuts = np.unique(rank_at[order], return_index=True)
    index = {int(r): part.tolist() for r, part in zip(ranks, np.split(order, cuts[1:]))}  # rank -> places of its pairs
    pending = rank_at.tolist()
    right = list(range(1, len(token) + 1))
    left = list(range(-1, len(token) - 1))
    heap = list(index)
    heapq.heapify(heap)
    get = merges.pairs.get
    while heap:
        rank = heapq.heappop(heap)
        places = index.pop(rank, None)
        if places is None:
            continue
        places.sort()
        for n, i in enumerate(places):
            if pending[i] != rank:
                continue  # a neighbour has been merged meanwhile
            j = right[i]
            k = right[j]
            token[i], token[j] = rank, -1
            pending[j] = -1
            right[i], left[k] = k, i
            lower = False
            r = get(rank << 32 | token[k]) if token[k] >= 0 else None
            if r is None:
                pending[i] = -1
            else:
                pending[i] = r
                if r in index:
                    index[r].append(i)
                else:
                    index[r] = [i]
                    heapq.heappush(heap, r)
                lower = r < rank
            h = left[i]
            if token[h] >= 0:
                r = get(token[h] << 32 | rank)
                if r is None:
                    pending[h] = -1
                else:
                    pending[h] = r
                    if r in index:
                        index[r].append(h)
                    else:
                        index[r] = [h]
                        heapq.heappush(heap, r)
                    lower |= r < rank
            if lower:  # the new pair goes first: come back to the rest of this rank
                index.setdefault(rank, []).extend(places[n + 1:])
                heapq.heappush(heap, rank)
                break
    out = []
    for start, length in zip(starts.tolist(), lengths.tolist()):
        ids, i, end = [], start, start + length
        while i < end:
            ids.append(token[i])
            i = right[i]
        out.append(ids)
    return out


class MergeReplay(ChunkTable):
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, data: bytes, entries: int = CACHE_ENTRIES):
        super().__init__(entries)
        pattern, rank_file = data.split(b"\0", 1) if b"\0" in data[:4096] else (b"", data)
        self.merges = Merges(read_ranks(rank_file))
        self.bytes_of = self.merges.bytes_of
        self.piece = regex.compile(pattern.decode())

    def pieces(self, chunk: str) -> list[str]:
        return self.piece.findall(chunk)

    def values(self, keys: list[str]) -> dict[str, bytes]:
        """Per chunk its ids as little-endian unsigned 32-bit integers."""
        pieces = {k: self.pieces(chunk_of(k)) for k in keys}
        distinct = list({p for ps in pieces.values() for p in ps})
        ids = dict(zip(distinct, replay_merges([p.encode() for p in distinct], self.merges)))
        return {k: array("I", chain.from_iterable(map(ids.__getitem__, ps))).tobytes() for k, ps in pieces.items()}

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        for keys in self.blocks(texts):
            yield b"".join(map(self.cache.__getitem__, keys))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def tokenizer_data(rank_path: str, pattern: str) -> bytes:
    return pattern.encode() + b"\0" + file_bytes(rank_path)


def encode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): one row per row of ``df`` with the ids of its whole text as
    little-endian unsigned 32-bit integers (binary)."""
    vocabulary = df.sparkSession.sparkContext.broadcast(tokenizer_data(rank_path, pattern))  # a fixed file, under 1 MB
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = per_worker(MergeReplay, vocabulary.value)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(replay.encode(texts)), pa.binary())], names=schema.names)

    return texts_to_python(df, id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the decoded bytes of its ids as a further column."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(tokenizer_data(rank_path, pattern))
    schema = T.StructType([*encoded.schema.fields, T.StructField(out_col, T.BinaryType())])
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = per_worker(MergeReplay, vocabulary.value)
        for batch in slices(batches):
            texts = pa.array([replay.decode(x or b"") for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=schema.names)

    return encoded.mapInArrow(run, schema)
