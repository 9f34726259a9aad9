"""Packing documents into token sequences along a Hilbert curve.

A document's token counts are hashed into a fixed number of buckets, damped,
normalised and projected by a fixed random matrix to a few dimensions; the
Hilbert index of that point is its place on the curve.  Documents are
range-sorted by (Hilbert index, id), so documents of similar words lie side by
side, copies included, and no single key can fill a partition.  Each range is
then one stream of tokens cut every ``length`` tokens; what is left at its end
is cut into runs whose lengths are powers of two, which need no padding.

Nulls and empty texts hold the end token only.  Repeated rows are packed each.
Rows with a null id sort first.  Further columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import byte_blocks, file_bytes, per_worker, release, slices, texts_to_python, written
from .word_bpe import WordIds, runs

HASH_BUCKETS = 1024
DIMENSIONS = 3
BITS = 16
BLOCK_BYTES = 6 << 20
RANGE_BYTES = 64 << 20  # of ids, in one range of the curve


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of integer points (n, d) of ``bits`` bits each."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # from axes to the transposed index: undo the excess rotations
        p = q - 1
        for i in range(d):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


class Projection:
    """Hashed document vectors projected to a few dimensions (fixed by a seed)."""

    def __init__(self, n_ids: int, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.bucket = rng.integers(0, HASH_BUCKETS, n_ids)
        self.sign = rng.choice([-1.0, 1.0], n_ids)
        self.matrix = rng.standard_normal((HASH_BUCKETS, DIMENSIONS))

    def vectors(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Damped bucket sums of documents given by their ids, end to end."""
        at = np.repeat(np.arange(len(count)) * HASH_BUCKETS, count) + self.bucket[ids]
        h = np.bincount(at, weights=self.sign[ids], minlength=len(count) * HASH_BUCKETS).reshape(len(count), HASH_BUCKETS)
        return (np.sign(h) * np.log1p(np.abs(h))).astype(np.float32).astype(np.float64)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        p = (vectors / np.where(norm > 0, norm, 1.0)) @ self.matrix
        unit = 1.0 / (1.0 + np.exp(-1.702 * p))
        return hilbert_index(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


class PlacedIds:
    """A worker's word ids and the projection of their counts."""

    def __init__(self, tokenizer_json: bytes):
        self.words = WordIds(tokenizer_json)
        self.projection = Projection(self.words.n_ids)


def parts(ids: np.ndarray, count: np.ndarray, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A block's ids and counts, a few documents at a time."""
    stop = np.concatenate([[0], np.cumsum(count)])
    for at in range(0, len(count), rows):
        n = count[at:at + rows]
        yield ids[stop[at]:stop[at + len(n)]], n


def tokenized(df: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """(id, place, n_tokens, ids): ids of each whole text and the end token, as
    little-endian unsigned 16-bit integers where the vocabulary fits (else
    32-bit), and the place of the document on the curve."""
    vocabulary = df.sparkSession.sparkContext.broadcast(file_bytes(tokenizer_path))  # a fixed file, under 2 MB
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("place", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placed = per_worker(PlacedIds, vocabulary.value)
        width = placed.words.dtype.itemsize
        for block in byte_blocks(batches, 1, BLOCK_BYTES):
            ids, count = placed.words.encode(block.column(1))
            place = np.concatenate([placed.projection.keys(placed.projection.vectors(i, n)) for i, n in parts(ids, count)])
            stop = np.cumsum(count + 1)
            ended = np.full(int(stop[-1]), end_id, placed.words.dtype)
            ended[runs(stop - count - 1, count)] = ids
            binary = pa.Array.from_buffers(pa.binary(), len(count), [
                None, pa.py_buffer(np.concatenate([[0], stop * width]).astype(np.int32).tobytes()), pa.py_buffer(ended.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(place, pa.int64()), pa.array(count + 1, pa.int64()), binary], names=schema.names)

    return texts_to_python(df, id_col, text_col).mapInArrow(run, schema)


def powers_of_two(n: int) -> list[int]:
    """Powers of two, falling, that sum to ``n``."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(df: DataFrame, tokenizer_path: str, end_id: int, length: int = 2048, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per piece: id, start (tokens of its document before it), length,
    ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset (its
    place in the sequence).  Every token lies in exactly one piece.  A range
    keeps its own count of sequences: sequence_id is the range's number times
    2**40 plus that count."""
    tokens = written(tokenized(df, tokenizer_path, end_id, id_col, text_col), "pack-tokens")
    width = np.dtype("<u4")
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType),
                           *(T.StructField(c, T.LongType()) for c in ("start", "length")),
                           T.StructField("ids", T.BinaryType()),
                           *(T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset"))])
    id_type = to_arrow_type(schema[0].dataType)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        sequence = TaskContext.get().partitionId() << 40
        full, open_, used = [], [], 0  # pieces of whole sequences, of the open one, its tokens

        def batch_of(rows):
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], id_type), *(pa.array(columns[k], pa.binary() if k == 3 else pa.int64())
                                                  for k in range(1, 7))], names=schema.names)

        release()
        for batch in slices(batches):
            for doc, n, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                ids = np.frombuffer(ids, f"<u{len(ids) // n}").astype(width)
                start = 0
                while start < n:
                    take = min(n - start, length - used)
                    open_.append((doc, start, take, ids[start:start + take].tobytes(), n, sequence, used))
                    start += take
                    used += take
                    if used == length:
                        full += open_
                        open_, used = [], 0
                        sequence += 1
            if full:
                yield batch_of(full)
                full = []
        if open_:
            yield batch_of(list(split_tail(open_, used, sequence, width.itemsize)))

    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    ranges = -(-total * width.itemsize // RANGE_BYTES)
    order = [F.col("place"), F.col(id_col)]
    if ranges > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        order = [ranges, *order]
    return (tokens.repartitionByRange(*order)
            .sortWithinPartitions("place", id_col).mapInArrow(cut, schema))


def split_tail(pieces: list[tuple], used: int, sequence: int, width: int) -> Iterator[tuple]:
    """The pieces of an open sequence, cut again into sequences whose lengths
    are powers of two."""
    lengths = powers_of_two(used)
    room, offset = lengths.pop(0), 0
    for doc, start, n, ids, total, _, _ in pieces:
        at = 0
        while at < n:
            take = min(n - at, room - offset)
            yield doc, start + at, take, ids[at * width:(at + take) * width], total, sequence, offset
            at += take
            offset += take
            if offset == room and lengths:
                room, offset, sequence = lengths.pop(0), 0, sequence + 1

