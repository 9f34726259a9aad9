"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder (``spark.checkpoint.dir``),
    read again: lineage is cut, and a lost executor costs a re-read only."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by ``written`` that a later table has replaced."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use yet (whatever the letter case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def located(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns that name each row for good, and their names: file
    and row of a Parquet scan (the same whatever the splits and executors), else a
    number that is written with the rows once."""
    if "_metadata" not in {c.lower() for c in docs.columns}:
        names = [free_name(docs, "file_"), free_name(docs, "place_")]
        try:
            return docs.withColumns({n: F.col(f"_metadata.{c}") for n, c in zip(names, ("file_path", "row_index"))}), names
        except AnalysisException:  # not a scan of Parquet files
            pass
    number = free_name(docs, "place_")
    return written(docs.withColumn(number, F.monotonically_increasing_id()), "located"), [number]


def only(rows: DataFrame, names: list[str], kept: DataFrame) -> DataFrame:
    """The rows named in ``kept`` (columns ``names``).  Whole rows cross one
    shuffle and are not sorted; a task holds the names of its share."""
    return rows.join(kept.select(*names).hint("shuffle_hash"), names, "left_semi").select(
        *(c for c in rows.columns if c not in names))


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


class GenerationCache(dict):
    """dict that fills itself with ``compute(key)`` and holds at most two
    generations of ``limit`` entries, so memory stays bounded while frequent
    keys stay in.  Text keys longer than ``longest`` are never kept (a whole text
    can be one chunk), so that the bytes are bounded too."""

    def __init__(self, compute: Callable, limit: int, longest: int | None = None):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if self.longest is not None and len(key) > self.longest:
            return
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def lacks(self, key) -> bool:
        """True when the value would have to be computed (an entry of the older
        generation moves to the younger one)."""
        if key in self:
            return False
        value = self.old.get(key)
        if value is None:
            return True
        self.put(key, value)
        return False


#: White space in at least one of the regex engines involved (Python, Rust,
#: Java) but not in all of them: texts that hold one are not cut into chunks.
UNSURE_SPACE = re.compile("[\x1c-\x1f\x85᠎​-‏⁠﻿]")
#: White space followed by the non-space run it leads to.
CHUNK = re.compile(r"\s*\S+|\s+")
def chunk_keys(text: str) -> list[str]:
    """Cut a text before each run of white space (a chunk is white space and
    the run it leads to).  A token of the tokenizers used here never crosses
    such a cut, so chunks are encoded on their own.  Each chunk is named by a
    key: the word itself when one space leads it, otherwise see ``chunk_of``."""
    if not text:
        return []
    if text.split() == text.replace("\n", " ").split(" "):  # single spaces and line feeds only
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = "\r" + keys[0]
        return keys
    if UNSURE_SPACE.search(text):
        return ["\r" + text]
    return ["\r" + c for c in CHUNK.findall(text)]


def chunk_of(key: str) -> str:
    """The chunk that a key of ``chunk_keys`` names."""
    first = key[:1]
    return key[1:] if first == "\r" else key if first == "\n" else " " + key


class ChunkTable:
    """Values of chunks under one encoder, computed for the distinct missing
    chunks of a block of texts at a time and kept in a cache that is bounded in
    entries and in the length of a key; longer chunks live as long as their block.
    Subclasses give ``values(keys) -> dict``."""

    BLOCK_CHARS = 4_000_000
    LONGEST_KEY = 64

    def __init__(self, entries: int):
        self.passing: dict = {}
        self.cache = GenerationCache(lambda k: self.passing[k] if k in self.passing else self.values([k])[k], entries, self.LONGEST_KEY)

    def values(self, keys: list[str]) -> dict:
        raise NotImplementedError

    def prepare(self, key_lists: list[list[str]]) -> None:
        self.passing = {}
        missing = [k for k in set().union(*key_lists) if self.cache.lacks(k)]
        if missing:
            for k, v in self.values(missing).items():
                if len(k) > self.LONGEST_KEY:
                    self.passing[k] = v
                else:
                    self.cache.put(k, v)

    def blocks(self, texts: list[str], keys=chunk_keys):
        """The texts in order, each as its list of chunk keys, after the block
        that holds it has been prepared."""
        block, size = [], 0
        for text in texts:
            block.append(keys(text))
            size += len(text)
            if size >= self.BLOCK_CHARS:
                self.prepare(block)
                yield from block
                block, size = [], 0
        if block:
            self.prepare(block)
            yield from block


def _byte_letters() -> list[str]:
    """The printable letter that byte-level BPE uses for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


BYTE_LETTERS = dict(enumerate(_byte_letters()))


_PER_WORKER: dict = {}


def per_worker(kind: type, data: bytes):
    """One ``kind(data)`` per Python worker, kept over its tasks until the
    worker turns to another operator."""
    key = (kind, hashlib.sha1(data).digest())
    if key not in _PER_WORKER:
        release()
        _PER_WORKER[key] = kind(data)
    return _PER_WORKER[key]


def release() -> None:
    """Drop what an earlier operator has left in this Python worker."""
    _PER_WORKER.clear()


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def texts_to_python(df: DataFrame, *columns: str) -> DataFrame:
    """Columns on their way to Python.  Whole texts make Spark's default Arrow
    batch of 10,000 rows large on both sides; unless the session says
    otherwise, batches get 1,000 rows."""
    spark = df.sparkSession
    if spark.conf.get(ARROW_ROWS, "10000") == "10000":
        spark.conf.set(ARROW_ROWS, "1000")
    return df.select(*columns) if columns else df


def slices(batches, rows: int = 512):
    """Arrow batches in pieces of few rows, so that only their texts are
    Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sized_slices(batches, sizes: Callable, size: int = 4_000_000, rows: int = 512):
    """As ``slices``, of about ``size`` bytes besides (at least one row), so that
    long texts are Python objects a few at a time; ``sizes`` gives the bytes of a
    batch's rows."""
    for batch in batches:
        at = used = 0
        for i, n in enumerate(sizes(batch).to_pylist()):
            if i - at == rows or (i > at and used + n > size):
                yield batch.slice(at, i - at)
                at, used = i, 0
            used += n
        if at < batch.num_rows:
            yield batch.slice(at)


def byte_blocks(batches, column: int, size: int):
    """Arrow batches dealt anew into blocks of about ``size`` bytes of one text
    column (at least one row), so that work by block is neither tiny nor unbounded."""
    held, used = [], 0

    def block():
        whole = pa.Table.from_batches(held).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in whole.columns], names=whole.column_names)

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        at = 0
        for i, n in enumerate(lengths):
            if used and used + n > size:
                if i > at:
                    held.append(batch.slice(at, i - at))
                yield block()
                held, used, at = [], 0, i
            used += n
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if held:
        yield block()
