"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprint bit positions are dealt to the non-zero vectors of F_2^(r+1) in
turn.  For each non-zero v the mask of v keeps the positions whose vector has
an odd inner product with v.  Any r positions leave some v orthogonal to all
of their vectors, so two fingerprints within r bits agree under that mask:
every pair within the radius meets in one of the 2^(r+1) - 1 tables.

Only distinct fingerprints enter the tables.  A bucket of at most
``MAX_BUCKET`` is verified by exact bit distances and gives the links of a
star for each of its groups, never all pairs.  A larger bucket is dealt again
by a covering of the positions its mask leaves free, until it fits: every mask
keeps a position, and once the free positions are at most log2(MAX_BUCKET) the
bucket must fit, since its members are distinct.  Nothing is dropped.

Null texts count as empty and have fingerprint zero; fingerprints of zero link
like any others.  Null ids never become a component's id unless nothing else
is there.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import located, only, release, slices, texts_to_python, written
from .components import components

SEED = 42
MAX_BUCKET = 1024
BITS = 64
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, shingle: int = 3, seed: int = SEED, block: int = 1 << 16) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a whole text."""
    words = text.encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    last = ends[-n:].tolist()
    starts = [0, *(ends[:n - 1] + 1).tolist()]
    ones = np.zeros(BITS, np.int64)
    hash64 = xxhash.xxh64_intdigest
    for at in range(0, n, block):
        h = np.array([hash64(joined[a:b], seed) for a, b in zip(starts[at:at + block], last[at:at + block])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 carry: Sequence[str] = ()) -> DataFrame:
    """(id, fp, columns of ``carry``): the fingerprint of each row as a signed long."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("fp", T.LongType()),
                           *(df.schema[c] for c in carry)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches):
            fps = np.array([fingerprint(t.as_py() or "", shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names=schema.names)

    return texts_to_python(df, id_col, text_col, *carry).mapInArrow(run, schema)


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Masks over some bit positions: any ``radius`` positions are all outside
    one of them.  Where the positions are too few for every v to keep one, the
    masks are radius + 1 disjoint groups of them, with the same promise."""
    vectors = (1 << (radius + 1)) - 1
    dealt = [(p, i % vectors + 1) for i, p in enumerate(positions)]
    masks = [sum(1 << p for p, m in dealt if (m & v).bit_count() & 1) for v in range(1, vectors + 1)]
    return masks if all(masks) else [sum(1 << p for p in positions[g::radius + 1]) for g in range(radius + 1)]


@functools.lru_cache(maxsize=10_000)
def path_masks(path: tuple[int, ...], radius: int) -> list[int]:
    """The masks of the covering nested below a path of chosen masks, each with
    the positions that the path has kept already."""
    kept = path_masks(path[:-1], radius)[path[-1]] if path else 0
    free = [p for p in range(BITS) if not kept >> p & 1]
    return [kept | m for m in covering_masks(free, radius)]


def _steps(code: int, radius: int) -> tuple[int, ...]:
    """The path that a table's number codes (digits from 1, base 2^(radius+1))."""
    out = []
    while code:
        out.append((code & ((1 << (radius + 1)) - 1)) - 1)
        code >>= radius + 1
    return tuple(reversed(out))


def dealt_rows(rows: DataFrame, radius: int) -> DataFrame:
    """(code, key, fp): each (code, fp) once per table of the covering of the
    positions that the masks behind ``code`` leave free."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for code in np.unique(codes).tolist():
                fp = fps[codes == code]
                for step, mask in enumerate(path_masks(_steps(code, radius), radius)):
                    key = (fp.view(np.uint64) & np.uint64(mask)).view(np.int64)
                    new = np.full(len(fp), (code << (radius + 1)) | (step + 1), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(new), pa.array(key), pa.array(fp)], names=["code", "key", "fp"])

    return rows.select("code", "fp").mapInArrow(run, "code long, key long, fp long")


def star_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, first member) of each group that distances up to ``radius`` connect."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        lower = np.where(near, label[None, :], len(fps)).min(axis=1)
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    moved = label != np.arange(len(fps))
    return fps[moved], fps[label[moved]]


def _bucket_links(radius: int, largest: int):
    """Over rows (code, key, fp) sorted by bucket: links (fp, link) of the
    buckets that fit, and the rows of larger ones again with a null link.  At
    most one batch and ``largest`` rows are held."""
    names = ["code", "fp", "link"]

    def out(code, fp, link) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(fp.view(np.int64)),
                                           pa.array(link, pa.int64()) if link is not None else pa.nulls(len(fp), pa.int64())],
                                          names=names)

    def links(fp, starts, ends):
        sizes = ends - starts
        two = starts[sizes == 2]
        a, b = fp[two], fp[two + 1]
        close = np.bitwise_count(a ^ b) <= radius
        found = [(b[close], a[close])]
        found += [star_links(fp[i:j], radius) for i, j in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist())]
        members, firsts = (np.concatenate(x) for x in zip(*found))
        return out(np.zeros(len(members), np.int64), members, firsts.view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        outgrown = None  # the open bucket, once it is larger than fits
        for batch in batches:
            code, key, fp = (batch.column(k).to_numpy() for k in range(3))
            if not len(code):
                continue
            if held is not None:
                code, key, fp = (np.concatenate(x) for x in zip(held, (code, key, fp)))
            bounds = np.flatnonzero((code[1:] != code[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.concatenate([[0], bounds]), np.concatenate([bounds, [len(code)]])
            large = ends - starts > largest
            large[0] |= (int(code[0]), int(key[0])) == outgrown
            for i, j in zip(starts[large].tolist(), ends[large].tolist()):
                yield out(code[i:j], fp[i:j].view(np.uint64), None)
            done = ~large
            done[-1] = False
            if done.any():
                yield links(fp.view(np.uint64), starts[done], ends[done])
            at = int(starts[-1])
            outgrown = (int(code[at]), int(key[at])) if large[-1] else None
            held = None if large[-1] else (code[at:], key[at:], fp[at:])
        if held is not None:
            yield links(held[2].view(np.uint64), np.array([0]), np.array([len(held[2])]))

    return run


def near_links(distinct: DataFrame, radius: int = 3, largest: int = MAX_BUCKET) -> DataFrame:
    """(fp, link) over a table of distinct fingerprints: links that connect
    exactly what distances of at most ``radius`` bits connect."""
    rows = distinct.select(F.lit(0).cast("long").alias("code"), "fp")
    if largest < 1 << radius:
        raise ValueError("a bucket must hold 2**radius fingerprints: so many may lie within the radius of each other")
    found = None
    while True:
        level = written(dealt_rows(rows, radius).repartition("code", "key").sortWithinPartitions("code", "key")
                        .mapInArrow(_bucket_links(radius, largest), "code long, fp long, link long"), "simhash-links")
        links = level.where("link is not null").select("fp", "link")
        found = links if found is None else found.union(links)
        rows = level.where("link is null").select("code", "fp")
        if rows.isEmpty():
            return found


def _members(fps: DataFrame, first: list, radius: int, largest: int) -> tuple[DataFrame, DataFrame]:
    """(fp, component) of the distinct fingerprints, and (component, first): the
    first of its rows in the order of the columns ``first``."""
    distinct = written(fps.groupBy("fp").agg(F.min(F.struct(*first)).alias("first")), "simhash-distinct")
    group = components(near_links(distinct, radius, largest), "fp", "link")
    member = written(distinct.hint("merge").join(group, distinct["fp"] == group["node"], "left")
                     .select("fp", "first", F.coalesce("component", "fp").alias("component")), "simhash-members")
    smallest = written(member.groupBy("component").agg(F.min("first").alias("first")), "simhash-smallest")
    return member, smallest


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                   radius: int = 3, largest: int = MAX_BUCKET) -> DataFrame:
    """One row per row of ``df``: id, fp (signed long), component_id (smallest
    id reachable over links of at most ``radius`` differing bits)."""
    fps = written(fingerprints(df, id_col, text_col, shingle), "simhash-fps")
    member, smallest = _members(fps, [F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id")], radius, largest)
    decided = written(member.drop("first").hint("merge").join(smallest, "component")
                      .select(F.col("fp").alias("fp_"), F.col("first.id").alias("component_id")), "simhash-decided")
    return (fps.hint("merge").join(decided, fps["fp"] == decided["fp_"])
            .select(id_col, "fp", "component_id"))


def hex_fingerprint(fp: str | Column) -> Column:
    """16 lowercase hex digits of a fingerprint."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                radius: int = 3, largest: int = MAX_BUCKET) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group (that of the smallest
    id; of repeated rows the first by its place), with their columns.  Texts are
    fingerprinted once, decided on by the rows' names and moved once."""
    rows, names = located(docs)
    fps = written(fingerprints(rows, id_col, text_col, shingle, carry=names), "simhash-fps")
    first = [F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), *names]
    _, smallest = _members(fps, first, radius, largest)
    return only(rows, names, smallest.select(*(F.col(f"first.{n}") for n in names)))
