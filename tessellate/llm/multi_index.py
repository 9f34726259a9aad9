"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut in half and each half gets its own codebook; the product
of the two is a grid of cells, and every distinct vector is filed under the
cell of its two nearest codewords.  A vector looks for its neighbours in the
cells nearest to it, in the order of the multi-sequence traversal (rising sum
of its two codeword distances).  How many cells it visits is calibrated on a
bounded sample of vectors: enough to find ``TARGET_RECALL`` of neighbours made at
exactly the threshold cosine in random directions, of such neighbours in
directions towards other vectors of the sample (data of low inner rank has its
neighbours there), and of the sample's true links, found by brute force.  A pair
is found when either end visits the other's cell.  Candidates are verified by
their cosine in double precision, so no pair below the threshold links.

Vectors are scaled by their largest component before their norm, so that every
finite non-zero vector has a direction.  Each dimension has an index of its own;
vectors of different dimensions do not link.  Equal vectors are one entry with a
count.  Vectors that are null, zero, or hold null or non-finite components link
with nothing.  Ids may have any type that orders.  A cell row that holds many vectors is split into chunks of at most
``CHUNK`` members; a task holds one chunk and streams its visitors past it.
Pairs are never stored: a chunk gives counts and the links of a star for each
group it finds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .components import components

SAMPLE = 20_000
CALIBRATION = 2_000
LINKS = 20_000
TARGET_RECALL = 0.98
CHUNK = 2_048
VISITORS = 1_024
MAX_CODES = 1_024


@dataclass
class MultiIndex:
    """Two codebooks and the number of cells to visit."""
    left: np.ndarray
    right: np.ndarray
    visits: int

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves to their codewords, summed row by
        row so that they do not depend on the batch."""
        h = unit.shape[1] // 2
        return _squared(unit[:, :h], self.left), _squared(unit[:, h:], self.right)

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.distances(unit)
        return a.argmin(axis=1), b.argmin(axis=1)


def _squared(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(codes)))
    for k, c in enumerate(codes):
        out[:, k] = np.square(x - c).sum(axis=1)
    return out


def multi_sequence(a: np.ndarray, b: np.ndarray, visits: int) -> tuple[np.ndarray, ...]:
    """(left codes, right codes, sums, radius): the ``visits`` cells of least
    summed distance of each row (the other sums are NaN) and the largest of
    those sums.  The cell of sorted ranks (i, j) comes after all (i', j') with i' <= i and j' <= j, so only
    those with (i + 1)(j + 1) <= visits can be among them."""
    visits = min(visits, a.shape[1] * b.shape[1])
    oa, ob = a.argsort(axis=1, kind="stable"), b.argsort(axis=1, kind="stable")
    sa, sb = np.take_along_axis(a, oa, 1), np.take_along_axis(b, ob, 1)
    pairs = [(i, j) for i in range(a.shape[1]) for j in range(min(b.shape[1], visits // (i + 1)))]
    ri, rj = (np.array(x) for x in zip(*pairs))
    sums = sa[:, ri] + sb[:, rj]
    radius = np.partition(sums, visits - 1, axis=1)[:, visits - 1] if visits < len(pairs) else sums.max(axis=1)
    return oa[:, ri], ob[:, rj], np.where(sums <= radius[:, None], sums, np.nan), radius


def _lloyd(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    codes = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = (np.square(codes).sum(axis=1)[None, :] - 2.0 * x @ codes.T).argmin(axis=1)
        n = np.bincount(at, minlength=k)
        for d in range(x.shape[1]):
            s = np.bincount(at, weights=x[:, d], minlength=k)
            codes[:, d] = np.where(n > 0, s / np.maximum(n, 1), codes[:, d])
    return codes


def fit_index(sample: np.ndarray, n_vectors: int, threshold: float, target: float = TARGET_RECALL, seed: int = 42) -> MultiIndex:
    """Codebooks of about sqrt(n)/6 codewords per half (a power of two, at most
    ``MAX_CODES``) and the visits that reach the target recall."""
    rng = np.random.default_rng(seed)
    k = 1 << max(0, int(np.log2(max(1.0, np.sqrt(n_vectors) / 6))))
    k = min(k, MAX_CODES, len(np.unique(sample, axis=0)))
    h = sample.shape[1] // 2
    index = MultiIndex(_lloyd(sample[:, :h], k, rng), _lloyd(sample[:, h:], k, rng), k * k)
    x = sample[rng.permutation(len(sample))[:CALIBRATION]]
    ranks = [_ranks(index, x, _at_cosine(x, rng.standard_normal(x.shape), threshold)),
             _ranks(index, x, _at_cosine(x, sample[rng.integers(len(sample), size=len(x))], threshold))]
    q, y = np.nonzero(x @ sample.T >= threshold)
    apart = np.abs(x[q] - sample[y]).max(axis=1, initial=0.0) > 0
    q, y = q[apart], y[apart]
    if len(q) > LINKS:
        some = rng.permutation(len(q))[:LINKS]
        q, y = q[some], y[some]
    if len(q):
        ranks.append(_ranks(index, sample[y], x[q]))
    index.visits = max(int(np.quantile(r, target, method="higher")) for r in ranks)
    return index


def _at_cosine(x: np.ndarray, towards: np.ndarray, cosine: float) -> np.ndarray:
    """Unit vectors at a cosine to the unit vectors ``x``, each turned towards another."""
    turn = towards - (towards * x).sum(axis=1, keepdims=True) * x
    length = np.linalg.norm(turn, axis=1, keepdims=True)
    return cosine * x + np.sqrt(1 - cosine ** 2) * turn / np.where(length > 1e-9, length, 1.0)


def _ranks(index: MultiIndex, x: np.ndarray, seekers: np.ndarray) -> np.ndarray:
    """How many cells each seeker visits until it comes to the cell of its ``x``."""
    out = []
    for lo in range(0, len(x), 256):
        i, j = index.cells(x[lo:lo + 256])
        a, b = index.distances(seekers[lo:lo + 256])
        own = np.take_along_axis(a, i[:, None], 1)[:, 0] + np.take_along_axis(b, j[:, None], 1)[:, 0]
        if a.shape[1] <= 128:
            out.append((a[:, :, None] + b[:, None, :] < own[:, None, None]).sum(axis=(1, 2)) + 1)
        else:  # the same count from the sorted right distances, one left codeword at a time
            sb = np.sort(b, axis=1)
            out.append(np.array([sum(np.searchsorted(sb[r], own[r] - d) for d in a[r]) for r in range(len(a))]) + 1)
    return np.concatenate(out)


def _units(raw: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def clean_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, raw): components as packed doubles, null where the vector links with nothing."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("raw", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for v in batch.column(1).to_pylist():
                x = np.array(v, np.float64) if v and None not in v else None
                raw.append(None if x is None or not np.isfinite(x).all() or not x.any() else (x + 0.0).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["id", "raw"])

    return df.select(F.col(id_col), F.col(vector_col)).mapInArrow(run, schema)


def _probes(index: MultiIndex, chunks: dict[int, int]):
    """(code, chunk, role, key, raw, weight, radius, own, js): a vector as a
    member of its own row of cells (role 0) and as a visitor of each row that
    it visits (role 1, once per chunk, with the right codes visited there)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                raw, key, weight = part.column(1).to_pylist(), part.column(0).to_pylist(), part.column(2).to_pylist()
                a, b = index.distances(_units(raw))
                own_i, own_j = a.argmin(axis=1).tolist(), b.argmin(axis=1).tolist()
                left, right, sums, radius = multi_sequence(a, b, index.visits)
                rows = []
                for r in range(len(raw)):
                    tail = (key[r], raw[r], weight[r], float(radius[r]), own_i[r] * MAX_CODES + own_j[r])
                    rows.append((own_i[r], key[r] % chunks[own_i[r]], 0, *tail, b""))
                    ok = ~np.isnan(sums[r])
                    li, lj = left[r][ok], right[r][ok]
                    for i in np.unique(li).tolist():
                        js = lj[li == i].astype("<u2").tobytes()
                        rows += [(i, c, 1, *tail, js) for c in range(chunks.get(i, 0))]
                cols = list(zip(*rows))
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=PROBE)
    return run


PROBE = ["code", "chunk", "role", "key", "raw", "weight", "radius", "own", "js"]
PROBE_SCHEMA = ("code int, chunk long, role int, key long, raw binary, weight long, radius double, own long, js binary")


def _stars(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Star links of the groups that pairs (a, b) of keys connect."""
    keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(keys))
    while True:
        low = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, x, low)
        np.minimum.at(after, y, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    for i in np.flatnonzero(label != np.arange(len(keys))).tolist():
        yield int(keys[i]), int(keys[label[i]])


def _verify(index: MultiIndex, threshold: float):
    """Over rows sorted by (code, chunk, role): (key, links, other).  Rows with
    a null other carry link counts; the rest are links for the components."""
    def found(members, visitors):
        m_key, m_unit, m_weight, m_radius, m_own, (ma, mb) = members
        v_raw, v_key, v_weight, v_own, v_js = visitors
        unit = _units(v_raw)
        add: dict[int, int] = {}
        pairs_a, pairs_b = [], []
        visited = np.zeros((len(v_key), MAX_CODES), bool)
        for r, js in enumerate(v_js):
            visited[r, np.frombuffer(js, "<u2")] = True
        right = m_own % MAX_CODES
        for j in np.unique(right).tolist():
            who, here = np.flatnonzero(visited[:, j]), np.flatnonzero(right == j)
            if not len(who):
                continue
            q, x = np.nonzero(unit[who] @ m_unit[here].T >= threshold)
            q, x = who[q], here[x]
            other = v_key[q] != m_key[x]
            q, x = q[other], x[other]
            if not len(q):
                continue
            pairs_a.append(v_key[q])
            pairs_b.append(m_key[x])
            for k, n in zip(v_key[q].tolist(), m_weight[x].tolist()):
                add[k] = add.get(k, 0) + n
            # the member counts the visitor too, unless it finds it by its own visit
            back = ma[x, v_own[q] // MAX_CODES] + mb[x, v_own[q] % MAX_CODES] > m_radius[x]
            for k, n in zip(m_key[x[back]].tolist(), v_weight[q[back]].tolist()):
                add[k] = add.get(k, 0) + n
        if not add:
            return None
        rows = [(k, n, None) for k, n in add.items()]
        rows += [(s, 0, t) for s, t in _stars(np.concatenate(pairs_a), np.concatenate(pairs_b))]
        k, n, o = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(o, pa.int64())],
                                          names=["key", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, members = None, [], None
        for batch in batches:
            code, chunk, role = (batch.column(k).to_numpy() for k in range(3))
            bounds = np.flatnonzero((code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1]) | (role[1:] != role[:-1])) + 1
            for lo, hi in zip([0, *bounds.tolist()], [*bounds.tolist(), len(code)]):
                if hi == lo:
                    continue
                if (code[lo], chunk[lo]) != block:
                    block, held, members = (code[lo], chunk[lo]), [], None
                part = batch.slice(lo, hi - lo)
                if role[lo] == 0:
                    held.append(part)
                    continue
                if members is None:
                    if not held:
                        continue
                    t = pa.Table.from_batches(held).combine_chunks()
                    unit = _units(t.column("raw").to_pylist())
                    members = (t.column("key").to_numpy(), unit, t.column("weight").to_numpy(), t.column("radius").to_numpy(),
                               t.column("own").to_numpy(), index.distances(unit))
                for at in range(0, part.num_rows, VISITORS):
                    p = part.slice(at, VISITORS)
                    out = found(members, (p.column(4).to_pylist(), p.column(3).to_numpy(), p.column(5).to_numpy(),
                                          p.column(7).to_numpy(), p.column(8).to_pylist()))
                    if out is not None:
                        yield out
    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9,
                 target: float = TARGET_RECALL) -> DataFrame:
    """One row per row of ``df``: id, n_links (other rows linked directly) and
    component_id (smallest id reachable, itself included)."""
    rows = written(clean_vectors(df, id_col, vector_col), "vectors")
    sizes = rows.where("raw is not null").groupBy(F.length("raw").alias("n")).count().collect()  # one row per dimension
    decided = None
    for n in sorted(r["n"] for r in sizes if r["count"] > 1):
        part = _decided(rows.where(F.length("raw") == n), threshold, target)
        decided = part if decided is None else decided.union(part)
    if decided is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return (rows.hint("merge").join(decided, "raw", "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                    F.coalesce("smallest", "id").alias("component_id")))


def _decided(rows: DataFrame, threshold: float, target: float) -> DataFrame:
    """(raw, n_links, smallest) of the distinct vectors of one dimension."""
    spark = rows.sparkSession
    distinct = written(rows.groupBy("raw")
                       .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("weight"))
                       .select(F.monotonically_increasing_id().alias("key"), "raw", "weight", "first_id"), "vectors-distinct")
    sample = [bytes(r["raw"]) for r in distinct.select("raw").orderBy(F.xxhash64("raw"), "raw").limit(SAMPLE).collect()]
    unit = _units(sample)
    if unit.shape[1] == 1:
        unit = np.hstack([unit, np.zeros_like(unit)])
    index = fit_index(unit, distinct.count(), threshold, target)
    shared = spark.sparkContext.broadcast(index)  # at most 2 x MAX_CODES codewords

    def cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.cells(_units(batch.column(0).to_pylist()))[0], pa.int32())], names=["code"])

    counts = {r["code"]: r["count"] for r in distinct.select("raw").mapInArrow(cell_rows, "code int").groupBy("code").count().collect()}
    chunks = {c: -(-n // CHUNK) for c, n in counts.items()}
    probes = distinct.select("key", "raw", "weight").mapInArrow(
        lambda it: _probes(shared.value, chunks)(it), PROBE_SCHEMA)
    found = written(probes.repartition("code", "chunk").sortWithinPartitions("code", "chunk", "role")
                    .mapInArrow(lambda it: _verify(shared.value, threshold)(it), "key long, links long, other long"), "vector-links")
    links = written(found.where("other is null").groupBy("key").agg(F.sum("links").alias("links")), "vector-counts")
    group = components(found.where("other is not null"), "key", "other")
    member = written(distinct.select("key", "raw", "weight", "first_id").join(group, F.col("key") == group["node"], "left")
                     .join(links, "key", "left")
                     .select("raw", "weight", "first_id", F.coalesce("component", "key").alias("component"),
                             F.coalesce("links", F.lit(0)).alias("links")), "vector-members")
    first = written(member.groupBy("component").agg(F.min("first_id").alias("smallest")), "vector-smallest")
    return written(member.hint("merge").join(first, "component")
                   .select("raw", (F.col("links") + F.col("weight") - 1).alias("n_links"), "smallest"), "vector-decided")
