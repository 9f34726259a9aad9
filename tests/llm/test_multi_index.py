import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellate.llm import multi_index, queries
from tessellate.llm.common import table
from tests.conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.9):
    """id -> (links, component) over all pairs; rows: (id, vector or None)."""
    good = [(i, np.array(v, np.float64)) for i, v in rows
            if v and None not in v and np.isfinite(v).all() and np.any(v)]
    x = np.array([v / np.linalg.norm(v) for _, v in good])
    near = x @ x.T >= threshold if len(x) else np.zeros((0, 0), bool)
    label = list(range(len(good)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for a, b in zip(*np.nonzero(near)):
        label[root(a)] = root(b)
    smallest = {}
    for k, (i, _) in enumerate(good):
        r = root(k)
        smallest[r] = min(i, smallest.get(r, i))
    out = {i: (0, i) for i, _ in rows}
    out |= {i: (int(near[k].sum()) - 1, smallest[root(k)]) for k, (i, _) in enumerate(good)}
    return out


def planted(n=1500, dims=64, seed=0):
    """Random vectors; a third of them near one, pairs just above and just below the threshold."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def near(v, cosine):
        u = rng.standard_normal(dims)
        u -= (u @ v) * v
        return cosine * v + math.sqrt(1 - cosine ** 2) * u / np.linalg.norm(u)
    for i in range(0, n // 5):
        x[i] = near(x[n - 1], 0.985)
    for k, cosine in enumerate([0.902] * 100 + [0.95] * 100 + [0.897] * 50):
        x[n // 4 + 2 * k] = near(x[n // 4 + 2 * k + 1], cosine)
    return [(i, [float(c) for c in np.float32(v)], i % 7) for i, v in enumerate(x)]


def test_recall_against_all_pairs(spark):
    rows = planted()
    want = brute([(i, v) for i, v, _ in rows])
    got = {r["vec_id"]: r for r in multi_index.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got.keys() == want.keys()
    assert all(got[i]["n_links"] <= n for i, (n, _) in want.items())  # none below the threshold
    assert sum(r["n_links"] for r in got.values()) >= 0.98 * sum(n for n, _ in want.values())
    pairs = [i for i in range(375, 775) if want[i][0]]
    assert sum(got[i]["n_links"] for i in pairs) >= 0.9 * sum(want[i][0] for i in pairs)
    assert sum(got[i]["component_id"] == c for i, (_, c) in want.items()) >= 0.98 * len(rows)


@pytest.mark.parametrize("rank", [4, 6, 10])
def test_recall_on_vectors_of_low_inner_rank(spark, rank):
    """Neighbours lie within the data's own few directions, not in random ones."""
    rng = np.random.default_rng(rank)
    x = rng.standard_normal((5000, rank)) @ rng.standard_normal((rank, 64))
    rows = [(i, [float(c) for c in np.float32(v)], 0) for i, v in enumerate(x)]
    u = np.float32(x).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    true = int((u @ u.T >= 0.9).sum()) - len(u)
    got = sum(r["n_links"] for r in multi_index.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert true > 1000 and 0.98 * true <= got <= true


def test_every_finite_vector_and_every_dimension(spark):
    """Components whose squares underflow or overflow, several dimensions, string ids."""
    v, w = [1.0, 2.0, 3.0], [2.0, -1.0, 0.5, 1.0]
    rows = [("a", v), ("b", [2 * c for c in v]), ("c", [c * 1e-200 for c in v]), ("d", [c * 1e200 for c in v]),
            ("e", w), ("f", [c * 5e-324 for c in (4.0, -2.0, 1.0, 2.0)]), ("g", [c * 1e-300 for c in w]), ("h", [7.0]), ("i", [1e-310]), ("j", [-1.0]),
            ("k", None), ("l", [0.0, -0.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in multi_index.near_vectors(df).collect()}
    assert got == {**{i: (3, "a") for i in "abcd"}, **{i: (2, "e") for i in "efg"}, "h": (1, "h"), "i": (1, "h"),
                   **{i: (0, i) for i in "jkl"}}


def test_links_are_counted_at_both_ends(spark):
    got = multi_index.near_vectors(spark.createDataFrame(planted(seed=3), SCHEMA), target=0.5).collect()
    links = {r["vec_id"]: r["n_links"] for r in got}
    for a in range(375, 775, 2):  # planted pairs: both ends agree, found or not
        if links[a] <= 1 and links[a + 1] <= 1:
            assert links[a] == links[a + 1]


def test_small_chunks_and_visitor_blocks_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame(planted(900), SCHEMA)
    whole = sorted(map(tuple, multi_index.near_vectors(df).collect()))
    monkeypatch.setattr(multi_index, "CHUNK", 64)
    assert sorted(map(tuple, multi_index.near_vectors(df).collect())) == whole


def test_query_against_all_pairs(spark):
    rows = table(spark, SF_SMALL, "embeddings").collect()
    want = brute([(r["vec_id"], r["embedding"]) for r in rows])
    for r in queries.op3_multi_index(spark, SF_SMALL).collect():
        assert (r["n_links"], r["component_id"]) == want[r["vec_id"]]
        assert r["kept"] == (r["vec_id"] == r["component_id"])


def test_edge_vectors(spark):
    v, w = [1.0, 2.0, 3.0, 4.0], [-1.0, 2.0, -3.0, 0.5]
    rows = [(1, v), (2, None), (3, [0.0] * 4), (4, [1.0, None, 1.0, 1.0]), (5, [float("nan"), 1.0, 1.0, 1.0]),
            (6, [float("inf"), 1.0, 1.0, 1.0]), (7, v), (8, [2.0, 4.0, 6.0, 8.0]), (9, w), (10, []), (11, [1.0, 2.0]), (7, v)]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows], SCHEMA).withColumns({c: F.lit("x") for c in ("raw", "key", "weight", "id")})
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in multi_index.near_vectors(df).collect())
    assert got == sorted([(1, 3, 1), (7, 3, 1), (7, 3, 1), (8, 3, 1)] + [(i, 0, i) for i in (2, 3, 4, 5, 6, 9, 10, 11)])
    assert multi_index.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = spark.createDataFrame([(3, v, 1)], T._parse_datatype_string(SCHEMA))
    assert [tuple(r) for r in multi_index.near_vectors(alone).collect()] == [(3, 0, 3)]


def test_multi_sequence_takes_the_nearest_cells():
    rng = np.random.default_rng(1)
    a, b = rng.random((20, 6)), rng.random((20, 5))
    for visits in (1, 4, 13, 30):
        left, right, sums, radius = multi_index.multi_sequence(a, b, visits)
        for r in range(20):
            ok = ~np.isnan(sums[r])
            every = np.sort((a[r][:, None] + b[r][None, :]).ravel())
            assert np.allclose(np.sort(sums[r][ok]), every[:visits]) and np.isclose(radius[r], every[visits - 1])
            assert np.allclose(a[r][left[r][ok]] + b[r][right[r][ok]], sums[r][ok])
