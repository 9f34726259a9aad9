"""Exact neighbour search by pivots, cells and tiles against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellate.operators import assign as A
from tessellate.operators import dbscan as DB
from tessellate.operators import metric as M
from tessellate.operators import quality as Q
from tessellate.operators import search as SE

FS = [f"f{i}" for i in range(5)]
SCHEMA = "id string, g int, " + ", ".join(f"{f} double" for f in FS)


def blobs(n, seed=1, spread=0.3, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, len(FS))) * 6
    x = centres[rng.integers(0, 10, n)] + rng.normal(size=(n, len(FS))) * spread
    x[:copies] = x[0]
    return x


def frame(spark, x, extra=()):
    rows = [(f"r{i:04d}", i % 3, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], SCHEMA).repartition(5)


ODD = [("null", 0, None, 1.0, 1.0, 1.0, 1.0), ("nan", 1, math.nan, 1.0, 1.0, 1.0, 1.0), ("inf", 2, math.inf, 1.0, 1.0, 1.0, 1.0)]


def distances(x, y=None):
    y = x if y is None else y
    return np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))


@pytest.mark.parametrize("n, copies, shift, tile", [(400, 130, 0.0, 16), (300, 0, 1e6, 16), (40, 0, 0.0, None)])
def test_near_pairs(spark, n, copies, shift, tile):
    """Cells of every size, a third of the rows equal, features far from zero."""
    x = blobs(n, copies=copies) + shift
    d = distances(x)
    want = {(f"r{i:04d}", f"r{j:04d}"): d[i, j] for i, j in zip(*np.nonzero(d <= 0.6)) if i < j}
    rows = M.near_pairs(frame(spark, x, ODD), FS, 0.6, "id", tile_rows=tile).collect()
    assert len(rows) == len(want) and {(r[0], r[1]) for r in rows} == set(want)
    assert all(abs(r["distance"] - want[r[0], r[1]]) < 1e-9 for r in rows)


def test_clustered_rows_meet_few_others(spark):
    df = frame(spark, blobs(1500))
    compared = M.compared_pairs(df, FS, 0.6, "id", tile_rows=32)
    assert compared < 0.25 * 1500 * 1499 / 2
    assert M.compared_pairs(df.where("false"), FS, 0.6, "id") == 0


@pytest.mark.parametrize("k, group, alone", [(1, None, False), (4, "g", True), (60, "g", True)])
def test_k_nearest(spark, k, group, alone):
    """k beyond a cell's rows, ties among copies (by id), own group only."""
    x = blobs(300, copies=60)
    df = frame(spark, x, ODD)
    asked = df.where("substr(id, 4) in ('00', '11', '05') or id = 'null'")
    found, q = M.k_nearest(asked, df, FS, k, "id", "id", group, "g", alone, tile_rows=16)
    got = {}
    for r in found.join(q.select("row", F.col("id").alias("q")), "row").collect():
        got.setdefault(r["q"], []).append((r["rank"], r["id"], r["payload"], r["distance"]))
    d = distances(x)
    ids = [i for i in range(300) if i % 100 in (0, 11, 5)]
    assert set(got) == {f"r{i:04d}" for i in ids}
    for i in ids:
        near = sorted((d[i, j], j) for j in range(300) if not (alone and i == j) and (group is None or i % 3 == j % 3))[:k]
        mine = sorted(got[f"r{i:04d}"])
        assert [r[0] for r in mine] == list(range(1, len(near) + 1))
        assert [r[1] for r in mine] == [f"r{j:04d}" for _, j in near] and all(r[2] == int(r[1][1:]) % 3 for r in mine)
        assert all(abs(r[3] - dist) < 1e-9 for r, (dist, _) in zip(mine, near))


def test_a_query_without_a_group_sees_all_rows(spark):
    x = blobs(120)
    df = frame(spark, x)
    q = df.where("id in ('r0001', 'r0002')").withColumn("g", F.when(F.col("id") == "r0001", F.lit(None).cast("int")).otherwise(F.col("g")))
    rows = SE.similar_items_many(df, q, FS, "id", "g", 5, tile_rows=8).collect()
    d = distances(x)
    for i in (1, 2):
        want = sorted((d[i, j], f"r{j:04d}") for j in range(120) if j != i and (i == 1 or j % 3 == i % 3))[:5]
        assert [r["id"] for r in sorted((r for r in rows if r["query_id"] == f"r{i:04d}"), key=lambda r: r["rank"])] == [n for _, n in want]


def test_propagate_nearest_over_many_cells(spark):
    x = blobs(500)
    df = frame(spark, x, ODD)
    sample = df.where("try_cast(substr(id, 2) as int) % 2 = 0 or id = 'nan'")
    got = {r["id"]: r for r in A.propagate_nearest(df, sample, FS, "id", "id", "g", tile_rows=16).collect()}
    d = distances(x, x[::2])
    assert len(got) == 503 and all(got[i]["nn_id"] is None for i in ("null", "nan", "inf"))
    for i in range(500):
        j = 2 * int(d[i].argmin())
        r = got[f"r{i:04d}"]
        assert (r["nn_id"], r["nn_label"]) == (f"r{j:04d}", j % 3) and abs(r["nn_dist"] - d[i].min()) < 1e-9
    none = A.propagate_nearest(df, sample.where("false"), FS, "id", "id", "g").collect()
    assert len(none) == 503 and all(r["nn_id"] is None and r["nn_dist"] is None for r in none)


def scan_dbscan(x, eps, least):
    """Labels by scan and expansion, numbered by first core."""
    d = distances(x)
    near = [np.flatnonzero(row <= eps) for row in d]
    label, cluster = [-1] * len(x), 0
    for i in range(len(x)):
        if label[i] != -1 or len(near[i]) < least:
            continue
        label[i], todo = cluster, [i]
        while todo:
            for j in near[todo.pop()]:
                if label[j] == -1:
                    label[j] = cluster
                    if len(near[j]) >= least:
                        todo.append(j)
        cluster += 1
    return label


@pytest.mark.parametrize("copies", [0, 150])
@pytest.mark.parametrize("features", [2, 5])
def test_dbscan_with_string_ids_and_copies(spark, copies, features):
    x = blobs(420, seed=4, spread=0.5, copies=copies)[:, :features]
    fs = FS[:features]
    df = frame(spark, np.pad(x, ((0, 0), (0, len(FS) - features)))).select("id", *fs)
    for method in (["auto", "grid", "pairs"] if features == 2 else ["auto"]):
        got = {r["id"]: r["cluster"] for r in DB.dbscan(df, fs, 0.7, 6, "id", method=method).collect()}
        assert [got[f"r{i:04d}"] for i in range(420)] == scan_dbscan(x, 0.7, 6)


def test_dbscan_rows_without_features_are_noise(spark):
    x = blobs(60, spread=0.1)
    rows = DB.dbscan(frame(spark, x, ODD), FS, 0.7, 3, "id").collect()
    assert len(rows) == 63 and {r["cluster"] for r in rows if r["id"] in ("null", "nan", "inf")} == {-1}
    assert DB.dbscan(frame(spark, x[:0]), FS, 0.7, 3, "id").count() == 0


def plain_silhouette(x, labels):
    d = distances(x)
    out = []
    for i, own in enumerate(labels):
        mean = {c: d[i, labels == c].sum() / max((labels == c).sum() - (c == own), 1) for c in set(labels.tolist())}
        a, b = mean.pop(own), min(mean.values(), default=0.0)
        out.append((b - a) / max(a, b) if (labels == own).sum() > 1 and max(a, b) > 0 else 0.0)
    return out


@pytest.mark.parametrize("tile", [7, 64, None])
def test_silhouette_in_tiles(spark, tile):
    """Labels longer and shorter than a tile, a singleton, copies, noise."""
    x = blobs(260, copies=90)
    labels = np.array([0] * 120 + [1] * 5 + [2] + [5] * 60 + [-1] * 14 + [9] * 60)
    df = frame(spark, x, ODD).withColumn("c", F.when(F.col("id").startswith("r"), F.array(*map(F.lit, labels.tolist()))[
        F.try_to_number(F.substring("id", 2, 4), F.lit("9999")).cast("int")]).otherwise(F.lit(0)))
    rows = Q.silhouette_samples(df, "c", FS, "id", tile_rows=tile).collect()
    keep = labels != -1
    want = dict(zip((f"r{i:04d}" for i in np.flatnonzero(keep)), plain_silhouette(x[keep], labels[keep])))
    assert {r["id"] for r in rows} == set(want)
    assert all(abs(r["silhouette"] - want[r["id"]]) < 1e-9 for r in rows)
    assert Q.silhouette_samples(df.where("false"), "c", FS, "id").count() == 0


def test_pairwise_centroids_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(A, "CENTRE_BLOCK", 4)
    x = blobs(13)
    cen = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "cid int, " + ", ".join(f"{f} double" for f in FS))
    got = {(r[0], r[1]): r[2] for r in A.pairwise_centroids(cen, FS).collect()}
    assert len(got) == 169 and all(abs(got[i, j] - v) < 1e-9 for (i, j), v in np.ndenumerate(distances(x)))
