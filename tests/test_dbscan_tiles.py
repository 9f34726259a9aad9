"""DBSCAN by tiles: pairs within eps are met in the tasks and never listed."""

import numpy as np
import pytest

from tessellate.operators import dbscan as DB
from tessellate.operators import metric as M

from tests.test_dbscan_grid import plain_dbscan


def dense(d):
    rng = np.random.default_rng(d)
    return np.concatenate([rng.normal(0, 0.05, (200, d)), rng.normal(0.7, 0.12, (150, d)), rng.uniform(-1, 2, (50, d))]).round(4)


def frame(spark, x):
    return spark.createDataFrame([(i, *v) for i, v in enumerate(x.tolist())], "id long, " + ", ".join(f"x{f} double" for f in range(x.shape[1])))


@pytest.fixture
def counted(monkeypatch):
    edges, plain = [], DB.connected_components

    def components(vertices, found, *more):
        edges.append(found.count())
        return plain(vertices, found, *more)

    def listed(*_):
        raise AssertionError("pairs are listed")

    monkeypatch.setattr(DB, "connected_components", components)
    monkeypatch.setattr(DB, "eps_join", listed)
    monkeypatch.setattr(DB, "_dbscan_grid", listed)
    monkeypatch.setattr(DB, "tile_size", lambda d: 64)
    return edges


def test_sampled_fit_lists_no_pairs(spark, counted):
    x = dense(3)
    rows = DB.dbscan_sampled(frame(spark, x), ["x0", "x1", "x2"], 0.1, 5, "id", sample_size=1000).collect()
    assert {r["id"]: r["cluster"] for r in rows} == dict(enumerate(plain_dbscan(x, 0.1, 5)[0].tolist()))
    assert counted[0] < 2 * len(x)


def test_many_features_list_no_pairs(spark, counted):
    x = dense(6)
    x[300:320] = x[300]  # copies
    df = frame(spark, x).unionByName(spark.createDataFrame([(900, None)], "id long, x0 double"), allowMissingColumns=True)
    rows = {r["id"]: (r["cluster"], r["is_core"]) for r in DB.dbscan(df, [f"x{f}" for f in range(6)], 0.25, 6, "id").collect()}
    label, core = plain_dbscan(x, 0.25, 6)
    assert rows == {**{i: (int(label[i]), bool(core[i])) for i in range(len(x))}, 900: (-1, False)}
    assert counted[0] < 4 * len(x)


def test_within_is_exact_at_the_radius():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, (80, 5)) * 0.25 + 1000.0
    assert (M.within(x, x, 0.25) == (((x[:, None] - x[None]) ** 2).sum(2) <= 0.25)).all()
