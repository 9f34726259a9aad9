"""DBSCAN's tiles travel in records: a task takes each part's rows a bounded number of times, and decides in single precision where it can."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellate.operators import metric as M


def test_tiles_are_dealt_in_records(spark, monkeypatch):
    monkeypatch.setattr(M, "MEET_TILES", 20)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1200, 4)).round(3)
    ids = [f"r{i // 2 if i < 100 else i:04d}" for i in range(len(x))]  # ids that come twice are no neighbours
    df = spark.createDataFrame([(i, 1 + k % 2, *v) for k, (i, v) in enumerate(zip(ids, x.tolist()))], "id string, copies long, a double, b double, c double, d double")
    rows = M.keyed(df, list("abcd"), id="id", copies="copies")
    pivots = M.Pivots.of(rows, 4, 16)
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= 0.7 ** 2
    names, weight = np.array(ids), 1 + np.arange(len(x)) % 2
    near &= names[:, None] != names[None]
    want = {}
    for i, n in zip(ids, (near @ weight).tolist()):
        want[i] = want.get(i, 0) + n
    for cross_bytes, most in ((8 << 20, 6), (32 * 40, 10 ** 6)):  # a record a part; of 40 rows or some more
        monkeypatch.setattr(M, "CROSS_BYTES", cross_bytes)
        tiles, _ = M.dealt_tiles(rows, pivots, 4, ["id", "copies"], 0.7, 16)
        assert tiles.agg(F.sum(F.length("x"))).first()[0] == 1200 * 32
        assert tiles.rdd.getNumPartitions() <= tiles.count() + 1 if most > 6 else tiles.count() <= tiles.rdd.getNumPartitions()
        got = {r["id"]: r["n"] for r in M.near_counts(tiles, pivots, 4, 0.7).collect()}
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
        assert M.met_records(tiles, tiles, ["x"], True).count() == tiles.count() * (tiles.count() + 1) // 2


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e-25, 1e6, 1e20])
@pytest.mark.parametrize("shift", [0.0, 1e3])
def test_within_at_any_scale(scale, shift):
    rng = np.random.default_rng(9)
    x = (rng.integers(0, 4, (90, 16)) * 0.25 + rng.choice([0.0, 1e-9], (90, 16)) + shift) * scale
    d2 = np.zeros((90, 90))
    for f in range(16):
        diff = x[:, f][:, None] - x[:, f][None]
        d2 += diff * diff
    for e2 in (1.0 * scale ** 2, 2.0 * scale ** 2, 1e-3 * scale ** 2, float(d2[0, 1])):
        assert (M.within(x, x, e2) == (d2 <= e2)).all()
