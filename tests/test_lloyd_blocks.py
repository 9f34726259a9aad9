"""Rounds of k-means read blocks of rows, and find cells by one product."""

import numpy as np

from tessellate.operators import lloyd as L


def test_cells_by_products_are_those_of_plain_distances():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(3000, 3)) * 4) / 4 + 1e4  # many ties
    for k in (1, 2, 7):
        model = L.Flat(np.round(rng.normal(size=(k, 3)) * 4) / 4 + 1e4)
        assert (model.cell(x, L.Moved.of(x, x[0])) == model.assign(x)[0]).all()


def test_rounds_read_blocks(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(1000, 2))
    df = spark.createDataFrame([(v,) for v in x.tolist()], "x array<double>").repartition(3)
    kinds, run = [], L.totals
    monkeypatch.setattr(L, "totals", lambda rows, *a: kinds.append(rows.schema["x"].dataType.simpleString()) or run(rows, *a))
    ((centres, cost),) = L.lloyd_many(df, 2, [x[:3]], 2)
    c = x[:3]
    for _ in range(2):
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[near == j].mean(axis=0) for j in range(3)])
    assert np.allclose(centres, c) and np.isclose(cost, ((x[:, None] - c[None]) ** 2).sum(2).min(1).sum())
    assert kinds == ["binary"] * 3
    assert sum(len(bytes(r["x"])) for r in L.in_blocks(df, 2).collect()) == x.nbytes
