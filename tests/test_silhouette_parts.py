"""All pairs of tiles without a shuffle of tiles: what a task passes on is one
state per tile."""

import numpy as np

from tessellate.operators import quality as Q
from tests.test_metric import plain_silhouette


def test_tiles_meet_without_a_shuffle(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 2)).round(2)
    labels = np.concatenate([np.zeros(100, int), 1 + np.arange(140) // 3, ])  # one large label, many small ones
    df = spark.createDataFrame([(i, int(c), *v) for i, (c, v) in enumerate(zip(labels, x.tolist()))], "id int, c int, a double, b double")
    out = Q.silhouette_samples(df, "c", ["a", "b"], "id", tile_rows=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan
    want = plain_silhouette(x, labels)
    got = out.collect()
    assert len(got) == 240 and all(abs(r["silhouette"] - want[r["id"]]) < 1e-9 for r in got)


def test_a_tile_keeps_the_sums_of_open_labels_only():
    state = Q._TileSilhouette(np.array([1, 1, 2]))
    state.add(np.array([1, 1, 2, 3, 3]), np.array([2, 2, 4, 2, 2]), np.arange(15.0).reshape(3, 5))
    assert list(state.open) == [2] and state.open[2][0] == 1  # three rows of label 2 are still to come
    assert state.own.tolist() == [1.0, 11.0, 0.0] and state.n_own.tolist() == [2.0, 2.0, 0.0]
    assert state.near.tolist() == [3.5, 8.5, 10.5]
