"""The links of DBSCAN's cores do not multiply with the parts that meet."""

import numpy as np

from tessellate.operators import metric as M


def components(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_links_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(M, "MEET_TILES", 1)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.1, (700, 4)), rng.normal(3, 0.1, (200, 4)), rng.uniform(5, 90, (60, 4))])
    rows = M.keyed(spark.createDataFrame([(i, *v) for i, v in enumerate(x.tolist())], "id long, a double, b double, c double, d double"),
                   list("abcd"), id="id")
    pivots = M.Pivots.of(rows, 4, 64)
    tiles, _ = M.dealt_tiles(rows, pivots, 4, ["id"], 0.4, 64)
    assert tiles.rdd.getNumPartitions() > 8
    links = [tuple(r) for r in M.near_links(tiles, pivots, 4, 0.4).collect()]
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= 0.4 ** 2
    assert components(len(x), links) == components(len(x), zip(*np.nonzero(near)))
    assert len(set(links)) == len(links) < 4 * len(x)
