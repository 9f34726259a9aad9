"""Tiles meet in few records: a task takes each part's rows a bounded number of times, not once per pair of tiles."""

import numpy as np
from pyspark.sql import functions as F

from tessellate.operators import metric as M
from tessellate.operators import quality as Q
from tests.test_metric import plain_silhouette


def test_shares_of_large_tables():
    parts, rows = M.shares(615_384, 64, 512)
    assert parts == 32 and rows * 64 * 8 <= 8 << 20 and -(-615_384 // parts) <= 2 * rows  # at most four pairs or so of 16 MB a task
    assert M.shares(0, 64, 512) == (1, 512) and M.shares(100, 64, 512) == (1, 512)


def test_silhouettes_of_few_records(spark, monkeypatch):
    met, plain = [], M.each_two

    def counted(records, columns):
        met.append(plain(records, columns).agg(F.sum(F.length("one_x") + F.length("two_x"))).first()[0])
        return plain(records, columns)

    monkeypatch.setattr(Q, "each_two", counted)
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(300, 2)).round(2), np.full((20, 2), 5.0), 1e6 + rng.normal(size=(20, 2)).round(2)])
    labels = np.concatenate([np.zeros(170, int), 1 + np.arange(170) // 3])
    df = spark.createDataFrame([(f"r{i:03d}", int(c), *v) for i, (c, v) in enumerate(zip(labels, x.tolist()))], "id string, c int, a double, b double")
    want = plain_silhouette(x, labels)
    for cross_bytes in (8 << 20, 16 * 7):  # records of a part, and of 7 rows in tiles of 4
        monkeypatch.setattr(M, "CROSS_BYTES", cross_bytes)
        got = Q.silhouette_samples(df, "c", ["a", "b"], "id", tile_rows=4).collect()
        assert len(got) == 340 and all(abs(r["silhouette"] - want[int(r["id"][1:])]) < 1e-9 for r in got)
    assert met[0] < 340 * 16 * 2 * 14  # 11 parts of about a record; 85 tiles of 4 rows would be 86 times the rows
