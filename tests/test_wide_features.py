"""Features named out of one array column, 64 of them: planning must end."""

import signal
from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellate.operators import hierarchy as H
from tessellate.operators import quality as Q
from tests.test_metric import plain_silhouette

FS = [f"e{i}" for i in range(64)]


@contextmanager
def within(seconds):
    def late(*_):
        raise TimeoutError(f"not planned and run in {seconds} s")
    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(seconds)
    try:
        yield
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)


@pytest.fixture
def vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 64)).round(3)
    rows = [(i, v.tolist(), i % 5) for i, v in enumerate(x)] + [(40, [1.0] * 63 + [float("nan")], 1), (41, [1.0] * 63 + [None], 1)]
    spark.createDataFrame(rows, "id long, v array<double>, c int").write.parquet(str(tmp_path / "v"))
    df = spark.read.parquet(str(tmp_path / "v"))
    return x, df.select("id", "c", *(F.col("v")[i].alias(f) for i, f in enumerate(FS)))


def test_silhouette_of_derived_labels(spark, vectors):
    x, df = vectors
    with within(60):
        got = Q.silhouette_samples(df.withColumn("c", F.pmod("c", F.lit(3))), "c", FS, "id").collect()
    want = plain_silhouette(x, np.arange(40) % 5 % 3)
    assert sorted(r["id"] for r in got) == list(range(40))
    assert all(abs(r["silhouette"] - want[r["id"]]) < 1e-9 for r in got)


def test_single_linkage_of_array_features(spark, vectors):
    x, df = vectors
    with within(100):
        labels = {r["id"]: r["cluster"] for r in H.single_linkage(df, FS, "id", height=8.5)[0].collect()}
    comp = list(range(40))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for _ in range(40):
        comp = [min(comp[j] for j in range(40) if d[i, j] <= 8.5) for i in range(40)]
    order = {c: k for k, c in enumerate(sorted(set(comp)))}
    assert labels == {i: order[c] for i, c in enumerate(comp)}
