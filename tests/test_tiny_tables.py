"""Empty, one-row and two-equal-row tables through every aggregate (FIXTURES §4)."""

import pytest

from tessellate.operators import profile as PR
from tessellate.operators import stats as S
from tessellate.operators import transform as T

SCHEMA = "id long, a double, b double, g string"


@pytest.mark.parametrize("rows", [[], [(1, 2.0, 3.0, "x")], [(1, 2.0, 3.0, "x"), (2, 2.0, 3.0, "x")]])
def test_aggregates_on_tiny_tables(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    n = len(rows)
    d = {r.feature: r for r in S.describe(df, ["a", "b"]).collect()}
    assert d["a"]["count"] == n
    if n == 0:
        assert d["a"].mean is None and d["a"].p50 is None
    else:
        assert d["a"].mean == 2.0 and d["a"].p50 == 2.0 and d["a"].p25 == 2.0
        assert d["a"].std is None if n == 1 else d["a"].std == 0.0
    deep = {r.feature: r for r in S.feature_deepdive(df, ["a"]).collect()}
    assert deep["a"].n_outliers == 0
    assert S.duplicate_count(df, ["a", "b"]).first()[0] == max(n - 1, 0)
    corr = {(r.feature_1, r.feature_2): r.r for r in S.correlation_matrix(df, ["a", "b"]).collect()}
    assert corr[("a", "b")] is None
    hist = S.histogram(df, ["a"], 4).collect()
    assert sum(r["count"] for r in hist) == n
    assert S.quality_summary(df).first().n_rows == n
    vc = S.value_counts(df, "g", 5).collect()
    assert sum(r["count"] for r in vc) == n
    z, _ = T.scale(df, ["a", "b"], "standard")
    assert all(r.a == 0.0 for r in z.collect())
    prof = PR.cluster_profile(df.withColumnRenamed("id", "c"), "c", ["a"]).collect()
    assert len(prof) == n
    out, rep = T.winsorize(df, ["a"], 0.95)
    assert out.count() == n and rep.first().n_clipped == 0
