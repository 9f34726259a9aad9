"""Operators that pass over a derived table many times write it once."""

import numpy as np
import pytest

from tessellate.operators import hierarchy as H
from tessellate.sources import reports as RP


@pytest.fixture
def derived(spark):
    x = np.random.default_rng(6).normal(size=(120, 2)).tolist()
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(i, *v) for i, v in enumerate(x)], "id long, a double, b double")
    return df.mapInArrow(run, df.schema), seen


def test_insights_report_derives_its_table_once(derived):
    df, seen = derived
    rows = RP.insights_report(df, ["a", "b"], id_col="id").collect()
    assert seen.value == 120 and any(r["key"] == "rows" and r["value"] == "120" for r in rows)


def test_hierarchical_derives_its_table_once(derived):
    df, seen = derived
    labels, _ = H.hierarchical(df, ["a", "b"], 3, "id", n_micro=20)
    assert labels.count() == 120 and seen.value == 120
