"""Distances to the pivots are held in blocks, whatever the batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tessellate.operators import metric as M


class Rows:
    """A frame of two columns whose Python kernel is called here."""

    def __init__(self, schema):
        self.schema, self.columns = schema, [f.name for f in schema]

    def mapInArrow(self, run, schema):
        return run


def test_homes_and_bounds_hold_no_matrix_of_all_pivots():
    from pyspark.sql import types as T
    rng = np.random.default_rng(1)
    points = rng.normal(size=(2048, 2))
    pivots = M.Pivots(points, points.mean(axis=0))
    x = rng.normal(size=(6000, 2))
    run = M.homes(Rows(T.StructType([T.StructField("row", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])), pivots, 2)
    batch = pa.RecordBatch.from_arrays([pa.array(range(6000)), pa.array(x.tolist())], names=["row", "x"])
    tracemalloc.start()
    (out,) = run([batch])
    low = pivots.bounds(x[:200], np.zeros(2048), np.full(2048, 0.1))[1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = ((x[:, None] - points[None]) ** 2).sum(axis=2)
    assert (out.column(2).to_numpy() == want.argmin(axis=1)).all() and low.shape == (200, 2048)
    assert np.allclose(out.column(3).to_numpy(), np.sqrt(want.min(axis=1)))
    assert peak < 40 << 20  # 6,000 x 2,048 distances alone are 94 MB
