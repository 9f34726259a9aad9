"""Connected components by minimum labels with pointer jumping, on DataFrames.

Rounds run until no label changes (no cap).  Every round's labels are a
written table in the shared folder; the joins read written tables on both
sides, so AQE can split the partition of a hub vertex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for each node of ``edges``; component is the smallest
    node reachable.  Self loops are allowed, null ends are ignored; no edges
    give no rows."""
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    e = written(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = written(e.groupBy(F.col("u").alias("node"))
                     .agg(F.min("v").alias("m"))
                     .select("node", F.least("node", "m").alias("component")), "cc-labels")
    while True:
        near = (e.join(labels.hint("merge"), e["v"] == labels["node"])
                .groupBy(F.col("u").alias("n")).agg(F.min("component").alias("m")))
        lower = written(labels.join(near.hint("merge"), labels["node"] == near["n"])
                        .select("node", F.least("component", "m").alias("component"),
                                F.col("component").alias("was")), "cc-lower")
        up = lower.select(F.col("node").alias("p"), F.col("component").alias("top"))
        after = written(lower.join(up.hint("merge"), lower["component"] == up["p"])
                        .select("node", F.col("top").alias("component"),
                                (F.col("top") != F.col("was")).alias("moved")), "cc-labels")
        moved = after.where("moved").limit(1).count()
        discard(lower)
        discard(labels)
        labels = after.select("node", "component")
        if not moved:
            discard(e)
            return labels
