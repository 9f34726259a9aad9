"""Stateless scoring of arriving rows.

The reference has no stream.  The fitted artefacts of a batch run - scaling
parameters, k centres, cluster names - are small literals, and every
per-row operator that uses them (keyword family, decade, log1p, z-score,
nearest centre, label lookup) is a column expression.  So the same scoring
runs unchanged on a Structured Streaming DataFrame: no state, no watermark,
no shuffle.  This module only packages that; it adds no streaming operator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.assign import nearest_centroid


class FittedScorer:
    """Literal model: per-feature (mean, std), k centres in scaled space and
    an optional cluster -> name map."""

    def __init__(self, features: Sequence[str], means: Sequence[float], stds: Sequence[float],
                 centres: Sequence[Sequence[float]], names: dict[int, str] | None = None):
        self.features = list(features)
        self.means = [float(m) for m in means]
        self.stds = [float(s) for s in stds]
        self.centres = [[float(v) for v in c] for c in centres]
        self.names = dict(names or {})

    @classmethod
    def from_batch(cls, params: DataFrame, centres: DataFrame, features: Sequence[str],
                   names: DataFrame | None = None) -> FittedScorer:
        """From the one-row scaling parameters, the k-row centre table and the
        k-row name table of a batch fit (all bounded by k / #features)."""
        p = params.first()
        rows = {int(r["cid"]): [r[f] for f in features] for r in centres.collect()}
        nm = {int(r["cluster"]): r["cluster_label"] for r in names.collect()} if names is not None else {}
        return cls(features, [p[f"{f}__mean"] for f in features], [p[f"{f}__std"] for f in features],
                   [rows[j] for j in sorted(rows)], nm)

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``cluster`` (and ``cluster_label``) to a batch or streaming frame."""
        z = df.withColumns({
            f"_z_{f}": F.lit(0.0) if s == 0 else (F.col(f).cast("double") - F.lit(m)) / F.lit(s)
            for f, m, s in zip(self.features, self.means, self.stds)})
        out = nearest_centroid(z, self.centres, [f"_z_{f}" for f in self.features], out="cluster")
        if self.names:
            mapping = F.create_map(*[x for k, v in sorted(self.names.items())
                                     for x in (F.lit(k), F.lit(v))])
            out = out.withColumn("cluster_label", mapping[F.col("cluster")])
        return out.drop(*[f"_z_{f}" for f in self.features])


def score_stream(stream: DataFrame, scorer: FittedScorer) -> DataFrame:
    """Apply a fitted scorer to a streaming DataFrame (append mode friendly)."""
    return scorer.score(stream)
