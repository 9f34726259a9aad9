"""Join-shaped assignment operators.

* Centres (k rows) reach the rows as one scalar-subquery struct, so
  nearest-centre assignment is a narrow projection: k squared distances as
  scalar columns inside whole-stage codegen, ``least`` + first-equal for the
  argmin (ties -> lowest centre id).  No join, no shuffle.
* 1-NN against a labelled sample searches the sample's cells (``metric``): no
  side is collected or broadcast, whatever its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bounded_broadcast, present
from ..session import cut_lineage
from .metric import finite, k_nearest

_CEN = "_cen"
CENTRE_BLOCK = 512


def _sq_dist(xs: Sequence[Column], cs: Sequence[Column]) -> Column:
    terms = [(x - c) * (x - c) for x, c in zip(xs, cs)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def nearest_centroid(df: DataFrame, centres, features: Sequence[str], k: int | None = None,
                     cid: str = "cid", out: str = "cluster",
                     dist2_col: str | None = None) -> DataFrame:
    """Id of the nearest centre (squared Euclidean; ties -> lowest id).

    ``centres`` is a DataFrame (cid in 0..k-1, one column per feature) or a
    list of k coordinate lists.  A centre table is collected first - it has
    k rows by construction - so the centres enter the plan as literals and
    the k distance expressions stay small enough for whole-stage codegen."""
    xs = [F.col(f).cast("double") for f in features]
    if isinstance(centres, DataFrame):
        if k is None:
            raise ValueError("k is required with a centre DataFrame")
        got = {int(r[cid]): [r[f] for f in features]
               for r in centres.select(cid, *features).collect()}          # k rows
        missing = [j for j in range(k) if j not in got]
        if missing:
            raise ValueError(f"centre ids {missing} missing from the centre table")
        centres = [got[j] for j in range(k)]
    k = len(centres)
    d = df
    cen = [[F.lit(None if v is None else float(v)).cast("double") for v in row] for row in centres]
    dn = [f"__dist{j}" for j in range(k)]
    d = d.withColumns({dn[j]: _sq_dist(xs, cen[j]) for j in range(k)})
    md = F.col(dn[0]) if k == 1 else F.least(*[F.col(c) for c in dn])
    d = d.withColumn("__mind", md)
    arg = F.coalesce(*[F.when(F.col(dn[j]) == F.col("__mind"), F.lit(j)) for j in range(k)])
    d = d.withColumn(out, arg.cast("int"))
    if dist2_col:
        d = d.withColumn(dist2_col, F.col("__mind"))
    return d.drop(*dn, "__mind", *([_CEN] if _CEN in d.columns else []))


def label_join(df: DataFrame, labels: DataFrame, on: str, label_col: str,
               default_to_id: bool = False) -> DataFrame:
    """Id -> text lookup of a label table (k rows for cluster names);
    missing -> NULL (or id).  Broadcast after a size check, so the (possibly
    hot) cluster column is never shuffled for it."""
    j = df.join(bounded_broadcast(labels.select(on, label_col)), on, "left")
    if default_to_id:
        j = j.withColumn(label_col, F.coalesce(F.col(label_col), F.col(on).cast("string")))
    return j


def pairwise_centroids(centres: DataFrame, features: Sequence[str], cid: str = "cid"
                       ) -> DataFrame:
    """Euclidean distance between every ordered pair of the k centres.

    The centres are dealt to blocks of about ``CENTRE_BLOCK``; each meets every
    block in an equi-join on the block number, so k^2 pairs are spread over the
    tasks (density clustering can give many clusters)."""
    rows = cut_lineage(centres.select(F.col(cid).alias("id"), *[F.col(f).cast("double").alias(f) for f in features]))
    blocks = max(1, -(-rows.count() // CENTRE_BLOCK))
    a = rows.select(F.struct(*rows.columns).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    b = rows.select(F.struct(*rows.columns).alias("b"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    pairs = a.join(b, "block")
    d = F.sqrt(_sq_dist([F.col(f"a.{f}") for f in features], [F.col(f"b.{f}") for f in features]))
    return pairs.select(F.col("a.id").alias("cid_a"), F.col("b.id").alias("cid_b"),
                        d.alias("distance"))


def centroids_of(df: DataFrame, features: Sequence[str], label_col: str,
                 cid: str = "cid", noise: int | None = -1) -> DataFrame:
    """Mean of each labelled group (noise excluded): the centre table."""
    src = df if noise is None else df.where(F.col(label_col) != F.lit(noise))
    return src.groupBy(F.col(label_col).alias(cid)).agg(
        *[F.avg(F.col(f).cast("double")).alias(f) for f in features])


def assign_from_sample(df: DataFrame, sample: DataFrame, features: Sequence[str],
                       label_col: str, k: int, out: str = "cluster") -> DataFrame:
    """Centroids of the labelled sample, then nearest centroid for all rows.

    Labels must be 0..k-1."""
    cen = centroids_of(sample, features, label_col)
    return nearest_centroid(df, cen, features, k, out=out)


def attach_labels(df: DataFrame, labels: dict[str, DataFrame], id_col: str = "row_id"
                  ) -> DataFrame:
    """Add label columns keyed by row id (one join per labelling)."""
    out = df
    for name, lab in labels.items():
        out = out.join(lab.select(id_col, F.col(name)), id_col, "left")
    return out


# --------------------------------------------------------------------- J3
def propagate_nearest(df: DataFrame, sample: DataFrame, features: Sequence[str],
                      id_col: str, sample_id: str, label_col: str, tile_rows: int | None = None) -> DataFrame:
    """Exact 1-NN of every row among the labelled sample; returns
    (id_col, nn_id, nn_label, nn_dist).  Ties -> lowest sample id; an empty
    sample gives NULLs, as does a row with a null, NaN or infinite feature (such
    sample rows, and those without an id, are nobody's neighbour).  The sample is
    searched by cells (``metric``); it may have any size and stays off the driver."""
    fs = present(df, features)
    labelled = sample.withColumn(label_col, F.col(label_col).cast("int"))
    found, asked = k_nearest(df, labelled, fs, 1, id_col, sample_id, payload=label_col, tile_rows=tile_rows)
    near = found.select("row", F.col("id").alias("nn_id"), F.col("payload").alias("nn_label"), F.col("distance").alias("nn_dist"))
    known = asked.select("row", F.col("id").alias(id_col)).join(near, "row", "left").drop("row")
    nothing = df.where(~finite(fs)).select(id_col, *(F.lit(None).cast(known.schema[c].dataType).alias(c)
                                                     for c in ("nn_id", "nn_label", "nn_dist")))
    return known.unionByName(nothing)
