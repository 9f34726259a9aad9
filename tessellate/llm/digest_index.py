"""Exact deduplication against a persistent index of text digests.

The index is a table bucketed and sorted by digest.  A batch of documents is
reduced to one row per digest (pre-aggregated before its shuffle), those rows
are anti-joined with the index by sort-merge, bucket against bucket, and the
new ones are appended.  Every document then gets the decision of its digest.

Texts are equal when identical after each run of ASCII white space has become
one space; null counts as empty.  Of equal texts the row of the smallest id
stays (a null id only if there is no other); of repeated rows of that id, one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import located, only, text_or_empty, written


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_or_empty(text), "[\\x20\\x09-\\x0D]+", " ")


def text_digest(text: str | Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(normalised(text).cast("binary"), 256)


class DigestIndex:
    """Persistent table (digest, keep_id) in ``buckets`` buckets sorted by digest.
    A location written by an earlier session is taken up again."""

    def __init__(self, spark: SparkSession, id_type: str = "long", location: str | None = None, buckets: int = 64):
        self.spark = spark
        self.location = location or scratch_path(spark, "digest-index")
        self.name = f"digest_index_{uuid.uuid4().hex[:12]}"
        spark.sql(f"CREATE TABLE {self.name} (digest STRING, keep_id {id_type}) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.location}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def absorb(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
        """Decide over a batch and append its new digests.  One row per row of
        ``docs``: id, keep_id, group_size (rows of the batch with that text,
        plus one when an earlier batch holds it), kept, text_sha256, and the
        columns ``carry`` of ``docs``; of repeated rows of an id the first by them stays."""
        carried = [f"carried_{i}" for i in range(len(carry))]
        rows = written(docs.select(F.col(id_col).alias("id"), text_digest(text_col).alias("digest"),
                                   F.monotonically_increasing_id().alias("row_no"),
                                   *(F.col(c).alias(n) for c, n in zip(carry, carried))), "digests")
        groups = rows.groupBy("digest").agg(
            F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", *carried, "row_no")).alias("first"),
            F.count(F.lit(1)).alias("n"))
        batch = written(groups.select("digest", "n", F.col("first.id").alias("first_id"),
                                      F.col("first.row_no").alias("first_row")), "digest-groups")
        new = batch.hint("merge").join(self.table(), "digest", "left_anti")
        known = written(batch.join(self.table().hint("merge").withColumn("known", F.lit(True)), "digest", "left")
                        .select("digest", "n", "first_id", "first_row", "keep_id",
                                F.coalesce("known", F.lit(False)).alias("known")), "digest-known")
        new.select("digest", F.col("first_id").alias("keep_id")).write.insertInto(self.name)
        d = rows.hint("merge").join(known, "digest")
        keep = F.when(F.col("known"), F.col("keep_id")).otherwise(F.col("first_id"))
        return d.select(
            F.col("id").alias(id_col), keep.alias("keep_id"),
            (F.col("n") + F.col("known").cast("long")).alias("group_size"),
            (~F.col("known") & (F.col("row_no") == F.col("first_row"))).alias("kept"),
            F.col("digest").alias("text_sha256"), *(F.col(n).alias(c) for c, n in zip(carry, carried)))


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns.  Texts are read for
    their digests, decided on by the rows' names and moved once."""
    rows, names = located(docs)
    kept = index.absorb(rows, id_col, text_col, carry=names).where("kept")
    return only(rows, names, kept)
