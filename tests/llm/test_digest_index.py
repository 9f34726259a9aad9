import hashlib
import re

from pyspark.sql import functions as F

from tessellate.llm.common import table
from tessellate.llm.digest_index import DigestIndex, deduplicate
from tests.conftest import SF_SMALL
from tests.llm import edge


def digest(text):
    return hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", text or "").encode()).hexdigest()


def test_edge_rows(spark):
    rows = DigestIndex(spark, buckets=4).absorb(edge.docs(spark)).collect()
    assert len(rows) == len(edge.DOCS)
    groups = {}
    for i, text, *_ in edge.DOCS:
        groups.setdefault(digest(text), []).append(i)
    for r in rows:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == min((i for i in ids if i is not None), default=None)
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len(groups) == len({r["text_sha256"] for r in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)
    assert DigestIndex(spark).absorb(edge.empty(spark)).count() == 0


def test_later_batches_meet_the_index(spark):
    docs = table(spark, SF_SMALL, "documents")
    index = DigestIndex(spark, buckets=4)
    first = index.absorb(docs.where("doc_id < 120")).where("kept").count()
    again = index.absorb(docs.where("doc_id < 120"))
    assert again.where("kept").count() == 0 and again.where("doc_id < keep_id").count() == 0
    second = index.absorb(docs.where("doc_id >= 120")).where("kept").count()
    whole = DigestIndex(spark, buckets=4).absorb(docs)
    assert first + second == whole.where("kept").count() == index.table().count() == index.table().distinct().count()
    taken_up = DigestIndex(spark, location=index.location, buckets=4)  # as a later session does
    assert taken_up.absorb(docs).where("kept").count() == 0


def test_index_is_joined_by_sort_merge_in_its_buckets(spark):
    index = DigestIndex(spark, buckets=4)
    index.absorb(table(spark, SF_SMALL, "documents"))
    plan = index.table().hint("merge").join(index.table(), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_deduplicate_keeps_columns_and_one_row_each(spark):
    docs = edge.docs(spark)
    out = deduplicate(docs, DigestIndex(spark, buckets=4))
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len({digest(r["text"]) for r in rows}) == len({digest(t[1]) for t in edge.DOCS})
    assert {r["doc_id"] for r in rows} == {1, 2, 4, 8, 9, 10, None}
    assert deduplicate(edge.empty(spark), DigestIndex(spark)).count() == 0


def test_hot_group(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(
        F.concat(F.lit("text "), "id")).alias("text"))
    rows = DigestIndex(spark).absorb(docs)
    assert rows.where("kept").count() == 1 + rows.where("doc_id % 3 != 0").count()
