"""The corpus pipeline: toxicity, exact deduplication, SimHash near-deduplication,
packing.  Each stage calls one operator of ``tessellate.llm`` over everything
its predecessor kept; all but the last return the columns of ``documents``.

Nulls, empty texts, repeated rows and empty tables are defined by the
operators: a null or empty text is clean (score 0), equal texts and
fingerprints keep the row of the smallest id, and every text that is left is
packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessellate.llm import covering_simhash, digest_index, hilbert_pack, mil_toxicity
from tessellate.llm.common import table, written
from tessellate.llm.queries import SEQUENCE_LENGTH, held_out


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model is fitted to the labels of the
    documents outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return mil_toxicity.reject_toxic(docs, mil_toxicity.train(docs, labels), threshold=0.5)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text."""
    return digest_index.deduplicate(docs, digest_index.DigestIndex(spark))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints within 3 bits, over 3-word shingles."""
    return covering_simhash.deduplicate(docs, shingle=3, radius=3)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids."""
    return hilbert_pack.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=SEQUENCE_LENGTH)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash_dedup", simhash_dedup), ("packing", packing)]

#: A fitted model, fingerprints and a tokenizer have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
