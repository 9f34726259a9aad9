"""The query of each operator, over its whole table, with production parameters."""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe_replay, compression_quality, covering_simhash, digest_index, hilbert_pack, host_suffix,
               importance_resample, license_scan, merkle_manifest, mil_toxicity, multi_index,
               reshard, token_prefix)
from .common import per_worker, slices, table, texts_to_python

QUERIES = {}
ORACLES = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


TOKEN_LIMIT = 1024


@register("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, whether it exceeds the limit, and the
    longest prefix (code points) that stays within it."""
    counts = token_prefix.prefix_token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        budgets=(TOKEN_LIMIT,), keep_table=False)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
                         F.col(f"fit_{TOKEN_LIMIT}").alias("fit_chars"))


@register("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    vocabulary = spark.sparkContext.broadcast(bpe_replay.tokenizer_data(path, public_tokenizers.PATTERN))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = per_worker(bpe_replay.MergeReplay, vocabulary.value)
        decimal = list(map(str, range(max(replay.bytes_of) + 1)))
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, ids_hash, text_hash = [], [], []
            for ids in replay.encode(texts):
                numbers = np.frombuffer(ids, "<u4").tolist()
                n.append(len(numbers))
                ids_hash.append(hashlib.sha256(" ".join(map(decimal.__getitem__, numbers)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(replay.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return (texts_to_python(table(spark, sf_dir, "documents"), "doc_id", "text")
            .mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))


@register("op2_digest_index", """
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256
      FROM documents)
WINDOW w AS (PARTITION BY text_sha256)""")
def op2_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents absorbed into a new digest index."""
    return digest_index.DigestIndex(spark).absorb(table(spark, sf_dir, "documents"))


@register("op9_covering_simhash")
def op9_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    groups = covering_simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", covering_simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


SEQUENCE_LENGTH = 2048


@register("op10_hilbert_pack")
def op10_hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of the packed documents, its ids as a checksum."""
    pieces = hilbert_pack.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                               end_id=1, length=SEQUENCE_LENGTH)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


@register("op3_multi_index")
def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.9 or more."""
    found = multi_index.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: The table has no paths; files are laid out by source, language and blocks of 64 ids.
DOCUMENT_PATH = "concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), CAST(floor(doc_id / 64) AS BIGINT), concat(doc_id, '.txt'))"


@register("op4_license_scan", license_scan.oracle_sql(DOCUMENT_PATH, "line_no = 0"))
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated or inherited licence of every document.  A document that opens
    with a licence statement stands as the licence file of its directory."""
    docs = table(spark, sf_dir, "documents").withColumn("path", F.expr(DOCUMENT_PATH))
    return license_scan.license_scan(docs, licence_file=lambda rows: F.col("line_no") == 0)


OLD_SHARDS, NEW_SHARDS = 12, 16


@register("op5_flow_reshard")
def op5_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents moved from 12 hashed shards to 16 of equal bytes."""
    rows = reshard.sized_rows(table(spark, sf_dir, "documents"), OLD_SHARDS)
    placed = reshard.reshard(rows, NEW_SHARDS)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "old_shard")


@register("op6_host_suffix")
def op6_host_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return host_suffix.extract_main_text(table(spark, sf_dir, "pages"))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


@register("op8_mil_toxicity")
def op8_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model fitted without the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = mil_toxicity.train(docs, labels.where(~held_out()))
    scored = mil_toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_start", "worst_end")


LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@register("op11_merkle_manifest", merkle_manifest.oracle_sql(LEAF_FIELDS))
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and what its proof says of the
    document presented: a third of them with their text lower-cased."""
    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    presented = merkle_manifest.leaf_digest([F.when(changed, lower).otherwise(F.col("text")) if c == "text" else F.col(c)
                                             for c in LEAF_FIELDS])
    found = merkle_manifest.manifest(docs, LEAF_FIELDS, carry={"presented": F.when(changed, presented)})
    folded = found.withColumn("folded_root", merkle_manifest.fold(F.coalesce("presented", "leaf"), "steps"))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle_manifest.siblings_digest("steps").alias("proof_sha256"),
                         "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


DRAW_PERCENT = 5


@register("op13_importance_resample", importance_resample.oracle_sql(DRAW_PERCENT))
def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document drawn towards the benchmark."""
    return importance_resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                        DRAW_PERCENT).select("doc_id", "n_features", "weight", "score", "rank")


@register("op12_compression_quality")
def op12_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by dictionaries built without the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = compression_quality.train(docs, labels.where(~held_out()))
    scored = compression_quality.score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))
