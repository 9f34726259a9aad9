"""Importance resampling of documents towards a target distribution.

A document is a bag of word n-grams hashed into buckets.  The corpus and the
target each give bucket counts; a bucket's gain is the log ratio of its smoothed
shares, a document's weight the sum of the gains of its n-grams.  Adding Gumbel
noise (a fixed function of the id) to the weights and keeping the highest sums
draws without replacement in proportion to the importance weights.

Words and n-grams are made by Arrow kernels over a block of texts:
``ascii_lower`` and ``split_pattern_regex`` cut the texts, ``list_flatten`` lays
their words end to end and ``dictionary_encode`` numbers them.  Word numbers
shifted by one place give pairs, pairs and words give triples, each numbered by
``dictionary_encode`` again.  CRC-32 is computed once per distinct word, pair
and triple: that of a joined pair follows from the CRCs of its halves (the CRC
is linear in its register), so no n-gram is ever written out.  ``take`` brings
buckets and gains back to the places in the texts, and a segment sum over each
document's places gives its weight.

Both counts and weights cover all rows and whole texts.  Counting leaves one
row of counters per task (bounded by the number of buckets); the gains, one
integer per bucket, go to every task.  The draw is a place in a range sort of
(score, id), so no task holds the candidates.

A null or empty text has no n-gram, weight 0 and is not drawn (it has fewer
words than ``min_words``, unless that is 0).  Rows with a null id get the noise
of the text ``<seed>:`` and lie behind other ids among ties; repeated rows are
drawn each.  Other columns are not read.  No rows give no rows.  A block holds
at most ``BLOCK_BYTES`` of text or one row; arrays of a block are a small
multiple of its text.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, texts_to_python, written
from .ordered import numbered

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
BLOCK_BYTES = 2 << 20
#: Everything but ASCII digits, ASCII lower-case letters and characters beyond ASCII.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _step_tables() -> np.ndarray:
    """Effect on the CRC register of one zero byte, per register byte (4 x 256)."""
    low = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        low = (low >> 1) ^ np.where(low & 1, np.uint32(0xEDB88320), np.uint32(0))
    return np.stack([low, *(np.arange(256, dtype=np.uint32) << np.uint32(8 * k - 8) for k in (1, 2, 3))])


def apply(tables: np.ndarray, registers: np.ndarray) -> np.ndarray:
    """A linear map of registers given as a table per register byte."""
    return (tables[0][registers & 255] ^ tables[1][(registers >> 8) & 255]
            ^ tables[2][(registers >> 16) & 255] ^ tables[3][registers >> 24])


@functools.lru_cache(maxsize=4096)
def skip_tables(n: int) -> np.ndarray:
    """Effect on a CRC of ``n`` further zero bytes: powers of the step of one."""
    if n == 1:
        return _step_tables()
    half = skip_tables(n // 2)
    twice = np.stack([apply(half, t) for t in half])
    return np.stack([apply(skip_tables(1), t) for t in twice]) if n % 2 else twice


def crc_joined(first: np.ndarray, second: np.ndarray, second_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 of first + second from their CRCs and the length of second."""
    out = np.empty_like(first)
    order = np.argsort(second_bytes, kind="stable")
    lengths, starts = np.unique(second_bytes[order], return_index=True)
    for n, at in zip(lengths.tolist(), np.split(order, starts[1:])):
        out[at] = apply(skip_tables(n), first[at])
    return out ^ second


class Ngrams:
    """The n-grams of a block of texts: per length up to ``longest``, the bucket
    of each distinct n-gram, the number of the n-gram at each place, and per
    text its span of places."""

    def __init__(self, texts: pa.Array, buckets: int, longest: int = LONGEST):
        lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), SEPARATOR)
        words, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
        real = pc.greater(pc.binary_length(words), 0)  # a text that starts or ends with a separator
        words, owner = words.filter(real), owner.filter(real).to_numpy()
        self.n_words = np.bincount(owner, minlength=len(texts))
        ends = np.cumsum(self.n_words)
        coded = words.dictionary_encode()
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        raw = [w.encode() for w in coded.dictionary.to_pylist()]
        crc_of_word = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
        led = np.fromiter((zlib.crc32(b" " + w) for w in raw), np.uint32, len(raw))
        led_bytes = np.fromiter((len(w) + 1 for w in raw), np.int64, len(raw))
        crc, place = crc_of_word, word
        self.bucket = [crc % buckets]
        self.place = [place]
        self.spans = [(ends - self.n_words, ends)]
        begins = np.zeros(len(word), bool)
        begins[(ends - self.n_words)[self.n_words > 0]] = True  # first words of texts
        inside = np.ones(len(word), bool)
        for n in range(2, longest + 1):
            last = np.roll(word, 1 - n)
            inside &= ~np.roll(begins, 1 - n)
            inside[max(len(word) - n + 1, 0):] = False
            size = max(len(raw), 1)
            pairs = pa.array(place * size + last, mask=~inside).dictionary_encode()
            distinct = pairs.dictionary.to_numpy(zero_copy_only=False).astype(np.int64)
            head, tail = distinct // size, distinct % size
            crc = crc_joined(crc[head], led[tail], led_bytes[tail])
            place = pc.fill_null(pairs.indices, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            count = np.maximum(self.n_words - n + 1, 0)
            stop = np.cumsum(count)
            self.bucket.append(crc % buckets)
            self.place.append(place[inside])
            self.spans.append((stop - count, stop))

    def counts(self, buckets: int) -> np.ndarray:
        """How often each bucket occurs."""
        out = np.zeros(buckets)
        for bucket, place in zip(self.bucket, self.place):
            out += np.bincount(bucket, weights=np.bincount(place, minlength=len(bucket)), minlength=buckets)
        return out.astype(np.int64)

    def n_features(self) -> np.ndarray:
        return sum(stop - start for start, stop in self.spans)

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """Per text the sum of the gains of its n-grams."""
        total = np.zeros(len(self.n_words), np.int64)
        for bucket, place, (start, stop) in zip(self.bucket, self.place, self.spans):
            along = np.concatenate([[0], np.cumsum(gains[bucket].take(place))])
            total += along[stop] - along[start]
        return total


def blocks(batches, column: int) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that a piece has ``BLOCK_BYTES`` of text or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at, used = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if used and used + n > BLOCK_BYTES:
                yield batch.slice(at, i - at)
                at, used = i, 0
            used += n
        yield batch.slice(at)


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n): occurrences of n-grams by bucket over all rows (absent: none)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros(buckets, np.int64)
        for block in blocks(batches, 0):
            total += Ngrams(block.column(0), buckets, longest).counts(buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    return texts_to_python(df, text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket from (bucket, n) counts of corpus and target: the
    floor of 1000 ln of the ratio of shares, with one added to each bucket."""
    def vector(df):
        out = np.zeros(buckets, np.float64)  # one row per bucket at most
        for r in df.collect():
            out[r["bucket"]] = r["n"]
        return out

    s, t = vector(corpus), vector(target)
    ratio = ((t + 1.0) * (s.sum() + buckets)) / ((s + 1.0) * (t.sum() + buckets))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def importance(df: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
               longest: int = LONGEST) -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(gains)  # one integer per bucket
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType),
                           *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for block in blocks(batches, 1):
            grams = Ngrams(block.column(1), len(shared.value), longest)
            yield pa.RecordBatch.from_arrays(
                [block.column(0), *(pa.array(x, pa.int64()) for x in (grams.n_words, grams.n_features(), grams.sums(shared.value)))],
                names=schema.names)

    return texts_to_python(df, id_col, text_col).mapInArrow(weigh, schema)


def gumbel_noise(id_col: str, seed: int):
    """Floor of 1000 times the Gumbel variate of an id: a fixed function of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(-1000.0 * F.ln(-F.ln((h.cast("double") + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text", seed: int = 42, buckets: int = BUCKETS, longest: int = LONGEST,
             min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_features, weight, score, rank.

    Of the rows of at least ``min_words`` words, ``percent`` in a hundred
    (rounded down) are drawn: rank 1, 2, ... by falling score, ties by id; the
    others have no rank."""
    gains = bucket_gains(bucket_counts(docs, text_col, buckets, longest),
                         bucket_counts(target, target_text_col, buckets, longest), buckets)
    scored = written(importance(docs, gains, id_col, text_col, longest)
                     .withColumns({"score": F.col("weight") + gumbel_noise(id_col, seed),
                                   "out": F.col("n_words") < min_words, "row": F.monotonically_increasing_id()}),
                     "resample-scores")
    placed = numbered(scored, ["out"], [F.col("score").desc(), F.col(id_col).asc_nulls_last(), "row"], "resample-order")
    rank = F.expr(f"CASE WHEN NOT out AND pos < n * {int(percent)} div 100 THEN pos + 1 END AS rank")
    return placed.select(id_col, "n_words", "n_features", "weight", "score", rank)


def drawn_rows(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id was drawn, with their columns."""
    return docs.join(ranks.where("rank is not null").select(F.col(id_col).alias("drawn_")).distinct(),
                     F.col(id_col) == F.col("drawn_"), "left_semi")


def oracle_sql(percent: int, seed: int = 42, buckets: int = BUCKETS, min_words: int = MIN_WORDS) -> str:
    """DuckDB SQL of the registered query.  CRC-32 runs over the bytes of each
    distinct n-gram with the usual table of 256 registers, itself made by rule."""
    def grams(source: str, key: str) -> str:
        return f"""SELECT {key} AS id, len(ws) AS n_words, list_concat(ws,
    list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
    list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS grams
  FROM (SELECT {key}, list_filter(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS ws FROM {source})"""

    return f"""WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(
    [i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
d AS MATERIALIZED ({grams("documents", "doc_id")}),
b AS MATERIALIZED ({grams("benchmark", "item_id")}),
dg AS MATERIALIZED (SELECT id, unnest(grams) AS gram FROM d),
bg AS MATERIALIZED (SELECT unnest(grams) AS gram FROM b),
codes AS MATERIALIZED (SELECT gram, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
    list_transform(range(0, strlen(gram)), lambda i: ('0x' || substr(hex(encode(gram)), 2 * i + 1, 2))::BIGINT)),
    lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % {buckets} AS bucket
  FROM (SELECT gram FROM dg UNION SELECT gram FROM bg), tab),
s AS (SELECT bucket, count(*) AS s FROM dg JOIN codes USING (gram) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bg JOIN codes USING (gram) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {buckets})::DOUBLE)
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {buckets})::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT range AS bucket FROM range({buckets})) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT id, CAST(sum(gain) AS BIGINT) AS weight FROM dg JOIN codes USING (gram) JOIN gains USING (bucket) GROUP BY id),
scored AS (SELECT d.id AS doc_id, n_words, CAST(len(grams) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || left(sha256('{seed}:' || d.id), 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN w USING (id)),
places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scored WHERE n_words >= {min_words})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {percent} * n // 100 THEN place END AS rank
FROM scored LEFT JOIN places USING (doc_id)"""
