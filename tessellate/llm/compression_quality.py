"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled
text.  A text is cut into windows of ``WINDOW`` bytes and every window is
compressed with either dictionary on its own, so that the dictionary, not the
text before it, decides the size.  The two sizes, summed over all windows of
the whole text, give the difference per byte (how much better the good
dictionary explains the text) and the mean size per byte (text that repeats
itself is small under any dictionary).  A logistic calibration turns these into
the probability of label 1; both weigh as ``n / (n + SHRINK)`` for a text of n
bytes, so a short text stays near what its length alone says.

The fit sees a bounded sample: ``FIT_ROWS`` labelled rows of each label, in the
order of a hash of the id.  Dictionaries are built from ``PIECES`` windows
spread over each of two thirds of these texts; the sizes of the remaining third
are summed on the executors over their whole texts, and only these numbers come
to the driver for the calibration.  Its rows weigh as the labels they stand for,
so scores are probabilities at the labelled rows' own share of label 1.
Scoring covers every row and whole texts.

A null or empty text has no windows: its score is that of length zero.  Labels,
ids and other columns are never features.  Without labelled rows of either
label there are no dictionaries, and every text scores the share of label 1
(0.5 without any label).  Repeated rows score each; labels count once an id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, slices, texts_to_python
from .mil_toxicity import labelled_sample

FIT_ROWS = 3000
PIECES = 24
WINDOW = 128
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
SHRINK = 64.0
RIDGE = 3e-5


def dictionary(pieces: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of the pieces; too few to train on are taken as they are."""
    try:
        return zstandard.train_dictionary(size, pieces, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:] or b"\n" * 8


def spread(data: bytes, pieces: int = PIECES, length: int = WINDOW) -> list[bytes]:
    """At most ``pieces`` pieces at even distances over the whole text."""
    n = min(pieces, -(-len(data) // length))
    return [data[at:at + length] for at in (len(data) * i // n for i in range(n))]


@dataclass
class CompressionModel:
    """Dictionaries and calibration; without dictionaries a constant score."""
    good: bytes = b""
    bad: bytes = b""
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def __post_init__(self):
        self.sizers = None
        if self.good and self.bad:
            self.sizers = [self._sizer(d) for d in (self.good, self.bad)]

    def __reduce__(self):
        return CompressionModel, (self.good, self.bad, self.weights)

    @staticmethod
    def _sizer(content: bytes):
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=WINDOW, dict_size=len(content), format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            write_content_size=False, write_dict_id=False)
        made = zstandard.ZstdCompressionDict(content)
        made.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=made, compression_params=params).compress

    def sizes(self, data: bytes) -> tuple[int, int]:
        """Compressed bytes of all windows under the good and the bad dictionary."""
        windows = [data[at:at + WINDOW] for at in range(0, len(data), WINDOW)]
        good, bad = self.sizers
        return sum(map(len, map(good, windows))), sum(map(len, map(bad, windows)))

    def evidence(self, data: bytes) -> tuple[float, float, float]:
        """Weight of the length, weighted difference and weighted mean size per byte."""
        if not data:
            return 0.0, 0.0, 0.0
        a, b = self.sizes(data)
        n = len(data)
        share = n / (n + SHRINK)
        return share, share * 20.0 * (b - a) / n, share * (a + b) / n

    def score(self, data: bytes) -> float:
        z = self.weights[0]
        if self.sizers:
            z += sum(w * x for w, x in zip(self.weights[1:], self.evidence(data)))
        return 1.0 / (1.0 + math.exp(-min(max(z, -500.0), 500.0)))


def logit(p: float) -> float:
    return math.log(p / (1.0 - p))


def calibrate(evidence: np.ndarray, labels: np.ndarray, row_weight: np.ndarray, ridge: float = RIDGE) -> tuple[float, ...]:
    """Weights of a logistic regression by Newton steps (intercept first, not shrunk)."""
    x = np.column_stack([np.ones(len(evidence)), evidence])
    w = row_weight / row_weight.sum()
    base = min(max(float(w @ labels), 1e-3), 1 - 1e-3)
    beta = np.zeros(x.shape[1])
    beta[0] = logit(base)
    pull = np.full(x.shape[1], ridge)
    pull[0] = 1e-6

    def loss(b):
        z = x @ b
        return float(w @ (np.logaddexp(0.0, z) - labels * z)) + 0.5 * float(pull @ (b * b))

    for _ in range(100):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -500, 500)))
        slope = x.T @ (w * (p - labels)) + pull * beta
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(pull), slope)
        size = 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-10:
            break
    return tuple(map(float, beta))


def sample_pieces(sample: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """Pieces of the bad and of the good texts of a sample (text, label), sorted."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches):
            label, pieces = [], []
            for t, y in zip(batch.column(0), batch.column(1).to_pylist()):
                found = spread((t.as_py() or "").encode())
                pieces += found
                label += [y] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(pieces, pa.binary())], names=["label", "piece"])

    rows = texts_to_python(sample, "text", "label").mapInArrow(cut, "label int, piece binary").collect()
    return tuple(sorted(bytes(r["piece"]) for r in rows if r["label"] == y) for y in (0, 1))


def sample_evidence(sample: DataFrame, model: CompressionModel) -> tuple[np.ndarray, np.ndarray]:
    """Evidence and labels of a sample's whole texts."""
    shared = sample.sparkSession.sparkContext.broadcast(model)  # two dictionaries

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches):
            found = [shared.value.evidence((t.as_py() or "").encode()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), *(pa.array([f[k] for f in found], pa.float64()) for k in range(3))], names=["label", "e0", "e1", "e2"])

    rows = texts_to_python(sample, "text", "label").mapInArrow(measure, "label int, e0 double, e1 double, e2 double").collect()
    rows = sorted(tuple(r) for r in rows)
    return np.array([r[1:] for r in rows]).reshape(len(rows), 3), np.array([r[0] for r in rows], np.float64)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", per_label: int = FIT_ROWS) -> CompressionModel:
    """Dictionaries and calibration from a bounded sample of the labelled rows."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
             .where("id is not null and label in (0, 1)").dropDuplicates(["id"]))
    total = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit(12)), F.lit(3)) == 0
    for_words = labelled_sample(docs, labels.where(~part), id_col, text_col, label_col, per_label * 2 // 3)
    for_scale = labelled_sample(docs, labels.where(part), id_col, text_col, label_col, per_label // 3)
    base = total.get(1, 0) / sum(total.values()) if total else 0.5
    constant = CompressionModel(weights=(logit(min(max(base, 1e-3), 1 - 1e-3)), 0.0, 0.0, 0.0))
    bad, good = sample_pieces(for_words)
    if not bad or not good:
        return constant
    model = CompressionModel(dictionary(good), dictionary(bad))
    evidence, y = sample_evidence(for_scale, model)
    if len(y) == 0 or y.min() == y.max():
        evidence, y = sample_evidence(for_words, model)
    stands_for = np.where(y == 1, total[1] / max((y == 1).sum(), 1), total[0] / max((y == 0).sum(), 1))
    return CompressionModel(model.good, model.bad, calibrate(evidence, y, stands_for))


def score(df: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text",
          out_col: str = "score") -> DataFrame:
    """(id, score): every row's probability of label 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches):
            found = [shared.value.score((t.as_py() or "").encode()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=schema.names)

    return texts_to_python(df, id_col, text_col).mapInArrow(run, schema)
