"""Toxicity by multiple-instance learning over sentences.

Only documents carry labels.  A document is a bag of sentences; a sentence has
the probability sigmoid(bias + sum of the weights of its distinct words), a
word's weight being the sum over its features: the word and its first 4 to 8
letters, so that stems count whatever their endings.  A document is toxic
unless every sentence is clean (noisy-or): 1 - prod(1 - p_s).  Bias and weights are fitted to document labels through
that product, so the sentence scores locate what made a document toxic.

Sentences that are each almost surely clean (without a weighted word, or with a
logit below ``WEAK``) add at most ``LEAK`` to -ln of a document's product when it
is scored, so that no number of them makes a document toxic.  The fit keeps the
whole sum, which holds such sentences down.

The fit takes a bounded sample of the labelled documents (``FIT_ROWS`` rows of
each label in the order of a hash of their id, a documented parameter); features
need ``MIN_DOCS`` documents of the sample.  Scoring covers every row and whole
texts, without a bound.

The bias stays at most ``MAX_BIAS``: a sentence without a weighted word is clean.

A text without sentences (null, empty, white space) scores 0.  Labels, ids and
other columns are never features.  With no labelled row of either label the
model has no weights and every text scores below 0.1.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import GenerationCache, release, slices, texts_to_python

FIT_ROWS = 3000
MIN_DOCS = 4
ROUNDS = 150
MAX_BIAS = -10.0
WEAK = -2.0
LEAK = 0.1
RATE = 0.2
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
WORD = re.compile(r"\w+")
STEMS = range(4, 9)
WORD_CACHE = 50_000


def features(word: str) -> list[str]:
    """The word itself and its beginnings (marked by a hyphen)."""
    return [word, *(word[:n] + "-" for n in STEMS if n <= len(word))]


def softplus(z: float) -> float:
    return math.log1p(math.exp(-abs(z))) + max(z, 0.0)


@dataclass
class SentenceModel:
    bias: float = MAX_BIAS
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.words = GenerationCache(lambda w: sum(self.weights.get(f, 0.0) for f in features(w)), WORD_CACHE)

    def __reduce__(self):
        return SentenceModel, (self.bias, self.weights)

    def logits(self, text: str) -> list[tuple[float, int, int]]:
        """(logit, start, end) of the sentences with a weighted word."""
        weight, out = self.words.__getitem__, []
        low = text.lower()
        same = len(low) == len(text)
        for m in SENTENCE.finditer(low if same else text):
            s = m.group() if same else m.group().lower()
            z = sum(map(weight, sorted(set(WORD.findall(s)))))
            if z:
                out.append((self.bias + z, m.start(), m.end()))
        return out

    def score(self, text: str) -> tuple[float, list[tuple[float, int, int]]]:
        """Noisy-or over all sentences of a text, and its sentences with a weighted word."""
        n = sum(1 for _ in SENTENCE.finditer(text))
        if not text.strip():
            return 0.0, []
        hits = self.logits(text)
        weak = (n - len(hits)) * softplus(self.bias) + sum(softplus(z) for z, _, _ in hits if z < WEAK)
        clean = min(weak, LEAK) + sum(softplus(z) for z, _, _ in hits if z >= WEAK)
        return -math.expm1(-clean), hits


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", per_label: int = FIT_ROWS) -> DataFrame:
    """(text, label) of at most ``per_label`` labelled documents of each label.
    The ids are chosen from the labels alone; only their texts are joined."""
    order = F.xxhash64(F.col("id"), F.lit(8))
    named = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
             .where("id is not null and label in (0, 1)").dropDuplicates(["id"]))
    chosen = None
    for value in (0, 1):  # per_label rows per value: a bounded broadcast
        part = named.where(F.col("label") == value).orderBy(order, "id").limit(per_label)
        chosen = part if chosen is None else chosen.union(part)
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return d.join(F.broadcast(chosen), "id").select("text", "label")


def fit(texts: list[str], labels: list[int], min_docs: int = MIN_DOCS, rounds: int = ROUNDS,
        shrink: float = 3e-4) -> SentenceModel:
    """Noisy-or likelihood by full-batch Adam with soft thresholding of the weights."""
    if not texts or min(labels) == max(labels):
        return SentenceModel()
    ids: dict[str, int] = {}
    word_of, sentence_of, bag_of = array("i"), array("i"), array("i")
    for k, text in enumerate(texts):
        for m in SENTENCE.finditer(text):
            words = {ids.setdefault(w, len(ids)) for w in WORD.findall(m.group().lower())}
            word_of.extend(words)
            sentence_of.extend([len(bag_of)] * len(words))
            bag_of.append(k)
    word_of, sentence_of, bag_of = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32)
                                    for x in (word_of, sentence_of, bag_of))
    docs_of = np.bincount(np.unique(bag_of[sentence_of].astype(np.int64) * max(len(ids), 1) + word_of) % max(len(ids), 1),
                          minlength=len(ids)).tolist()
    seen: Counter = Counter()
    for word, i in ids.items():
        for f in features(word):
            seen[f] += docs_of[i]
    vocab = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= min_docs))}
    if not vocab:
        return SentenceModel()
    del seen, docs_of
    of_word, of_feature = array("i"), array("i")
    for word, i in ids.items():
        known = [vocab[f] for f in features(word) if f in vocab]
        of_word.extend([i] * len(known))
        of_feature.extend(known)
    of_word, of_feature = np.frombuffer(of_word, np.int32), np.frombuffer(of_feature, np.int32)
    n_words, n = len(ids), len(bag_of)
    y = np.array(labels, np.float64)
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))  # both labels weigh the same
    w = np.zeros(len(vocab) + 1)
    w[-1] = MAX_BIAS
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        word = np.bincount(of_word, weights=w[of_feature], minlength=n_words)
        z = w[-1] + np.bincount(sentence_of, weights=word[word_of], minlength=n)
        clean = np.bincount(bag_of, weights=np.logaddexp(0.0, z), minlength=len(y))
        slope = np.where(y == 1, -1.0 / np.expm1(np.clip(clean, 1e-9, 500.0)), 1.0) * share
        d = slope[bag_of] / (1.0 + np.exp(-z))
        g = np.empty_like(w)
        of = np.bincount(word_of, weights=d[sentence_of], minlength=n_words)
        g[:-1] = np.bincount(of_feature, weights=of[of_word], minlength=len(vocab))
        g[-1] = d.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        rate = RATE * min(1.0, 2.0 * (1.0 - t / (rounds + 1)))
        scale = np.sqrt(v / (1 - 0.99 ** t)) + 1e-8
        w -= rate * (m / (1 - 0.9 ** t)) / scale
        w[-1] = min(w[-1], MAX_BIAS)
        pull = rate * shrink / scale[:-1]
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - np.minimum(pull, 1.0), 0.0)
    return SentenceModel(float(w[-1]), {f: float(w[i]) for f, i in vocab.items() if w[i] != 0.0})


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", per_label: int = FIT_ROWS) -> SentenceModel:
    """Model fitted on ``labelled_sample``; the bounded sample is all the driver sees."""
    rows = labelled_sample(docs, labels, id_col, text_col, label_col, per_label).collect()
    rows.sort(key=lambda r: (r["label"], r["text"]))
    return fit([r["text"] for r in rows], [r["label"] for r in rows])


def score(df: DataFrame, model: SentenceModel, id_col: str = "doc_id", text_col: str = "text",
          out_cols: tuple[str, str, str] = ("score", "worst_start", "worst_end")) -> DataFrame:
    """(id, score, worst_start, worst_end): every row's score and the span (code
    points) of its highest sentence with a weighted word, else nulls."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # words of the bounded sample
    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField(out_cols[0], T.DoubleType()),
              T.StructField(out_cols[1], T.LongType()), T.StructField(out_cols[2], T.LongType())]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        release()
        for batch in slices(batches):
            scores, starts, ends = [], [], []
            for t in batch.column(1):
                p, hits = m.score(t.as_py() or "")
                scores.append(p)
                best = max(hits, default=(None, None, None), key=lambda h: (h[0], -h[1]))
                starts.append(best[1])
                ends.append(best[2])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()),
                                              pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=schema.names)

    return texts_to_python(df, id_col, text_col).mapInArrow(run, schema)


def offending_sentences(df: DataFrame, model: SentenceModel, threshold: float = 0.5, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """(id, start, end, sentence, probability): every sentence at or above the threshold."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("start", T.LongType()),
                           T.StructField("end", T.LongType()), T.StructField("sentence", T.StringType()),
                           T.StructField("probability", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        release()
        for batch in slices(batches):
            at, rows = [], []
            for i, t in enumerate(batch.column(1)):
                text = t.as_py() or ""
                for z, a, b in m.logits(text):
                    p = 1.0 / (1.0 + math.exp(-z)) if z > -500 else 0.0
                    if p >= threshold:
                        at.append(i)
                        rows.append((a, b, text[a:b], p))
            if rows:
                a, b, s, p = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                     pa.array(s, pa.string()), pa.array(p, pa.float64())], names=schema.names)

    return texts_to_python(df, id_col, text_col).mapInArrow(run, schema)


def reject_toxic(docs: DataFrame, model: SentenceModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        release()
        for batch in slices(batches):
            yield batch.filter(pa.array([m.score(t.as_py() or "")[0] < threshold for t in batch.column(at)], pa.bool_()))

    return texts_to_python(docs).mapInArrow(clean, docs.schema)
