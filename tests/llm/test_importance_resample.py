import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessellate.llm import importance_resample as ir
from tests.llm import edge

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_features(text, longest=3):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain_resample(docs, target, percent, buckets=10_000, seed=42, min_words=20):
    """docs: [(id, text)] -> {id: (n_features, weight, score, rank)}, n-gram by n-gram."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in plain_features(t)[1])
    t = Counter(bucket(f) for x in target for f in plain_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows, able = {}, []
    for i, x in docs:
        words, grams = plain_features(x)
        weight = sum(gain[bucket(f)] for f in grams)
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows[i] = [len(grams), weight, score, None]
        if len(words) >= min_words:
            able.append((-score, i))
    for rank, (_, i) in enumerate(sorted(able)[:percent * len(able) // 100], 1):
        rows[i][3] = rank
    return {i: tuple(r) for i, r in rows.items()}


def test_crc_of_a_joined_text():
    rng = random.Random(3)
    pairs = [(rng.randbytes(rng.randrange(9)), rng.randbytes(rng.choice([1, 2, 3, 7, 64, 1000, 65537]))) for _ in range(300)]
    crc = lambda parts: np.array([zlib.crc32(p) for p in parts], np.uint32)
    got = ir.crc_joined(crc([a for a, _ in pairs]), crc([b for _, b in pairs]), np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_ngrams_against_plain_loops():
    rng = random.Random(4)
    letters = "aAzZ09 é日😀\x00\x7f'`{/:@[\n\t \u0085"
    texts = ["", " ", "one", "one two", "One-two THREE", "x" * 70_000 + " y z", None,
             *("".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(400))]
    grams = ir.Ngrams(pa.array(texts), 10_000)
    gains = np.array([rng.randrange(-5000, 5000) for _ in range(10_000)])
    found = [plain_features(t) for t in texts]
    assert grams.n_words.tolist() == [len(w) for w, _ in found]
    assert grams.n_features().tolist() == [len(f) for _, f in found]
    assert grams.sums(gains).tolist() == [sum(int(gains[zlib.crc32(f.encode()) % 10_000]) for f in fs) for _, fs in found]
    counts = Counter(zlib.crc32(f.encode()) % 10_000 for _, fs in found for f in fs)
    assert dict(enumerate(grams.counts(10_000).tolist())) == {b: counts[b] for b in range(10_000)}
    for longest in (1, 2, 5):
        g = ir.Ngrams(pa.array(texts), 97, longest)
        assert g.n_features().tolist() == [len(plain_features(t, longest)[1]) for t in texts]
        assert g.counts(97).sum() == sum(len(plain_features(t, longest)[1]) for t in texts)
    assert ir.Ngrams(pa.array([], pa.string()), 97).counts(97).sum() == 0


def test_blocks_hold_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 3 << 20, 0, 1 << 20, 1 << 20, 1)] + [None])], ["t"])
    assert [b.num_rows for b in ir.blocks([batch], 0)] == [1, 1, 3, 2]
    assert [x for b in ir.blocks([batch], 0) for x in b.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert sum(b.num_rows for b in ir.blocks([batch.slice(0, 0)], 0)) == 0


@pytest.mark.parametrize("percent, same_share", [(5, 0), (50, 0), (100, 0.4)])
def test_draw_against_plain_loops(spark, percent, same_share):
    """A third of the documents can be one text: their weights tie, the noise of the ids decides."""
    rng = random.Random(percent)
    words = [a + b for a in "ba de gi mo ru é 日".split() for b in "lan ter vos nik".split()]
    text = lambda n: " ".join(rng.choices(words, k=n))
    same = text(40)
    docs = [(i, same if rng.random() < same_share else text(rng.randrange(0, 60))) for i in range(300)]
    target = [" ".join(rng.choices(words[:6], k=30)) for _ in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    rows = ir.resample(df, goal, percent).collect()
    got = {r["doc_id"]: (r["n_features"], r["weight"], r["score"], r["rank"]) for r in rows}
    assert len(rows) == 300 and got == plain_resample(docs, target, percent)


def test_resampling_moves_towards_the_target(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(rng.choices(words[:40] if i % 10 == 0 else words, k=50))) for i in range(500)]
    goal = spark.createDataFrame([(" ".join(rng.choices(words[:40], k=60)),) for _ in range(50)], "text string")
    ranks = ir.resample(spark.createDataFrame(docs, "doc_id long, text string"), goal, 10)
    drawn = [r["doc_id"] for r in ranks.where("rank is not null").collect()]
    assert len(drawn) == 50 and sum(i % 10 == 0 for i in drawn) >= 45
    kept = ir.drawn_rows(spark.createDataFrame(docs, "doc_id long, text string"), ranks)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(drawn) and kept.columns == ["doc_id", "text"]


def test_edge_rows(spark):
    docs = edge.docs(spark)
    goal = spark.createDataFrame([("alpha beta",), (None,)], "text string")
    rows = ir.resample(docs, goal, 100, min_words=1).collect()
    assert len(rows) == len(edge.DOCS)
    ranks = sorted(r["rank"] for r in rows if r["rank"] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) == sum(bool(plain_features(t[1])[0]) for t in edge.DOCS)
    for r in rows:
        assert (r["n_words"] == 0) == (r["n_features"] == 0) and (r["n_features"] or r["weight"] == 0)
    assert next(r for r in rows if r["doc_id"] == 8)["n_words"] == 9000
    assert ir.resample(edge.empty(spark), goal, 5).count() == 0
    none = ir.resample(docs, goal.where("false"), 5).collect()  # without a target the corpus alone decides
    assert len(none) == len(edge.DOCS) and all(r["rank"] is None for r in none)
