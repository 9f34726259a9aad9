import random
import zlib

import numpy as np
import pytest
import zstandard

from tessellate.llm import compression_quality as cq
from tessellate.llm import queries
from tessellate.llm.common import table
from tests.conftest import SF_SMALL
from tests.llm import edge

SF = SF_SMALL.replace("0.001", "0.1")


def texts(rng, good, n):
    words = [a + b for a in "ba de gi mo ru sel tan".split() for b in "lan ter vos nik".split()]
    if good:
        return " ".join(rng.choices(words, k=n)) + "."
    return " ".join(f"{w.upper()}$$" for w in rng.choices(words, k=n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows = [(i, texts(rng, i % 3 > 0, rng.randrange(5, 80)), int(i % 3 > 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    return rows, docs, labels


def test_scores_separate_and_are_calibrated(spark, labelled):
    rows, docs, labels = labelled
    model = cq.train(docs, labels.where("doc_id < 400"))
    scores = {r["doc_id"]: r["score"] for r in cq.score(docs, model).collect()}
    test = [(scores[i], y) for i, _, y in rows if i >= 400]
    assert all((s >= 0.5) == bool(y) for s, y in test)
    assert cq.train(docs, labels.where("doc_id < 400")) == model  # the fit is a function of its rows


def test_sizes_are_those_of_the_library():
    rng = random.Random(6)
    good, bad = ([texts(rng, g, 60).encode() for _ in range(300)] for g in (True, False))
    model = cq.CompressionModel(cq.dictionary(good), cq.dictionary(bad), (0.5, 1.0, 2.0, 3.0))
    data = texts(rng, True, 400).encode() + "é日".encode() * 50
    a, b = model.sizes(data)
    params = zstandard.ZstdCompressionParameters.from_level(
        cq.LEVEL, source_size=cq.WINDOW, dict_size=len(model.good), format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=False, write_dict_id=False)
    d = zstandard.ZstdCompressionDict(model.good)
    plain, back = 0, b""
    for at in range(0, len(data), cq.WINDOW):
        packed = zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress(data[at:at + cq.WINDOW])
        plain += len(packed)
        back += zstandard.ZstdDecompressor(dict_data=d, format=zstandard.FORMAT_ZSTD1_MAGICLESS).decompress(packed, max_output_size=cq.WINDOW)
    assert a == plain and back == data and a < b
    n = len(data)
    share = n / (n + cq.SHRINK)
    z = 0.5 + share * (1.0 + 2.0 * 20 * (b - a) / n + 3.0 * (a + b) / n)
    assert abs(model.score(data) - 1 / (1 + np.exp(-z))) < 1e-12
    assert model.score(b"") == 1 / (1 + np.exp(-0.5))


def test_the_end_of_a_long_text_counts():
    rng = random.Random(7)
    good, bad = ([texts(rng, g, 60).encode() for _ in range(300)] for g in (True, False))
    model = cq.CompressionModel(cq.dictionary(good), cq.dictionary(bad))
    clean = texts(rng, True, 3000).encode()
    assert model.evidence(clean + texts(rng, False, 3000).encode())[1] < 0.5 * model.evidence(clean)[1]


def test_calibration_reaches_the_optimum():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 3))
    y = (rng.random(500) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -2.0, 0.0])))).astype(float)
    w = np.where(y == 1, 2.0, 0.5)
    beta = np.array(cq.calibrate(x, y, w, ridge=0.0))
    p = 1 / (1 + np.exp(-(beta[0] + x @ beta[1:])))
    full = np.column_stack([np.ones(500), x])
    assert np.abs(full.T @ (w * (p - y)) / w.sum()).max() < 1e-5
    assert np.isfinite(cq.calibrate(np.sign(x), (x[:, 0] > 0).astype(float), np.ones(500))).all()  # separable labels


def test_pieces_are_spread():
    data = bytes(range(256)) * 40
    assert [data.index(p[:1]) == p[0] for p in cq.spread(data)] and len(cq.spread(data)) == cq.PIECES
    assert cq.spread(b"") == [] and cq.spread(b"abc") == [b"abc"]
    assert b"".join(cq.spread(data[:300], 9, 100)) == data[:300]


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    rows = queries.op12_compression_quality(spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0.0 <= r["score"] <= 1.0 and r["predicted"] == int(r["score"] >= 0.3)
    test = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [t for t in test if t[2] == 1], [t for t in test if t[2] == 0]
    assert sum(p for _, p, _ in good) >= 0.98 * len(good)
    assert sum(1 - p for _, p, _ in bad) >= 0.9 * len(bad)
    assert sum((s - y) ** 2 for s, _, y in test) / len(test) < 0.02  # a constant score has 0.13


def test_edge_rows(spark, labelled):
    rows, train_docs, labels = labelled
    model = cq.train(train_docs, labels)
    docs = edge.docs(spark)
    got = cq.score(docs, model).collect()
    assert len(got) == len(edge.DOCS) and all(0.0 <= r["score"] <= 1.0 for r in got)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[2] == by_id[3] == model.score(b"")
    assert sorted(r["score"] for r in got if r["doc_id"] == 5)[0] == by_id[5]
    assert cq.score(edge.empty(spark), model).count() == 0
    # no labels, one label, labels of no document, unusable labels
    none = labels.where("false")
    assert cq.train(docs, none).score(b"x") == 0.5
    assert cq.train(train_docs, labels.where("quality = 1")).score(b"x") > 0.99
    assert abs(cq.train(edge.empty(spark), labels).score(b"x") - 2 / 3) < 0.01
    odd = spark.createDataFrame([(1, 1), (1, 1), (8, 0), (None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    assert 0.0 <= cq.train(docs, odd).score(b"alpha") <= 1.0
