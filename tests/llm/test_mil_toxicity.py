import random
import zlib

from pyspark.sql import functions as F

from tessellate.llm import mil_toxicity, queries
from tessellate.llm.common import table
from tests.conftest import SF_SMALL
from tests.llm import edge

SF = SF_SMALL.replace("0.001", "0.1")


def bags(n, rng):
    words = [a + b for a in "ba de gi mo ru".split() for b in "lan ter vos nik".split()]
    texts, labels = [], []
    for i in range(n):
        s = [" ".join(rng.choices(words, k=rng.randint(3, 9))) for _ in range(rng.randint(1, 20))]
        toxic = int(i % 4 == 0)
        if toxic:
            k = rng.randrange(len(s))
            s[k] += " " + rng.choice(["vile", "nastyer", "nastyish"])
        texts.append(". ".join(s) + ".")
        labels.append(toxic)
    return texts, labels


def test_sentences_are_found_from_document_labels():
    rng = random.Random(1)
    model = mil_toxicity.fit(*bags(600, rng))
    texts, labels = bags(300, rng)
    hits = 0
    for text, label in zip(texts, labels):
        score, found = model.score(text)
        assert (score >= 0.5) == bool(label)
        if label:
            z, a, b = max(found)
            hits += "vile" in text[a:b] or "nasty" in text[a:b]
    assert hits == sum(labels)
    assert model.score("clean words only. " * 3000)[0] < 0.5  # many sentences alone are not toxic


def test_any_number_of_clean_sentences():
    rng = random.Random(2)
    model = mil_toxicity.fit(*bags(600, rng))
    texts, labels = bags(2000, rng)
    prose = " ".join(t for t, toxic in zip(texts, labels) if not toxic)
    clean = (prose + " ") * (200_000 // prose.count(".") + 1)
    for text in ("clean words only. " * 200_000, "1.5\n" * 200_000, clean):
        assert model.score(text)[0] < 0.5 and mil_toxicity.SentenceModel().score(text)[0] < 0.1
        assert model.score(text + "what a vile thing.")[0] >= 0.5
    slight = mil_toxicity.SentenceModel(weights={"words": 0.3, "vile": 14.0})
    assert slight.score("clean words only. " * 200_000)[0] < 0.1


def test_noisy_or():
    model = mil_toxicity.SentenceModel(-3.0, {"bad": 2.0, "good": -1.0})
    p = [1 / (1 + 2.718281828459045 ** -z) for z in (-1.0, -4.0, -3.0)]
    want = 1 - (1 - p[0]) * (1 - p[1]) * (1 - p[2])
    assert abs(model.score("A bad thing. Good day! Else")[0] - want) < 1e-12
    assert model.score("")[0] == model.score(" \n")[0] == 0.0
    assert mil_toxicity.SentenceModel().score("x")[0] < 0.01


def test_no_labels_of_one_kind():
    assert mil_toxicity.fit([], []).weights == {} and mil_toxicity.fit(["a b"], [1]).weights == {}


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    rows = queries.op8_mil_toxicity(spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0.0 <= r["score"] <= 1.0 and r["predicted"] == int(r["score"] >= 0.5)
    test = sorted((r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels)
    pos = sum(y for _, y in test)
    below = auc = 0
    for _, y in test:
        auc += below * y
        below += 1 - y
    assert auc / (pos * (len(test) - pos)) > 0.95
    assert sum(s >= 0.5 for s, y in test if y) >= 0.85 * pos
    assert sum(s >= 0.5 for s, y in test if not y) <= 0.02 * (len(test) - pos)


def test_edge_rows_and_sentences(spark):
    docs = edge.docs(spark)
    model = mil_toxicity.SentenceModel(-6.0, {"thing": 9.0})
    rows = mil_toxicity.score(docs, model).collect()
    assert len(rows) == len(edge.DOCS)
    for r in rows:
        assert (r["score"] >= 0.5) == (r["doc_id"] == 8)
    spans = mil_toxicity.offending_sentences(docs, model).collect()
    assert len(spans) == 3000 and {s["doc_id"] for s in spans} == {8}
    assert all(edge.LONG[s["start"]:s["end"]] == s["sentence"] for s in spans)
    kept = mil_toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(edge.DOCS) - 1
    assert mil_toxicity.score(edge.empty(spark), model).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (2, 0)], "doc_id long, toxic int")
    assert mil_toxicity.labelled_sample(docs.where("doc_id < 4"), labels).count() == 2
    assert mil_toxicity.train(edge.empty(spark), labels.where(F.lit(False))).weights == {}
