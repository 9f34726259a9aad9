import corpus_pipeline
import pytest

from tessellate.llm import mil_toxicity
from tessellate.llm.common import table, written
from tessellate.llm.queries import held_out
from tests.conftest import SF_SMALL
from tests.llm import edge
from tests.llm.test_covering_simhash import plain_components, plain_fingerprint
from tests.llm.test_digest_index import digest

SF = SF_SMALL.replace("0.001", "0.01")


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "packing"]


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    model = mil_toxicity.train(docs, table(spark, SF, "labels").where(~held_out()))
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {i for i, t in rows.items() if model.score(t or "")[0] < 0.5}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        if name == "exact_dedup":
            first = {}
            for i in sorted(want):
                first.setdefault(digest(rows[i]), i)
            want = set(first.values())
        elif name == "simhash_dedup":
            ids = sorted(want)
            want = set(plain_components([plain_fingerprint(rows[i]) for i in ids], ids))
        got = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(got) == len(set(got)) and set(got) == want, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == want
    whole = corpus_pipeline.run(spark, SF)
    order = ["doc_id", "start", "length"]
    assert whole.select(order).orderBy(order).collect() == pieces.select(order).orderBy(order).collect()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_answer_edge_rows_and_empty_tables(spark, name, stage):
    for docs, n in ((edge.docs(spark), len(edge.DOCS)), (edge.empty(spark), 0)):
        out = stage(spark, docs, SF_SMALL)
        rows = out.count()
        if name != "packing":
            assert out.columns == docs.columns and rows <= n
        assert (rows > 0) == (n > 0)


def test_entry_works_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path
    root = Path(corpus_pipeline.__file__).parent
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "tessellate", tmp_path / "tessellate", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 90 and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
