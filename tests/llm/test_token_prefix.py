import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tessellate.llm import queries
from tessellate.llm.common import chunk_keys, chunk_of, table
from tessellate.llm.token_prefix import PrefixTable, longest_prefix, prefix_token_counts, tokens_of_prefix
from tests.conftest import SF_SMALL
from tests.llm import edge

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def count(tok, text):
    return len(tok.encode(text or "", add_special_tokens=False).ids)


def test_chunks_join_to_the_text():
    for text in ["", "a b", " a  b\n\nc ", "a\nb c", "\tx y", "a \n b", "\ra", "x\x1cy z"]:
        assert "".join(map(chunk_of, chunk_keys(text))) == text


def test_every_prefix_is_exact(tok):
    table_ = PrefixTable(open(PATH, "rb").read(), entries=50)  # a small cache, so generations turn over
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "'", "ll", "re", "s", "é", "12", ".", "!!", "\t", "<|endoftext|>", "日本", "😀", "the", "'ve"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        got = np.cumsum(np.frombuffer(table_.text_deltas(text, chunk_keys(text)), "<i2"))
        assert got.tolist() == [count(tok, text[:i]) for i in range(1, len(text) + 1)], text


def test_query_matches_the_library(spark, tok):
    rows = {r["doc_id"]: r["text"] for r in table(spark, SF_SMALL, "documents").collect()}
    got = queries.op1_token_counts(spark, SF_SMALL).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r["doc_id"]] or ""
        n = count(tok, text)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 1024)
        assert r["fit_chars"] == len(text) if n <= 1024 else count(tok, text[:r["fit_chars"]]) <= 1024


def test_edge_rows_and_stored_table(spark, tok):
    d = edge.docs(spark)
    rows = prefix_token_counts(d, PATH, budgets=(3,)).withColumns({
        "fit": longest_prefix("prefix_deltas", 3), "at_2": tokens_of_prefix("prefix_deltas", "fit_3")}).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(count(tok, t[1]) for t in edge.DOCS)
    assert all(r["fit"] == r["fit_3"] and r["at_2"] <= 3 for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["n_tokens"] == by_id[3]["n_tokens"] == 0 and by_id[8]["n_tokens"] == count(tok, edge.LONG)
    assert prefix_token_counts(edge.empty(spark), PATH).count() == 0
