"""Long pages are Python objects a few at a time; whole texts are not sorted."""

import re

import pyarrow as pa
import pyarrow.compute as pc

from tessellate.llm.common import sized_slices
from tessellate.llm.host_suffix import extract_main_text, html_bytes, text_and_heads_bytes

SCHEMA = "page_id long, url string, html string"
MENU = "Home News Sport Weather Travel Contact us"


def test_slices_hold_few_bytes_and_every_row_once():
    lengths = [1_000_000] * 10 + [9_000_000, 0, 3_999_999, 1, 1] + [0] * 1200
    values = ["x" * n if n else None for n in lengths]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(values))), pa.array(["h"] * len(values)), pa.array(values, pa.string())],
                                       names=["id", "host", "html"])
    parts = list(sized_slices([batch, batch.slice(0, 0)], html_bytes))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(len(values)))
    held = [pc.sum(html_bytes(p)).as_py() for p in parts]
    assert sorted(held)[-1] == 9_000_000 and sorted(held)[-2] <= 4_000_000  # one page may be longer, by itself
    assert [p.num_rows for p, n in zip(parts, held) if n == 9_000_000] in ([1], [2]) and max(p.num_rows for p in parts) <= 512
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.nulls(3), pa.array(["é", "", "ab"]), pa.array([True, False, True]),
                                       pa.array([[1, 2], None, []], pa.list_(pa.int64()))], names=list("abcde"))
    assert text_and_heads_bytes(rows).to_pylist() == [82, 0, 2]


def test_whole_texts_are_not_sorted(spark):
    pages = spark.createDataFrame([(1, "http://h/1", f"<nav>{MENU}</nav><article><p>a</p></article>")], SCHEMA)
    plan = extract_main_text(pages)._jdf.queryExecution().executedPlan().toString()
    join = next(line for line in plan.splitlines() if re.search(r"\bpage#\S+\], \[page_#", line))
    assert "ShuffledHashJoin" in join
    assert not re.search(r"Sort \[page#", plan)


def test_long_pages_of_both_kinds(spark):
    def words(i, n):
        return " ".join(f"w{i}x{k}" for k in range(n))

    rows = [(i, f"http://h/{i}", f"<div>{MENU}</div><p>{words(i, 60_000)}</p><p>{words(100 + i, 9)}</p>") for i in range(8)]
    rows += [(10 + i, f"http://a/{i}", f"<div>{MENU}</div><article><p>{words(i, 60_000)}</p><p>{MENU}</p></article>") for i in range(8)]
    rows += [(30, "http://h/30", f"<div>{MENU}</div>"), (31, "http://h/31", None), (32, None, f"<p>{words(1, 5)}</p>"), rows[0]]
    got = {}
    for r in extract_main_text(spark.createDataFrame(rows, SCHEMA).repartition(1)).collect():
        got.setdefault(r["page_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows) and got[0][0] == got[0][1]
    for i in range(8):
        assert got[i][0]["text"] == f"{words(i, 60_000)}\n{words(100 + i, 9)}"
        assert got[10 + i][0]["text"] == words(i, 60_000)
        assert got[10 + i][0]["n_chars"] == len(got[10 + i][0]["text"]) and got[i][0]["n_repeated"] > 0
    assert got[30][0]["text"] == got[31][0]["text"] == "" and got[32][0]["text"] == words(1, 5)
