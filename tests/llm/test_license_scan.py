import math
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tessellate.llm.license_scan import SPLIT, license_scan, oracle_sql, stated_licences, template_words, TEMPLATES
from tests.llm import edge

FILES = [
    ("p/LICENSE", "Apache notice\nLicensed under the Apache License, Version 2.0.\nmore words here"),
    ("p/a.txt", "no statement at all"),
    ("p/sub/deep/b.txt", "plain words"),
    ("p/own/COPYING.md", "Released under the MIT License."),
    ("p/own/c.txt", "plain words again"),
    ("p/own/d.txt", "Text.\nThis work is licensed under the GNU General Public License, version 3.\nText."),
    ("q/e.txt", "Released under the MIT License."),
    ("q/f.txt", "plain words once more"),
    ("pp/g.txt", "a sibling whose name begins alike"),
    ("LICENSE.old", None),
    (None, "no path, no licence"),
]


def files(spark, rows=FILES):
    return spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")


def test_inheritance_from_the_nearest_directory(spark):
    got = {r["path"]: (r["licence"], r["origin"], r["from_dir"]) for r in license_scan(files(spark)).collect()}
    assert got == {
        "p/LICENSE": ("Apache-2.0", "own", None), "p/a.txt": ("Apache-2.0", "inherited", "p"),
        "p/sub/deep/b.txt": ("Apache-2.0", "inherited", "p"), "p/own/COPYING.md": ("MIT", "own", None),
        "p/own/c.txt": ("MIT", "inherited", "p/own"), "p/own/d.txt": ("GPL-3.0", "own", None),
        "q/e.txt": ("MIT", "own", None), "q/f.txt": (None, "none", None), "pp/g.txt": (None, "none", None),
        "LICENSE.old": (None, "none", None), None: (None, "none", None)}


def test_root_licence_covers_all(spark):
    rows = [("LICENSE", "Licensed under CC BY 4.0."), ("x/y.txt", "words"), ("z.txt", "words")]
    got = {r["path"]: (r["licence"], r["origin"], r["from_dir"]) for r in license_scan(files(spark, rows)).collect()}
    assert got["x/y.txt"] == ("CC-BY-4.0", "inherited", "") and got["z.txt"] == ("CC-BY-4.0", "inherited", "")


def test_statements(spark):
    rows = [(None, "Licensed under CC BY-NC 4.0."), (None, "licensed under cc by 4.0"), (None, "the license under which"),
            (None, "x\n\nRELEASED UNDER THE MIT LICENSE"), (None, "Licensed under the Apache License, Version 2.0. " + " ".join(f"word{i}" for i in range(9)))]
    got = {r["id"]: (r["licence"], r["line_no"]) for r in stated_licences(files(spark, rows)).collect()}
    assert got == {0: ("CC-BY-NC-4.0", 0), 1: ("CC-BY-4.0", 0), 3: ("MIT", 2)}


def test_no_python_in_the_plan(spark):
    plan = license_scan(files(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_edge_rows(spark):
    d = edge.docs(spark).withColumns({"path": F.lit("a/b"), "licence": F.lit("clash"), "dir": F.lit("clash"), "line_no": F.lit(1)})
    rows = license_scan(d).collect()
    assert len(rows) == len(edge.DOCS) and all(r["origin"] == "none" for r in rows)
    assert license_scan(edge.empty(spark).withColumn("path", F.lit("x"))).count() == 0


def test_frequencies_of_all_words(spark):
    texts = ["the quiet that runs on and que der die\n" * 40 + f"other{i} line{i}" for i in range(20)]
    texts += ["The that on que: Released under the MIT License.", "Released under the MIT License. rare odd words here", None]
    texts += [texts[-3]]
    lines = [(i, k, set(re.split(SPLIT, x.lower())) - {""}) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n"))]
    df = Counter(w for _, _, ws in lines for w in ws)

    def size(ws):
        return sum((math.log((1 + len(lines)) / (1 + df[w])) + 1) ** 2 for w in ws)

    want = {}
    for i, k, ws in lines:
        for name, _, t in template_words(TEMPLATES):
            score = round(size(ws & set(t)) / math.sqrt(size(ws) * size(t)), 6) if ws else 0.0
            if score >= 0.75:
                want[i] = min(want.get(i, (0, 0, "")), (-score, k, name))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: (-r["score"], r["line_no"], r["licence"]) for r in stated_licences(rows).collect()}
    assert got.keys() == want.keys() >= {20} and got[20][2] == "MIT"
    assert all(got[i][1:] == want[i][1:] and abs(got[i][0] - want[i][0]) < 2e-6 for i in want)


def test_sql_is_the_same_formula(spark, tmp_path):
    """Statements beside common and rare words: Spark and the SQL agree on every score."""
    texts = ["Released under the MIT License. que", "The and of that to: Released under the MIT License.", "x\nLicensed under CC BY 4.0. für",
             "Licensed under the Apache License, Version 2.0 for that die", None, "", "Released under the MIT License. zzz yyy xxx"]
    texts += ["que das and that the of to for die"] * 60 + [f"für line{i}\nthe of" for i in range(9)]
    docs = spark.createDataFrame([(i, t, f"s{i % 3}", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    path = "concat_ws('/', source, lang, concat(doc_id, '.txt'))"
    want = con.execute(oracle_sql(path, "line_no = 0")).fetchall()
    rows = license_scan(docs.withColumn("path", F.expr(path)), licence_file=lambda r: F.col("line_no") == 0).collect()
    order = lambda r: r[0]
    got, want = sorted(map(tuple, rows), key=order), sorted(want, key=order)
    assert [(r[0], r[1], r[2], r[4], r[5], r[6]) for r in got] == [(r[0], r[1], r[2], r[4], r[5], r[6]) for r in want]
    assert all(a[3] == b[3] or abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want)) and got[0][2] == "MIT" and got[0][3] > 0.98
