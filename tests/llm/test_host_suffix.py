import html
import re

import pytest

from tessellate.llm import queries
from tessellate.llm.common import table
from tessellate.llm.host_suffix import article, blocks, extract_main_text, stream, suffix_heads, unique_runs
from tests.conftest import SF_SMALL

SCHEMA = "page_id long, url string, html string"


def main_text(page):
    return "\n".join(article(blocks(page)) or [])


def test_article_without_its_surroundings():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><article>no";</script></head>
    <body class="article-page"><header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
    <div id="cookie-notice">We use cookies</div><!-- <article>no</article> --><article>
    <h1>Title &amp; more</h1><p>First&nbsp;line,<br>second &lt;line&gt; &#233;&eacute; &copy</p>
    <p>An <b>unclosed bold<p>Third <i>in</i>line <script>no()</script>end</p><ul><li>one<li>two</ul>
    <div class="ad">Buy</div><aside>Aside</aside><form>Name <input name=x></form>
    <section class="comments"><article class="comment"><p>Reader says</p></article></section>
    <footer>Tags</footer></article><aside class="sidebar">More</aside><footer>&copy; Site</footer></body></html>"""
    assert main_text(page) == ("Title & more\nFirst line, second <line> éé ©\nAn unclosed bold\nThird inline end\none\ntwo")


@pytest.mark.parametrize("page, want", [
    ("", ""), ("<article></article>", ""), ("<article>bare text", "bare text"),
    ("<main><p>a</p><aside>b</aside><p>c</p></main><p>d</p>", "a\nc"),
    ("<div class='entry-content'><p>a</p></div><div class=footer>x</div>", "a"),
    ("<div role=main><p>1 < 2 and 3 > 2</p></div>", "1 < 2 and 3 > 2"),
    ("<article><p>cut &am", "cut &am"), ("<article><p>a</article></div></p><p>b", "a"),
    ("<article><pre>  a\n   b </pre></article>", "a b"), ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
    ("<article><p>x<article><p>inner</p></article></p></article>", "x\ninner"),
])
def test_small_pages(page, want):
    assert main_text(page) == want


def test_unmarked_pages_lose_what_their_host_repeats(spark):
    menu = "<div>Home News Sport Weather Travel Contact us</div>"
    foot = "<div>All rights reserved by the owner of this site</div>"
    rows = [(i, "http://h/" + str(i), f"<body>{menu}<p>Unique words {i} of page number {i} only here, nothing else {i}</p>{foot}</body>")
            for i in range(6)]
    rows += [(10, "http://other/x", f"<body>{menu}<p>alone</p></body>"), (11, None, None), (12, "http://h/e", ""),
             (13, "http://h/a", f"{menu}<article><p>All rights reserved by the owner of this site</p></article>")]
    rows += [rows[0]]  # a repeated page
    got = {}
    for r in extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["page_id"], []).append(r)
    for i in range(6):
        assert got[i][0]["text"] == f"Unique words {i} of page number {i} only here, nothing else {i}"
    assert len(got[0]) == 2 and got[0][0]["text"] == got[0][1]["text"]
    assert got[10][0]["text"] == "Home News Sport Weather Travel Contact us\nalone"  # seen on one page of its host
    assert (got[11][0]["text"], got[11][0]["n_chars"], got[12][0]["text"]) == ("", 0, "")
    assert got[10][0]["n_repeated"] == 0 and got[13][0]["n_repeated"] > 0  # the menu, outside the article
    assert got[13][0]["text"] == "All rights reserved by the owner of this site"
    assert extract_main_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_unique_runs_against_all_substrings():
    pages = [["a b c d e f g", "x y"], ["q a b c d e f r", "x z"], ["a b c", "d e f g h"], ["x y", "k l m"]]
    depth = 3
    heads = [set(suffix_heads(stream(p), depth)) for p in pages]
    for k, p in enumerate(pages):
        others = set().union(*(h for j, h in enumerate(heads) if j != k))
        tokens = stream(p)
        covered = set()
        for i in range(len(tokens)):
            for j in range(i + depth, len(tokens) + 1):
                text = "\x01" + "\x01".join(tokens[i:j]) + "\x01"
                if any(text in "\x01" + "\x01".join(stream(o)) + "\x01" for n, o in enumerate(pages) if n != k):
                    covered |= set(range(i, j))
        want, at = [], 1
        for block in p:
            words = block.split()
            spans = "".join("x" if at + i in covered else "." for i in range(len(words)))
            at += len(words) + 1
            if "." in spans:
                for run in re.findall("x+", spans):
                    if len(run) < depth:
                        spans = spans.replace(run, "." * len(run))
                want.append(" ".join(w for w, c in zip(words, spans) if c == "."))
        assert unique_runs(p, others, depth) == want


def test_query_on_its_table(spark):
    pages = {r["page_id"]: r for r in table(spark, SF_SMALL, "pages").collect()}
    rows = queries.op6_host_suffix(spark, SF_SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = pages[r["page_id"]]["html"].split("<article>")[1].split("</article>")[0]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(filter(None, want)) and r["n_chars"] == len(r["text"])
        assert r["url"] == pages[r["page_id"]]["url"] and r["n_repeated"] >= 0
