"""Blocks that the articles of a host share are judged by its array too."""

from tessellate.llm.host_suffix import extract_main_text

SCHEMA = "page_id long, url string, html string"
NOTICE = "Subscribe to our letter and read more of this every day"
LINE = "A common line that several of the articles share"


def own(i):
    return " ".join(f"w{i}x{k}" for k in range(12))


def page(i, host, *paragraphs, around=""):
    return (i, f"http://{host}/{i}", f"<body>{around}<article><h1>Part one</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}</article></body>")


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_a_notice_inside_every_article_goes(spark):
    rows = [page(i, "h", own(i), NOTICE, *([LINE] if i < 5 else []), own(100 + i)) for i in range(12)]
    rows += [page(20 + i, "few", own(i), NOTICE) for i in range(4)]
    rows += [page(30 + i, "around", own(i), *([NOTICE] if i == 0 else []), around=f"<nav>{NOTICE}</nav>") for i in range(8)]
    rows += [rows[0], (40, "http://h/none", None), (41, None, "")]
    got = texts(spark, rows)
    for i in range(12):
        assert got[i] == "\n".join(["Part one", own(i), *([LINE] if i < 5 else []), own(100 + i)])
    for i in range(4):
        assert got[20 + i] == f"Part one\n{own(i)}\n{NOTICE}"  # too few articles to tell
    assert got[30] == f"Part one\n{own(0)}\n{NOTICE}"  # repeated around the articles, not in them
    assert got[40] == got[41] == ""


def test_near_copies_and_copies_stay_whole(spark):
    body = [own(k) for k in range(6)]
    near = [[own(50 + i) if k == i % 6 else t for k, t in enumerate(body)] for i in range(14)]
    rows = [page(i, "near", *near[i]) for i in range(14)]
    rows += [page(20, "near", own(20), body[0], own(21))]  # quotes what only near copies share
    rows += [page(30 + i, "same", own(1), NOTICE, around=f"<nav>{own(i)}</nav>") for i in range(7)]  # one article
    got = texts(spark, rows)
    for i in range(14):
        assert got[i] == "\n".join(["Part one", *near[i]])
    assert got[20] == "\n".join(["Part one", own(20), body[0], own(21)])
    assert all(got[30 + i] == f"Part one\n{own(1)}\n{NOTICE}" for i in range(7))
