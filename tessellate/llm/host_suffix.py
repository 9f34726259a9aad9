"""Main text of web pages, with a suffix array per host against boilerplate.

A page is cut into blocks at its block elements.  Where the page marks its
article (``article``, ``main``, their roles, or a content class) the blocks in
it are kept, less those that the markup calls menus, footers, asides, adverts,
forms, notices or comments.  What no article element settles is judged by the
host: the token streams of its pages (blocks joined by a separator token) are
put in one suffix array, sorted as deep as the shortest substring that counts
(``MIN_TOKENS``); suffixes that agree so far are its runs, longer repeated
substrings are unions of overlapping runs.  Tokens covered by a substring that
occurs on at least ``MIN_PAGES`` distinct pages and ``MIN_SHARE`` of the
host's pages are boilerplate; the unique runs stay.

A marked article enters the array too, by the suffixes that start at its
separators, compared to the next separator: whole blocks, of ``MIN_TOKENS``
tokens with both.  A block on more than ``STORY_SHARE`` of the host's distinct
articles, ``MIN_STORIES`` of them at least, is a notice and goes; what fewer
articles share is text.  Articles of which ``NEAR_COPY`` or more would go are
near copies of each other: they are no evidence and stay whole.

The array is dealt by (host, leading tokens) and pre-aggregated, so a host
with a third of all pages is spread like any other and its menu costs one
partial count per task.

Null or empty html gives an empty text; null urls form one host; repeated
pages are answered each; a run needs two pages that differ.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import sized_slices, texts_to_python, written

MIN_TOKENS = 6
MIN_PAGES = 3
MIN_SHARE = 0.02
MIN_STORIES = 5
STORY_SHARE = 0.5
NEAR_COPY = 0.75
SEPARATOR = "\x00"

#: Elements whose content is never text of the page.
RAW = "script|style|noscript|template|svg|title|textarea|iframe|object|select|math|canvas|video|audio"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*?(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\s(?:\"[^\"]*\"|'[^']*'|[^'\">])*)?)/?>"
    r"|<[!?][^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
BLOCK = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section
    summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, roles and words of class or id that mark what is not the article.
OFF_TAGS = frozenset("nav footer aside form button menu dialog head search".split())
OFF_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
OFF_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments
    commentlist consent cookie cookies disqus footer login masthead menu modal nav navbar navigation newsletter notice
    notification pager pagination popup promo promoted promotion related replies reply respond share sharing sidebar
    signup skip social sponsor sponsored subscribe subscription toolbar widget widgets""".split())
#: Words of class or id that mark the article where no element does.
ON_WORDS = frozenset("article articlebody content entry post story".split())


def _marks(tag: str, attrs: str) -> tuple[bool, int]:
    """(is not the article, rank as the article: 3 article, 2 main, 1 by class)."""
    role, words = "", set()
    if attrs:
        for name, a, b, c in ATTRIBUTE.findall(attrs):
            name, value = name.lower(), (a or b or c).lower()
            if name == "role":
                role = value
            elif name in ("class", "id", "itemprop"):
                words |= set(re.split(r"[^a-z0-9]+", value))
    off = tag in OFF_TAGS or role in OFF_ROLES or bool(words & OFF_WORDS and tag not in ("body", "html"))
    if off:
        return True, 0
    rank = 3 if tag == "article" or role == "article" else 2 if tag == "main" or role == "main" else \
        1 if words & ON_WORDS and tag in ("div", "section", "td") else 0
    return False, rank


def blocks(page: str) -> list[tuple[str, int, bool]]:
    """(text, rank of the article element around it, marked as not the article)
    of each block in page order; blocks without text are left out."""
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, bool, int]] = []
    parts: list[str] = []
    off, rank = False, 0

    def close_block():
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((text, rank, off))

    def state():
        return any(o for _, o, _ in stack), max((r for _, _, r in stack), default=0)

    def pop_to(k: int):
        nonlocal off, rank
        marked = any(o or r for _, o, r in stack[k:])
        if marked:
            close_block()
        del stack[k:]
        if marked:
            off, rank = state()

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at:m.start()])
        at = m.end()
        tag = m.group("tag")
        if tag is None:
            if m.group("raw"):
                parts.append(" ")
            continue
        tag = tag.lower()
        if tag in BLOCK:
            close_block()
        elif tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        if m.group("end"):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
            continue
        if tag in BLOCK:  # an open paragraph ends here; so does an open item before the next one
            for k in range(len(stack) - 1, -1, -1):
                t = stack[k][0]
                if t == "p" or (t == tag and tag in ("li", "dt", "dd", "tr", "td", "th")):
                    pop_to(k)
                    break
                if t in BLOCK:
                    break
        o, r = _marks(tag, m.group("attrs") or "")
        if tag == "header" and not rank:
            o = True
        if (o and not off) or r > rank:
            close_block()
        stack.append((tag, o, r))
        if o or r:
            off, rank = off or o, max(rank, r)
    if at < len(page):
        parts.append(page[at:])
    close_block()
    return out


def article(found: list[tuple[str, int, bool]]) -> list[str] | None:
    """The blocks of the best marked article, or None where none is marked."""
    best = max((r for _, r, off in found if r and not off), default=0)
    return [t for t, r, off in found if r >= best and not off] if best else None


def stream(texts: list[str]) -> list[str]:
    """Token stream of blocks, a separator before, between and after them."""
    out = [SEPARATOR]
    for t in texts:
        out += [*t.split(), SEPARATOR]
    return out


def suffix_heads(tokens: list[str], depth: int = MIN_TOKENS, host: str = "") -> list[int]:
    """Hash of the host and the first ``depth`` tokens of each suffix that has as many."""
    joined = [xxhash.xxh64_intdigest(f"{host} {' '.join(tokens[i:i + depth])}") for i in range(len(tokens) - depth + 1)]
    return [h - (1 << 64) if h >> 63 else h for h in joined]


def unique_runs(texts: list[str], repeated: set[int], depth: int = MIN_TOKENS, host: str = "") -> list[str]:
    """The blocks without what repeated substrings cover: whole blocks, and
    parts of a block that are as long as a substring must be by themselves (a
    shorter part only continues the repetition of its neighbour)."""
    tokens = stream(texts)
    covered = bytearray(len(tokens))
    for i, h in enumerate(suffix_heads(tokens, depth, host)):
        if h in repeated:
            covered[i:i + depth] = b"\x01" * depth
    out, at = [], 1
    for text in texts:
        words = text.split()
        gone = covered[at:at + len(words)]
        at += len(words) + 1
        if all(gone):
            continue
        kept, i = [], 0
        while i < len(words):
            j = i
            while j < len(words) and gone[j] == gone[i]:
                j += 1
            if not gone[i] or j - i < depth:
                kept += words[i:j]
            i = j
        out.append(" ".join(kept))
    return out


def block_heads(texts: list[str], depth: int = MIN_TOKENS, host: str = "") -> list[int | None]:
    """Hash of the host and each block between its separators, None where they are fewer than ``depth`` tokens."""
    out: list[int | None] = []
    for text in texts:
        words = text.split()
        h = xxhash.xxh64_intdigest("\x01".join((host, SEPARATOR, *words, SEPARATOR)))
        out.append(None if len(words) + 2 < depth else h - (1 << 64) if h >> 63 else h)
    return out


def own_blocks(texts: list[str], repeated: set[int], depth: int = MIN_TOKENS, host: str = "") -> list[str]:
    """The blocks of an article without the repeated ones, or all of a near copy."""
    heads = block_heads(texts, depth, host)
    words = [len(t.split()) for t in texts]
    if sum(n for n, h in zip(words, heads) if h in repeated) >= NEAR_COPY * sum(words):
        return texts
    return [t for t, h in zip(texts, heads) if h not in repeated]


def judged_blocks(found: list[tuple[str, int, bool]]) -> tuple[list[str] | None, list[str] | None, list[str]]:
    """(article or None, unmarked blocks of a page without one or None, the
    blocks whose repetition on other pages is evidence).  An article is judged
    by its whole blocks, among articles; the others by their substrings."""
    kept = article(found)
    if kept is not None:
        return kept, None, [t for t, r, off in found if off or not r]
    return None, [t for t, _, off in found if not off], [t for t, _, _ in found]


def host_of(url: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def html_bytes(batch: pa.RecordBatch) -> pa.Array:
    return pc.fill_null(pc.binary_length(batch.column(2)), 0)


def text_and_heads_bytes(batch: pa.RecordBatch) -> pa.Array:
    """Of the text and the covered heads of each row, 40 bytes for a head (a Python int in a list)."""
    heads = pc.cast(pc.fill_null(pc.list_value_length(batch.column(4)), 0), pa.int64())
    return pc.add(pc.cast(pc.binary_length(batch.column(2)), pa.int64()), pc.multiply(heads, 40))


def page_key(page, value: str | None) -> int:
    return xxhash.xxh64_intdigest(f"{page}\x00{value or ''}") >> 1


def page_heads(pages: DataFrame, id_col: str, url_col: str, html_col: str, depth: int) -> DataFrame:
    """(page, content, host, heads, story, words, blocks): the distinct suffix
    heads of each page's evidence; page and content are hashes of id and html, and
    of html.  Of an article: the hash of its text, its words, and by head of its
    blocks their words (null without one)."""
    block = T.StructType([T.StructField("head", T.LongType()), T.StructField("words", T.IntegerType())])
    schema = T.StructType([T.StructField("page", T.LongType()), T.StructField("content", T.LongType()),
                           T.StructField("host", T.StringType()), T.StructField("heads", T.ArrayType(T.LongType())),
                           T.StructField("story", T.LongType()), T.StructField("words", T.IntegerType()),
                           T.StructField("blocks", T.ArrayType(block))])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, html_bytes):
            rows = []
            for page, host, value in zip(*(batch.column(k).to_pylist() for k in range(3))):
                kept, judged, evidence = judged_blocks(blocks(value or ""))
                found = set(suffix_heads(stream(evidence), depth, host))
                if judged:
                    found |= set(suffix_heads(stream(judged), depth, host))
                story = words = parts = None
                if kept:
                    counts: dict[int, int] = {}
                    for text, h in zip(kept, block_heads(kept, depth, host)):
                        if h is not None:
                            counts[h] = counts.get(h, 0) + len(text.split())
                    story, words = xxhash.xxh64_intdigest("\n".join(kept)) >> 1, sum(len(t.split()) for t in kept)
                    parts = [{"head": h, "words": n} for h, n in counts.items()]
                rows.append((page_key(page, value), xxhash.xxh64_intdigest(value or "") >> 1, host, sorted(found), story, words, parts))
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=schema.names)

    return texts_to_python(pages).select(id_col, host_of(url_col).alias("host"), html_col).mapInArrow(run, schema)


def repeated_heads(heads: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(head, pages): the runs of the hosts' suffix arrays, that is
    suffixes agreeing on their head, which lie on enough distinct pages."""
    n_pages = heads.groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    array = (heads.select("host", "content", F.explode("heads").alias("head")).groupBy("head")
             .agg(F.min("host").alias("host"), F.count(F.lit(1)).alias("pages"), F.min("content").alias("a"),
                  F.max("content").alias("b")))
    return (array.where((F.col("pages") >= min_pages) & (F.col("a") != F.col("b"))).join(n_pages, "host")
            .where(F.col("pages") >= min_share * F.col("of")).select("head", "pages"))


def repeated_blocks(heads: DataFrame, min_stories: int = MIN_STORIES, min_share: float = STORY_SHARE) -> DataFrame:
    """(host, gone): the heads of the blocks that repeat on enough of the host's
    distinct articles, near copies aside; at most ``1 / min_share`` times as many as
    an article has on average."""
    stories = heads.where(F.col("story").isNotNull()).select("host", "story", "words", "blocks")
    of = written(stories.groupBy("host").agg(F.count_distinct("story").alias("of")), "stories")
    listed = stories.select("host", "story", F.explode("blocks.head").alias("head"))
    # rows are at least as many as distinct articles: first those with enough rows at all, then on their host
    often = listed.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_stories).select("head")
    common = (listed.join(often, "head", "left_semi").groupBy("head").agg(F.min("host").alias("host"), F.count(F.lit(1)).alias("n"))
              .join(of, "host").where(F.col("n") > min_share * F.col("of")).select("head"))
    seen = written(listed.join(written(common, "common-blocks"), "head", "left_semi").distinct(), "common-blocks-seen")

    def repeated(seen: DataFrame, of: DataFrame) -> DataFrame:
        enough = (F.col("n") >= min_stories) & (F.col("n") > min_share * F.col("of"))
        return (seen.groupBy("host", "head").agg(F.count(F.lit(1)).alias("n")).join(of, "host").where(enough)
                .groupBy("host").agg(F.collect_list("head").alias("gone")))

    covered = F.aggregate(F.filter("blocks", lambda b: F.array_contains("gone", b["head"])), F.lit(0), lambda n, b: n + b["words"])
    near = written(stories.join(repeated(seen, of), "host").where(covered >= NEAR_COPY * F.col("words"))
                   .select("host", "story").distinct(), "near-copies")
    others = of.join(near.groupBy("host").agg(F.count(F.lit(1)).alias("near")), "host", "left").select(
        "host", (F.col("of") - F.coalesce("near", F.lit(0))).alias("of"))
    return repeated(seen.join(near, ["host", "story"], "left_anti"), others)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                      min_tokens: int = MIN_TOKENS, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(id, url, text, n_chars, n_repeated), one row per page; n_repeated is the
    number of its suffixes, outside its article, that its host repeats."""
    heads = written(page_heads(pages, id_col, url_col, html_col, min_tokens), "page-heads")
    repeated = written(repeated_heads(heads, min_pages, min_share), "repeated-heads")
    blocks_ = written(repeated_blocks(heads), "repeated-blocks")
    covered = (heads.select("page", F.explode("heads").alias("head")).hint("merge")
               .join(repeated.select("head"), "head").select("page", "head", F.lit(None).cast("long").alias("block")))
    cut = heads.join(blocks_, "host").select("page", F.lit(None).cast("long").alias("head"),
                                             F.explode(F.array_intersect("blocks.head", "gone")).alias("block"))
    covered = (covered.union(cut).groupBy("page").agg(F.collect_set("head").alias("covered"), F.collect_set("block").alias("cut"))  # of one page
               .withColumnRenamed("page", "page_"))
    fields = [T.StructField("id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType),
              T.StructField("page", T.LongType()), T.StructField("text", T.StringType()),
              T.StructField("marked", T.BooleanType())]
    out = T.StructType([*fields[:2], fields[3], T.StructField("n_repeated", T.LongType())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, html_bytes):
            rows = [(value or "", *judged_blocks(blocks(value or ""))) for value in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([page_key(i, v) for i, (v, *_) in zip(batch.column(0).to_pylist(), rows)], pa.int64()),
                 pa.array(["\n".join(judged if kept is None else kept) for _, kept, judged, _ in rows], pa.string()),
                 pa.array([kept is not None for _, kept, _, _ in rows], pa.bool_())], names=[f.name for f in fields])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_slices(batches, text_and_heads_bytes):
            texts, counts = [], []
            for text, marked, gone, cut, host in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5, 6))):
                if not marked:
                    text = "\n".join(unique_runs(text.split("\n") if text else [], set(gone or ()), min_tokens, host))
                elif cut:
                    text = "\n".join(own_blocks(text.split("\n"), set(cut), min_tokens, host))
                texts.append(text)
                counts.append(len(gone or ()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array(counts, pa.int64())], names=out.names)

    parsed = texts_to_python(pages, id_col, url_col, html_col).mapInArrow(parse, T.StructType(fields))
    # texts cross one shuffle and are not sorted; a task holds the heads of its share
    whole = (parsed.join(covered.hint("shuffle_hash"), parsed["page"] == covered["page_"], "left")
             .select("id", "url", "text", "marked", "covered", "cut", host_of("url").alias("host")).mapInArrow(finish, out))
    return whole.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text",
                        F.char_length("text").cast("long").alias("n_chars"), "n_repeated")
