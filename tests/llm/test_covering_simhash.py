import itertools
import random
import re

import xxhash

from tessellate.llm import queries
from tessellate.llm.common import table
from tessellate.llm.covering_simhash import (covering_masks, deduplicate, fingerprint, near_links, path_masks,
                                             simhash_groups)
from tests.conftest import SF_SMALL
from tests.llm import edge


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, ids, radius=3):
    """Union of all pairs within the radius; component = smallest id."""
    distinct = sorted(set(fps))
    label = {f: f for f in distinct}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f
    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= radius:
            label[root(a)] = root(b)
    smallest = {}
    for f, i in zip(fps, ids):
        if i is not None:
            r = root(f)
            smallest[r] = min(i, smallest.get(r, i))
    return [smallest.get(root(f)) for f in fps]


def test_fingerprint():
    for text in ["", " \t", "One", "one TWO", "A b c d", "É B c", "x" * 5000, edge.LONG, "a b c a b c a b c"]:
        assert fingerprint(text) == plain_fingerprint(text)
    assert fingerprint(edge.LONG, block=7) == fingerprint(edge.LONG)


def test_every_pair_within_the_radius_meets_in_a_table():
    rng = random.Random(1)
    positions = list(range(64))
    masks = covering_masks(positions, 3)
    assert len(masks) == 15
    for _ in range(3000):
        differ = sum(1 << p for p in rng.sample(positions, 3))
        assert any(not differ & m for m in masks)
    path = ()
    while True:  # nested coverings keep the promise on what is left, and always keep a position more
        kept = path_masks(path, 3)[4 % len(path_masks(path, 3))]
        path += (4 % len(path_masks(path, 3)),)
        free = [p for p in positions if not kept >> p & 1]
        if len(free) <= 3:
            break
        below = path_masks(path, 3)
        assert all(m & ~kept for m in below)
        for three in itertools.combinations(free[:20], 3):
            assert any(not sum(1 << p for p in three) & m for m in below)


def test_large_buckets_are_dealt_again_and_lose_nothing(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 5))) for _ in range(300)}
    fps |= {base ^ (v << 10) for v in range(64)}  # a dense group within six positions
    fps |= {rng.getrandbits(64) for _ in range(100)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in sorted(fps)]
    links = near_links(spark.createDataFrame(signed, "fp long"), 3, largest=8).collect()
    want = plain_components(sorted(fps), sorted(fps))
    label = {f: f for f in fps}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f
    for r in links:
        a, b = root(r["fp"] & (1 << 64) - 1), root(r["link"] & (1 << 64) - 1)
        label[max(a, b)] = min(a, b)
    assert [root(f) for f in sorted(fps)] == want


def test_query_against_all_pairs(spark):
    rows = table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    want = dict(zip((r["doc_id"] for r in rows), zip(fps, plain_components(fps, [r["doc_id"] for r in rows]))))
    got = queries.op9_covering_simhash(spark, SF_SMALL).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["fingerprint"], r["component_id"]) == (f"{want[r['doc_id']][0]:016x}", want[r["doc_id"]][1])


def test_edge_rows(spark):
    got = simhash_groups(edge.docs(spark)).collect()
    fps = [plain_fingerprint(t[1]) for t in edge.DOCS]
    want = plain_components(fps, [t[0] for t in edge.DOCS])
    key = lambda x: tuple(map(str, x))
    assert sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got), key=key) == \
        sorted(zip((t[0] for t in edge.DOCS), fps, want), key=key)
    assert simhash_groups(edge.empty(spark)).count() == 0
    kept = deduplicate(edge.docs(spark))
    assert kept.columns == edge.docs(spark).columns
    rows = kept.collect()
    groups = {(w, f) if w is None else w for w, f in zip(want, fps)}
    assert len(rows) == len(groups)
    assert {r["doc_id"] for r in rows if r["doc_id"] is not None} == {w for w in want if w is not None}


def test_star_of_many_copies(spark):
    from pyspark.sql import functions as F
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "one two three four five six").otherwise(
        F.concat(F.lit("text "), F.sha2(F.col("id").cast("string").cast("binary"), 256))).alias("text"))
    assert simhash_groups(docs).where("component_id = 0").count() == 300
