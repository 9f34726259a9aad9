"""Scalar column functions: keyword families, decades, cluster
names, display names, correlation strength.  All are built-in Spark
expressions, so they stay inside whole-stage codegen and also run unchanged
on a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# Keyword -> family, tested in this order; the first keyword contained in the
# lower-cased text wins, anything else (and NULL) is "Other".
# ---------------------------------------------------------------------------
GENRE_KEYWORDS: tuple[tuple[str, str], ...] = (
    ("jazz", "Jazz"),
    ("blues", "Blues"),
    ("pop", "Pop"),
    ("rock", "Rock"),
    ("classical", "Classical"),
    ("opera", "Classical"),
    ("hip hop", "Hip-Hop"),
    ("rap", "Hip-Hop"),
    ("r&b", "R&B"),
    ("soul", "R&B"),
    ("electronic", "Electronic"),
    ("dance", "Electronic"),
    ("edm", "Electronic"),
    ("country", "Country"),
    ("folk", "Folk"),
    ("indie", "Indie"),
    ("hoerspiel", "Spoken Word"),
    ("podcast", "Spoken Word"),
    ("metal", "Metal"),
    ("punk", "Punk"),
    ("latin", "Latin"),
    ("reggae", "Reggae"),
    ("world", "World Music"),
)
OTHER_FAMILY = "Other"

# Cluster-naming rules (feature, comparison, threshold, trait),
# tested in this order; the first two traits that fire are joined by " + ",
# none firing gives "balanced".
CLUSTER_NAME_RULES: tuple[tuple[str, str, float, str], ...] = (
    ("speechiness", ">", 0.5, "speech-heavy"),
    ("acousticness", ">", 0.6, "acoustic"),
    ("energy", ">", 0.65, "high-energy"),
    ("energy", "<", 0.35, "low-energy"),
    ("danceability", ">", 0.7, "danceable"),
    ("instrumentalness", ">", 0.3, "instrumental"),
    ("valence", ">", 0.7, "upbeat"),
    ("valence", "<", 0.3, "melancholic"),
    ("tempo", ">", 130.0, "fast-tempo"),
    ("liveness", ">", 0.4, "live-feel"),
)
BALANCED = "balanced"
TRAIT_SEPARATOR = " + "
MAX_TRAITS = 2

# Own keyword list for the driver's part names ("colour/size noun").  "cold"
# precedes "old" on purpose: the order decides overlapping keys.
PART_KEYWORDS: tuple[tuple[str, str], ...] = (
    ("cold", "Temperature"),
    ("hot", "Temperature"),
    ("old", "Age"),
    ("new", "Age"),
    ("red", "Colour"),
    ("blue", "Colour"),
    ("small", "Size"),
    ("large", "Size"),
)


def keyword_family(c: str | Column,
                   mapping: Sequence[tuple[str, str]] = GENRE_KEYWORDS,
                   other: str = OTHER_FAMILY) -> Column:
    """First keyword (in list order) contained in lower(c) -> its family."""
    text = F.lower(col(c))
    expr = None
    for key, fam in mapping:
        cond = text.contains(F.lit(key.lower()))
        expr = F.when(cond, F.lit(fam)) if expr is None else expr.when(cond, F.lit(fam))
    if expr is None:
        return F.lit(other)
    return expr.otherwise(F.lit(other))


def decade(c: str | Column, strict: bool = False) -> Column:
    """year // 10 * 10 as nullable int; unparseable values become NULL.

    Strings are parsed leniently (``yyyy``, ``yyyy-MM``, ``yyyy-MM-dd``) by
    default; ``strict=True`` accepts full ISO dates only.  Dates and
    timestamps are used directly.
    """
    e = col(c)
    if strict:
        parsed = F.try_to_timestamp(e.cast("string"), F.lit("yyyy-MM-dd"))
    else:
        parsed = e.try_cast("date")
    return (F.floor(F.year(parsed) / 10) * 10).cast("int")


def decade_of_timestamp(c: str | Column) -> Column:
    return (F.floor(F.year(col(c)) / 10) * 10).cast("int")


def _rule_fires(feature_col: Column, op: str, threshold: float) -> Column:
    if op == ">":
        return feature_col > F.lit(threshold)
    if op == "<":
        return feature_col < F.lit(threshold)
    if op == ">=":
        return feature_col >= F.lit(threshold)
    if op == "<=":
        return feature_col <= F.lit(threshold)
    raise ValueError(f"unknown comparison {op!r}")


def cluster_name(available: Sequence[str],
                 rules: Sequence[tuple[str, str, float, str]] = CLUSTER_NAME_RULES,
                 max_traits: int = MAX_TRAITS) -> Column:
    """Trait name of a profile row; a rule on a missing feature never fires."""
    have = set(available)
    traits = [F.when(_rule_fires(F.col(f), op, t), F.lit(name))
              for f, op, t, name in rules if f in have]
    if not traits:
        return F.lit(BALANCED)
    fired = F.filter(F.array(*traits), lambda x: x.isNotNull())
    joined = F.array_join(F.slice(fired, 1, max_traits), TRAIT_SEPARATOR)
    return F.when(F.size(fired) == 0, F.lit(BALANCED)).otherwise(joined)


def display_name(cluster: str | Column, label: str | Column | None = None,
                 noise: int = -1) -> Column:
    """"C{id}: {label}" when a label exists, "Noise" for noise, else "Cluster {id}"."""
    cid = col(cluster)
    base = F.format_string("Cluster %d", cid)
    if label is not None:
        lab = col(label)
        base = F.when(lab.isNotNull(), F.format_string("C%d: %s", cid, lab)).otherwise(base)
    return F.when(cid == F.lit(noise), F.lit("Noise")).otherwise(base)


def correlation_strength(r: str | Column, strong: float = 0.5) -> Column:
    """"+ STRONG" / "- MODERATE" style label of a correlation coefficient."""
    rc = col(r)
    direction = F.when(rc > 0, F.lit("+")).otherwise(F.lit("-"))
    level = F.when(F.abs(rc) > F.lit(strong), F.lit("STRONG")).otherwise(F.lit("MODERATE"))
    return F.concat_ws(" ", direction, level)


def similarity_score(distance: str | Column, nd: int = 4) -> Column:
    """round(1 / (1 + d), nd)."""
    return F.round(F.lit(1.0) / (F.lit(1.0) + col(distance)), nd)
