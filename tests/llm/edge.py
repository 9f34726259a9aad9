"""Small tables with the awkward rows every operator must answer."""

from pyspark.sql import types as T

LONG = "word other, thing. " * 3000
DOCS = [
    (1, "Alpha beta gamma delta epsilon zeta.", "en", "a", 5, "x"),
    (2, None, "en", "a", None, None),
    (3, "", None, None, 0, "y"),
    (4, "  \t\n ", "de", "a", 4, "z"),
    (5, "Alpha  beta\tgamma delta epsilon zeta.", "en", "b", 5, "x"),
    (5, "Alpha  beta\tgamma delta epsilon zeta.", "en", "b", 5, "x"),
    (None, "Alpha beta gamma delta epsilon zeta.", "en", "b", 5, "x"),
    (None, "only a row without an id says this", "en", "b", 5, "x"),
    (8, LONG, "en", None, 1, "long"),
    (9, "é日本 😀 ' 's <|endoftext|>   x\x1cy\x85z", "xx", "c", 9, "odd"),
    (10, "alpha", None, None, None, None),
]
#: n_tokens, ids, fp, digest and kept clash with names that operators make.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("kept", T.StringType())])
CLASHES = ["n_tokens", "ids", "fp", "fp_", "digest", "digest_", "keep_", "row", "size", "score", "place", "id", "code", "link"]


def docs(spark, rows=DOCS):
    from pyspark.sql import functions as F
    d = spark.createDataFrame(rows, SCHEMA)
    return d.withColumns({c: F.lit("clash") for c in CLASHES})


def empty(spark):
    return docs(spark, [])
