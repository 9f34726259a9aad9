"""Licence scan: TF-IDF cosine of lines to licence statements, then inheritance
along directories.

Every line of every text is a sparse vector of its distinct words, weighted by
idf = ln((1 + lines) / (1 + lines with the word)) + 1, counted over all lines
for every word.  A line states the licence of the template with the highest
cosine, from ``THRESHOLD`` on.  A bound on the cosine that holds for any idf of
the words outside the templates (none is below 1) leaves few lines to compare;
only their words are joined to the frequencies.

A file's licence is the statement in it with the highest score (ties: the
first line, then the licence's name).  A licence file covers its directory and
all below; a file without a statement inherits from its nearest ancestor
directory that has a licence file (of several there, the highest score, then
the smallest path).

Null texts count as empty.  Rows of one id are judged together.  A null path
inherits nothing.  All of it is DataFrame functions.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bounded_broadcast
from .common import text_or_empty, written

THRESHOLD = 0.75
#: Statements by which texts name their licence.
TEMPLATES = {
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "You may not use this file except in compliance with the Apache License, Version 2.0."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and modify it under the terms of the "
                "GNU General Public License, version 3."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."],
}
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense)([._-].*)?$"
SPLIT = "[^a-z0-9]+"


def template_words(templates: dict[str, list[str]]) -> list[tuple[str, int, list[str]]]:
    """(licence, number of the statement, its distinct words)."""
    return [(name, k, sorted(set(re.split(SPLIT, text.lower())) - {""}))
            for name, texts in sorted(templates.items()) for k, text in enumerate(texts)]


def words_of(line: Column) -> Column:
    """The distinct words of a line."""
    return F.array_remove(F.array_distinct(F.split(F.lower(line), SPLIT)), "")


def line_words(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, words, known): lines that hold a word of the templates."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_or_empty(text_col), "\n")).alias("line_no", "line"))
    return (lines.select("id", "line_no", words_of(F.col("line")).alias("words"))
            .withColumn("known", F.array_intersect("words", F.array(*map(F.lit, vocabulary))))
            .where(F.size("known") > 0))


def line_frequencies(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, df): the number of lines that hold each word; the empty word
    stands for the line itself and counts them all."""
    lines = docs.select(F.explode(F.split(text_or_empty(text_col), "\n")).alias("line"))
    return (lines.select(F.explode(F.array_append(words_of(F.col("line")), F.lit(""))).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("df")))


def stated_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, licence, score, line_no): the best statement of each id that has one."""
    spark = docs.sparkSession
    statements = template_words(templates)
    vocabulary = sorted({w for _, _, ws in statements for w in ws})
    seen = written(line_frequencies(docs, text_col), "licence-words")
    df = {r["word"]: r["df"] for r in seen.where(F.col("word").isin(["", *vocabulary])).collect()}  # the words of the templates
    n_lines = float(df.get("", 0))
    square = {w: (math.log((1 + n_lines) / (1 + df.get(w, 0))) + 1) ** 2 for w in vocabulary}
    squares = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, square[w])])
    own = F.aggregate("known", F.lit(0.0), lambda acc, w: acc + F.element_at(squares, w))
    template = [(name, k, ws, sum(square[w] for w in ws)) for name, k, ws in statements]
    least = F.col("own") + F.size("words") - F.size("known")  # of the squared norm
    most = F.least("own", F.col("own") * F.col("own") / min(size for *_, size in template))  # of the cosine's square times the norm's
    near = written(line_words(docs, vocabulary, id_col, text_col).withColumn("own", own)
                   .where(most >= F.lit(threshold * threshold * (1 - 1e-9)) * least)
                   .select("id", "line_no", "words", "known").dropDuplicates(["id", "line_no", "words"]), "licence-lines")
    of_word = spark.createDataFrame([(w, name, k, square[w], size) for name, k, ws, size in template for w in ws],
                                    "word string, licence string, statement int, square double, template double")
    line = ["id", "line_no", "words"]
    floor = F.sum("square") / F.sqrt(F.max("template"))
    dots = (near.select(*line, F.explode("known").alias("word"))
            .join(F.broadcast(of_word), "word")  # the words of the templates
            .groupBy(*line, "licence", "statement").agg(floor.alias("dot")))
    in_near = near.select(F.explode("words").alias("word")).distinct()
    idf = seen.join(in_near, "word").select(
        "word", F.pow(F.log(F.lit(1 + n_lines) / (1 + F.col("df"))) + 1, 2).alias("square"))
    norms = (near.select(*line, F.explode("words").alias("word")).join(bounded_broadcast(idf), "word")
             .groupBy(*line).agg(F.sum("square").alias("norm")))
    at = [a.eqNullSafe(b) for a, b in ((dots[c], norms[c]) for c in line)]
    scored = (dots.join(norms, at[0] & at[1] & at[2])
              .select(dots["id"], dots["line_no"], "licence", F.round(F.col("dot") / F.sqrt("norm"), 6).alias("score"))
              .where(F.col("score") >= threshold))
    best = F.min(F.struct((-F.col("score")).alias("order"), "line_no", "licence", "score"))
    return scored.groupBy("id").agg(best.alias("b")).select("id", "b.licence", "b.score", "b.line_no")


def named_as_licence(rows: DataFrame) -> Column:
    return F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path",
                 templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD,
                 licence_file: Callable[[DataFrame], Column] = named_as_licence) -> DataFrame:
    """One row per row of ``docs``: id, path, licence, score and line_no of its
    own statement, origin (own, inherited or none) and from_dir (the directory
    it inherits from).  ``licence_file`` tells the licence files among the
    rows (id, path, licence, score, line_no) that state a licence."""
    stated = stated_licences(docs, id_col, text_col, templates, threshold)
    stated = stated.withColumnRenamed("id", "id_")
    files = docs.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"))
    own = written(files.join(stated, files["id"].eqNullSafe(stated["id_"]), "left").drop("id_")
                  .withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", ""))
                              .when(F.col("path").isNotNull(), F.lit(""))), "licence-own")
    having = own.where(F.col("licence").isNotNull() & F.col("dir").isNotNull())
    first = F.min(F.struct((-F.col("score")).alias("order"), "path", "licence"))
    of_dir = (having.where(licence_file(having)).groupBy("dir").agg(first.alias("f"))
              .select(F.col("dir").alias("from_dir"), F.col("f.licence").alias("inherited")))
    parts = F.split("dir", "/")
    above = (own.where("dir is not null").select("dir").distinct()
             .select("dir", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts)))).alias("depth"),
                     parts.alias("parts"))
             .select("dir", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("up")))
    nearest = written(above.join(of_dir, above["up"] == of_dir["from_dir"])
                      .groupBy("dir").agg(F.max_by(F.struct("from_dir", "inherited"), "depth").alias("n"))
                      .select(F.col("dir").alias("dir_"), "n.from_dir", "n.inherited"), "licence-nearest")
    joined = own.hint("merge").join(nearest, own["dir"] == nearest["dir_"], "left")
    return joined.select(
        F.col("id").alias(id_col), "path", F.coalesce("licence", "inherited").alias("licence"), "score", "line_no",
        F.when(F.col("licence").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited")
        .otherwise("none").alias("origin"),
        F.when(F.col("licence").isNull(), F.col("from_dir")).alias("from_dir"))


def oracle_sql(path_sql: str, licence_file_sql: str, templates: dict[str, list[str]] = TEMPLATES,
               threshold: float = THRESHOLD) -> str:
    """The same result for ``documents`` as DuckDB SQL."""
    rows = ", ".join(f"('{w}', '{name}', {k})" for name, k, ws in template_words(templates) for w in ws)
    return f"""
WITH template(word, licence, statement) AS (VALUES {rows}),
vocabulary AS (SELECT DISTINCT word FROM template),
files AS (SELECT doc_id, {path_sql} AS path, coalesce(text, '') AS text FROM documents),
texts AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line
          FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM files)),
words AS (SELECT doc_id, line_no, unnest(list_distinct(list_filter(string_split_regex(lower(line), '{SPLIT}'), lambda w: w <> ''))) AS word FROM texts),
seen AS (SELECT word, count(*) AS df FROM words GROUP BY word),
total AS (SELECT count(*)::DOUBLE AS n FROM texts),
idf AS (SELECT word, ln((1 + n) / (1 + coalesce(df, 0))) + 1 AS idf
        FROM (SELECT word FROM seen UNION SELECT word FROM vocabulary) LEFT JOIN seen USING (word), total),
known AS (SELECT doc_id, line_no, word, idf FROM words JOIN idf USING (word)),
norms AS (SELECT doc_id, line_no, sum(idf * idf) AS norm FROM known GROUP BY doc_id, line_no),
sizes AS (SELECT licence, statement, sum(idf * idf) AS size FROM template JOIN idf USING (word) GROUP BY licence, statement),
scored AS (SELECT doc_id, line_no, licence, round(sum(idf * idf) / sqrt(any_value(norm) * any_value(size)), 6) AS score
           FROM known JOIN template USING (word) JOIN norms USING (doc_id, line_no) JOIN sizes USING (licence, statement)
           GROUP BY doc_id, line_no, licence, statement),
stated AS (SELECT doc_id, licence, score, line_no FROM scored WHERE score >= {threshold}
           QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no, licence) = 1),
own AS (SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, licence, score, line_no
        FROM files LEFT JOIN stated USING (doc_id)),
of_dir AS (SELECT dir AS from_dir, licence AS inherited FROM own WHERE licence IS NOT NULL AND {licence_file_sql}
           QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) = 1),
nearest AS (SELECT d.dir, from_dir, inherited FROM (SELECT DISTINCT dir FROM own) d
            JOIN of_dir ON d.dir = from_dir OR starts_with(d.dir, from_dir || '/')
            QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(from_dir) DESC) = 1)
SELECT doc_id, path, coalesce(licence, inherited) AS licence, score, line_no,
       CASE WHEN licence IS NOT NULL THEN 'own' WHEN inherited IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN licence IS NULL THEN from_dir END AS from_dir
FROM own LEFT JOIN nearest USING (dir)"""
