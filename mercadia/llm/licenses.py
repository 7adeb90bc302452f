"""Licence scans: TF-IDF cosine to notices, then inheritance from the nearest directory (operator 1). DataFrame functions only."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercadia.llm.common import WORD, materialize, n_words, table

#: Notices of well-known licences, as files and headers state them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FILE = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"
_TERMS = "[a-z0-9]+"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_TERMS), F.lit(0))


def weights(counts: dict[str, int], n_units: int, templates: tuple, threshold: float) -> tuple[dict[str, float], list[tuple], list[str], float]:
    """idf by term, (license, template, term, weight / norm) rows, key terms, and the idf of an unknown term.

    A unit without any key term of a template has a cosine to it below the threshold: what the template has
    outside its key terms is too short (Cauchy-Schwarz)."""
    split = [(name, Counter(re.findall(_TERMS, text.lower()))) for name, text in templates]
    idf = {t: math.log((1 + n_units) / (1 + counts.get(t, 0))) + 1 for _, c in split for t in c}
    rows, keys = [], set()
    for k, (name, c) in enumerate(split):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(name, k, t, n * idf[t] * idf[t] / norm) for t, n in sorted(c.items())]
        rest = 1.0
        for t in sorted(c, key=lambda t: (-c[t] * idf[t], t)):
            if rest < threshold**2 * 0.999:
                break
            keys.add(t)
            rest -= (c[t] * idf[t] / norm) ** 2
    return idf, rows, sorted(keys), math.log(1 + n_units) + 1


def scan(files: DataFrame, templates: tuple = TEMPLATES, threshold: float = 0.6) -> DataFrame:
    """(file_id, path, license, score, origin, from_dir) for every file.

    files: file_id, path, text. The units compared are the lines of every file, and licence files (LICENSE, COPYING,
    NOTICE) as a whole too. Weights are term frequency times ln((1 + units) / (1 + units with the term)) + 1, counted
    over the lines of all files; terms that no template has count only in a unit's length. A unit's cosine to some
    template of at least the threshold gives its file a licence, the best unit's (ties: the licence first by name).
    Only units with a key term are compared (see weights), which loses none. origin is header, or file for licence
    files; other files inherit the licence of the nearest directory at or above theirs that holds a licence file with
    one (best score, then name): inherited, with from_dir; else none. score has six decimals.

    Null texts are empty, a null path lies in the root. Files of equal file_id and path are one file with all their
    lines. An empty table gives an empty result; texts of any length are whole; extra columns are ignored.
    """
    spark = files.sparkSession
    path = F.coalesce("path", F.lit(""))
    given = files.select("file_id", path.alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    is_file = F.regexp_extract("path", r"([^/]*)$", 1).rlike(_FILE)
    lines = given.select("file_id", "path", is_file.alias("is_file"), "text", F.posexplode(F.split("text", "\n")).alias("unit", "line"))
    vocabulary = sorted({t for _, text in templates for t in re.findall(_TERMS, text.lower())})
    known = F.lit(vocabulary)
    seen = lines.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(known, terms(F.col("line"))))).alias("term"))
    counts = {r.term: r.n for r in seen.groupBy("term").agg(F.count("*").alias("n")).collect()}
    n_units = counts.pop("", 0)
    idf, rows, keys, unknown = weights(counts, n_units, templates, threshold)

    whole = given.where(is_file).select("file_id", "path", F.lit(True).alias("is_file"), F.lit(-1).alias("unit"), F.col("text").alias("line"))
    units = lines.select("file_id", "path", "is_file", "unit", "line").unionByName(whole).withColumn("terms", terms(F.col("line")))
    close = units.where(F.arrays_overlap("terms", F.lit(keys))).select("file_id", "path", "is_file", "unit", "terms")
    id_ = ["file_id", "path", "is_file", "unit"]
    each = close.select(*id_, F.explode("terms").alias("term")).groupBy(*id_, "term").agg(F.count("*").alias("tf"))
    table_ = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{t}', {float(v)!r}D)" for t, v in sorted(idf.items())) + " AS v(term, idf)")
    square = F.pow(F.col("tf") * F.coalesce("idf", F.lit(unknown)), 2)
    dots = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{t}', '{name}', {k}, {w!r}D)" for name, k, t, w in rows) + " AS v(term, license, template, weight)")
    weighed = materialize(each.join(F.broadcast(table_), "term", "left"))  # bounded by the templates' terms
    norms = weighed.groupBy(*id_).agg(F.sqrt(F.sum(square)).alias("norm"))
    scores = weighed.join(F.broadcast(dots), "term").groupBy(*id_, "license", "template").agg(F.sum(F.col("tf") * F.col("weight")).alias("dot"))
    best = (
        scores.join(norms, id_)
        .withColumn("score", F.round(F.col("dot") / F.col("norm"), 6))
        .where(F.col("score") >= threshold)
        .groupBy("file_id", "path", "is_file")
        .agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("best"))
    )
    own = materialize(best.select(F.col("file_id").alias("f"), F.col("path").alias("p"), "is_file", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("score")))

    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    held = own.where("is_file").select(F.regexp_extract("p", r"^(.*)/[^/]*$", 1).alias("held_dir"), "license", "score")
    held = held.groupBy("held_dir").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("held"))
    dirs = given.select(directory.alias("dir")).distinct()
    depth = F.size(F.split("dir", "/"))
    above = F.transform(F.sequence(F.lit(0), depth), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(F.split("dir", "/"), 1, i), "/").alias("above")))
    nearest = (
        dirs.select("dir", F.inline(above))
        .join(held, F.col("above") == F.col("held_dir"))
        .groupBy("dir").agg(F.max(F.struct("depth", "above", "held")).alias("near"))
        .select(F.col("dir").alias("in_dir"), F.col("near.above").alias("from_dir"), F.col("near.held.license").alias("inherited"), (-F.col("near.held.minus")).alias("inherited_score"))
    )
    every = given.select("file_id", "path", directory.alias("dir")).distinct()
    all_ = every.join(own, F.col("file_id").eqNullSafe(F.col("f")) & (F.col("path") == F.col("p")), "left").join(nearest, F.col("dir") == F.col("in_dir"), "left")
    has = F.col("license").isNotNull()
    return all_.select(
        "file_id", "path",
        F.coalesce("license", "inherited").alias("license"), F.coalesce("score", "inherited_score").alias("score"),
        F.when(has & F.col("is_file"), "file").when(has, "header").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~has, F.col("from_dir")).alias("from_dir"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths: they are filed by source, language and hundred; those of up to 40 words are LICENSE files."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(n_words(F.col("text")) <= 40, F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.floor(F.col("doc_id") / 100).cast("string"), name)
    found = scan(docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text"))
    return found.withColumnRenamed("file_id", "doc_id")


def _op1_sql() -> str:
    values = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))
    lowered = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH templates(k, license, text) AS (VALUES {values}),
template_terms AS (SELECT k, license, term, count(*) AS n FROM (SELECT k, license, unnest(regexp_extract_all({lowered.format('text')}, '{_TERMS}')) AS term FROM templates) GROUP BY ALL),
files AS (
  SELECT doc_id, coalesce(text, '') AS text,
    concat_ws('/', coalesce(source, 'unknown'), coalesce(lang, 'unknown'), CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR),
      CASE WHEN len(regexp_extract_all(coalesce(text, ''), '{WORD}')) <= 40 THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END) AS path,
    len(regexp_extract_all(coalesce(text, ''), '{WORD}')) <= 40 AS is_file
  FROM documents),
lines AS (SELECT doc_id, path, is_file, unnest(range(1, len(l) + 1)) AS unit, unnest(l) AS line FROM (SELECT *, string_split(text, chr(10)) AS l FROM files)),
tokens AS (
  SELECT doc_id, path, is_file, unit, unnest(regexp_extract_all({lowered.format('line')}, '{_TERMS}')) AS term
  FROM (SELECT doc_id, path, is_file, unit, line FROM lines UNION ALL SELECT doc_id, path, is_file, -1, text FROM files WHERE is_file)),
tf AS (SELECT doc_id, path, is_file, unit, term, count(*) AS tf FROM tokens GROUP BY ALL),
n AS (SELECT count(*) AS n FROM lines),
idf AS (
  SELECT v.term, ln((1 + n.n) / (1 + coalesce(c.n, 0))) + 1 AS idf
  FROM (SELECT DISTINCT term FROM template_terms) v CROSS JOIN n
  LEFT JOIN (SELECT term, count(*) AS n FROM tf WHERE unit > 0 GROUP BY term) c ON v.term = c.term),
template_norms AS (SELECT k, sqrt(sum((n * idf) ** 2)) AS norm FROM template_terms JOIN idf USING (term) GROUP BY k),
norms AS (SELECT doc_id, unit, sqrt(sum((tf * coalesce(idf, ln(1 + n.n) + 1)) ** 2)) AS norm FROM tf CROSS JOIN n LEFT JOIN idf USING (term) GROUP BY doc_id, unit),
scores AS (
  SELECT t.doc_id, t.path, t.is_file, x.license, round(sum(tf * x.n * idf * idf) / any_value(m.norm) / any_value(u.norm), 6) AS score
  FROM tf t JOIN template_terms x USING (term) JOIN idf USING (term) JOIN template_norms m ON x.k = m.k JOIN norms u ON u.doc_id = t.doc_id AND u.unit = t.unit
  GROUP BY t.doc_id, t.path, t.is_file, t.unit, x.k, x.license),
own AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) AS nth FROM scores WHERE score >= 0.6) WHERE nth = 1),
held AS (
  SELECT * FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, license, score, row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]*$', 1) ORDER BY score DESC, license) AS nth
    FROM own WHERE is_file) WHERE nth = 1),
placed AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files),
near AS (
  SELECT * FROM (SELECT p.doc_id, h.dir AS from_dir, h.license, h.score, row_number() OVER (PARTITION BY p.doc_id ORDER BY length(h.dir) DESC) AS nth
    FROM placed p JOIN held h ON p.dir = h.dir OR starts_with(p.dir, h.dir || '/') OR h.dir = '') WHERE nth = 1)
SELECT p.doc_id, p.path, coalesce(o.license, i.license) AS license, coalesce(o.score, i.score) AS score,
  CASE WHEN o.license IS NOT NULL AND p.is_file THEN 'file' WHEN o.license IS NOT NULL THEN 'header' WHEN i.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  CASE WHEN o.license IS NULL THEN i.from_dir END AS from_dir
FROM placed p LEFT JOIN own o ON p.doc_id = o.doc_id LEFT JOIN near i ON p.doc_id = i.doc_id
"""


OP1_SQL = _op1_sql()
