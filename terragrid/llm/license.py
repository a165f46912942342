"""License scans, in DataFrame operations only.

Files are cut into sentences, line by line and once more with the lines of a paragraph joined; a
sentence, and the whole text of a licence file, is a sparse TF-IDF vector, and its cosine to each
template says which licence it states.  A file without a notice of
its own inherits from the nearest ancestor directory whose licence file states one: directories,
not files, are joined with their ancestors' paths, and files then with their own directory.

Function words aren't terms.  Terms are weighted by their document frequency among the templates; a word of no template weighs as
much as one that occurs in a single template.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Licence names and the wording of their notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This source code form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
]
#: English function words.
STOP = "a and any are as be by for following in is of or that the this to under with without".split()
LICENCE_FILE = r"(?i)^(LICEN[CS]E|COPYING)(\.(txt|md))?$"
#: A cosine of this much states a licence.
LEAST = 0.7
#: A path or directory with more files than this, and than a thousandth of all, is dealt to several tasks.
HOT_ROWS = 100_000
#: Words of a vector: letters and digits, with inner dots, hyphens and pluses.  Ends of sentences.
WORD, END = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*", r"([.!?])[ \t\r\n]+"

#: A line after which a paragraph is cut: it ends with a colon, or it is a copyright line.
LAST = r"(?im)(?::[ \t]*|^[^a-z0-9\n]*(?:copyright|\(c\)|©)[^\n]*|all rights reserved\.?[ \t]*)$"
#: Lines without letters and digits between paragraphs; a line feed inside of one, with a comment mark that is a word.
GAP, INNER = r"\n[^\p{L}\p{N}]*\n", r"\n[ \t]*(?:(?i:rem|dnl)[ \t]+)?"


def weights() -> tuple[dict[str, float], list[tuple[int, str, float]], float]:
    """Idf of every template term; (template, term, weight of a vector of length 1); idf of other words."""
    bags = [Counter(t for t in re.findall(WORD, text.lower()) if t not in STOP) for _, text in TEMPLATES]
    df = Counter(t for bag in bags for t in bag)
    idf = {t: round(math.log((1 + len(bags)) / (1 + n)) + 1, 6) for t, n in df.items()}
    rows = []
    for k, bag in enumerate(bags):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
        rows += [(k, t, round(n * idf[t] / norm, 9)) for t, n in sorted(bag.items())]
    return idf, rows, round(math.log((1 + len(bags)) / 2) + 1, 6)


def telling(rows: list[tuple[int, str, float]]) -> list[str]:
    """Terms of which a vector needs at least one for a cosine of LEAST: what is left of a template
    without its heaviest terms is shorter than LEAST, and no cosine exceeds that length."""
    out = set()
    for k in {k for k, _, _ in rows}:
        mine = sorted(((w, t) for j, t, w in rows if j == k), reverse=True)
        left = sum(w * w for w, _ in mine)
        for w, t in mine:
            if math.sqrt(max(left, 0)) < LEAST * 0.999:
                break
            out.add(t)
            left -= w * w
    return sorted(out)


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


def vectors(spark: SparkSession) -> DataFrame:
    """``term, idf, v``: the weight of each template term in every template; of fixed size, so it may be broadcast."""
    idf, rows, _ = weights()
    of = {(t, k): w for k, t, w in rows}
    lines = ", ".join(f"({t!r}, {i!r}D, array({', '.join(f'{of.get((t, k), 0.0)!r}D' for k in range(len(TEMPLATES)))}))" for t, i in sorted(idf.items()))
    return spark.sql(f"SELECT * FROM VALUES {lines} AS t(term, idf, v)")


def folder(path: Column) -> Column:
    """The directory of a path, '' for the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def joined(text: Column) -> Column:
    """Sentences of a text whose lines are joined within each paragraph; comment marks are no words."""
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), LAST, "$0\n"), GAP, "\x01")
    return F.split(F.regexp_replace(F.regexp_replace(cut, INNER, " "), END, "$1\x01"), "\x01")


def stated(files: DataFrame) -> DataFrame:
    """``path, licence, score`` of the best notice of each file that states a licence."""
    _, rows, other = weights()
    any_term = "(?i)(^|[^a-z0-9])(" + "|".join(re.escape(t) for t in telling(rows)) + ")([^a-z0-9]|$)"
    hinted = files.where(F.col("text").rlike(any_term))
    sentences = F.split(F.regexp_replace("text", END, "$1\n"), "\n")
    whole = F.when(F.regexp_extract("path", r"[^/]*$", 0).rlike(LICENCE_FILE), F.array("text")).otherwise(F.array().cast("array<string>"))
    units = hinted.select("path", "text", F.posexplode(F.concat(F.filter(F.concat(sentences, F.array_except(joined(F.col("text")), sentences)), lambda s: s.rlike(any_term)), whole)).alias("unit", "said"))
    units = units.select("path", F.xxhash64("text", "unit").alias("unit"), "said")  # two files of one path aren't mixed
    # terms of a unit meet once; its norm and its products with all templates are sums of one aggregation
    said = units.select("path", "unit", F.explode(F.regexp_extract_all(F.lower("said"), F.lit(WORD), 0)).alias("term")).where(~F.col("term").isin(STOP)).repartition("path", "unit")
    tf = said.groupBy("path", "unit", "term").agg(F.count("*").cast("double").alias("tf"))
    weighed = tf.join(F.broadcast(vectors(files.sparkSession)), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    dots = [F.sum(F.col("w") * F.get("v", F.lit(k))).alias(f"dot{k}") for k in range(len(TEMPLATES))]
    summed = weighed.groupBy("path", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *dots)
    scores = F.array(*[F.struct(F.round(F.coalesce(F.col(f"dot{k}"), F.lit(0.0)) / F.col("norm"), 6).alias("score"), F.lit(-k).alias("first"), F.lit(name).alias("licence")) for k, (name, _) in enumerate(TEMPLATES)])
    best = summed.select("path", F.array_max(scores).alias("b")).where(F.col("b.score") >= LEAST)
    return best.groupBy("path").agg(F.max("b").alias("b")).select("path", "b.licence", "b.score")


def scan(files: DataFrame, id_col: str = "file_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``file_id, path, stated, score, licence, inherited_from`` of every file.

    ``stated`` is the licence of the file's own best notice, ``licence`` that one or the one of the
    nearest ancestor directory (its own directory first) with a licence file that states one, which
    ``inherited_from`` names.  A null or empty text states nothing; a null path neither states nor
    inherits.  Files of one path count together; a tie goes to the template listed first, in a
    directory to the licence of the higher score and then the first in order of its path.  Empty
    tables give an empty result.
    """
    rows = files.select(files[id_col].alias("file_id"), files[path_col].alias("path"), F.coalesce(files[text_col], F.lit("")).alias("text"))
    found = common.stored(stated(rows.where(F.col("path").isNotNull())), "found")  # used twice, made once
    grants = (
        found.where(F.regexp_extract("path", r"[^/]*$", 0).rlike(LICENCE_FILE))
        .groupBy(folder(F.col("path")).alias("dir"))
        .agg(F.min_by(F.struct("licence", "path"), F.struct((-F.col("score")).alias("s"), F.col("path"))).alias("g"))
        .select("dir", F.col("g.licence").alias("granted"))
    )
    dirs = rows.where(F.col("path").isNotNull()).select(folder(F.col("path")).alias("own")).distinct()
    parts = F.split("own", "/")
    up = dirs.select("own", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("dir")).distinct()
    near = up.join(grants, "dir").groupBy("own").agg(F.max_by(F.struct("granted", "dir"), F.length("dir")).alias("n")).select("own", "n.granted", F.col("n.dir").alias("from"))
    placed = rows.where(F.col("path").isNotNull()).select("file_id", "path", folder(F.col("path")).alias("own"))
    # a directory, or a path, may hold a large share of all files: such keys are dealt to several tasks
    of_path, of_dir = (placed.groupBy(c).agg(F.count("*").alias("size")) for c in ("path", "own"))
    total = placed.count()
    out = common.joined(placed, found, common.hot(of_path, "path", total, HOT_ROWS), "path", "file_id", "left")
    out = common.joined(out, near, common.hot(of_dir, "own", total, HOT_ROWS), "own", "file_id", "left")
    out = out.select(
        "file_id", "path", F.col("licence").alias("stated"), "score", F.coalesce("licence", "granted").alias("licence"), F.when(F.col("licence").isNull(), F.col("from")).alias("inherited_from")
    )
    nothing = rows.where(F.col("path").isNull()).select("file_id", "path", *(F.lit(None).cast(t).alias(c) for c, t in (("stated", "string"), ("score", "double"), ("licence", "string"), ("inherited_from", "string"))))
    return out.unionByName(nothing)


def scan_sql(files: str) -> str:
    """The same for DuckDB, over a query that gives file_id, path, text."""
    idf, rows, other = weights()
    named = [(k, TEMPLATES[k][0], t, w) for k, t, w in rows]
    return rf"""
WITH files AS ({files}),
terms(template, licence, term, weight) AS (VALUES {values(named)}),
idfs(term, idf) AS (VALUES {values(sorted(idf.items()))}),
units AS (
  SELECT path, regexp_matches(path, '(^|/)(LICENSE|LICENCE|COPYING)(\.(txt|md))?$', 'i') AS lf,
    unnest(list_concat(string_split(regexp_replace(text, '{END}', '\1' || chr(10), 'g'), chr(10)), CASE WHEN regexp_matches(path, '(^|/)(LICENSE|LICENCE|COPYING)(\.(txt|md))?$', 'i') THEN [text] ELSE [] END)) AS said,
    unnest(range(len(list_concat(string_split(regexp_replace(text, '{END}', '\1' || chr(10), 'g'), chr(10)), CASE WHEN regexp_matches(path, '(^|/)(LICENSE|LICENCE|COPYING)(\.(txt|md))?$', 'i') THEN [text] ELSE [] END)))) AS unit
  FROM files
), words AS (SELECT path, unit, unnest(regexp_extract_all(lower(said), '{WORD}')) AS term FROM units),
tf AS (SELECT path, unit, term, CAST(count(*) AS DOUBLE) AS tf FROM words WHERE term NOT IN ({', '.join(repr(t) for t in STOP)}) GROUP BY ALL),
weighed AS (SELECT tf.path, tf.unit, tf.term, tf.tf * coalesce(CAST(i.idf AS DOUBLE), CAST({other} AS DOUBLE)) AS w FROM tf LEFT JOIN idfs i ON tf.term = i.term),
norms AS (SELECT path, unit, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
dots AS (SELECT w.path, w.unit, t.template, t.licence, sum(w.w * CAST(t.weight AS DOUBLE)) AS dot FROM weighed w JOIN terms t ON w.term = t.term GROUP BY ALL),
scores AS (SELECT d.path, d.template, d.licence, round(d.dot / n.norm, 6) AS score FROM dots d JOIN norms n ON d.path = n.path AND d.unit = n.unit WHERE round(d.dot / n.norm, 6) >= {LEAST}),
found AS (SELECT path, licence, score FROM scores QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, template) = 1),
grants AS (
  SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, licence FROM found WHERE regexp_matches(path, '(^|/)(LICENSE|LICENCE|COPYING)(\.(txt|md))?$', 'i')
  QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY score DESC, path) = 1
), dirs AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS own FROM files),
near AS (SELECT d.own, g.dir, g.licence FROM dirs d JOIN grants g ON d.own = g.dir OR starts_with(d.own, g.dir || '/') QUALIFY row_number() OVER (PARTITION BY d.own ORDER BY length(g.dir) DESC) = 1)
SELECT f.file_id, f.path, s.licence AS stated, s.score, coalesce(s.licence, n.licence) AS licence, CASE WHEN s.licence IS NULL THEN n.dir END AS inherited_from
FROM files f LEFT JOIN found s ON f.path = s.path LEFT JOIN near n ON regexp_replace(f.path, '/?[^/]*$', '') = n.own
"""


def corpus_path(i: Column) -> Column:
    """Documents as a tree of files, sixteen a directory; the first of a directory is its licence file."""
    a, b, c = (F.floor(i / n).cast("long") for n in (4096, 256, 16))
    parts = [F.when(i % n != 0, F.concat(F.lit(f"/{name}"), (x % 16).cast("string"))).otherwise("") for n, name, x in ((4096, "b", b), (256, "c", c))]
    return reduce(F.concat, [F.lit("corpus/a"), a.cast("string"), *parts, F.when(i % 16 == 0, F.lit("/LICENSE")).otherwise(F.concat(F.lit("/"), i.cast("string"), F.lit(".txt")))])


#: The same in SQL.
CORPUS_PATH_SQL = """'corpus/a' || CAST(doc_id // 4096 AS VARCHAR) || CASE WHEN doc_id % 4096 <> 0 THEN '/b' || CAST(doc_id // 256 % 16 AS VARCHAR) ELSE '' END
  || CASE WHEN doc_id % 256 <> 0 THEN '/c' || CAST(doc_id // 16 % 16 AS VARCHAR) ELSE '' END || CASE WHEN doc_id % 16 = 0 THEN '/LICENSE' ELSE '/' || CAST(doc_id AS VARCHAR) || '.txt' END"""
