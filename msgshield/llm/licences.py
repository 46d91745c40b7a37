"""Licence scan: TF-IDF cosine of lines and licence files to templates, then inheritance from the nearest directory.

Every line of a text, every run of consecutive lines up to twice the longest template, and the whole text of a licence
file, is compared with the notices below by the cosine of sparse TF-IDF vectors; so are the paragraphs that licence texts
and headers consist of, and in licence files their titles. Only texts that hold a key term of a template are looked at: without any of them the cosine cannot reach the
threshold. Equal texts are scanned once. A file without a notice of its own inherits from the nearest directory above
it that holds a licence file; directories are resolved once each, by a join on their ancestors. Everything is a
built-in function.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# Usual one-line notices with their SPDX names.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
]
_GNU = (
    "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by "
    "the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
)
# Paragraphs that tell a licence by themselves, in any file.
PARAGRAPHS = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-2.0", _GNU.format("This program", "General Public License", "2")),
    ("GPL-3.0", _GNU.format("This program", "General Public License", "3")),
    ("LGPL-2.1", _GNU.format("This library", "Lesser General Public License", "2.1")),
    ("LGPL-3.0", _GNU.format("This program", "Lesser General Public License", "3")),
    ("AGPL-3.0", _GNU.format("This program", "Affero General Public License", "3")),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
]
# How the texts of licences begin; they count in licence files only.
TITLES = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
]
THRESHOLD = 0.8
TERM = "[a-z0-9]+"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)\b"


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def vocabulary(templates: list[tuple[str, str]]) -> list[str]:
    return sorted({t for _, text in templates for t in terms(text)})


VOCABULARY = vocabulary(TEMPLATES)
ALL_TERMS = vocabulary(TEMPLATES + PARAGRAPHS + TITLES)


def document_frequency(texts: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of texts (column ``text``), and of those that hold each term of the templates."""
    held = F.array_intersect(
        F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))), F.array(*[F.lit(t) for t in ALL_TERMS])
    )
    # An empty term stands for the text itself.
    rows = texts.select(F.explode(F.concat(F.array(F.lit("")), F.coalesce(held, F.array().cast("array<string>")))).alias("term"))
    counts = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    return counts.get("", 0), {t: counts.get(t, 0) for t in ALL_TERMS}


def idf(total: int, df: int) -> float:
    """Weight of a term; a term outside the templates counts as one that a single text holds."""
    return math.log((1 + total) / (1 + df)) + 1.0


def template_vectors(
    total: int, df: dict[str, int], templates: list[tuple[str, str]] = TEMPLATES
) -> list[dict[str, float]]:
    """Unit TF-IDF vectors of the templates."""
    out = []
    for _, text in templates:
        vector = {t: n * idf(total, df[t]) for t, n in Counter(terms(text)).items()}
        norm = math.sqrt(sum(w * w for w in vector.values()))
        out.append({t: w / norm for t, w in vector.items()})
    return out


def key_terms(vectors: list[dict[str, float]], threshold: float) -> list[str]:
    """Terms of which a text must hold one to reach the threshold with any template: the heaviest of each template, until
    the rest of its vector is shorter than the threshold."""
    keys: set[str] = set()
    for vector in vectors:
        left = 1.0
        for term, weight in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if left < (threshold * 0.999) ** 2:
                break
            keys.add(term)
            left -= weight * weight
    return sorted(keys)


def line_runs(rows: DataFrame, words: int) -> DataFrame:
    """``rows`` (h1, h2, whole, text) -> (h1, h2, whole, unit, line): every run of two or more consecutive lines that has
    at most ``words`` words; lines without a word are left out first. Units are negative."""
    lines = F.filter(F.split(F.lower("text"), "\n"), lambda x: x.rlike("[a-z0-9]"))
    each = rows.select("h1", "h2", "whole", F.posexplode(lines).alias("place", "line"))
    # A longer line is in no run.
    each = each.withColumn("n", F.regexp_count("line", F.lit(TERM)))
    each = each.withColumn("line", F.when(F.col("n") < words, F.col("line")).otherwise(""))
    ahead = Window.partitionBy("h1", "h2", "whole").orderBy("place").rowsBetween(1, words - 1)
    each = each.withColumn("ahead", F.collect_list(F.struct("line", "n")).over(ahead)).filter(F.col("n") < words)
    start = F.struct(F.col("line").alias("line"), F.col("n").alias("n"), F.array().cast("array<string>").alias("out"))

    def longer(run: Column, x: Column) -> Column:
        line, n = F.concat(run["line"], F.lit("\n"), x["line"]), run["n"] + x["n"]
        grown = F.struct(line.alias("line"), n.alias("n"), F.concat(run["out"], F.array(line)).alias("out"))
        over = F.struct(run["line"].alias("line"), n.alias("n"), run["out"].alias("out"))
        return F.when(n <= words, grown).otherwise(over)

    runs = each.select("h1", "h2", "whole", "place", F.aggregate("ahead", start, longer)["out"].alias("runs"))
    runs = runs.select("h1", "h2", "whole", "place", F.posexplode("runs").alias("k", "line"))
    return runs.select("h1", "h2", "whole", (-1 - F.col("place").cast("long") * words - F.col("k")).alias("unit"), "line")


def cosines(
    texts: DataFrame, templates: list[tuple[str, str]], total: int, df: dict[str, int], threshold: float
) -> DataFrame:
    """``texts`` (h1, h2, text, whole) -> (h1, h2, whole, template, cosine) of all units that reach the threshold."""
    spark = texts.sparkSession
    vectors = template_vectors(total, df, templates)
    keys = "|".join(key_terms(vectors, threshold))
    weights = spark.createDataFrame(
        [(k, t, w) for k, v in enumerate(vectors) for t, w in sorted(v.items())], "template int, term string, weight double"
    )
    known = vocabulary(templates)
    common = spark.createDataFrame([(t, idf(total, df[t])) for t in known], "term string, idf double")
    has_key = f"(?:^|[^a-z0-9])(?:{keys})(?:[^a-z0-9]|$)"
    rows = texts.filter(F.lower("text").rlike(has_key)).groupBy("h1", "h2", "whole").agg(F.first("text").alias("text"))
    lines = F.split(F.lower("text"), "\n")
    units = F.when(F.col("whole"), F.concat(lines, F.array(F.lower("text")))).otherwise(lines)
    units = rows.select("h1", "h2", "whole", F.posexplode(units).alias("unit", "line"))
    # A cosine is at most the length of the part of the template whose terms occur: a text that holds less has no run.
    held = F.array_intersect(
        F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))), F.array(*[F.lit(t) for t in known])
    )
    squares = F.array(*[F.create_map(*[F.lit(x) for t, w in sorted(v.items()) for x in (t, w * w)]) for v in vectors])
    enough = F.exists(
        squares,
        lambda m: F.aggregate(held, F.lit(0.0), lambda a, t: a + F.coalesce(m[t], F.lit(0.0))) >= (threshold * 0.999) ** 2,
    )
    runs = line_runs(rows.filter(enough), 2 * max(len(terms(text)) for _, text in templates))
    units = units.withColumn("unit", F.col("unit").cast("long")).unionByName(runs)
    units = units.filter(F.col("line").rlike(has_key))
    unit = ["h1", "h2", "whole", "unit"]
    counts = units.select(*unit, F.explode(F.regexp_extract_all("line", F.lit(TERM), F.lit(0))).alias("term"))
    counts = counts.groupBy(*unit, "term").agg(F.count(F.lit(1)).alias("tf"))
    counts = counts.join(F.broadcast(common), "term", "left").withColumn(
        "w", F.col("tf") * F.coalesce("idf", F.lit(idf(total, 1)))
    )
    norms = counts.groupBy(*unit).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = counts.join(F.broadcast(weights), "term").groupBy(*unit, "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    found = dots.join(norms, unit).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 9))
    return found.filter(F.col("cosine") >= threshold).select("h1", "h2", "whole", "template", "cosine")


def scan(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``texts`` (h1, h2, text, whole) -> (h1, h2, whole, licence, cosine) of those that reach the threshold.

    Every line and every run of lines is a unit, and where ``whole`` is true the text as well. The template with the
    highest cosine wins, of equal ones the first; cosines are compared after rounding to nine digits.
    """
    total, df = document_frequency(texts.select("text"))
    found, first = None, 0
    for templates, where in ((TEMPLATES, F.lit(True)), (PARAGRAPHS, F.lit(True)), (TITLES, F.col("whole"))):
        part = cosines(texts.filter(where), templates, total, df, threshold)
        part = part.withColumn("template", F.col("template") + first)
        found, first = part if found is None else found.unionByName(part), first + len(templates)
    best = found.groupBy("h1", "h2", "whole").agg(F.max(F.struct("cosine", (-F.col("template")).alias("place"))).alias("best"))
    names = F.array(*[F.lit(name) for name, _ in TEMPLATES + PARAGRAPHS + TITLES])
    return best.select(
        "h1", "h2", "whole", F.element_at(names, 1 - F.col("best.place")).alias("licence"), F.col("best.cosine").alias("cosine")
    )


def directory(path: Column) -> Column:
    """The folder of a path, without a trailing slash; the top is the empty string."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def inherited(directories: DataFrame, holders: DataFrame) -> DataFrame:
    """(dir, from_dir, licence): for each directory the nearest one at or above it among ``holders`` (dir, licence)."""
    parts = F.split("dir", "/")
    above = F.transform(
        F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))),
        lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("from_dir")),
    )
    chain = directories.select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.from_dir")
    found = chain.join(holders.select(F.col("dir").alias("from_dir"), "licence"), "from_dir")
    near = found.groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "licence")).alias("near"))
    return near.select("dir", "near.from_dir", "near.licence")


def scan_files(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``files`` (file_id, path, text) -> file_id, path, licence, cosine, effective, from_dir, one row a file.

    licence: the notice found in the file itself, or null; effective: that, or the inherited one; from_dir: the
    directory inherited from. A licence file gives its directory the notice found in it; of several the one with the
    highest cosine, then the least path. Null texts hold no notice, null paths inherit nothing and lie in no
    directory. Repeated rows stay. Other columns are ignored.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    whole = F.coalesce(name.rlike(LICENCE_FILE), F.lit(False))
    rows = files.select("file_id", "path", "text", whole.alias("whole"))
    rows = rows.withColumns({"h1": F.xxhash64(F.lit(1), "text"), "h2": F.xxhash64(F.lit(2), "text")})
    found = stored(scan(rows.select("h1", "h2", "text", "whole"), threshold), "notices")
    own = stored(rows.drop("text").join(found, ["h1", "h2", "whole"], "left").drop("h1", "h2"), "scanned")
    own = own.withColumn("dir", directory(F.col("path")))
    holders = own.filter("whole AND licence IS NOT NULL AND path IS NOT NULL")
    # The highest cosine, then the least path: two steps, as a struct has one direction.
    highest = holders.groupBy("dir").agg(F.max("cosine").alias("cosine"))
    holders = holders.join(highest, ["dir", "cosine"]).groupBy("dir").agg(F.min(F.struct("path", "licence")).alias("first"))
    holders = holders.select("dir", F.col("first.licence").alias("licence"))
    near = inherited(own.filter("path IS NOT NULL").select("dir").distinct(), holders)
    near = near.select("dir", "from_dir", F.col("licence").alias("dir_licence"))
    return own.join(near, "dir", "left").select(
        "file_id", "path", "licence", F.round("cosine", 6).alias("cosine"),
        F.coalesce("licence", "dir_licence").alias("effective"),
        F.when(F.col("licence").isNull(), F.col("from_dir")).alias("from_dir"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """The documents as files: folders by source, language and number; a text with a line that opens like a notice is a
    licence file if its doc_id is even, of the source's folder if that is divisible by 3."""
    opening = r"(?im)^(licensed under|released under|this work is licensed|this project is licensed)"
    top = F.col("source")
    folder = F.concat_ws("/", top, F.col("lang"), (F.col("doc_id") % 8).cast("string"))
    begins = F.coalesce(F.col("text").rlike(opening) & (F.col("doc_id") % 2 == 0), F.lit(False))
    holder = F.when(F.col("doc_id") % 3 == 0, top).otherwise(folder)
    number = F.col("doc_id").cast("string")
    path = F.when(begins, F.concat(holder, F.lit("/LICENSE."), number)).otherwise(F.concat(folder, F.lit("/"), number, F.lit(".txt")))
    return docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text")


def _values(rows: list[tuple]) -> str:
    quoted = [", ".join("'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) for r in rows]
    return ", ".join(f"({r})" for r in quoted)


ORACLE = f"""
WITH templates(template, licence, text) AS (VALUES {_values([(k, n, t) for k, (n, t) in enumerate(TEMPLATES)])}),
template_terms AS (
  SELECT template, term, count(*) AS tf
  FROM (SELECT template, unnest(regexp_extract_all(lower(text), '{TERM}')) AS term FROM templates) GROUP BY ALL),
vocabulary AS (SELECT DISTINCT term FROM template_terms),
total AS (SELECT count(*) AS n FROM documents),
df AS (
  SELECT term, count(*) AS df
  FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{TERM}'))) AS term FROM documents)
  WHERE term IN (SELECT term FROM vocabulary) GROUP BY term),
idf AS (
  SELECT term, ln((1.0 + n) / (1.0 + coalesce(df, 0))) + 1 AS idf FROM vocabulary CROSS JOIN total LEFT JOIN df USING (term)),
template_weights AS (SELECT template, term, tf * idf AS w FROM template_terms JOIN idf USING (term)),
vectors AS (
  SELECT template, term, w / sqrt(s) AS weight
  FROM template_weights JOIN (SELECT template, sum(w * w) AS s FROM template_weights GROUP BY template) USING (template)),
files AS (
  SELECT doc_id AS file_id, text, coalesce(doc_id % 2 = 0 AND regexp_matches(text,
    '(?im)^(licensed under|released under|this work is licensed|this project is licensed)'), false) AS whole,
    source, source || '/' || lang || '/' || (doc_id % 8) AS folder FROM documents),
placed AS (
  SELECT file_id, text, whole, CASE WHEN whole AND file_id % 3 = 0 THEN source ELSE folder END AS dir,
    CASE WHEN whole THEN (CASE WHEN file_id % 3 = 0 THEN source ELSE folder END) || '/LICENSE.' || file_id
         ELSE folder || '/' || file_id || '.txt' END AS path FROM files),
units AS (
  SELECT file_id, unnest(range(1, len(l) + 1)) AS unit, unnest(l) AS line
  FROM (SELECT file_id, CASE WHEN whole THEN list_append(string_split(lower(text), chr(10)), lower(text))
                             ELSE string_split(lower(text), chr(10)) END AS l FROM placed)),
near_units AS (SELECT * FROM units WHERE regexp_matches(line, 'licen|public|domain|redistribute|cc|mit|apache|gnu|bsd|mozilla')),
counts AS (
  SELECT file_id, unit, term, count(*) AS tf
  FROM (SELECT file_id, unit, unnest(regexp_extract_all(line, '{TERM}')) AS term FROM near_units) GROUP BY ALL),
weighted AS (
  SELECT file_id, unit, term, tf * coalesce(idf, ln((1.0 + n) / 2.0) + 1) AS w
  FROM counts LEFT JOIN idf USING (term) CROSS JOIN total),
norms AS (SELECT file_id, unit, sqrt(sum(w * w)) AS norm FROM weighted GROUP BY ALL),
cosines AS (
  SELECT file_id, template, round(sum(w * weight) / any_value(norm), 9) AS cosine
  FROM weighted JOIN vectors USING (term) JOIN norms USING (file_id, unit) GROUP BY file_id, unit, template),
best AS (
  SELECT file_id, licence, cosine FROM cosines JOIN templates USING (template) WHERE cosine >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY cosine DESC, template) = 1),
own AS (SELECT file_id, path, dir, whole, licence, cosine FROM placed LEFT JOIN best USING (file_id)),
holders AS (
  SELECT dir, licence AS dir_licence FROM own WHERE whole AND licence IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, path) = 1),
near AS (
  SELECT d.dir, h.dir AS from_dir, dir_licence FROM (SELECT DISTINCT dir FROM own) d
  JOIN holders h ON d.dir = h.dir OR starts_with(d.dir, h.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(h.dir) DESC) = 1)
SELECT file_id, path, licence, round(cosine, 6) AS cosine, coalesce(licence, dir_licence) AS effective,
  CASE WHEN licence IS NULL THEN from_dir END AS from_dir
FROM own LEFT JOIN near USING (dir)
"""
