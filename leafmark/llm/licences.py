"""Licence scan: what a file's text says, else what its nearest directory above says.

Every line and every block between blank lines of a whole text is a segment (headers are segments wherever they
stand). Segments and licence templates are sparse TF-IDF vectors over lower-case runs of letters and digits; the
inverse document frequencies count all given files. A segment has the licence of the template with the greatest
cosine, if that reaches the threshold; a file has the licence of its best segment.

Only segments that can reach the threshold are looked at: from each template the heaviest terms are taken until
the rest of its vector is shorter than threshold times its length. By Cauchy-Schwarz a segment without any of
these anchors stays below the threshold for every template, so leaving it out changes nothing.

A licence file - by its name, or because a segment with a licence makes up half of its words - gives its licence to
its directory; the best of several licence files counts, ties go by licence and path. A file without a licence of
its own takes that of the nearest directory above it that has one: every directory meets its ancestors in a join
by path, and files join their directory's result.

Defined results: null texts are empty, null paths are in the root and have the name null; neither has a licence
of its own unless its text says so. Repeated rows each get a result. Rows are joined by directory, so a directory
with a third of all files is split by adaptive execution.
"""

from __future__ import annotations

import math
import re
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import stored

THRESHOLD = 0.6
COVERAGE = 0.5
LICENCE_NAME = r"(?i)^(un)?licen[cs]es?([._-].*)?$|(?i)^(copying|copyright)([._-].*)?$"

# Well-known notices by licence.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved. Proprietary and confidential."),
    # a short notice has a template of its own: within a longer one its cosine falls as the other terms' idf grows
    ("Proprietary", "All rights reserved."),
]


def terms_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})))


def _terms(text):
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[^a-z0-9]+"), lambda x: x != "")


def frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """The number of files, and for each template term how many of them have it: one row a term comes back."""
    known = F.array(*[F.lit(t) for t in vocabulary])
    present = files.select(F.explode(F.array_intersect(F.array_distinct(_terms(F.col("text"))), known)).alias("term"))
    rows = present.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()
    return files.count(), {r["term"]: r["n"] for r in rows}


def template_vectors(n: int, found: dict[str, int], templates=TEMPLATES) -> tuple[dict[str, float], float, list[tuple[str, dict[str, float]]]]:
    """Idf of the terms, idf of any other term, and each template's unit vector. Templates count as files."""
    total = n + len(templates)
    sets = [set(terms_of(t)) for _, t in templates]
    vocabulary = sorted(set(chain.from_iterable(sets)))
    idf = {t: math.log((1 + total) / (1 + found.get(t, 0) + sum(t in s for s in sets))) + 1 for t in vocabulary}
    vectors = []
    for licence, text in templates:
        terms = terms_of(text)
        weights = {t: terms.count(t) * idf[t] for t in terms}
        length = math.sqrt(sum(w * w for w in weights.values()))
        vectors.append((licence, {t: w / length for t, w in weights.items()}))
    return idf, math.log(1 + total) + 1, vectors


def anchors_of(vectors: list[tuple[str, dict[str, float]]], threshold: float) -> list[str]:
    """The heaviest terms of each template, until what is left of it is shorter than the threshold."""
    out: set[str] = set()
    for _, vector in vectors:
        rest = 1.0
        for term, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if rest < threshold * threshold * (1 - 1e-9):
                break
            out.add(term)
            rest -= w * w
    return sorted(out)


def segments(files: DataFrame, anchors: list[str]) -> DataFrame:
    """``(row, path, words, segment)`` of the segments with an anchor; ``words`` counts the file's words."""
    blocks = F.split("text", r"\n[\x20\x09\r]*\n")
    parts = F.array_distinct(F.concat(F.split("text", r"\n"), F.filter(blocks, lambda x: F.contains(x, F.lit("\n")))))
    pattern = rf"(?i)(?<![a-z0-9])({'|'.join(anchors)})(?![a-z0-9])"
    having = F.filter(parts, lambda x: F.regexp_like(x, F.lit(pattern)))
    some = files.where(F.regexp_like("text", F.lit(pattern)))
    return some.select("row", "path", F.size(_terms(F.col("text"))).alias("words"), F.explode(having).alias("segment"))


def own_licences(files: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """``(row, licence, similarity, covered, words)`` of the files ``(row, path, text)`` whose text names a licence."""
    spark = files.sparkSession
    n, found = frequencies(files, sorted(set(chain.from_iterable(terms_of(t) for _, t in templates))))
    idf, other, vectors = template_vectors(n, found, templates)
    parts = stored(segments(files, anchors_of(vectors, threshold)).withColumn("part", F.monotonically_increasing_id()), "segments")
    weights = spark.createDataFrame([(k, lic, t, w) for k, (lic, v) in enumerate(vectors) for t, w in v.items()], "template int, licence string, term string, weight double")
    idfs = spark.createDataFrame(list(idf.items()), "term string, idf double")
    counts = parts.select("part", F.explode(_terms(F.col("segment"))).alias("term")).groupBy("part", "term").agg(F.count(F.lit(1)).alias("tf"))
    # the tables of template terms have a few hundred rows, whatever the input
    weighed = stored(counts.join(F.broadcast(idfs), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other))), "weights")
    norms = weighed.groupBy("part").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("terms"))
    dots = weighed.join(F.broadcast(weights), "term").groupBy("part", "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, "part").withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("similarity") >= threshold)
    best = scored.groupBy("part").agg(
        F.min(F.struct((-F.col("similarity")).alias("minus"), "licence")).alias("best"), F.max("terms").alias("terms")
    )
    named = parts.select("part", "row", "words").join(best, "part")
    return named.groupBy("row").agg(
        F.min("best").alias("best"), F.max("words").alias("words"), F.max("terms").alias("terms")
    ).select("row", F.col("best.licence").alias("licence"), (-F.col("best.minus")).alias("similarity"), (F.col("terms") >= COVERAGE * F.col("words")).alias("covered"))


def scan(files: DataFrame, keep: list[str], path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """The ``keep`` columns and ``path`` of every row, with ``licence``, ``origin`` (text, directory or none),
    ``similarity`` of the file's own text and ``from_directory``."""
    given = files.select(*[F.col(c).alias(f"_keep_{c}") for c in keep], F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    path = F.coalesce("path", F.lit(""))
    directory = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    keyed = given.withColumn("row", F.xxhash64("path", "text")).withColumn("row2", F.xxhash64(F.lit(2), "path", "text"))
    texts = keyed.select(F.struct("row", "row2").alias("row"), "path", "text")
    own = stored(own_licences(texts, threshold, templates).groupBy("row").agg(F.min(F.struct("licence", "similarity", "covered")).alias("own")), "own")
    narrow = keyed.drop("text").withColumn("row", F.struct("row", "row2")).drop("row2")
    rows = stored(narrow.join(own, "row", "left").select(*narrow.columns, "own.*", directory.alias("directory"), name.alias("name")), "files")
    giving = rows.where(F.col("licence").isNotNull() & (F.regexp_like("name", F.lit(LICENCE_NAME)) | F.col("covered")))
    given_by = giving.groupBy("directory").agg(F.min(F.struct((-F.col("similarity")).alias("minus"), "licence", "path")).alias("best"))
    given_by = stored(given_by.select(F.col("directory").alias("above"), F.col("best.licence").alias("given")), "directories")
    parts = F.split("directory", "/")
    levels = F.sequence(F.lit(0), F.size(parts))
    above = F.transform(levels, lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("above")))
    folders = rows.select("directory").distinct().select("directory", F.explode(above).alias("x")).select("directory", "x.depth", "x.above")
    nearest = folders.join(given_by, "above").groupBy("directory").agg(F.max(F.struct("depth", "above", "given")).alias("near"))
    nearest = stored(nearest.select("directory", "near.above", "near.given"), "nearest")
    origin = F.when(F.col("licence").isNotNull(), "text").when(F.col("given").isNotNull(), "directory").otherwise("none")
    return rows.join(nearest, "directory", "left").select(
        *[F.col(f"_keep_{c}").alias(c) for c in keep], "path",
        F.coalesce("licence", "given").alias("licence"), origin.alias("origin"), "similarity",
        F.when(origin == "directory", F.col("above")).alias("from_directory"),
    )
