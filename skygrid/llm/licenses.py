"""License scan: MinHash bands over overlapping windows, exact containment.

A text is cut into words (lower case, letters and digits) and five-word
shingles. Windows of each size class overlap by two thirds, so a notice of the
class lies whole in one of them. A window's band keys are minima of its
shingle hashes under different seeds; the templates' keys are a broadcast table
whose size is fixed by the list below. The number of bands of a class is set so
that a window holding at least the required share of a template's shingles
meets it with probability ``1 - miss``. Every candidate is verified by the exact
share of the template's shingles that the window holds.

All of it is column expressions. Windows without a single shingle of any
template cannot share a band with one, so texts without any are left out before
windows are formed. No shuffle but the final best match by text and license.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

# Common license notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without written permission."),
]

SHINGLE = 5
SHARE = 0.8
SPLIT = r"[^\p{L}\p{N}]+"


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_", text.lower()) if w]


def classes(templates=None) -> list[tuple[int, int, int]]:
    """(longest template words, window words, stride) of each size class; any
    run of so many words lies whole in some window."""
    top, out = 6, []
    longest = max(len(template_words(t)) for _, t in templates or TEMPLATES)
    while True:
        stride = max(2, top // 2)
        out.append((top, top + stride - 1, stride))
        if top >= longest:
            return out
        top = top * 3 // 2


def bands_for(words: int, window: int, share: float, miss: float) -> int:
    """Bands that a window of ``window`` words holding ``share`` of a template of
    ``words`` words fails to meet with probability ``miss`` at most."""
    m, w = words - SHINGLE + 1, window - SHINGLE + 1
    need = math.ceil(share * m)
    jaccard = need / (m + w - need)
    return math.ceil(math.log(miss) / math.log(1 - jaccard))


def words_column(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")


def shingles_column(words: Column) -> Column:
    n = F.size(words) - (SHINGLE - 1)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))
    return F.when(n > 0, each).otherwise(F.array().cast("array<bigint>"))


def _band(shingles: Column, seed: int) -> Column:
    return F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(seed))))


def _window(top: int, width: int):
    return lambda s: F.struct(F.lit(top).alias("class"), s.alias("start"), F.slice("shingles", s, width).alias("held"))


def scan(docs: DataFrame, templates=None, share: float = SHARE, miss: float = 1e-4) -> DataFrame:
    """(doc_id, license, template, share, start): for each document and license
    its best matching template and the first word of the window that holds it.

    Texts below five words, null texts included, hold no license; rows that
    repeat a doc_id count as one document; an empty table gives no rows; extra
    columns are ignored.
    """
    spark = docs.sparkSession
    templates = templates or TEMPLATES
    rows = []
    for i, (license_, text) in enumerate(templates):
        w = template_words(text)
        rows.append((i, license_, w, next(c for c in classes(templates) if c[0] >= len(w))[0]))
    known = spark.createDataFrame(rows, "template int, license string, words array<string>, class int")
    known = known.select("template", "license", "class", F.array_distinct(shingles_column(F.col("words"))).alias("needed"))
    every = [r["h"] for r in known.select(F.explode("needed").alias("h")).distinct().orderBy("h").collect()]  # a few hundred

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_column(F.coalesce("text", F.lit(""))).alias("words"))
    # explode of one: the optimizer would otherwise copy the expression to each of its uses
    base = base.select("doc_id", F.explode(F.array("words")).alias("words"))
    base = base.select("doc_id", F.explode(F.array(shingles_column(F.col("words")))).alias("shingles"))
    base = base.where(F.arrays_overlap("shingles", F.array(*[F.lit(h) for h in every])))

    bands, spans = {}, []
    for top, window, stride in classes(templates):
        mine = [len(r[2]) for r in rows if r[3] == top]
        if mine:
            bands[top] = max(bands_for(n, window, share, miss) for n in mine)
            starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("shingles")), F.lit(stride))
            spans.append(F.transform(starts, _window(top, window - SHINGLE + 1)))
    windows = base.select("doc_id", F.explode(F.concat(*spans)).alias("w")).select("doc_id", "w.class", "w.start", "w.held")
    windows = windows.where(F.arrays_overlap("held", F.array(*[F.lit(h) for h in every])))

    most = max(bands.values())
    number = F.create_map(*[x for c, n in bands.items() for x in (F.lit(c), F.lit(n))])

    def keys(shingles: str) -> Column:
        all_ = F.array(*[F.struct(F.lit(j).alias("band"), _band(F.col(shingles), j).alias("key")) for j in range(most)])
        return F.slice(all_, F.lit(1), number[F.col("class")])

    left = windows.select("*", F.explode(keys("held")).alias("b"))
    right = known.select("template", "license", "class", "needed", F.explode(keys("needed")).alias("b"))
    # the template table's size is fixed by the list of templates
    met = left.join(F.broadcast(right), (left["b"] == right["b"]) & (left["class"] == right["class"]))
    part = F.size(F.array_intersect("held", "needed")) / F.size("needed")
    found = met.select("doc_id", "license", "template", part.alias("share"), (F.col("start") - 1).alias("start")).where(F.col("share") >= share)
    best = F.max_by(F.struct("template", "share", "start"), F.struct("share", -F.col("template"), -F.col("start")))
    return found.groupBy("doc_id", "license").agg(best.alias("m")).select("doc_id", "license", "m.template", "m.share", "m.start")


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    d = scan(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "license", F.col("template").cast("int").alias("template"), F.round("share", 6).alias("share"), F.col("start").cast("int").alias("start"))


def oracle() -> str:
    """The same by brute force: every window against every template."""
    values = ",\n".join(
        f"({i}, '{lic}', {len(template_words(t))}, [{', '.join(chr(39) + w + chr(39) for w in template_words(t))}])" for i, (lic, t) in enumerate(TEMPLATES)
    )
    sized = ", ".join(f"({a}, {b}, {c})" for a, b, c in classes())
    return f"""
WITH tpl(template, license, n, w) AS (VALUES {values}),
cls(top, win, stride) AS (VALUES {sized}),
t AS (
  SELECT template, license, (SELECT min(top) FROM cls WHERE top >= n) AS top,
         list_distinct([list_reduce(w[i:i + 4], lambda a, b: a || ' ' || b) for i in range(1, n - 3)]) AS needed
  FROM tpl),
d AS (
  SELECT doc_id, [x for x in regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+') if x <> ''] AS w FROM documents),
s AS (
  SELECT doc_id, [list_reduce(w[i:i + 4], lambda a, b: a || ' ' || b) for i in range(1, len(w) - 3)] AS sh FROM d WHERE len(w) >= 5),
e AS (
  SELECT doc_id, sh FROM s WHERE list_has_any(sh, (SELECT list_distinct(flatten(list(needed))) FROM t))),
v AS (
  SELECT doc_id, top, p AS start, sh[p:p + win - 5] AS held
  FROM (SELECT doc_id, sh, top, win, unnest(range(1, len(sh) + 1, stride)) AS p FROM e, cls)),
m AS (
  SELECT v.doc_id, t.license, t.template, len(list_intersect(list_distinct(v.held), t.needed)) / len(t.needed) AS share, v.start - 1 AS start
  FROM v JOIN t ON t.top = v.top),
r AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY share DESC, template, start) AS k FROM m WHERE share >= 0.8)
SELECT doc_id, license, template::INTEGER AS template, round(share, 6) AS share, start::INTEGER AS start FROM r WHERE k = 1
"""
