"""License scans: MinHash bands over windows retrieve templates, containment verifies; DataFrame only.

Texts are lower-cased runs of letters and digits; a shingle is three of them.  All overlapping windows of
texts (WINDOW words, every STRIDE words) and of the templates (every word) get MinHash signatures of BANDS bands of
one row, so a window pair of similarity s meets with probability 1 - (1 - s)^BANDS; at s = 0.4 that
is over 0.99999.  The bands alone give the candidates, pairs of a document and a template.  Candidates' texts are
read again, and a document keeps a template if at least ``containment`` of the template's shingles occur in it.
Template bands and shingles are small tables that Spark sends to all tasks; nothing of them is in the plan.

Defined results: null, empty and short texts match nothing, as do rows without an id; documents with several licenses
give a row for each; repeated ids count as one document; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored

SHINGLE = 3
WINDOW = 8
STRIDE = 4
BANDS = 24

# License notices, by SPDX name.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def template_frame(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """template (its number), license, words; templates shorter than a shingle are refused."""
    rows = [(i, name, template_words(text)) for i, (name, text) in enumerate(templates)]
    if any(len(w) < SHINGLE for _, _, w in rows):
        raise ValueError(f"a template needs {SHINGLE} words")
    return spark.createDataFrame(rows, T.StructType([T.StructField("template", T.IntegerType()), T.StructField("license", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))]))


def shingles_of(words: str) -> F.Column:
    """Hashes of the shingles of an array of words, in order."""
    n = F.size(words) - (SHINGLE - 1)
    hashed = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))
    return F.when(n > 0, hashed).otherwise(F.array().cast("array<bigint>"))


def _low(shingles: list[F.Column], band: F.Column) -> F.Column:
    """The least hash of the shingles that are there, for one band."""
    return F.least(*[F.when(x.isNotNull(), F.xxhash64(x, band)) for x in shingles])


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = 0.8) -> DataFrame:
    """Per document and template that it holds: the id, template, license, n_matched and n_shingles (of the
    template), and n_windows (windows that met it)."""
    spark = docs.sparkSession
    known = template_frame(spark, templates)
    parts = known.select("template", "license", F.posexplode(shingles_of("words")).alias("pos", "shingle"))
    own = WINDOW - SHINGLE + 1
    every_band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")

    # windows of templates: every word starts one, so a text window inside a copied template equals one of them
    spread = parts.select("template", "shingle", F.explode(F.sequence(F.greatest(F.col("pos") - (own - 1), F.lit(0)), F.col("pos"))).alias("start"))
    template_bands = spread.select("template", "start", "shingle", every_band).groupBy("template", "start", "band").agg(F.min(F.xxhash64("shingle", "band")).alias("low"))
    template_bands = template_bands.select("template", "band", "low").distinct()

    def cut(rows: DataFrame) -> DataFrame:
        # an array of one, exploded: filters and projections above aren't moved below it, so each step runs once per text
        once = lambda c: F.explode(F.array(c))
        words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit("[a-z0-9]+"), 0)
        return rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), once(words).alias("words")).select("id", once(shingles_of("words")).alias("shingles"))

    # a window is a row of its shingles, so that hashes are generated code; a row per band then meets the templates' bands
    starts = cut(docs).where(F.size("shingles") > 0).select("id", "shingles", F.explode(F.sequence(F.lit(0), F.size("shingles") - 1, F.lit(STRIDE))).alias("start"))
    windows = starts.select("id", "start", *[F.get("shingles", F.col("start") + i).alias(f"s{i}") for i in range(own)])
    met = windows.select("*", every_band).select("id", "start", "band", _low([F.col(f"s{i}") for i in range(own)], F.col("band")).alias("low"))
    met = met.join(F.broadcast(template_bands), ["band", "low"]).groupBy("id", "template").agg(F.count_distinct("start").alias("n_windows"))
    met = stored(met, "license-candidates")

    # exact containment: the candidates' shingles against the whole template's
    again = docs.select(F.col(id_col), F.col(text_col)).join(met.select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi")
    shingles = parts.select("template", "shingle").distinct()
    held = cut(again).select("id", F.explode("shingles").alias("shingle")).join(F.broadcast(shingles), "shingle")
    sizes = shingles.groupBy("template").agg(F.count("*").alias("n_shingles")).join(known.select("template", "license"), "template")
    matched = held.groupBy("id", "template").agg(F.count_distinct("shingle").alias("n_matched"))
    out = matched.join(met, ["id", "template"]).join(F.broadcast(sizes), "template").where(F.col("n_matched") >= containment * F.col("n_shingles"))
    return out.select(F.col("id").alias(id_col), "template", "license", "n_matched", "n_shingles", "n_windows")


def oracle_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = 0.8) -> str:
    """The scan's rows without n_windows, by brute force over all shingles."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quote(name)}, {quote(' '.join(template_words(text)))})" for i, (name, text) in enumerate(templates))
    shingles = "list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]))"
    return f"""
WITH t(template, license, w) AS (SELECT a, b, string_split(c, ' ') FROM (VALUES {values}) v(a, b, c)),
ts AS (SELECT template, license, unnest({shingles}) AS s FROM t),
sizes AS (SELECT template, license, count(*) AS n_shingles FROM ts GROUP BY ALL),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, unnest({shingles}) AS s FROM d WHERE len(w) >= 3)
SELECT doc_id, template, license, count(*) AS n_matched, n_shingles
FROM ds JOIN ts USING (s) JOIN sizes USING (template, license)
GROUP BY doc_id, template, license, n_shingles HAVING count(*) >= {containment} * n_shingles"""
