"""License notices in documents, found with DataFrame expressions alone.

Words are runs of letters and digits, lower-cased.  Template and text are
compared by 5-word shingles.

Retrieve: overlapping windows of the text are sketched by their ``BANDS`` least
shingle hashes; each is a band of one row, and a shared value is a collision.
A template shorter than ``PIECE_WORDS`` meets windows of five words, one a word:
such a window has one shingle, its MinHash is that shingle, and a shared shingle
collides for certain.  A longer template is cut into pieces of ``PIECE_WORDS``
words; windows of ``WINDOW`` (60) shingles every ``STRIDE`` hold any such piece
whole.  A document that holds 80 % of a template has lost a fifth of its shingles
at most.  A template of one piece has up to 75, so its piece of 36 loses 15 at
most; of more pieces, the least damaged one loses 11 at most.  That is less than
``BANDS`` (16): one of the piece's 16 least hashes is left, and it is the least of
those left.  A window that holds the other 21 or more collides unless its own 16
least hashes are all foreign, which has probability (39 / 60) ** 16 = 0.001 at
most.  Further pieces and windows are more chances.  This holds for words that
are changed or lost, and for inserted ones while a window still spans the piece.

Verify: a retrieved template matches a document that holds at least 80 % of its
distinct shingles.

The plan is one projection over the scan: no shuffle, no join, no Python.  The
templates are constants of the plan.  Null, empty and shorter texts match
nothing; repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
PIECE_WORDS = 40
STRIDE = 20
WINDOW = PIECE_WORDS - SHINGLE + 1 + STRIDE + 4
BANDS = 16
CONTAINED = (80, 100)
BREAK = r"[^\p{L}\p{N}]+"

# The wording of public licence notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def text_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK), "")


def shingles(words: Column) -> Column:
    """Hashes of the runs of ``SHINGLE`` words, in order; empty for a shorter text."""
    last = F.size(words) - SHINGLE
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(SHINGLE)]))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<long>"))


def window_bands(found: Column, starts: Column) -> Column:
    """Band values of the windows at ``starts``: their least hashes."""
    return F.flatten(F.transform(starts, lambda at: F.slice(F.sort_array(F.slice(found, at + 1, WINDOW)), 1, BANDS)))


def template_table(spark, templates: dict[str, str]) -> list[dict]:
    """Shingles and retrieval keys of the templates, made by the same expressions that read texts."""
    pieces = []
    for name, text in templates.items():
        words = template_words(text)
        if len(words) < SHINGLE:
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        long = len(words) >= PIECE_WORDS
        starts = range(0, len(words) - PIECE_WORDS + 1, PIECE_WORDS) if long else [0]
        pieces += [(name, " ".join(words), " ".join(words[s : s + PIECE_WORDS]) if long else "", long) for s in starts]
    rows = spark.createDataFrame(pieces, "name string, text string, piece string, long boolean")
    rows = rows.select("name", "long", F.array_distinct(shingles(text_words(F.col("text")))).alias("shingles"), shingles(text_words(F.col("piece"))).alias("piece"))
    rows = rows.withColumn("keys", F.when(F.col("long"), window_bands(F.col("piece"), F.array(F.lit(0)))).otherwise(F.col("shingles")))
    found: dict[str, dict] = {}
    for r in rows.collect():  # as many rows as pieces of templates
        t = found.setdefault(r["name"], {"name": r["name"], "long": r["long"], "shingles": r["shingles"], "keys": []})
        t["keys"] += r["keys"]
    return list(found.values())


def longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values]) if values else F.array().cast("array<long>")


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and matching template: id, license, n_matched, n_shingles."""
    table = template_table(docs.sparkSession, templates or TEMPLATES)
    short, long = (sorted({k for t in table if t["long"] == kind for k in t["keys"]}) for kind in (False, True))
    rows = docs.select(F.col(id_col).alias("id"), text_words(F.col(text_col)).alias("words")).select("id", shingles(F.col("words")).alias("found"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("found") - 1, F.lit(0)), F.lit(STRIDE))
    hits = F.array_intersect(F.col("found"), longs(short))
    if long:
        bands = F.when(F.size("found") > 0, F.array_intersect(window_bands(F.col("found"), starts), longs(long))).otherwise(F.array().cast("array<long>"))
        hits = F.concat(hits, bands)
    rows = rows.select("id", "found", hits.alias("hits"))
    matched = [F.struct(F.lit(t["name"]).alias("license"), F.when(F.arrays_overlap("hits", longs(sorted(set(t["keys"])))), F.size(F.array_intersect(F.col("found"), longs(t["shingles"])))).otherwise(0).alias("n"), F.lit(len(t["shingles"])).alias("of")) for t in table]
    verified = F.when(F.size("hits") > 0, F.filter(F.array(*matched), lambda m: CONTAINED[1] * m["n"] >= CONTAINED[0] * m["of"]))
    # the outer form keeps the optimizer from working all this out twice, once as a filter
    out = rows.select("id", F.explode_outer(verified).alias("m")).filter("m.license is not null")
    return out.select(F.col("id").alias(id_col), "m.license", F.col("m.n").cast("long").alias("n_matched"), F.col("m.of").cast("long").alias("n_shingles"))


def oracle_sql(templates: dict[str, str] | None = None) -> str:
    """The same rows by exact containment, for DuckDB."""
    values = ", ".join("('{}', '{}')".format(n, " ".join(template_words(t))) for n, t in (templates or TEMPLATES).items())
    cut = "list_distinct(list_transform(range(1, greatest(len({0}) - 3, 1)), lambda i: array_to_string({0}[i:i + 4], ' ')))"
    return f"""
    WITH t AS (SELECT name, {cut.format("string_split(words, ' ')")} AS s FROM (VALUES {values}) AS v(name, words)),
    w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM documents),
    d AS (SELECT r, doc_id, {cut.format("words")} AS s FROM w WHERE len(words) >= 5),
    e AS (SELECT r, doc_id, unnest(s) AS x FROM d), u AS (SELECT name, len(s) AS n, unnest(s) AS x FROM t)
    SELECT doc_id, name AS license, count(*)::BIGINT AS n_matched, any_value(n)::BIGINT AS n_shingles
    FROM e JOIN u USING (x) GROUP BY r, doc_id, name HAVING 100 * count(*) >= 80 * any_value(n)
    """
