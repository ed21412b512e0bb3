"""License scan with DataFrame functions only.

Texts and license notices are cut into overlapping windows of 8 words.  A window's MinHash
bands (one hash each) over its 5-word shingles retrieve the notices that have a window with an
equal band.  Then the notice's shingles that the document holds are counted exactly, and a notice
matches if at least `percent` % of its distinct shingles are there.

Any notice of 5 to 7 words lies whole in some window of 8 at every second word, so one of the
window's 4 shingles at least is the notice's: with resemblance 1/4, 32 bands of one hash miss it
with probability 0.75 ** 32 = 0.0001.  Notices are cut at every word, so an unbroken run of 9
words of a longer one meets an equal window and is never missed.

Before, and without loss: each 5-word shingle of each notice holds one word of a small cover, so
texts and windows without any word of the cover hold no shingle of a notice.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from celldag.llm.common import cut

WINDOW, STRIDE, BANDS, SHINGLE = 8, 2, 32, 5
#: Beyond this many characters of notices they are joined by a shuffle.
BROADCAST_CHARS = 2_000_000

#: Names of licenses and the wording of their notices.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


def words_column(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_column(words: Column) -> Column:
    """Hash of each SHINGLE words in a row; none where there are fewer words."""
    every = F.transform(F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))
    return F.when(F.size(words) >= SHINGLE, every).otherwise(F.array().cast("array<bigint>"))


def windows(rows: DataFrame, keys: list[str], stride: int, cover: list[str] | None = None) -> DataFrame:
    """(*keys, at, s): where each overlapping window begins and its shingle hashes.  rows: keys and words."""
    within = F.array(*map(F.lit, cover)) if cover else None
    if cover:
        rows = rows.where(F.arrays_overlap("words", within))
    rows = rows.where(F.size("words") >= SHINGLE)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - F.lit(SHINGLE), F.lit(0)), F.lit(stride))
    cutout = rows.select(*keys, "words", F.explode(starts).alias("at")).select(*keys, "at", F.slice("words", F.col("at") + 1, WINDOW).alias("w"))
    if cover:
        cutout = cutout.where(F.arrays_overlap("w", within))
    return cutout.select(*keys, "at", shingles_column(F.col("w")).alias("s"))


def bands(windowed: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, band, h): MinHash of each window under each of BANDS hash functions."""
    least = F.array(*[F.array_min(F.transform("s", lambda x: F.xxhash64(F.lit(i), x))) for i in range(BANDS)])
    return windowed.select(*keys, F.posexplode(least).alias("band", "h"))


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def word_cover(texts: list[str]) -> list[str]:
    """A few words of which each shingle of the texts holds one: again and again the word in most shingles left; longer ones before shorter."""
    left = set()
    for t in texts:
        ws = _words(t)
        left |= {frozenset(ws[i : i + SHINGLE]) for i in range(len(ws) - SHINGLE + 1)}
    cover = []
    while left:
        n = Counter(w for s in left for w in s)
        best = max(n, key=lambda w: (n[w] * (len(w) > 3), n[w], len(w), w))
        cover.append(best)
        left = {s for s in left if best not in s}
    return sorted(cover)


def scan(docs: DataFrame, notices=tuple(NOTICES), percent: int = 80) -> DataFrame:
    """(doc_id, license_id, notice, n_shingles, matched, containment, first_word) of each notice that a text holds.

    notice: its number in the list; first_word: where its first shingle begins, in words from 0.
    Null and empty texts match nothing; rows with equal id and text count once, a null id being one
    more id; notices of fewer than 5 words have no shingle and raise ValueError.  Further columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    if short := [name for name, t in notices if len(_words(t)) < SHINGLE]:
        raise ValueError(f"notices of fewer than {SHINGLE} words can't be matched: {short}")
    cover = word_cover([t for _, t in notices])
    listed = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(notices)], "notice int, license_id string, text string")
    listed = listed.withColumn("words", words_column(F.col("text")))
    small = sum(len(t) for _, t in notices) <= BROADCAST_CHARS
    ship = F.broadcast if small else (lambda df: df)
    keys = ["doc_id", "row"]
    words = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), words_column(F.col("text")).alias("words"))
    held = cut(windows(words, keys, STRIDE, cover))
    wanted = bands(windows(listed.select("notice", "words"), ["notice"], 1), ["notice"]).distinct()
    found = bands(held, keys).join(ship(wanted), ["band", "h"]).select("row", "notice").distinct()  # by row, as doc_id may be null
    of_notice = listed.select("notice", "license_id", F.array_distinct(shingles_column(F.col("words"))).alias("t"))
    of_notice = of_notice.select("notice", "license_id", F.size("t").alias("n_shingles"), F.explode("t").alias("x"))
    in_docs = held.select(*keys, "at", F.posexplode("s").alias("i", "x")).select(*keys, "x", (F.col("at") + F.col("i")).alias("place"))
    places = in_docs.join(ship(of_notice), "x").join(found, ["row", "notice"], "left_semi")
    counted = places.groupBy(*keys, "notice", "license_id", "n_shingles").agg(F.count_distinct("x").cast("int").alias("matched"), F.min("place").alias("first_word"))
    good = counted.where(F.col("matched") * 100 >= F.col("n_shingles") * percent)
    return good.select("doc_id", "license_id", "notice", "n_shingles", "matched", (F.col("matched") / F.col("n_shingles")).alias("containment"), "first_word")


_VALUES = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(NOTICES))
#: The same by comparing all shingles.
ORACLE = rf"""
WITH notices(notice, license_id, text) AS (VALUES {_VALUES}),
tw AS (SELECT notice, license_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM notices),
ts AS (SELECT DISTINCT notice, license_id, array_to_string(w[i : i + 4], ' ') AS x FROM tw, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
n AS (SELECT notice, CAST(count(*) AS INTEGER) AS n_shingles FROM ts GROUP BY notice),
dw AS (SELECT DISTINCT doc_id, text, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
ds AS (SELECT doc_id, text, i - 1 AS place, array_to_string(w[i : i + 4], ' ') AS x FROM dw, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
m AS (
  SELECT doc_id, text, notice, license_id, CAST(count(DISTINCT x) AS INTEGER) AS matched, CAST(min(place) AS INTEGER) AS first_word
  FROM ds JOIN ts USING (x) GROUP BY ALL
)
SELECT doc_id, license_id, notice, n_shingles, matched, matched / n_shingles AS containment, first_word
FROM m JOIN n USING (notice) WHERE matched * 100 >= n_shingles * 80
"""
