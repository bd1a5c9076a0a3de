"""License notices in documents: MinHash bands over overlapping windows of text retrieve templates, shingle containment verifies them.

All of it is DataFrame expressions. Positions whose five-word shingle occurs in some template are kept first: a window's MinHash can only equal
a template's in such a shingle, so nothing is lost, and the windows become small. Windows come in sizes of powers of two, half
overlapping; a template is met in the smallest size of which half holds all its shingles, so some window holds the template whole, and that
window has less than four times as many shingles as the template, whatever stands around it. So their sets are alike by a quarter at
least, and with 32 bands of one row they share a band with probability 1 - 0.75^32 = 0.9999 (0.9988 where only four fifths of the
template are there). A window that shares a band is verified: at least four fifths of the template's shingles are in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed texts: the usual short notices and headers of licenses, as published.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions:",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
}
SHINGLE, BANDS, ROWS, SHARE = 5, 32, 1, 0.8
SIZES = (2, 4, 8, 16, 32, 64, 128, 256, 512, 1024)
BETWEEN = r"[^\p{L}\p{N}]+"


def words(text):
    return F.filter(F.split(F.lower(text), BETWEEN), lambda w: w != "")


def shingle_hash(words_, at):
    return F.xxhash64(*[F.get(words_, at + j) for j in range(SHINGLE)])


def band_keys(hashes):
    """Per band the hash of its MinHashes, each the smallest of the hashes re-hashed with the number of its row."""
    least = lambda k: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k)))
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, *[least(b * ROWS + r) for r in range(ROWS)]))


def template_table(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    """license, template (its number), size (of its windows), shingles (a set of hashes), bands. Templates under five words are refused."""
    rows = [(name, n, text) for n, (name, text) in enumerate((k, t) for k, texts in templates.items() for t in texts)]
    t = spark.createDataFrame(rows, "license string, template int, text string").withColumn("w", words(F.col("text")))
    starts = F.sequence(F.lit(0), F.size("w") - SHINGLE)
    n = F.size("w") - SHINGLE + 1
    size = F.raise_error(F.concat(F.lit("no window holds "), F.col("text"))).cast("int")
    for s in reversed(SIZES):
        size = F.when(n <= s // 2, s).otherwise(size)
    t = t.withColumn("w", F.when(n >= 1, F.col("w")).otherwise(F.raise_error(F.concat(F.lit("too short: "), F.col("text")))))
    t = t.select("license", "template", size.alias("size"), F.array_distinct(F.transform(starts, lambda i: shingle_hash(F.col("w"), i))).alias("shingles"))
    return t.withColumn("bands", band_keys(F.col("shingles")))


def license_notices(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """doc_id, license, containment, first_word: one row for each license found in each document of ``docs`` (doc_id, text).

    ``containment`` is the largest share of a template's shingles in one window, ``first_word`` the place (from 0) of the earliest matching
    shingle in such a window. Words are runs of letters and digits, lower-cased. A NULL text has none, and so do texts of fewer than five
    words. Each text is searched by itself: a notice stands whole in one row's text. Rows repeating a doc_id give one row per license, from the
    best of their texts, and so do rows without doc_id, under NULL. Very long texts have as many windows as words that may belong to a
    template. Other columns are ignored. No rows give no rows. The templates are a parameter of the code, some hundreds of shingles, whatever the size of the table.
    """
    spark = docs.sparkSession
    known = template_table(spark, templates)
    # a few hundred numbers and words of the templates themselves
    hashes = sorted({h for r in known.select("shingles").collect() for h in r["shingles"]})
    texts = spark.createDataFrame([(t,) for own in templates.values() for t in own], "t string")
    vocabulary = sorted({w for r in texts.select(words(F.col("t")).alias("w")).collect() for w in r["w"]})
    w = F.col("w")
    starts = F.when(F.size("w") >= SHINGLE, F.sequence(F.lit(0), F.size("w") - SHINGLE)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(
        starts,
        lambda i: F.get(w, i + SHINGLE - 1).isin(vocabulary) & F.get(w, i).isin(vocabulary) & shingle_hash(w, i).isin(hashes),
    )
    text = F.col("text").cast("string")
    row = ["doc_id", "text_a", "text_b"]  # a text is told apart by 128 bits
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit(1), text).alias("text_b"), words(text).alias("w")
    )
    found = split.select(*row, "w", F.explode(hits).alias("at")).select(*row, "at", shingle_hash(w, F.col("at")).alias("h"))
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # of SIZES, those that a template uses
    scales = F.explode(F.array(*[F.lit(s) for s in sizes]))
    spread = found.select(*row, "at", "h", scales.alias("size"))
    half = F.floor(F.col("at") / (F.col("size") / 2)).cast("int")
    spread = spread.select(*row, "at", "h", "size", F.explode(F.array(half, half - 1)).alias("window")).filter("window >= 0 OR at < size / 2")
    windows = spread.groupBy(*row, "size", "window").agg(
        F.sort_array(F.collect_set(F.struct("at", "h"))).alias("own")
    )
    windows = windows.withColumn("hashes", F.array_distinct(F.transform("own", lambda x: x["h"])))
    keyed = windows.withColumn("band", F.explode(band_keys(F.col("hashes"))))
    bands = F.broadcast(known.select("size", "license", "template", "shingles", F.explode("bands").alias("band")))
    met = keyed.join(bands, ["size", "band"]).dropDuplicates([*row, "size", "window", "template"])
    share = F.size(F.array_intersect("hashes", "shingles")) / F.size("shingles")
    first = F.array_min(F.transform(F.filter("own", lambda x: F.array_contains("shingles", x["h"])), lambda x: x["at"]))
    held = met.select("doc_id", "license", share.alias("containment"), first.alias("first_word")).filter(F.col("containment") >= SHARE)
    best = held.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("first_word").alias("first_word"))
    return best.select("doc_id", "license", "containment", F.col("first_word").cast("long").alias("first_word"))


def sql(templates: dict[str, list[str]] = TEMPLATES) -> str:
    """The same rows by comparing every window with every template's shingles, without hashes."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    rows = ", ".join(
        f"({quoted(name)}, {n}, {quoted(text)})" for n, (name, text) in enumerate((k, t) for k, texts in templates.items() for t in texts)
    )
    cases = " ".join(f"WHEN n <= {s // 2} THEN {s}" for s in SIZES)
    split = lambda t: f"list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    shingles = "list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))"
    return f"""
WITH t AS (SELECT license, template, {split("txt")} AS w FROM (VALUES {rows}) v(license, template, txt)),
ts AS (SELECT license, template, len(w) - 4 AS n, list_distinct({shingles}) AS s FROM t),
tt AS (SELECT license, template, CASE {cases} END AS size, len(s) AS m, unnest(s) AS h FROM ts),
d AS (SELECT doc_id, {split("text")} AS w FROM documents),
ds AS (SELECT doc_id, unnest({shingles}) AS h, unnest(range(0, len(w) - 4)) AS "at" FROM d WHERE len(w) >= 5),
hit AS (SELECT ds.doc_id, ds."at", tt.* FROM ds JOIN tt USING (h)),
win AS (SELECT *, CAST(floor("at" / (size / 2)) AS INT) - k AS win FROM hit, (VALUES (0), (1)) z(k)),
sh AS (SELECT doc_id, license, template, win, m, count(DISTINCT h) AS c, min("at") AS first_word FROM win GROUP BY ALL)
SELECT doc_id, license, max(c / m) AS containment, min(first_word) AS first_word FROM sh WHERE c >= {SHARE} * m GROUP BY ALL"""
