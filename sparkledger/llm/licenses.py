"""License scan by MinHash bands over overlapping windows, on DataFrame functions only.

A template of m shingles (five words each) is looked for in windows of m shingles that start
every m/4. `BANDS` bands of one value each retrieve a template for a window at similarity J with
probability 1 - (1 - J) ** BANDS: above 0.999 for a whole copy at the worst offset, 0.99 for one
that lost a quarter of its shingles. A retrieved template is then held exactly: it counts if at
least 75 % of its shingles stand within one window length of the window.

Of templates found in one text, one whose shingles found there all lie within those of another is not told apart by them: it
goes if the other's are more and as large a share of its template, or as many and a larger share. Those equal in both all stay. So a
notice within a longer one, or a license whose words another one repeats with a change, is reported once, as what fits best.

Windows are cut only in texts with at least one template shingle: the similarity of any window of
the others is 0. Words are runs of letters and digits, lower-cased. Null and short texts hold no
license; rows that repeat an id and license are one; a null id is an id like others; extra columns
are left out; an empty table gives an empty result; texts are scanned whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .license_texts import TEXTS

WORDS = 5
BANDS = 8
PERCENT = 75
#: Notices, opening paragraphs and whole texts of public licenses. The text of the AGPL is not among them; it is found as that of the GPL.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-short": "Licensed under CC BY-SA 4.0.",
    "cc-by-nd-4.0-short": "Licensed under CC BY-ND 4.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0-long-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "mit-license-notice": "Licensed under the MIT License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "lgpl-notice": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-3.0-notice": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "lgpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0-notice": "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    **TEXTS,
}


def words_of(text: str) -> list[str]:
    """The same rule for templates, on the driver."""
    return re.findall(r"[^\W_]+", text.lower())


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column) -> Column:
    """A hash of every five words in a row, in order of place."""
    n = F.size(w) - (WORDS - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(w, i, F.lit(WORDS))))))


def templates(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """license, m, and the set of shingle hashes."""
    rows = spark.createDataFrame([(k, " ".join(words_of(v))) for k, v in texts.items()], "license string, text string")
    rows = rows.select("license", F.explode(F.array(F.split("text", " "))).alias("w"))  # held fast, as in scan()
    return rows.select("license", F.array_distinct(shingles(F.col("w"))).alias("t")).filter("t IS NOT NULL").select("license", F.size("t").alias("m"), "t")


def least(h: Column, band: int) -> Column:
    return F.array_min(F.transform(h, lambda x: F.xxhash64(x, F.lit(band))))


@common.tidy("licenses")
def scan(docs: DataFrame, texts: dict[str, str] | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """A row per document and license found in it: id, license, shared (template shingles), of (all of them)."""
    return _told_apart(common.table(docs.sparkSession, places(docs, texts, text, id), "license-places")).withColumnRenamed("id", id)


def places(docs: DataFrame, texts: dict[str, str] | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Wherever a template is found: id, license, of, and s, its shingles there."""
    spark = docs.sparkSession
    known = templates(spark, TEMPLATES if texts is None else texts).collect()  # the given templates, no corpus data
    if not known:
        return docs.select(F.col(id).alias("id"), F.lit("").alias("license"), F.lit(0).cast("long").alias("of"), F.array().cast("array<long>").alias("s")).limit(0)
    every = F.split(F.lit(",".join(str(x) for x in sorted({x for k in known for x in k["t"]}))), ",").cast("array<bigint>")  # folds to one value
    bands = spark.createDataFrame([(k["license"], k["m"], list(k["t"])) for k in known], "license string, m int, t array<long>")
    bands = bands.select("license", "m", "t", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), least(F.col("t"), b).alias("value")) for b in range(BANDS)])).alias("x")).select("license", "m", "t", "x.*")

    # explode() of one row holds a value fast: a lambda that named the expression would compute it anew for each element
    split = docs.select(F.col(id).alias("id"), F.explode(F.array(words(F.col(text)))).alias("w"))
    hashed = split.select("id", F.explode(F.array(shingles(F.col("w")))).alias("h")).filter(F.arrays_overlap("h", every))
    hashed = hashed.select("id", "h", F.explode(F.array(F.array_intersect("h", every))).alias("own"))  # of whole texts there are thousands; a text holds few
    scales = F.array(*[F.lit(m) for m in sorted({k["m"] for k in known})])
    scaled = hashed.select("id", "h", "own", F.explode(scales).alias("m"))
    step = F.greatest(F.lit(1), F.floor(F.col("m") / 4).cast("int"))
    starts = F.sequence(F.lit(0), F.size("h") - 1, step)
    window = F.transform(starts, lambda i: F.struct(F.slice("h", i + 1, F.col("m")).alias("w"), F.slice("h", F.greatest(i - F.col("m"), F.lit(0)) + 1, F.col("m") + F.least(i, F.col("m")) + F.col("m")).alias("near")))
    cut = scaled.select("id", "m", "own", F.explode(window).alias("x")).select("id", "m", "own", "x.*").filter(F.arrays_overlap("w", "own"))
    valued = cut.select("id", "m", "near", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), least(F.col("w"), b).alias("value")) for b in range(BANDS)])).alias("x")).select("id", "m", "near", "x.*")
    met = valued.join(F.broadcast(bands), ["m", "band", "value"])  # a row per template and band
    own = met.select("id", "license", F.col("m").cast("long").alias("of"), F.explode(F.array(F.array_intersect("t", "near"))).alias("s"))  # held fast
    return own.filter(100 * F.size("s") >= PERCENT * F.col("of"))


def _told_apart(exact: DataFrame) -> DataFrame:
    """id, license, shared, of: what stays of the places found (id, license, of, s: the template's shingles there)."""
    best = exact.groupBy("id", "license").agg(F.max(F.size("s")).cast("long").alias("shared"), F.first("of").alias("of"))
    # each shingle once for a text and a template, however many places hold it
    held = exact.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("k"), F.col("id").isNull().alias("none"), "license", F.explode("s").alias("s")).distinct()
    sizes = held.groupBy("k", "none", "license").agg(F.count("*").alias("n"))
    both = held.join(held.withColumnRenamed("license", "other"), ["k", "none", "s"]).filter("license <> other").groupBy("k", "none", "license", "other").agg(F.count("*").alias("both"))
    key = best.withColumns({"k": F.coalesce(F.col("id").cast("string"), F.lit("")), "none": F.col("id").isNull()}).join(sizes, ["k", "none", "license"])
    other = key.select("k", "none", F.col("license").alias("other"), F.col("n").alias("m"), F.col("shared").alias("their"), F.col("of").alias("their_of"))
    within = both.join(key.select("k", "none", "license", "n", "shared", "of"), ["k", "none", "license"]).join(other, ["k", "none", "other"]).filter("both = n")
    mine, theirs = F.col("shared") * F.col("their_of"), F.col("their") * F.col("of")
    worse = within.filter((F.col("m") > F.col("n")) & (theirs >= mine) | (theirs > mine)).select("k", "none", "license").distinct()
    return key.join(worse, ["k", "none", "license"], "left_anti").select("id", "license", "shared", "of")
