"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

A template of up to L words (L a power of two) is sought in windows of 2 L words that start every L words, so each occurrence
lies wholly in a window. A sketch has, for each of SEEDS hash functions and BINS bins, the least hash of the shingles in that bin;
every bin is a band of one row, and its key is the least hash. A window retrieves a template if a band has the same key in both,
which is an equi-join. A shingle that the two share gives its band the same key unless another of the window's at most 2 L
shingles or of the template's L has a smaller hash in the same bin, which for one seed has a probability under 1.5 L / BINS. A
template is missed only if that happens to all shared shingles under both seeds: under (384 / 16384) ** 2 = 0.06 % for L = 256 if
they share a single shingle, and under 1e-6 for L = 8; with each further shared shingle that is to the next power.

The key of a window's band is one of its shingles, so the shingles of a text are joined with the templates' keys, and only
where they meet it is seen whether the shingle is the least of its band in a window that holds it. Windows that meet no key
are never sketched. Everything is DataFrame functions: no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import without

BIN_BITS = 14
BINS = 1 << BIN_BITS
SEEDS = 2
SHINGLE = 5
#: Lower-casing is of A-Z alone; words are runs of letters, digits and bytes beyond ASCII.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ADDED = ("license", "window_start", "window_words", "shared", "containment")

# Wordings of common license notices.
TEMPLATES = {
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD (redistribution)": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0 (line)": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 (line)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL (notice)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT (line)": "Released under the MIT License.",
    "MIT (grant)": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "MPL-2.0 (notice)": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
}


def templates(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """license and template, from a mapping."""
    rows = [F.struct(F.lit(k).alias("license"), F.lit(v).alias("template")) for k, v in (texts or TEMPLATES).items()]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("_t")).select("_t.*")


def license_words(text: str | Column) -> Column:
    """Lower-cased words; null has none."""
    low = F.translate(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, BREAKS), lambda w: w != "")


def shingles(words: str) -> Column:
    """A hash of each run of SHINGLE words, in order."""
    n = f"greatest(size({words}) - {SHINGLE - 1}, 0)"
    parts = ", ".join(f"element_at({words}, i + {k})" for k in range(SHINGLE))
    return F.expr(f"case when {n} = 0 then cast(array() as array<bigint>) else transform(sequence(1, {n}), i -> xxhash64({parts})) end")


def _least(shingle: str, others: str) -> str:
    """SQL: under some seed the shingle has the least hash of its bin among the others."""
    value = lambda x, seed: x if seed == 0 else f"xxhash64({x}, {seed})"
    bin_of = lambda x, seed: f"shiftrightunsigned({value(x, seed)}, {64 - BIN_BITS})"
    return " or ".join(f"not exists({others}, y -> {bin_of('y', k)} = {bin_of(shingle, k)} and {value('y', k)} < {value(shingle, k)})" for k in range(SEEDS))


def candidates(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (_s: shingles, in order) with each template (of known: license, _shingles, _half) and window number _k that have the
    key of a band in common, and _w, the window's shingles. Window k holds the words [k L, k L + 2 L). A window that has several
    keys in common with a template is there several times."""
    keys = known.select("license", "_shingles", "_half", F.explode("_shingles").alias("_key")).where(F.expr(_least("_key", "_shingles")))
    met = rows.select("*", F.posexplode("_s").alias("_at", "_value")).join(F.broadcast(keys), F.col("_value") == F.col("_key"))
    first = F.expr("cast(floor(_at / _half) as int)")
    windows = met.withColumn("_k", F.explode(F.array(first, first - 1))).where("_k >= 0")
    windows = windows.withColumn("_w", F.expr(f"slice(_s, _k * _half + 1, 2 * _half - {SHINGLE - 1})"))
    return windows.where(F.expr(_least("_key", "_w"))).drop("_at", "_value", "_key")


def scan_licenses(docs: DataFrame, wanted: DataFrame, text: str = "text", containment: float = 0.8, block_bytes: int = 32_000_000) -> DataFrame:
    """A row for each row of docs (without the text) and license of which some window holds the part `containment` of the
    template's distinct shingles: the license, window_start and window_words (of the first window that holds most), shared
    (distinct shingles of the template in it) and containment.

    wanted has license and template. Its shingles are held by every task, so templates are taken in blocks whose shingles have
    a checked size of block_bytes; each block reads docs once. Templates under SHINGLE words, empty or null ones match nothing;
    of equal templates each is reported. Null and empty texts hold nothing; repeated rows are scanned each; columns of docs
    whose names clash with an added column are replaced.
    """
    known = wanted.where("template is not null").select("license", license_words("template").alias("_t")).withColumn("_shingles", F.array_distinct(shingles("_t"))).where(F.size("_shingles") > 0)
    known = known.select("license", "_shingles", F.expr("cast(pow(2, ceil(log2(greatest(size(_t), 8)))) as int)").alias("_half"))
    n_bytes = known.agg(F.coalesce(F.sum(8.0 * F.size("_shingles") * (F.size("_shingles") + 2)), F.lit(0.0))).first()[0]
    n_blocks = max(1, -(-int(n_bytes) // block_bytes))
    base = without(docs, *(c for c in ADDED if c != text), "_s", "_t", "_id", "_half", "_shingles", "_k", "_w", "_n", "_at", "_value", "_key", "_b")
    rest = [c for c in base.columns if c != text]
    rows = base.select(*rest, license_words(text).alias("_t")).where(F.size("_t") >= SHINGLE).select(*rest, F.size("_t").alias("_n"), shingles("_t").alias("_s"), F.monotonically_increasing_id().alias("_id"))
    out = None
    for block in range(n_blocks):
        part = known if n_blocks == 1 else known.where(F.pmod(F.xxhash64("license", "_shingles"), F.lit(n_blocks)) == block)
        found = candidates(rows, part).withColumn("shared", F.size(F.array_intersect("_shingles", "_w")).cast("long")).where(F.col("shared") >= F.lit(containment) * F.size("_shingles"))
        window = F.struct((F.col("_k") * F.col("_half")).cast("long").alias("window_start"), F.least(F.lit(2) * F.col("_half"), F.col("_n") - F.col("_k") * F.col("_half")).cast("long").alias("window_words"), "shared", (F.col("shared") / F.size("_shingles")).alias("containment"))
        best = found.groupBy("_id", "license").agg(*(F.first(c).alias(c) for c in rest), F.max_by(window, F.struct("shared", -F.col("_k"))).alias("_b")).select(*rest, "license", "_b.*")
        out = best if out is None else out.unionByName(best)
    return out
