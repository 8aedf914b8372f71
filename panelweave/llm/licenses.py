"""License scan with MinHash bands over overlapping text windows, in DataFrame functions only.

Templates are cut into pieces of at most PIECE words. A window of 2 * PIECE words, moved by PIECE,
holds every piece whole. Each band is the least hash of a window's two-word shingles under one of
BANDS permutations (one row a band). A piece of w words makes up at least (w - 1) / (2 * PIECE - 1) of a
window that holds it, so five words are met with a probability of at least 1 - (1 - 4/15) ** 48, which
is above 0.9999995; longer templates have several pieces. Windows met in a band retrieve the
template; the share of its shingles that occurs around the window decides exactly.

A window can only meet a template in a band through one of the template's own least shingles, so
windows without any of them are set aside before their bands are computed.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelweave.llm.common import fenced

PIECE, BANDS = 8, 48
SEEDS = [random.Random(20240501 + b).getrandbits(63) for b in range(BANDS)]
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Notices to look for (fixed values).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("MIT", "Released under the MIT License."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def _next(words: Column) -> Column:
    return F.slice(words, F.lit(2), F.size(words))


def _hashes(words: Column) -> Column:
    """Hash of each two-word shingle; a single word has none."""
    return F.slice(F.zip_with(words, _next(words), lambda a, b: F.xxhash64(a, b)), F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))


def _shingles(words: Column) -> Column:
    pairs = F.zip_with(words, _next(words), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))


def _bands(hashes: Column) -> Column:
    seeds = F.array(*[F.lit(s) for s in SEEDS])
    return F.transform(seeds, lambda s: F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(s))))


def _templates(spark: SparkSession, templates) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("template")) for i, t in templates])
    words = spark.range(1).select(F.inline(rows)).select("license_id", _words(F.col("template")).alias("tw"))
    return words.select("license_id", _shingles(F.col("tw")).alias("ts"), F.size("tw").alias("tn"), "tw")


def _pieces(templates: DataFrame) -> DataFrame:
    """Bands of each piece: pieces start every PIECE words, the last one ends with the template."""
    last = F.greatest(F.col("tn") - PIECE, F.lit(0))
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("tn") - 1, F.lit(PIECE)), lambda i: F.least(i, last)))
    cut = templates.select("license_id", "ts", "tn", F.explode(F.transform(starts, lambda i: F.slice("tw", i + 1, PIECE))).alias("pw"))
    banded = cut.select("license_id", "ts", "tn", F.posexplode(_bands(_hashes(F.col("pw")))).alias("band", "value")).where("value is not null")
    return banded.distinct()


def scan(docs: DataFrame, templates=TEMPLATES, share: float = 0.8) -> DataFrame:
    """(doc_id, license_id, containment, first_word, n_windows) for every template found in a document.

    containment is the largest share of the template's two-word shingles found around a retrieved window
    (at least `share`), first_word the start of the first such window, in words. Words are letters, digits and
    other scripts in lower case. Null, empty and one-word texts have no rows; repeated doc_ids are one
    document; other columns are ignored; an empty table gives an empty result. Templates of fewer than two
    words can't match. Templates are broadcast: their number is that of the parameter.
    """
    spark = docs.sparkSession
    table = _templates(spark, templates)
    pieces = _pieces(table)
    least = sorted({r["value"] ^ SEEDS[r["band"]] for r in pieces.select("band", "value").distinct().collect()})
    keys = F.split(F.lit(",".join(map(str, least))), ",").cast("array<bigint>")
    hashed = fenced(docs.select("doc_id", _words(F.col("text")).alias("w")).withColumn("h", _hashes(F.col("w"))), F.arrays_overlap("h", keys))
    hits = F.filter(F.transform("h", lambda h, i: F.when(F.array_contains(keys, h), i)), lambda i: i.isNotNull())
    blocks = F.flatten(F.transform(hits, lambda i: F.array(F.floor(i / PIECE), F.floor(i / PIECE) - 1)))
    starts = F.filter(F.array_distinct(blocks), lambda b: b >= 0)
    windows = hashed.select("doc_id", "w", F.explode_outer(F.transform(starts, lambda b: (b * PIECE).cast("int"))).alias("at"))
    banded = windows.select("doc_id", "w", "at", F.posexplode_outer(_bands(_hashes(F.slice("w", F.col("at") + 1, 2 * PIECE)))).alias("band", "value"))
    met = banded.join(F.broadcast(pieces), ["band", "value"]).select("doc_id", "at", "license_id", "ts", "tn", F.slice(
        "w", F.greatest(F.col("at") - F.col("tn"), F.lit(0)) + 1, 2 * PIECE + 2 * F.col("tn")).alias("near")).dropDuplicates(["doc_id", "at", "license_id"])
    part = F.size(F.array_intersect("ts", _shingles(F.col("near")))) / F.size("ts")
    found = met.select("doc_id", "license_id", "at", F.round(part, 6).alias("c")).where(F.col("c") >= share)
    return found.groupBy("doc_id", "license_id").agg(F.max("c").alias("containment"), F.min("at").cast("long").alias("first_word"), F.count("*").alias("n_windows"))
