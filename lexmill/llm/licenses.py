"""License scans with DataFrame expressions only.

Texts and templates become lower-case words and shingles of three words. A template of n shingles
belongs to the class of the next power of two, s; longer ones than the largest class are cut into
overlapping segments of that size. Text windows of s shingles overlap by three quarters. Of each
window BANDS MinHash values are taken, every one a band of its own, and what agrees in a band with a
template is retrieved. If 0.8 of the template's shingles stand together, some window has a Jaccard
similarity of 0.36 with it at least (0.29 if they stand in two halves), so that a band agrees with a
probability of 0.9992 (0.996). Windows without any shingle of any template can agree in no band and
are not hashed.

A match is decided exactly: the share of the template's distinct shingles that stand in a stretch of
twice the template's words. Everything up to the matches happens inside each text's row: texts are
never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, BANDS, LARGEST = 3, 16, 64
#: Template shingles up to here are looked up in each row and their bands broadcast; of more, every
#: window of the texts is hashed and joined.
MOST_SHINGLES = 20_000

#: Fixed texts: (license, text of its notice or of its grant).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("all-rights-reserved", "All rights reserved"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
]


def license_words(text: Column) -> Column:
    """Letters and digits in lower case; anything else separates."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_codes(w: Column) -> Column:
    return F.when(F.size(w) < SHINGLE, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
    )


def shingle_texts(w: Column) -> Column:
    return F.when(F.size(w) < SHINGLE, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(SHINGLE)]))
    )


def bands(window: Column) -> Column:
    """The MinHash values of an array of shingle codes."""

    def smallest(k: int) -> Column:
        return F.array_min(F.transform(window, lambda x: F.xxhash64(x, F.lit(k))))

    return F.array(*[smallest(k) for k in range(BANDS)])


def hop_of(size: int) -> int:
    return max(1, size // 4)


def template_table(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """template, license, n_words, h (shingle codes), shingles (distinct, as texts) and size (of its class)."""
    rows = spark.createDataFrame([(n, name, text) for n, (name, text) in enumerate(templates)], "template int, license string, text string")
    cut = rows.select("template", "license", license_words(F.col("text")).alias("w")).withColumn("h", shingle_codes(F.col("w")))
    size = F.least(F.pow(F.lit(2), F.ceil(F.log2(F.size("h")))), F.lit(LARGEST)).cast("int")
    return cut.where(F.size("h") > 0).select("template", "license", F.size("w").alias("n_words"), "h", F.array_distinct(shingle_texts(F.col("w"))).alias("shingles"), size.alias("size"))


def template_bands(table: DataFrame) -> DataFrame:
    """The bands of each template, or of its segments of LARGEST shingles."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("h") - LARGEST, F.lit(0)), F.lit(hop_of(LARGEST)))
    cut = table.select("template", "license", "n_words", "shingles", "size", F.explode(F.transform(starts, lambda i: F.slice("h", i + 1, F.lit(LARGEST)))).alias("window"))
    return cut.select("template", "license", "n_words", "shingles", "size", F.posexplode(bands(F.col("window"))).alias("band", "key")).distinct()


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """doc_id, license, containment (the best), first_word (of the first stretch that reaches ``least``)
    and n_templates of each license in a row of ``docs`` (doc_id, text). Texts without any, null, empty
    and short ones give no rows, nor do rows without doc_id; rows that share a doc_id count as one
    document. Templates of under three words match nothing.
    """
    table = template_table(docs.sparkSession, templates)
    of = table.select("h", "size", "n_words").collect()  # as many as the caller's list
    codes, longest = sorted({c for r in of for c in r["h"]}), {}
    for r in of:
        longest[r["size"]] = max(longest.get(r["size"], 0), r["n_words"])
    few = len(codes) <= MOST_SHINGLES
    w, h = F.col("w"), F.col("h")
    cut = docs.where("doc_id is not null").select("doc_id", license_words(F.col("text")).alias("w")).select("doc_id", "w", shingle_codes(w).alias("h"))
    places = F.sequence(F.lit(0), F.size(h) - 1)
    anchors = F.filter(places, lambda i: F.get(h, i).isin(codes)) if few else places
    found = cut.select("doc_id", "w", "h", F.when(F.size(h) == 0, F.array().cast("array<int>")).otherwise(anchors).alias("anchors"))

    def windows(size: int, reach: int) -> Column:
        """Windows of ``size`` shingles that hold an anchor, with the words that a match may take up."""
        hop = hop_of(size)
        numbers = F.array_distinct(F.flatten(F.transform("anchors", lambda i: F.sequence(F.greatest(F.ceil((i - size + 1) / hop), F.lit(0)).cast("int"), F.floor(i / hop).cast("int")))))

        def window(j: Column) -> Column:
            start, base = (j * hop).alias("start"), F.greatest(j * hop - 2 * reach, F.lit(0))
            return F.struct(F.lit(size).alias("size"), start, bands(F.slice(h, j * hop + 1, F.lit(size))).alias("keys"), base.alias("base"), F.slice(w, base + 1, F.lit(4 * reach + size)).alias("words"))

        return F.transform(numbers, window)

    if not longest:
        return docs.sparkSession.createDataFrame([], "license string, containment double, first_word long, n_templates long").join(docs.select("doc_id").limit(0)).select("doc_id", "license", "containment", "first_word", "n_templates")
    around = F.flatten(F.array(*[windows(size, reach) for size, reach in sorted(longest.items())]))
    # outer, as the plain form would add a filter that computes the windows a second time
    each = found.select("doc_id", F.explode_outer(around).alias("hit")).where("hit is not null")
    banded = each.select("doc_id", "hit.size", "hit.start", "hit.base", "hit.words", F.posexplode_outer("hit.keys").alias("band", "key"))
    index = template_bands(table)
    pairs = banded.join(F.broadcast(index) if few else index, ["size", "band", "key"])
    cuts = pairs.select("doc_id", "license", "template", "n_words", "shingles", "start", "size", "base", shingle_texts(F.col("words")).alias("found"))
    share = lambda i: F.size(F.array_intersect("shingles", F.slice("found", i + 1, 2 * F.col("n_words") - SHINGLE + 1))) / F.size("shingles")
    begins = F.filter(F.sequence(F.lit(0), F.size("found") - 1), lambda i: (F.col("base") + i < F.col("start") + F.col("size")) & F.array_contains(F.col("shingles"), F.get("found", i)))
    reached = F.filter(F.transform(begins, lambda i: F.struct(share(i).alias("containment"), (F.col("base") + i).alias("word"))), lambda x: x["containment"] >= least)
    good = cuts.where(F.size("found") > 0).select("doc_id", "license", "template", F.explode(reached).alias("m"))
    return good.groupBy("doc_id", "license").agg(
        F.max("m.containment").alias("containment"), F.min("m.word").cast("long").alias("first_word"), F.countDistinct("template").alias("n_templates")
    )
