"""Every match of many patterns with its place and context, by expressions inside the row.

A pattern cuts a text into pieces; the lengths of pieces and matches, summed up along the row, are the
offsets. Sums run in two levels (blocks of about the root of their number), so a row with n matches
costs n ** 1.5 additions, and contexts are cut from blocks of BLOCK characters, not from the text's start.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096


def running(column: str) -> Column:
    """Running sums of an array column of whole numbers."""
    v, none = F.col(column), F.array().cast("array<int>")
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v)))).cast("int")
    of = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / step).cast("int") - 1), lambda k: F.slice(v, k * step + 1, step))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    inside = F.transform(of, lambda b: F.transform(b, lambda _, i: total(F.slice(b, F.lit(1), i + 1))))
    sums = F.transform(of, total)
    base = F.transform(sums, lambda _, k: total(F.slice(sums, F.lit(1), k)))
    return F.when(F.size(v) > 0, F.flatten(F.zip_with(base, inside, lambda o, b: F.transform(b, lambda x: x + o)))).otherwise(none)


def cut(blocks: Column, start: Column, length: Column) -> Column:
    """Up to BLOCK characters of a text from its blocks."""
    k = F.floor(start / BLOCK).cast("int")
    two = F.concat(F.coalesce(F.get(blocks, k), F.lit("")), F.coalesce(F.get(blocks, k + 1), F.lit("")))
    return F.substring(two, start - k * BLOCK + 1, length)


def word_pieces(text: Column, word: str) -> Column:
    """Pieces that each end where an occurrence begins, overlapping ones too; the first has a sign in front."""
    sign = "x" if not word.startswith("x") else "y"  # a cut in front of the first character would be lost
    return F.split(F.concat(F.lit(sign), text), f"(?={re.escape(word)})", -1)


def matches(rows: DataFrame, patterns: list[tuple[str, str, str]], around: int = 50, text: str = "text") -> DataFrame:
    """All columns of ``rows``, and of every match: ordinal (place of its pattern), name, pos, end (offsets
    from 0), raw and context (``around`` characters on both sides, cut at the text's ends).

    ``patterns`` are (name, kind, pattern). Kind ``word``: every occurrence of a literal whatever its case,
    overlapping ones included; ``first``: its first occurrence; ``regex``: matches that don't overlap,
    multi-line, whatever their case. Null texts have none. Patterns that match the empty text are refused.
    """
    low, cells = F.lower(F.col(text)), []
    for n, (name, kind, p) in enumerate(patterns):
        if not p or (kind == "regex" and re.search(p, "")):
            raise ValueError(f"{p!r} matches the empty text")
        if kind == "regex":
            java = "(?im)" + p
            there, pieces, raws, size = F.col(text).rlike(java), F.split(text, java, -1), F.regexp_extract_all(text, F.lit(java), F.lit(0)), 0
        else:
            there, pieces, raws, size = low.contains(p.lower()), word_pieces(low, p.lower()), F.array().cast("array<string>"), len(p)
        cell = F.struct(F.lit(n).alias("ordinal"), F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(size).alias("size"), pieces.alias("pieces"), raws.alias("raws"))
        cells.append(F.when(there, cell))
    names = rows.columns
    # an outer explode, as a plain one brings a filter along that evaluates all patterns once more
    hit = rows.withColumn("_m", F.explode_outer(F.array_compact(F.array(*cells)))).where("_m is not null")
    literal = F.col("_m.kind") != "regex"
    gaps = F.slice(F.transform("_m.pieces", lambda p: F.length(p)), F.lit(1), F.size("_m.pieces") - 1)
    gaps = F.when(F.col("_m.kind") == "first", F.slice(gaps, 1, 1)).otherwise(gaps)
    steps = F.when(literal, gaps).otherwise(F.zip_with(gaps, F.transform("_m.raws", lambda r: F.length(r)), lambda g, r: g + r))
    lined = hit.select(*names, F.col("_m.ordinal").alias("ordinal"), F.col("_m.name").alias("name"), F.col("_m.size").alias("_size"), F.col("_m.raws").alias("_raws"), steps.alias("_steps"))
    lined = lined.withColumn("_at", running("_steps")).withColumn("_blocks", F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    # outer again: the filter on size(_at) would put the whole of its expression in place of each _steps
    one = lined.select("*", F.posexplode_outer("_at").alias("_k", "_e")).where("_e is not null")
    raw_size = F.when(F.col("_size") > 0, F.col("_size")).otherwise(F.length(F.get("_raws", F.col("_k"))))
    # the running sum of a literal stands behind the sign in front and before the word, that of a pattern behind its match
    placed = one.withColumn("pos", F.when(F.col("_size") > 0, F.col("_e") - 1).otherwise(F.col("_e") - raw_size)).withColumn("end", F.col("pos") + raw_size)
    raw = F.when(F.col("_size") > 0, cut(F.col("_blocks"), F.col("pos"), F.col("_size"))).otherwise(F.get("_raws", F.col("_k")))
    start = F.greatest(F.col("pos") - around, F.lit(0))
    context = F.concat(cut(F.col("_blocks"), start, F.col("pos") - start), raw, cut(F.col("_blocks"), F.col("end"), F.lit(around)))
    return placed.select(*names, "ordinal", "name", "pos", "end", raw.alias("raw"), context.alias("context"))
