"""Benchmark decontamination with DataFrame expressions only.

An item of n shingles (five lower-case words each) is 0.8 like a stretch of n shingles only if at
least 0.8 n places of that stretch hold a shingle of the item. Every shingle of every document is
looked up by its 64-bit hash among the items' shingles; where a stretch holds enough places, it is
compared. Nothing that is 0.8 alike is missed, wherever it stands and whatever was edited. At every
such start the exact similarity, of shingles weighted by how often they occur, decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import SPACE_CLASS, ascii_lower, keep

SHINGLE, LEAST = 5, 0.8
#: Up to so many shingles of all items their index is broadcast (about a hundred bytes each); more are joined.
MOST_BROADCAST = 500_000
SPACES = " \t\n\x0b\x0c\r"


def leak_words(text: Column) -> Column:
    inner = F.trim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_CLASS))


def _shingles(w: Column, one) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: one(*[F.get(w, i + k) for k in range(SHINGLE)]))


def shingle_codes(w: Column) -> Column:
    return F.when(F.size(w) < SHINGLE, F.array().cast("array<bigint>")).otherwise(_shingles(w, F.xxhash64))


def shingle_texts(w: Column) -> Column:
    return F.when(F.size(w) < SHINGLE, F.array().cast("array<string>")).otherwise(_shingles(w, lambda *x: F.concat_ws(" ", *x)))


def leaks(docs: DataFrame, items: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """doc_id, item_id, similarity, first_word: each benchmark item (item_id, text) that a document
    (doc_id, text) holds, at the place where it is most alike (the first, on ties).

    Similarity is the sum of the smaller over the sum of the larger shingle counts of the item and
    of the document's stretch of the item's length, 0.8 at least. Null, empty and short texts hold
    nothing; items of under five words have no shingle and take no part, as do rows without id.
    Rows that share an id count as one document or item.
    """
    cut = items.where("item_id is not null").select("item_id", leak_words(F.col("text")).alias("w")).select("item_id", shingle_codes(F.col("w")).alias("h"), shingle_texts(F.col("w")).alias("texts"))
    cut = keep(cut, "items").where(F.size("h") > 0)
    many = cut.agg(F.sum(F.size("h"))).first()[0] or 0

    def within_bound(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if many <= most_broadcast else df

    index = cut.select("item_id", F.size("h").alias("length"), F.explode_outer(F.array_distinct("h")).alias("code"))
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    coded = texts.select("doc_id", leak_words(F.col("text")).alias("w")).select("doc_id", shingle_codes(F.col("w")).alias("h"))
    # outer, as the plain form would add a filter that computes the shingles a second time
    probes = coded.select("doc_id", F.posexplode_outer("h").alias("place", "code")).where("code is not null")
    met = probes.join(within_bound(index), "code")
    # bounded by a document's words; rows that share an id may add places, never lose them
    held = met.groupBy("doc_id", "item_id", "length").agg(F.sort_array(F.collect_list("place")).alias("at"))
    needed = F.ceil(F.col("length") * LEAST - 1e-9).cast("int")
    held = held.select("*", needed.alias("needed")).where(F.size("at") >= F.col("needed"))
    # the starts of stretches that hold the i-th place and the next ones up to ``needed``
    last = lambda i: F.get("at", i + F.col("needed") - 1)
    starts = lambda i: F.when(last(i) - F.get("at", i) < F.col("length"), F.sequence(last(i) - F.col("length") + 1, F.get("at", i))).otherwise(F.array().cast("array<int>"))
    found = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("needed")), starts)))
    places = held.select("doc_id", "item_id", "length", F.explode(found).alias("start")).select("doc_id", F.struct("item_id", "start", "length").alias("c"))
    by_doc = places.groupBy("doc_id").agg(F.collect_set("c").alias("cs"))  # bounded by a document's places and the items they meet
    regions = F.transform(
        "cs",
        lambda c: F.struct(c["item_id"].alias("item_id"), c["start"].alias("start"), F.slice(F.col("w"), F.greatest(c["start"], F.lit(0)) + 1, c["length"] + SHINGLE - 1 + F.least(c["start"], F.lit(0))).alias("words")),
    )
    # texts travel as they are; words are cut behind the join, of documents with a match alone
    matched = texts.join(by_doc, "doc_id").select("doc_id", leak_words(F.col("text")).alias("w"), "cs")
    stretches = matched.select("doc_id", F.explode_outer(regions).alias("r")).select("doc_id", "r.item_id", F.greatest("r.start", F.lit(0)).alias("start"), shingle_texts(F.col("r.words")).alias("found"))
    repeats = F.filter(F.array_distinct("texts"), lambda x: F.size(F.filter(F.col("texts"), lambda y: y == x)) > 1)
    compared = stretches.join(within_bound(cut.select("item_id", "texts", repeats.alias("repeats"))), "item_id")

    def times(a: str, x: Column) -> Column:
        return F.size(F.filter(F.col(a), lambda y: y == x))

    again = F.aggregate("repeats", F.lit(0), lambda n, x: n + F.greatest(F.least(times("texts", x), times("found", x)) - 1, F.lit(0)))
    shared = F.size(F.array_intersect("texts", "found")) + again
    scored = compared.select("doc_id", "item_id", "start", F.size("texts").alias("a"), F.size("found").alias("b"), shared.alias("both"))
    alike = (F.col("both") / (F.col("a") + F.col("b") - F.col("both"))).alias("similarity")
    good = scored.select("doc_id", "item_id", "start", alike).where(F.col("similarity") >= LEAST)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before"))).alias("best")
    return good.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.similarity", (-F.col("best.before")).cast("long").alias("first_word"))
