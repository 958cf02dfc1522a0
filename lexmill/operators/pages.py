"""Page anchors ``[[page=N]]``: insertion, positions, lookup and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ANCHOR = r"\[\[page=(\d+)\]\]"


def anchor_lines(docs: DataFrame, every: int = 50) -> DataFrame:
    """A marker line before each run of ``every`` lines."""
    lines = F.split("text", "\n")
    marked = F.transform(lines, lambda line, i: F.when(i % every == 0, F.concat(F.lit("[[page="), (F.floor(i / every) + 1).cast("string"), F.lit("]]\n"), line)).otherwise(line))
    return docs.select("doc_id", F.array_join(marked, "\n").alias("text"))


def page_marker_breaks(docs: DataFrame, marker: str = r"(?i)^\s*page\s+(\d+)") -> DataFrame:
    """Lines that open a page: doc_id, page, start_line, end_line (exclusive; null: to the end). A number that
    no int holds opens a page too; its page is null."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("start_line", "line"))
    found = lines.withColumn("page", F.regexp_extract("line", marker, 1)).where("page <> ''")
    after = F.lead("start_line").over(Window.partitionBy("doc_id").orderBy("start_line"))
    return found.select("doc_id", F.col("page").try_cast("int").alias("page"), "start_line", after.alias("end_line"))


def extract_anchors(docs: DataFrame, around: int = 50) -> DataFrame:
    """doc_id, ordinal, page, pos (offset of the marker, from 0) and context on both sides.

    Splitting at the marker gives the pieces between; their summed lengths give the offsets.
    """
    pieces = F.split("text", r"\[\[page=\d+\]\]", -1)
    pages = F.regexp_extract_all("text", F.lit(ANCHOR), F.lit(1))
    marks = F.transform(pages, lambda p: F.length(p) + F.lit(9))  # [[page= and ]]
    cut = docs.select("doc_id", "text", pieces.alias("pieces"), pages.alias("pages"), marks.alias("marks"))
    one = cut.select("doc_id", "text", "pieces", "marks", F.posexplode("pages").alias("ordinal", "page"))
    before = F.aggregate(F.slice("pieces", F.lit(1), F.col("ordinal") + 1), F.lit(0), lambda a, x: a + F.length(x))
    earlier = F.aggregate(F.slice("marks", F.lit(1), F.col("ordinal")), F.lit(0), lambda a, x: a + x)
    placed = one.withColumn("pos", before + earlier)
    start = F.greatest(F.col("pos") - around, F.lit(0))
    context = F.substring(F.col("text"), start + 1, F.col("pos") + F.get("marks", F.col("ordinal")) + around - start)
    return placed.select("doc_id", "ordinal", F.col("page").cast("int").alias("page"), "pos", context.alias("context"))


def page_of_position(positions: DataFrame, anchors: DataFrame) -> DataFrame:
    """Add ``page`` to ``positions`` (doc_id, pos, ...): of the last anchor at or before pos, else 1."""
    names = positions.columns
    rows = positions.withColumn("page", F.lit(None).cast("int")).withColumn("_asks", F.lit(1))
    marks = anchors.select("doc_id", "pos", "page").withColumn("_asks", F.lit(0))
    order = Window.partitionBy("doc_id").orderBy("pos", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("page", F.last("page", ignorenulls=True).over(order))
    return both.where("_asks = 1").select(*names, F.coalesce("page", F.lit(1)).alias("page"))


def validate_anchors(anchors: DataFrame) -> DataFrame:
    """doc_id, issue, page: duplicate pages and pages below an earlier one."""
    same = F.count("*").over(Window.partitionBy("doc_id", "page"))
    highest = F.max("page").over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    rows = anchors.withColumn("same", same).withColumn("highest", highest)
    issues = F.array_compact(F.array(F.when(F.col("same") > 1, "duplicate"), F.when(F.col("page") < F.col("highest"), "out_of_order")))
    return rows.select("doc_id", F.explode(issues).alias("issue"), "page").distinct()


def missing_pages(pages: DataFrame) -> DataFrame:
    """Gaps in 1..max(page) per document (doc_id, page): doc_id, missing (array)."""
    seen = pages.groupBy("doc_id").agg(F.collect_set("page").alias("seen"), F.max("page").alias("last"))
    return seen.select("doc_id", F.array_sort(F.array_except(F.sequence(F.lit(1), F.col("last")), "seen")).alias("missing"))


def estimate_page(pos: Column, per_page: int = 3000) -> Column:
    return (F.floor(pos / per_page) + 1).cast("int")


def anchor_citation(text: Column, page: Column) -> Column:
    """Append the marker unless one is there or there is no page."""
    return F.when(text.rlike(ANCHOR) | page.isNull(), text).otherwise(F.concat(text, F.lit(" [[page="), page.cast("string"), F.lit("]]")))


def anchored_text(docs: DataFrame) -> DataFrame:
    """(text, page) pairs: what stands in front of each marker."""
    pieces = F.split("text", r"\[\[page=\d+\]\]", -1)
    pages = F.regexp_extract_all("text", F.lit(ANCHOR), F.lit(1))
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(pages)), pages, lambda t, p: F.struct(F.trim(t).alias("text"), p.cast("int").alias("page")))
    return docs.select("doc_id", F.posexplode(pairs).alias("ordinal", "x")).select("doc_id", "ordinal", "x.text", "x.page").where("text <> ''")


def annotate_sentences(sents: DataFrame) -> DataFrame:
    """Sentences (doc_id, sent_id, text, page) with their marker; without a page, the document's most frequent."""
    usual = sents.where("page is not null").groupBy("doc_id").agg(F.mode("page", deterministic=True).alias("usual"))
    both = sents.join(usual, "doc_id", "left").withColumn("page", F.coalesce("page", "usual"))
    return both.select("doc_id", "sent_id", anchor_citation(F.col("text"), F.col("page")).alias("text"), "page")
