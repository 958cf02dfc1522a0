"""Segmentation, filters and text measures: documents in, rows or columns out.

``sep`` is the paragraph separator of a corpus: a blank line in converted contracts, a line feed in
plain corpora. ``\\s``, ``\\w`` and ``\\d`` are ASCII classes throughout.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions import lexicons as L


def strip(c: Column) -> Column:
    """Without the ASCII white space at both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\x0c\r"))


def word_count(c: Column) -> Column:
    return F.when(strip(c) == "", 0).otherwise(F.size(F.split(strip(c), r"\s+")))


def close_quotes(text: Column) -> Column:
    """Unescape angle brackets; no blank beside a quotation mark."""
    out = F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    for mark in ("'", '"'):
        out = F.replace(out, F.lit(f" {mark} "), F.lit(mark))
    for mark in ("'", '"'):
        out = F.replace(out, F.lit(f"{mark} "), F.lit(mark))
    for mark in ("'", '"'):
        out = F.replace(out, F.lit(f" {mark}"), F.lit(mark))
    return out


def paragraph_array(text: Column, sep: str = "\n\n") -> Column:
    """Cleaned paragraphs: lines trimmed and joined by a blank, empty ones dropped."""

    def joined(p: Column) -> Column:
        lines = F.filter(F.transform(F.split(p, "\n"), strip), lambda x: x != "")
        return F.array_join(lines, " ")

    return F.filter(F.transform(F.split(close_quotes(F.coalesce(text, F.lit(""))), sep), joined), lambda p: p != "")


def clean_text(text: Column, sep: str = "\n\n") -> Column:
    return F.array_join(paragraph_array(text, sep), sep)


def paragraphs(docs: DataFrame, sep: str = "\n\n") -> DataFrame:
    """doc_id, para_id, text of the non-blank paragraphs, numbered as they stand."""
    cut = docs.select("doc_id", F.posexplode(F.split("text", sep)).alias("para_id", "text"))
    return cut.select("doc_id", "para_id", strip(F.col("text")).alias("text")).where("text <> ''")


def _kind(p: Column, item: str) -> Column:
    comment = p.startswith("<!--") & p.endswith("-->")
    return F.when(comment, "comment").when(p.startswith("#"), "header").when(p.rlike(item), "item").otherwise("text")


def pieces(text: Column, sep: str, item: str) -> Column:
    """The sentence candidates of a text in order, as an array of (kind of their paragraph, text)."""
    kinds = F.transform(paragraph_array(text, sep), lambda p: F.struct(p.alias("para"), _kind(p, item).alias("kind")))

    def cut(s: Column) -> Column:
        para, kind = s["para"], s["kind"]
        parts = F.when(kind == "header", F.array(F.regexp_replace(para, r"^#+\s*", ""))).when(kind == "item", F.array(para)).otherwise(F.split(para, r"(?<=[.!?])\s+(?=[A-Z])"))
        return F.transform(parts, lambda x: F.struct(kind.alias("kind"), strip(x).alias("text")))

    return F.flatten(F.transform(F.filter(kinds, lambda s: s["kind"] != "comment"), cut))


def numbered(docs: DataFrame, texts: Column) -> DataFrame:
    """doc_id, sent_id (from 0), text of an array of texts: numbered in the row, without a shuffle."""
    # outer, as the plain form would add a filter that computes the texts a second time
    return docs.select("doc_id", F.posexplode_outer(texts).alias("sent_id", "text")).where("sent_id is not null")


def is_sentence(t: Column) -> Column:
    starts = t.startswith("|") | t.startswith("+-") | t.startswith("=") | t.startswith("_")
    return (F.length(t) > 30) & ~starts & t.rlike(r"\S\s+\S+\s+\S+\s+\S") & t.rlike(r"\p{L}")  # four words, a letter


def sentence_array(text: Column, sep: str) -> Column:
    def good(s: Column) -> Column:
        t, kind = s["text"], s["kind"]
        return F.when(kind == "header", F.length(t) > 15).when(kind == "item", F.length(t) > 30).otherwise(is_sentence(t))

    return F.transform(F.filter(pieces(text, sep, L.LIST_ITEM), good), lambda s: s["text"])


def sentences(docs: DataFrame, sep: str = "\n\n") -> DataFrame:
    """doc_id, sent_id (from 0), text. Headers and list items stay whole."""
    return numbered(docs, sentence_array(F.col("text"), sep))


def sentence_stats(docs: DataFrame, sep: str = "\n\n") -> DataFrame:
    """Per document: paragraphs, processed, skipped (comments) and sentences."""
    paras = paragraph_array(F.col("text"), sep)
    comments = F.filter(paras, lambda p: p.startswith("<!--") & p.endswith("-->"))
    counts = docs.select("doc_id", F.size(paras).cast("long").alias("paragraphs"), F.size(comments).cast("long").alias("skipped"), F.size(sentence_array(F.col("text"), sep)).cast("long").alias("sentences"))
    return counts.select("doc_id", "paragraphs", (F.col("paragraphs") - F.col("skipped")).alias("processed"), "skipped", "sentences")


def drop_noise_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_id, text of the lines that match none of the noise patterns; blanks collapsed."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_id", "line")).withColumn("stripped", strip(F.col("line")))
    good = lines.where((F.col("stripped") != "") & ~F.col("stripped").rlike(L.NOISE_LINE))
    return good.select("doc_id", "line_id", strip(F.regexp_replace(close_quotes(F.col("line")), r"\s+", " ")).alias("text"))


def symbol_share(t: Column, symbols: str) -> Column:
    gone = F.translate(t, symbols, "")
    return (F.length(t) - F.length(gone)) / F.length(t)


def is_noise(t: Column, low: Column | None = None, words: Column | None = None) -> Column:
    """Short, tell-tale or mostly symbols; the stripped lower-case text and its words may be at hand."""
    low, words = F.lower(strip(t)) if low is None else low, word_count(t) if words is None else words
    tell = low.rlike("|".join(map(re.escape, L.NOISE_INDICATORS)))
    return (F.length(low) < 15) | (words < 4) | (symbol_share(t, L.NOISE_SYMBOLS) > 0.3) | tell


def reference_sentences(docs: DataFrame, sep: str = "\n\n") -> DataFrame:
    """The stricter variant for reference documents, paragraph by paragraph."""
    measured = F.transform(pieces(F.col("text"), sep, L.REFERENCE_ITEM), lambda s: F.struct(s["kind"].alias("kind"), s["text"].alias("text"), F.lower(strip(s["text"])).alias("low"), word_count(s["text"]).alias("words")))

    def good(s: Column) -> Column:
        t, kind = s["text"], s["kind"]
        plain = (F.length(t) > 25) & (s["words"] > 5) & ~t.rlike(r"^[\d\-*•|]") & t.rlike(r"\p{L}")
        wanted = F.when(kind == "header", (F.length(t) > 15) & t.contains(".")).when(kind == "item", t.rlike(r"[.!?;:]$")).otherwise(plain)
        return wanted & ~is_noise(t, s["low"], s["words"])

    return numbered(docs, F.transform(F.filter(measured, good), lambda s: F.regexp_replace(s["text"], r"\s+", " ")))


def keep_legal(sents: DataFrame, keywords: list[str] = L.LEGAL_KEYWORDS, least: int = 40) -> DataFrame:
    """Sentences with a keyword or a capitalised word that are long enough and no bare number or bullet."""
    t = strip(F.col("text"))
    hit = F.lower(t).rlike("|".join(keywords)) | t.rlike(r"(?<![A-Za-z0-9_])[A-Z][a-z]+")
    return sents.where((F.length(t) >= least) & ~t.rlike(r"^[\d.)(\-\s]+$") & hit)


def filter_ratio(sents: DataFrame, kept: DataFrame) -> DataFrame:
    """Share of each document's sentences that ``kept`` still has."""
    total = sents.groupBy("doc_id").agg(F.count("*").alias("initial"))
    left = kept.groupBy("doc_id").agg(F.count("*").alias("kept"))
    both = total.join(left, "doc_id", "left").na.fill(0, ["kept"])
    return both.withColumn("ratio", F.col("kept") / F.col("initial"))


def period_split(docs: DataFrame) -> DataFrame:
    cut = docs.select("doc_id", F.posexplode(F.split("text", r"\.")).alias("part_id", "text"))
    return cut.select("doc_id", "part_id", strip(F.col("text")).alias("text")).where("text <> ''")


def strip_anchors(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\[\[page=\d+\]\]", ""))


def with_metadata_sentence(sents: DataFrame, metadata: DataFrame) -> DataFrame:
    """A synthetic first sentence (doc_id, text of ``metadata``) at position 0; the others move by one."""
    first = metadata.select("doc_id", F.lit(0).alias("sent_id"), "text")
    return first.unionByName(sents.select("doc_id", (F.col("sent_id") + 1).alias("sent_id"), "text"))


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def doc_identifier(path: Column) -> Column:
    """File stem with blanks, slashes and hyphens as underscores, 50 characters at most."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.substring(F.translate(stem, " /-", "___"), 1, 50)


def sentence_key(sent_id: Column) -> Column:
    return F.format_string("sent_%04d", sent_id)


# -- measures of whole documents ------------------------------------------------------------------


def type_scores(docs: DataFrame, patterns: list[tuple[str, str]], head: int = 5000) -> DataFrame:
    """doc_id, type, score: 3 for each pattern that fits the name, and per pattern up to 5 hits in the head."""
    name, text = F.lower(F.col("name")), F.lower(F.substring("text", 1, head))
    order, by_type = [], {}
    for kind, pattern in patterns:
        by_type.setdefault(kind, []).append(pattern)
        order += [kind] * (kind not in order)
    entries = []
    for n, kind in enumerate(order):
        score = F.lit(0)
        for p in by_type[kind]:
            score = score + F.when(name.rlike(p), 3).otherwise(0) + F.least(F.regexp_count(text, F.lit(p)), F.lit(5))
        entries.append(F.struct(F.lit(n).alias("ordinal"), F.lit(kind).alias("type"), score.alias("score")))
    return docs.select("doc_id", F.explode(F.array(*entries)).alias("x")).select("doc_id", "x.ordinal", "x.type", "x.score")


def doc_type(docs: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """doc_id, type, confidence: the best score, earlier types on ties; Unknown without any hit."""
    best = type_scores(docs, patterns).groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("ordinal")).alias("before"), "type")).alias("b"))
    known = F.col("b.score") > 0
    return best.select("doc_id", F.when(known, F.col("b.type")).otherwise("Unknown").alias("type"), F.least(F.lit(1.0), F.col("b.score") / 10).alias("confidence"))


def filename_type(name: Column, patterns: list[tuple[str, str]]) -> Column:
    """The first type with a pattern that fits the file stem."""
    out = F.lit(None).cast("string")
    for kind, p in reversed(patterns):
        out = F.when(F.lower(name).rlike(p), kind).otherwise(out)
    return out


def doc_title(docs: DataFrame, keywords: list[str] = L.TITLE_KEYWORDS) -> DataFrame:
    """The first of 20 lines that is a title: a header or line with a keyword, or capitals only."""
    lines = docs.select("doc_id", F.posexplode(F.slice(F.split("text", "\n"), 1, 20)).alias("pos", "line")).withColumn("line", strip(F.col("line")))
    line, header = F.col("line"), F.regexp_replace("line", r"^#+\s*", "")
    likely = "|".join(keywords)
    is_header = line.startswith("#")
    capitals = (F.upper(line) == line) & (F.lower(line) != line) & (F.length(line) > 15)
    title = F.when(is_header, F.when(F.lower(header).rlike(likely), header)).when(capitals, F.initcap(line)).when(F.lower(line).rlike(likely), line)
    found = lines.where(F.length("line") >= 10).withColumn("title", title).where("title is not null")
    return found.groupBy("doc_id").agg(F.min_by("title", "pos").alias("title"))


def section_headers(docs: DataFrame, most: int = 5) -> DataFrame:
    """The first distinct headers among 200 lines: doc_id, rank, header."""
    lines = docs.select("doc_id", F.posexplode(F.slice(F.split("text", "\n"), 1, 200)).alias("pos", "line")).withColumn("line", strip(F.col("line")))
    header = F.lit(None).cast("string")
    for p in reversed(L.HEADER_PATTERNS):
        header = F.when(F.col("line").rlike(p), F.regexp_extract("line", p, 1)).otherwise(header)
    found = lines.withColumn("header", strip(header)).where(F.length("header") > 10)
    first = found.groupBy("doc_id", "header").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return first.withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", "rank", "header")


def mentions_any(text: Column, words: list[str]) -> Column:
    return F.lower(text).rlike("|".join(words))


def text_quality(text: Column) -> Column:
    t = strip(text)
    specials = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]", "")) / F.length(text)
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    mean = F.length(F.regexp_replace(text, r"\s", "")) / F.size(words)
    lines = F.size(F.split(F.regexp_replace(text, r"\n$", ""), "\n"))
    return (
        F.when(F.length(t) < 50, 0.0).when(specials > 0.3, 0.3).when((mean < 2) | (mean > 15), 0.4)
        .when((F.size(words) > 100) & (lines > 5), 0.8).when(F.size(words) > 50, 0.6).otherwise(0.4)
    )


def page_text_length(docs: DataFrame) -> DataFrame:
    visible = F.length(F.regexp_replace("text", r"\s", ""))
    return docs.select("doc_id", F.length(strip(F.regexp_replace("text", r"\s+", " "))).alias("text_length"), (visible < 0.1 * F.length("text")).alias("mostly_blank"))


def image_ratio(text: Column, mark: str = r"(?i)<!--\s*image\s*-->") -> Column:
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S")))
    return F.when(lines > 0, F.regexp_count(text, F.lit(mark)) / lines).otherwise(0.0)


def table_lines(docs: DataFrame) -> DataFrame:
    def hits(p: str) -> Column:
        return F.regexp_count("text", F.lit(p))

    broken = hits(r"\|\s*\|") + hits(r"\|{3,}") + hits(r"(?m)^[ \t]*\|+[ \t]*$")
    counted = docs.select("doc_id", hits(r"\|.*\|.*\|").alias("table_lines"), broken.alias("broken"))
    return counted.withColumn("broken_tables", (F.col("table_lines") > 0) & (F.col("broken") > 0.3 * F.col("table_lines")))


def garbled_text(docs: DataFrame) -> DataFrame:
    count = F.lit(0)
    for p in L.GARBLED_PATTERNS:
        count = count + F.regexp_count("text", F.lit(p))
    specials = F.length(F.regexp_replace("text", r"[\p{L}\p{N}_\s.,;:!?\-()\[\]]", ""))
    share = F.when(F.length("text") > 0, specials / F.length("text")).otherwise(0.0)
    counted = docs.select("doc_id", count.alias("hits"), share.alias("special_ratio"))
    return counted.withColumn("garbled", (F.col("hits") > 10) | (F.col("special_ratio") > 0.1))


def structure_grade(docs: DataFrame) -> DataFrame:
    counted = docs.select(
        "doc_id",
        F.regexp_count("text", F.lit(r"(?m)^#+\s+.+")).alias("headers"),
        F.regexp_count("text", F.lit(r"(?m)^\d+\.\s+.+")).alias("sections"),
        F.size(F.split("text", r"\n\n+")).alias("paragraphs"),
    )
    grade = F.when((F.col("headers") > 3) | (F.col("sections") > 3), "good").when(F.col("paragraphs") > 10, "fair").otherwise("poor")
    return counted.withColumn("grade", grade)


def with_measures(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text, ...) with text_length, mostly_blank, broken_tables, garbled and grade, by the same
    expressions as the operators above, so that one scan serves them all."""
    for measure, names in ((page_text_length, ("text_length", "mostly_blank")), (table_lines, ("broken_tables",)), (garbled_text, ("garbled",)), (structure_grade, ("grade",))):
        whole = rows.select(F.struct(*rows.columns).alias("doc_id"), "text")  # an id that carries the row along
        rows = measure(whole).select("doc_id.*", *names)
    return rows
