"""Citations: locating quotes, matching answers with their sources, checks and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.operators.pages import ANCHOR, estimate_page
from lexmill.operators.retrieval import beside, literal
from lexmill.operators.text import strip


def quoted_spans(docs: DataFrame, least: int = 20, most: int = 500) -> DataFrame:
    """doc_id, ordinal, quote, pos, page of quotes of a sensible length inside the document."""
    found = docs.select("doc_id", "text", F.posexplode(F.regexp_extract_all("text", F.lit('"([^"]+)"'), F.lit(1))).alias("ordinal", "quote"))
    rows = found.where(F.length("quote").between(least, most)).withColumn("pos", F.instr("text", F.col("quote")) - 1)
    return rows.where("pos >= 0").select("doc_id", "ordinal", "quote", "pos", estimate_page(F.col("pos")).alias("page"))


def locate(text: Column, quote: Column) -> Column:
    """Offset of a quote: as it stands, else whatever its case; null if absent."""
    return F.coalesce(F.nullif(F.instr(text, quote), F.lit(0)), F.nullif(F.instr(F.lower(text), F.lower(quote)), F.lit(0))) - 1


#: Keys up to here are looked up inside each row; of more, every run of words of the texts is joined.
MOST_KEYS = 10_000


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")


def _run_codes(w: Column, n: int) -> Column:
    """Hashes of every ``n`` neighbouring words."""
    at = F.sequence(F.lit(0), F.size(w) - n)
    return F.when(F.size(w) < n, F.array().cast("array<bigint>")).otherwise(F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])))


def locate_quotes(docs: DataFrame, quotes: DataFrame, run: int = 5, block: int = 1000) -> DataFrame:
    """doc_id, item_id, pos of every quote (item_id, text) that a document holds.

    A quote's first and last word may be a part of a document's word (behind a bracket, before a
    comma), so quotes meet documents by the hash of up to ``run`` of their inner words. Quotes of
    under three words have none and are searched in every document, ``block`` of them at a time.
    """
    q = quotes.select("item_id", F.col("text").alias("quote"), _words(F.col("text")).alias("w")).where(F.size("w") > 0)
    inner = q.where("size(w) > 2").select("item_id", "quote", F.least(F.size("w") - 2, F.lit(run)).alias("n"), "w")
    code = F.lit(None).cast("long")
    for n in range(1, run + 1):
        code = F.when(F.col("n") == n, F.xxhash64(*[F.get("w", F.lit(1 + k)) for k in range(n)])).otherwise(code)
    keyed = inner.select("item_id", "quote", "n", code.alias("code"))
    sizes = [r["n"] for r in keyed.select("n").distinct().collect()]  # run values at most
    keys = [r["code"] for r in keyed.select("code").distinct().limit(MOST_KEYS + 1).collect()]
    few = len(keys) <= MOST_KEYS
    w = F.col("w")
    cut = docs.select("doc_id", "text", _words(F.col("text")).alias("w"))
    codes = F.array_distinct(F.flatten(F.array(*[_run_codes(w, n) for n in sizes]))) if sizes else F.array().cast("array<bigint>")
    wanted = cut.select("doc_id", "text", (F.filter(codes, lambda c: c.isin(keys)) if few else codes).alias("codes"))
    if few:  # only documents with a key go on, so their texts may travel
        met = wanted.select("doc_id", "text", F.explode_outer("codes").alias("code")).where("code is not null").join(keyed, "code").select("doc_id", "item_id", "text", "quote")
    else:
        pairs = wanted.select("doc_id", F.explode_outer("codes").alias("code")).where("code is not null").join(keyed.select("code", "item_id", "quote"), "code")
        met = pairs.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "item_id", "text", "quote")
    short = q.where("size(w) < 3").select("item_id", "quote")
    blocks = max(1, -(-short.count() // block))
    packed = short.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("item_id", "quote")).alias("qs"))
    beside = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")).join(packed, "block")
    held = F.filter("qs", lambda x: F.contains(F.lower("text"), F.lower(x["quote"])))
    rest = beside.select("doc_id", "text", F.explode_outer(held).alias("x")).where("x is not null").select("doc_id", "x.item_id", "text", "x.quote")
    found = met.unionByName(rest).withColumn("pos", locate(F.col("text"), F.col("quote")))
    return found.where("pos is not null").select("doc_id", "item_id", "pos").distinct()


def locate_near(docs: DataFrame, quotes: DataFrame, hints: DataFrame, reach: int = 1000) -> DataFrame:
    """doc_id, item_id, pos, end, how of every quote (item_id, text) that a document holds; ``hints`` (doc_id, item_id,
    hint) say where to look first.

    ``near``: the first occurrence that lies whole within ``reach`` of the hint; else ``exact``: the first in the
    document; else ``folded``: the first whatever its case. Hints join the pairs that are found anyway, by
    equality; a stretch of the text is searched, not a table of occurrences. Several hints give a row each.
    """
    found = locate_quotes(docs, quotes)
    wanted = found.join(hints.select("doc_id", "item_id", "hint"), ["doc_id", "item_id"], "left")
    both = wanted.join(docs.select("doc_id", F.col("text").alias("_t")), "doc_id").join(quotes.select("item_id", F.col("text").alias("_q")), "item_id")
    start = F.greatest(F.col("hint") - reach, F.lit(0))
    inside = F.instr(F.substring(F.col("_t"), (start + 1).cast("int"), (F.col("hint") + reach - start).cast("int")), F.col("_q"))
    near = F.when(inside > 0, start + inside - 1)
    exact = F.nullif(F.instr("_t", F.col("_q")), F.lit(0)) - 1
    how = F.when(near.isNotNull(), "near").when(exact.isNotNull(), "exact").otherwise("folded")
    pos = F.coalesce(near, exact, F.col("pos")).cast("int")
    return both.select("doc_id", "item_id", pos.alias("pos"), (pos + F.length("_q")).alias("end"), how.alias("how"))


def fuzzy_quotes(docs: DataFrame, quotes: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, similarity of quotes that a document holds nearly: the best 1 - levenshtein / length over
    stretches of as many words as the quote, of at least ``least``.

    Candidates by pigeonhole: of a quote of w words 2 e + 1 disjoint runs are looked up, e = (1 - least) w
    rounded up, so every stretch in which no more than 2 e words are changed still holds one of them where it
    belongs. A run has w / (2 e + 1) words, at least one. A stretch all of whose words are
    changed is found by none of them, and a quote of one word only as that word.
    """
    words = _words
    w = F.size("w")
    parts = 2 * F.ceil((1 - least) * w - 1e-9) + 1
    q = quotes.select("item_id", words(F.col("text")).alias("w")).where(w > 0).withColumn("n", F.greatest(F.lit(1), F.floor(w / parts)).cast("int"))
    sizes = [r["n"] for r in q.select("n").distinct().collect()]  # lengths of runs, few
    own = F.lit(None).cast("array<bigint>")
    for n in sizes:
        own = F.when(F.col("n") == n, _run_codes(F.col("w"), n)).otherwise(own)
    q = q.select("item_id", "n", F.posexplode(own).alias("offset", "code")).where(F.col("offset") % F.col("n") == 0).drop("n")
    keys = [r["code"] for r in q.select("code").distinct().limit(MOST_KEYS + 1).collect()]
    runs = F.flatten(F.array(*[F.transform(_run_codes(F.col("w"), n), lambda c, i: F.struct(i.alias("at"), c.alias("code"))) for n in sizes])) if sizes else F.array().cast("array<struct<at:int,code:bigint>>")
    wanted = F.filter(runs, lambda r: r["code"].isin(keys)) if len(keys) <= MOST_KEYS else runs
    d = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode_outer(wanted).alias("r")).where("r is not null").select("doc_id", "r.at", "r.code")
    places = d.join(beside(q), "code").select("doc_id", "item_id", (F.col("at") - F.col("offset")).alias("start")).where("start >= 0").distinct()
    both = places.join(docs.select("doc_id", words(F.col("text")).alias("w")).hint("merge"), "doc_id").join(beside(quotes.select("item_id", words(F.col("text")).alias("q"))), "item_id")
    pairs = both.select("doc_id", "item_id", F.array_join(F.slice("w", F.col("start") + 1, F.size("q")), " ").alias("a"), F.array_join("q", " ").alias("b"))
    longest, shortest = F.greatest(F.length("a"), F.length("b")), F.least(F.length("a"), F.length("b"))
    # no filter on pairs: pushed into the join, it would join the words again wherever it names them. The difference of
    # lengths is a part of the distance; one above the most (and one more, for rounding) is not computed to its end
    sized = pairs.select("doc_id", "item_id", "a", "b", longest.alias("longest"), shortest.alias("shortest"))
    most = F.floor((1 - least) * F.col("longest") + 1).cast("int")
    distance = F.when(F.col("shortest") >= least * F.col("longest") - 1e-9, F.call_function("levenshtein", F.col("a"), F.col("b"), most))
    scored = sized.select("doc_id", "item_id", "longest", distance.alias("distance")).select("doc_id", "item_id", F.when(F.col("distance") >= 0, 1 - F.col("distance") / F.col("longest")).alias("score"))
    return scored.groupBy("doc_id", "item_id").agg(F.max("score").alias("similarity")).where(F.col("similarity") >= least)


def citation_problems(found: Column, page: Column, expected: Column, marker: Column) -> Column:
    return F.array_compact(F.array(
        F.when(~found, "not_found"), F.when(page.isNotNull() & expected.isNotNull() & (page != expected), "page_mismatch"), F.when(marker.isNotNull() & ~marker.rlike("^" + ANCHOR + "$"), "bad_marker"),
    ))


def citations_by_page(citations: DataFrame) -> DataFrame:
    return citations.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("citation_id")).alias("citations"))


def key_phrases(text: Column, most: int = 5) -> Column:
    """First and last four words of sentences of six words and more; shorter ones of three whole."""
    sents = F.filter(F.transform(F.split(text, r"[.!?]+", -1), strip), lambda s: F.length(s) >= 10)

    def of(s: Column) -> Column:
        w = F.split(s, r"\s+")
        ends = F.array(F.array_join(F.slice(w, 1, 4), " "), F.array_join(F.slice(w, -4, 4), " "))
        return F.when(F.size(w) >= 6, ends).when(F.size(w) >= 3, F.array(s)).otherwise(F.array().cast("array<string>"))

    return F.slice(F.array_distinct(F.flatten(F.transform(sents, of))), 1, most)


def normal(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(strip(text), r"\s+", " "), r"[^\p{L}\p{N}_\s.,;:!?]", ""))


def phrase_match(phrase: Column, text: Column) -> Column:
    """1 for containment, else the best share of equal words over windows of the phrase's length; below three words 0."""
    p, t = F.split(normal(phrase), " "), F.split(normal(text), " ")
    n = F.size(p)
    starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
    shares = F.transform(starts, lambda i: F.size(F.filter(F.zip_with(p, F.slice(t, i, n), lambda a, b: a == b), lambda x: x)) / n)
    return F.when(F.contains(normal(text), normal(phrase)), 1.0).when(n < 3, 0.0).otherwise(F.coalesce(F.array_max(shares), F.lit(0.0)))


def answer_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, sent_id, type, confidence: a citation per source sentence (answer_id, sent_id, sentence, page)
    that some key phrase of the answer (answer_id, answer) matches at .6 and more, those with a page
    first; without any, the first source at .3; an empty answer is not_found."""
    empty = strip(F.coalesce("answer", F.lit(""))) == ""
    phrases = answers.where(~empty).select("answer_id", F.explode(key_phrases(F.col("answer"))).alias("phrase"))
    scored = phrases.join(sources, "answer_id").withColumn("confidence", phrase_match(F.col("phrase"), F.col("sentence")))
    best = scored.groupBy("answer_id", "sent_id", "page").agg(F.max("confidence").alias("confidence")).where("confidence >= 0.6")
    kind = F.when(F.col("confidence") >= 0.95, "quote").when(F.col("confidence") >= 0.8, "paraphrase").otherwise("inference")
    rank = F.row_number().over(Window.partitionBy("answer_id").orderBy(F.col("page").isNull(), F.desc("confidence"), "sent_id"))
    matched = best.select("answer_id", "sent_id", kind.alias("type"), "confidence", rank.alias("rank"))
    spare = sources.groupBy("answer_id").agg(F.min(F.struct(F.col("page").isNull().alias("p"), "sent_id")).alias("s"))
    open_ = answers.where(~empty).select("answer_id").join(matched.select("answer_id").distinct(), "answer_id", "left_anti").join(spare, "answer_id")
    fallback = open_.select("answer_id", F.col("s.sent_id").alias("sent_id"), F.lit("inference").alias("type"), F.lit(0.3).alias("confidence"), F.lit(1).alias("rank"))
    none = answers.where(empty).select("answer_id", F.lit(None).cast("int").alias("sent_id"), F.lit("not_found").alias("type"), F.lit(0.0).alias("confidence"), F.lit(1).alias("rank"))
    return matched.unionByName(fallback).unionByName(none)


def citation_location(section: Column, page: Column, sentence_id: Column) -> Column:
    place = F.concat_ws(" ", F.concat(F.lit("Section "), section), F.concat(F.lit("[[page="), page.cast("string"), F.lit("]]")))
    return F.coalesce(F.nullif(place, F.lit("")), sentence_id, F.lit("Unknown location"))


def fallback_citation(sents: DataFrame, keywords: list[str]) -> DataFrame:
    """The first sentence per document with a keyword, those with a page first, at .4."""
    hits = sents.where(F.lower("text").rlike(literal(keywords)))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("page").isNull(), "sent_id"))
    return hits.withColumn("r", rank).where("r = 1").select("doc_id", "sent_id", "page", F.lit(0.4).alias("confidence"))


def backfill_page(sents: DataFrame, w: int = 2) -> DataFrame:
    """Sentences without page take the first page among their neighbours."""
    frame = Window.partitionBy("doc_id").orderBy("sent_id").rowsBetween(-w, w)
    return sents.withColumn("page", F.coalesce("page", F.first("page", ignorenulls=True).over(frame)))


def citation_summary(citations: DataFrame) -> DataFrame:
    return citations.groupBy("type").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"), F.min("confidence").alias("lowest"), F.max("confidence").alias("highest"))


def requirements(status: Column, n: Column, least: Column, rationale: Column) -> Column:
    return F.array_compact(F.array(
        F.when((status != "unknown") & (n < least), "too_few_citations"), F.when(status.isin("compliant", "non_compliant") & (n == 0), "no_evidence"), F.when(F.length(F.coalesce(rationale, F.lit(""))) < 20, "short_rationale"),
    ))


def evidence_confidence(valid: Column, valid_ratio: Column, anchor_ratio: Column, errors: Column, warnings: Column) -> Column:
    return F.when(~valid, 0.0).otherwise((valid_ratio + anchor_ratio + F.greatest(F.lit(0.0), 1 - 0.1 * errors - 0.05 * warnings)) / 3)


def enforce_evidence(verdicts: DataFrame, citations: DataFrame) -> DataFrame:
    """Verdicts without citation become unknown at 0; missing anchors halve the confidence."""
    n = citations.groupBy("doc_id", "rule_id").agg(F.count("*").alias("n"), F.count_if(F.col("page").isNull()).alias("bare"))
    both = verdicts.join(n, ["doc_id", "rule_id"], "left").na.fill(0, ["n", "bare"])
    status = F.when(F.col("n") == 0, "unknown").otherwise(F.col("status"))
    confidence = F.when(F.col("n") == 0, 0.0).when(F.col("bare") > 0, F.col("confidence") / 2).otherwise(F.col("confidence"))
    return both.select("doc_id", "rule_id", status.alias("status"), confidence.alias("confidence"))
