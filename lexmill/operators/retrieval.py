"""BM25 and friends. One document is a corpus, its sentences are the entries.

Statistics are made once per document and serve all rules. Queries meet sentences by equality of
tokens; nothing compares every query with every sentence.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K1, B = 1.5, 0.75
#: Terms up to here are looked up inside each row; of more, the postings are joined with them.
MOST_TERMS = 10_000


#: Dimensions of up to so many rows are broadcast; larger ones are shuffled.
MOST_BROADCAST = 100_000


def beside(dim: DataFrame) -> DataFrame:
    """``dim`` with a broadcast hint if counting shows that it is small; otherwise a hint for a merge join,
    so that the other side, which grows with the corpus, is never broadcast in its place."""
    return F.broadcast(dim) if dim.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else dim.hint("merge")


def literal(words: list[str]) -> str:
    """A pattern for lower-case text that finds any of the words as it stands, whatever its signs and case."""
    return "|".join(re.escape(w.lower()) for w in words) or "(?!)"


def token_array(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), 0)


def tokens(sents: DataFrame) -> DataFrame:
    return sents.select("doc_id", "sent_id", F.explode(token_array(F.col("text"))).alias("token"))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named inside (as the variable of a lambda)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def counted_tokens(own: Column) -> Column:
    """Distinct tokens of an array with their counts; the array is sorted once, equal tokens are neighbours."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        cell = lambda at: lambda i, k: F.struct(F.get(s, i).alias("token"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("tf"))
        return let(starts, lambda at: F.transform(at, cell(at)))

    return F.when(F.size(own) > 0, let(F.sort_array(own), runs)).otherwise(F.array().cast("array<struct<token:string,tf:int>>"))


def term_index(sents: DataFrame) -> DataFrame:
    """doc_id, sent_id, token, tf, df, sent_len, n_sents, avg_len. One shuffle, by document: tokens are counted
    inside the sentence's row, and the document's sums and frequencies are windows over the same rows."""
    doc = Window.partitionBy("doc_id")
    cut = sents.select("doc_id", "sent_id", token_array(F.col("text")).alias("t"))
    sized = cut.select("doc_id", "sent_id", "t", F.size("t").alias("sent_len"), F.count("*").over(doc).alias("n_sents"), F.avg(F.size("t")).over(doc).alias("avg_len"))
    tf = sized.select("doc_id", "sent_id", "sent_len", "n_sents", "avg_len", F.explode(counted_tokens(F.col("t"))).alias("x"))
    rows = tf.select("doc_id", "sent_id", "x.token", F.col("x.tf").cast("long").alias("tf"), "sent_len", "n_sents", "avg_len")
    return rows.withColumn("df", F.count("*").over(Window.partitionBy("doc_id", "token"))).select("doc_id", "sent_id", "token", "tf", "df", "sent_len", "n_sents", "avg_len")


def query_terms(parts: list[Column], keywords: Column) -> Column:
    """Distinct tokens of the parts and keywords, first seen first."""
    return F.array_distinct(F.flatten(F.array(*[token_array(F.coalesce(p, F.lit(""))) for p in parts], token_array(F.array_join(keywords, " ")))))


def bm25(sents: DataFrame, terms: DataFrame) -> DataFrame:
    """rule_id, doc_id, sent_id, score of sentences that hold a term; ``terms``: (rule_id, token).

    Texts are cut into tokens once. One shuffle, by document, of each sentence's length and the tokens that some
    rule asks for, counted; the document's sums, the frequencies and the scores are made where its rows lie.
    """
    wanted = terms.select("token").distinct()
    known = [r["token"] for r in wanted.limit(MOST_TERMS + 1).collect()]
    own = F.filter("t", lambda x: x.isin(known)) if len(known) <= MOST_TERMS else F.col("t")
    # generated, so that the tokens are not computed again by what reads them
    cut = sents.where("doc_id is not null").select("doc_id", "sent_id", F.explode(F.array(token_array(F.col("text")))).alias("t"))
    held = cut.select("doc_id", "sent_id", F.size("t").alias("len"), own.alias("own")).select("doc_id", "sent_id", "len", counted_tokens(F.col("own")).alias("xs"))
    doc = Window.partitionBy("doc_id")
    sized = held.select("doc_id", "sent_id", "len", "xs", F.count("*").over(doc).alias("n"), F.avg("len").over(doc).alias("avg_len"))
    rows = sized.select("doc_id", "sent_id", "len", "n", "avg_len", F.explode("xs").alias("x"))
    tf = rows.select("doc_id", "sent_id", "len", "n", "avg_len", "x.token", "x.tf")
    if len(known) > MOST_TERMS:
        tf = tf.join(wanted, "token", "left_semi")
    hits = tf.withColumn("df", F.count("*").over(Window.partitionBy("doc_id", "token"))).join(beside(terms), "token")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return hits.groupBy("rule_id", "doc_id", "sent_id").agg(F.sum(part).alias("score")).where("score > 0")


def window_chunk(sents: DataFrame, w: int = 1) -> DataFrame:
    """Each sentence with its neighbours: doc_id, sent_id, chunk, indices."""
    frame = Window.partitionBy("doc_id").orderBy("sent_id").rowsBetween(-w, w)
    return sents.select("doc_id", "sent_id", F.array_join(F.collect_list("text").over(frame), " ").alias("chunk"), F.collect_list("sent_id").over(frame).alias("indices"))


def top_k(scores: DataFrame, k: int, keys: tuple[str, ...] = ("rule_id", "doc_id"), order: tuple[str, ...] = ("sent_id",)) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), *order))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k_chunks(scores: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """The best chunks of each rule and document; chunks of one span are one. Ranks are decided on ids and
    spans; only the winners meet the chunks' texts, by a merge of both sides, as either grows with the corpus."""
    keys = ["doc_id", "sent_id"]
    placed = scores.join(chunks.select(*keys, "indices").hint("merge"), keys)
    span = Window.partitionBy("rule_id", "doc_id", "indices").orderBy(F.desc("score"), "sent_id")
    best = top_k(placed.withColumn("s", F.row_number().over(span)).where("s = 1").drop("s"), k)
    return best.join(chunks.select(*keys, "chunk").hint("merge"), keys)


def max_normalise(scores: DataFrame, keys: tuple[str, ...] = ("rule_id", "doc_id")) -> DataFrame:
    best = F.max("score").over(Window.partitionBy(*keys))
    return scores.withColumn("norm", F.when(best > 0, F.col("score") / best).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, zero or unequal vectors."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fit = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0)
    return F.coalesce(F.when(fit, dot(a, b) / norm), F.lit(0.0))


def hybrid_score(lexical: DataFrame, dense: DataFrame, alpha: float = 0.5, keys: tuple[str, ...] = ("rule_id", "doc_id", "sent_id")) -> DataFrame:
    """alpha x dense + (1 - alpha) x lexical (both ``norm``); lexical alone where there is no vector."""
    both = lexical.select(*keys, F.col("norm").alias("lexical")).join(dense.select(*keys, F.col("norm").alias("dense")), list(keys), "left")
    mixed = alpha * F.col("dense") + (1 - alpha) * F.col("lexical")
    return both.withColumn("score", F.coalesce(mixed, F.col("lexical")))


def paragraph_scores(paras: DataFrame, terms: DataFrame) -> DataFrame:
    """rule_id, doc_id, para_id, score: shared distinct tokens over max(5, tokens of the paragraph). Tokens that
    no rule asks for stay in their row."""
    cut = paras.select("doc_id", "para_id", F.array_distinct(token_array(F.col("text"))).alias("t"))
    wanted = terms.distinct()
    known = [r["token"] for r in wanted.select("token").distinct().limit(MOST_TERMS + 1).collect()]
    own = F.filter("t", lambda x: x.isin(known)) if len(known) <= MOST_TERMS else F.col("t")
    held = cut.select("doc_id", "para_id", F.size("t").alias("n"), F.explode_outer(own).alias("token")).where("token is not null")
    hits = held.join(beside(wanted), "token")
    return hits.groupBy("rule_id", "doc_id", "para_id", "n").agg(F.count("*").alias("shared")).select("rule_id", "doc_id", "para_id", (F.col("shared") / F.greatest(F.lit(5), F.col("n"))).alias("score"))


def paragraph_fallback(paras: DataFrame, terms: DataFrame, window: int = 1, k: int = 8) -> DataFrame:
    """rule_id, doc_id, rank, para_id, score, indices, chunk: the ``k`` best paragraphs of a document (doc_id,
    para_id from 0 without gaps, text) for each rule, each with ``window`` neighbours on both sides.

    Windows of one span are one, as at the ends of short documents; the best paragraph stands for them.
    """
    scores = paragraph_scores(paras, terms)
    sizes = paras.groupBy("doc_id").agg((F.max("para_id") + 1).alias("n"))
    spans = scores.join(sizes.hint("merge"), "doc_id").select("rule_id", "doc_id", "para_id", "score", F.greatest(F.col("para_id") - window, F.lit(0)).alias("start"), F.least(F.col("para_id") + window, F.col("n") - 1).alias("end"))
    one = Window.partitionBy("rule_id", "doc_id", "start", "end").orderBy(F.desc("score"), "para_id")
    best = top_k(spans.withColumn("s", F.row_number().over(one)).where("s = 1").drop("s"), k, order=("para_id",))
    return _with_text_of_few(best, paras, ["rule_id", "doc_id", "rank", "para_id", "score"])


def merged_passages(paras: DataFrame, scores: DataFrame, window: int = 1) -> DataFrame:
    """rule_id, doc_id, para_id, score, indices, chunk: windows of ``window`` neighbours around all hits (rule_id,
    doc_id, para_id, score), those that meet or touch merged into passages without overlap.

    Gaps and islands: hits in order open a passage where their window starts beyond the end of all before.
    ``para_id`` and ``score`` are those of the passage's best paragraph.
    """
    sizes = paras.groupBy("doc_id").agg((F.max("para_id") + 1).alias("n"))
    order = Window.partitionBy("rule_id", "doc_id").orderBy("para_id")
    spans = scores.join(sizes.hint("merge"), "doc_id").select("rule_id", "doc_id", "para_id", "score", F.greatest(F.col("para_id") - window, F.lit(0)).alias("start"), F.least(F.col("para_id") + window, F.col("n") - 1).alias("end"))
    opens = F.coalesce(F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    island = spans.withColumn("opens", opens.cast("int")).withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    passages = island.groupBy("rule_id", "doc_id", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"), F.max_by("para_id", F.struct("score", -F.col("para_id"))).alias("para_id"),
    )
    return _with_text(passages, paras, ["rule_id", "doc_id", "para_id", "score"])


def _with_text(spans: DataFrame, paras: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` of spans (doc_id, start, end), and the paragraphs of each span as indices and chunk."""
    wide = spans.select(*keys, "start", "end", F.explode(F.sequence("start", "end")).alias("_i"))
    text = paras.select("doc_id", F.col("para_id").alias("_i"), "text").hint("merge")
    met = wide.join(text, ["doc_id", "_i"]).groupBy(*keys, "start", "end").agg(F.array_sort(F.collect_list(F.struct("_i", "text"))).alias("p"))
    return met.select(*keys, F.col("p._i").alias("indices"), F.array_join(F.col("p.text"), "\n").alias("chunk"))


def _with_text_of_few(spans: DataFrame, paras: DataFrame, keys: list[str]) -> DataFrame:
    """``_with_text`` for a bounded number of spans a document: they travel to its paragraphs, so a text is
    shuffled once, by document, and not once more for each span that holds it."""
    asked = spans.groupBy("doc_id").agg(F.collect_list(F.struct(*[c for c in keys if c != "doc_id"], "start", "end")).alias("_s"))
    text = paras.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("para_id").alias("_i"), "text"))).alias("_p"))

    def filled(s: Column) -> Column:
        return F.struct(s.alias("s"), F.filter("_p", lambda p: p["_i"].between(s["start"], s["end"])).alias("p"))

    met = text.hint("merge").join(asked, "doc_id").select("doc_id", F.explode(F.transform("_s", filled)).alias("_x"))
    own = [F.col("doc_id") if c == "doc_id" else F.col(f"_x.s.{c}").alias(c) for c in keys]
    rows = met.select(*own, F.col("_x.p").alias("p")).where(F.size("p") > 0)
    return rows.select(*keys, F.col("p._i").alias("indices"), F.array_join(F.col("p.text"), "\n").alias("chunk"))


def candidates(ranked: DataFrame, fallback: DataFrame, grid: DataFrame) -> DataFrame:
    """``ranked`` (rule_id, doc_id, unit_id, score), and ``fallback`` for the pairs of ``grid`` without any."""
    empty = grid.join(ranked.select("rule_id", "doc_id").distinct(), ["rule_id", "doc_id"], "left_anti")
    spare = fallback.join(empty, ["rule_id", "doc_id"], "left_semi")
    return ranked.withColumn("fallback_used", F.lit(False)).unionByName(spare.withColumn("fallback_used", F.lit(True)))


#: Fixed values.
STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "be", "been", "being"]
EXPANSIONS = {"ip": "intellectual property", "nda": "non-disclosure agreement", "sla": "service level agreement", "t&c": "terms and conditions"}


def optimise_query(text: Column, stop: list[str] = STOP_WORDS, expand: dict[str, str] = EXPANSIONS) -> Column:
    """Lower-case words without stop words, abbreviations written out."""
    words = F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: ~w.isin(stop) & (w != ""))
    long = F.create_map(*[F.lit(x) for kv in expand.items() for x in kv])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(long, w), w)), " ")


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text has."""

    def parts(c: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))

    size = F.size(parts(query))
    return F.when(size > 0, F.size(F.array_intersect(parts(query), parts(text))) / size).otherwise(0.0)


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def latency_stats(events: DataFrame, value: str = "value", range_rows: int = 1_000_000) -> DataFrame:
    """mean, median, p95, p99 (linear between neighbours), exact at any size: values are counted in
    ranges of about ``range_rows`` rows, and only the ranges that hold a wanted rank are ordered."""
    rows = events.select(F.col(value).cast("double").alias("v")).where("v is not null")
    n, mean = rows.agg(F.count("*"), F.avg("v")).first()
    ranges = max(1, min(10_000, n // range_rows))
    edges = rows.agg(F.percentile_approx("v", [k / ranges for k in range(1, ranges)], 100 * ranges)).first()[0] or [] if ranges > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("v"))) if edges else F.lit(0)
    counted = rows.groupBy("v").agg(F.count("*").alias("n")).withColumn("part", part)
    sizes = {r["part"]: r["n"] for r in counted.groupBy("part").agg(F.sum("n").alias("n")).collect()} if edges else {0: n}  # one row per range
    before, so_far = {}, 0
    for k in sorted(sizes):
        before[k], so_far = so_far, so_far + sizes[k]
    at = {p: p * (n - 1) for p in (0.5, 0.95, 0.99)} if n else {}
    ranks = {r for x in at.values() for r in (math.floor(x), math.ceil(x))}
    of = {r: max(k for k in before if before[k] <= r) for r in ranks}
    through = F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.where(F.col("part").isin(sorted(set(of.values())))).withColumn("through", through)

    def value_at(rank: int) -> Column:
        k = rank - before[of[rank]]
        return F.max(F.when((F.col("part") == of[rank]) & (F.col("through") > k) & (F.col("through") - F.col("n") <= k), F.col("v")))

    def between(x: float) -> Column:
        low = math.floor(x)
        return value_at(low) + (value_at(math.ceil(x)) - value_at(low)) * (x - low)

    found = [between(at[p]) if at else F.max("v") for p in (0.5, 0.95, 0.99)]
    return placed.agg(*[c.alias(name) for c, name in zip(found, ("median", "p95", "p99"), strict=True)]).select(F.lit(mean).cast("double").alias("mean"), "median", "p95", "p99")


def keyword_sections(sents: DataFrame, rules: list[tuple[str, list[str]]], most: int = 10) -> DataFrame:
    """Sentences with a rule's keyword, one neighbour on each side, the first ``most`` per rule and document.

    The keywords of all rules are one expression over the sentence, so nothing is compared pairwise.
    """
    around = Window.partitionBy("doc_id").orderBy("sent_id")
    low = F.lower("text")
    found = [F.struct(F.lit(r).alias("rule_id"), F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: F.contains(F.lower("text"), F.lower(k))).alias("matched")) for r, ks in rules]
    rows = sents.select("doc_id", "sent_id", "text", F.lag("text").over(around).alias("before"), F.lead("text").over(around).alias("after"))
    hits = rows.where(low.rlike(literal(sorted({k for _, ks in rules for k in ks})))).withColumn("hit", F.explode(F.filter(F.array(*found), lambda x: F.size(x["matched"]) > 0)))
    flat = hits.select("hit.rule_id", "doc_id", "sent_id", F.concat_ws(" ", "before", "text", "after").alias("section"), F.col("hit.matched").alias("matched"))
    rank = F.row_number().over(Window.partitionBy("rule_id", "doc_id").orderBy("sent_id"))
    return flat.withColumn("rank", rank).where(F.col("rank") <= most)
