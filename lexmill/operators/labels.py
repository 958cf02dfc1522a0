"""Labelling by taxonomy, and the joins that use labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.operators.retrieval import beside, literal, token_array


def canonical_label(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """Replace ``label`` by its canonical form through ``aliases`` (alias, canonical); unknown ones stay."""
    known = F.broadcast(aliases.select(F.lower("alias").alias("_key"), "canonical"))  # a dimension of the taxonomy
    keyed = labels.withColumn("_key", F.lower(F.trim("label")))
    return keyed.join(known, "_key", "left").withColumn("label", F.coalesce("canonical", "label")).drop("_key", "canonical")


def allowed_labels(classes: Column, allowed: list[str]) -> Column:
    """Only allowed labels, in order; ``none`` when nothing is left."""
    kept = F.filter(classes, lambda c: c.isin(allowed))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("none")))


#: Taxonomies of up to so many keywords are walked inside each row; larger ones are joined.
MOST_KEYWORDS = 10_000


def taxonomy(keywords: DataFrame, compounds: DataFrame | None = None) -> DataFrame:
    """label, n, run: keywords (label, keyword), and compound terms (keyword, labels) that stand for several
    labels, cut into words as sentences are. Keywords without a letter or digit have no words and go."""
    rows = keywords.select("label", "keyword")
    if compounds is not None:
        rows = rows.unionByName(compounds.select(F.explode("labels").alias("label"), "keyword"))
    cut = rows.select("label", token_array(F.col("keyword")).alias("w")).where(F.size("w") > 0)
    return cut.select("label", F.size("w").alias("n"), F.array_join("w", " ").alias("run")).distinct()


def label_sentences(sents: DataFrame, keywords: DataFrame, compounds: DataFrame | None = None) -> DataFrame:
    """doc_id, sent_id, classes: labels of the keywords and compound terms that stand in the sentence, as a run
    of its words, of any length.

    The taxonomy is a trie of words whose nodes are named by the words that lead there. Each sentence walks
    it in its own row, from every word at once: level by level only those starts stay whose run leads to a
    node, looked up by hash. Nothing is exploded, joined or shuffled. Only beyond MOST_KEYWORDS runs of words
    are joined with the taxonomy.
    """
    return with_classes(sents.select("doc_id", "sent_id", "text"), keywords, compounds).where("classes is not null").select("doc_id", "sent_id", "classes")


def with_classes(sents: DataFrame, keywords: DataFrame, compounds: DataFrame | None = None) -> DataFrame:
    """All rows and columns of sentences (doc_id, sent_id, text), and the classes of ``label_sentences``, null
    without any: what needs the sentences beside their labels cuts and walks each text once."""
    keys = taxonomy(keywords, compounds)
    known = keys.limit(MOST_KEYWORDS + 1).collect()
    own = sents.columns
    if len(known) > MOST_KEYWORDS:
        found = _label_by_join(sents.select("doc_id", "sent_id", token_array(F.col("text")).alias("t")), keys)
        return sents.join(found.hint("merge"), ["doc_id", "sent_id"], "left").select(*own, "classes")
    if not known:
        return sents.withColumn("classes", F.lit(None).cast("array<string>"))
    whole: dict[int, set[str]] = {}
    nodes: dict[int, set[str]] = {}
    for r in known:
        words = r.run.split(" ")
        whole.setdefault(r.n, set()).add(r.run)
        for d in range(1, r.n + 1):
            nodes.setdefault(d, set()).add(" ".join(words[:d]))
    heads = {run.split(" ")[0] for run in nodes.get(2, [])}
    empty = F.array().cast("array<string>")
    # generated columns are computed once, however many read them
    rows = sents.select(*own, F.explode_outer(F.array(token_array(F.col("text")))).alias("_t"))
    rows = rows.select("*", F.explode_outer(F.array(F.filter("_t", lambda w: w.isin(sorted(nodes[1]))))).alias("_w"))
    found = [F.filter("_w", lambda w: w.isin(sorted(whole[1])))] if 1 in whole else []
    if heads:
        # most sentences hold no word that opens a longer run: only the others look for its places
        places = F.filter(F.transform("_t", lambda w, i: F.when(w.isin(sorted(heads)), i + 1)), lambda i: i.isNotNull())
        opens = F.exists("_w", lambda w: w.isin(sorted(heads)))
        rows = rows.select("*", F.explode_outer(F.array(F.when(opens, F.filter(places, _leads_to("_t", 2, nodes[2]))))).alias("_at2"))
    for d in range(2, max(nodes) + 1):
        if d in whole:
            found.append(F.coalesce(F.filter(F.transform(f"_at{d}", _run("_t", d)), _within(whole[d])), empty))
        if d + 1 in nodes:
            rows = rows.withColumn(f"_at{d + 1}", F.filter(f"_at{d}", _leads_to("_t", d + 1, nodes[d + 1])))
    runs_of: dict[str, list[str]] = {}
    for r in known:
        runs_of.setdefault(r.label, []).append(r.run)
    hits = rows.select(*own, F.explode_outer(F.array(F.concat(*found))).alias("_hits"))
    classes = F.array_compact(F.array(*[F.when(F.arrays_overlap("_hits", F.array(*map(F.lit, sorted(runs_of[k])))), k) for k in sorted(runs_of)]))
    return hits.select(*own, F.when(F.size("_hits") > 0, classes).alias("classes"))


def _run(column: str, n: int):
    return lambda i: F.array_join(F.slice(F.col(column), i, n), " ")


def _within(runs: set[str]):
    return lambda r: r.isin(sorted(runs))


def _leads_to(column: str, n: int, runs: set[str]):
    return lambda i: _run(column, n)(i).isin(sorted(runs))


def _label_by_join(t: DataFrame, keys: DataFrame) -> DataFrame:
    """The same for large taxonomies: runs of the keywords' lengths whose first word opens a keyword."""
    sizes = [r.n for r in keys.select("n").distinct().collect()]  # lengths of keywords
    heads = beside(keys.select(F.split("run", " ")[0].alias("head")).distinct())
    starts = t.select("doc_id", "sent_id", "t", F.posexplode("t").alias("i", "head")).join(heads, "head", "left_semi")
    runs = F.array(*[F.when(F.size("t") - F.col("i") >= n, F.array_join(F.slice("t", F.col("i") + 1, n), " ")) for n in sizes])
    rows = starts.select("doc_id", "sent_id", F.explode(F.array_compact(runs)).alias("run"))
    return rows.join(beside(keys.select("run", "label")), "run").groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_set("label")).alias("classes"))


def label_batches(sents: DataFrame, size: int = 8) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("sent_id")
    return sents.select("doc_id", "sent_id", F.floor((F.row_number().over(order) - 1) / size).cast("int").alias("batch"))


def cache_key(text: Column, terminology: str) -> Column:
    return F.md5(F.concat(text, F.lit("_" + terminology)))


def skip_scored(sents: DataFrame, scored: DataFrame, terminology: str) -> DataFrame:
    """One row per new key; keys in ``scored`` (key) are left out."""
    keyed = sents.select(cache_key(F.col("text"), terminology).alias("key"), "doc_id", "sent_id")
    fresh = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "sent_id")).alias("first"))
    return fresh.join(scored.select("key").distinct(), "key", "left_anti").select("key", "first.doc_id", "first.sent_id")


def skip_filed(sents: DataFrame, path: str, terminology: str) -> DataFrame:
    """As ``skip_scored`` against the keys filed in ``path`` (``sources.merged.add_keys``): their filters decide
    for new keys, so keys scored before are read only in the buckets of possible hits."""
    from lexmill.sources.merged import unseen

    keyed = sents.select(cache_key(F.col("text"), terminology).alias("key"), "doc_id", "sent_id")
    fresh = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "sent_id")).alias("first"))
    return unseen(fresh, path).select("key", "first.doc_id", "first.sent_id")


def cache_stats(sents: DataFrame, scored: DataFrame, terminology: str) -> DataFrame:
    keyed = sents.select(cache_key(F.col("text"), terminology).alias("key"))
    hit = scored.select("key").distinct().withColumn("hit", F.lit(1))
    return keyed.join(hit, "key", "left").agg(F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"), F.countDistinct("key").alias("entries"))


def logprob_confidence(logprobs: Column, head: int | None = None) -> Column:
    lp = F.slice(logprobs, 1, head) if head else logprobs
    mean = F.aggregate(F.transform(lp, lambda x: F.exp(x)), F.lit(0.0), lambda a, x: a + x) / F.size(lp)
    return F.when(F.size(lp) > 0, mean).otherwise(0.5)


def logprob_linear(mean: Column) -> Column:
    return F.when(mean >= 0, 0.95).when(mean <= -5, 0.5).otherwise(0.5 + (mean + 5) * 0.09)


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "high").when(confidence >= 0.4, "medium").otherwise("low")


def pass_fail(answer: Column, amendment: Column) -> Column:
    """struct(valid, confidence) from a Pass/Fail text."""
    low = F.lower(answer)
    valid = low.contains("pass")
    fail = low.contains("fail")
    confidence = F.when(valid, 0.9).when(fail, F.when(amendment, 0.3).otherwise(0.1)).otherwise(F.when(amendment, 0.6).otherwise(0.5))
    return F.struct((valid | (~fail & amendment)).alias("valid"), confidence.alias("confidence"))


def term_from_response(response: Column) -> Column:
    """struct(term, confidence): the JSON term, else a quoted or named one at .3, else a short raw text at .3."""
    js = F.get_json_object(response, "$.term")
    patterns = [r'"term"\s*:\s*"([^"]+)"', r"(?i)term:\s*([\w-]+)", r"(?i)classified as\s+['\"]?([\w-]+)", r"(?i)classification:\s*([\w-]+)", r"'([\w-]+)'"]
    found = F.coalesce(*[F.nullif(F.regexp_extract(response, p, 1), F.lit("")) for p in patterns], F.when(F.length(F.trim(response)) < 50, F.trim(response)))
    confidence = F.coalesce(F.try_to_number(F.get_json_object(response, "$.confidence"), F.lit("9.999")).cast("double"), F.lit(0.7))
    return F.struct(F.coalesce(js, found, F.lit("none")).alias("term"), F.when(js.isNotNull(), confidence).otherwise(0.3).alias("confidence"))


def asked_labels(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """question_id, label: the questions' terms and their aliases."""
    terms = questions.select("question_id", F.explode("terms").alias("label"))
    wide = terms.join(aliases.select(F.col("canonical").alias("label"), "alias"), "label", "left")
    return terms.unionByName(wide.where("alias is not null").select("question_id", F.col("alias").alias("label"))).distinct()


def question_sentences(labelled: DataFrame, questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """question_id, doc_id, sent_id of sentences whose classes meet the question's terms or their aliases."""
    classes = labelled.select("doc_id", "sent_id", F.explode("classes").alias("label"))
    return classes.join(asked_labels(questions, aliases), "label").select("question_id", "doc_id", "sent_id").distinct()


def question_clauses(labelled: DataFrame, questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """question_id and the columns of sentences (doc_id, sent_id, text, classes), once for each question that
    ``question_sentences`` finds. Up to MOST_KEYWORDS labels are looked up in the row, so no text is shuffled."""
    wanted = asked_labels(questions, aliases)
    known = wanted.where("label is not null").limit(MOST_KEYWORDS + 1).collect()
    if len(known) > MOST_KEYWORDS:
        return labelled.join(question_sentences(labelled, questions, aliases).hint("merge"), ["doc_id", "sent_id"]).select("question_id", *labelled.columns)
    of: dict[str, set[str]] = {}
    for r in known:
        of.setdefault(r.question_id, set()).add(r.label)
    asks = [F.when(F.exists("classes", _within(labels)), F.lit(q)) for q, labels in sorted(of.items())]
    if not asks:
        return labelled.where(F.lit(False)).select(F.lit(None).cast("string").alias("question_id"), *labelled.columns)
    return labelled.select(F.explode_outer(F.array_compact(F.array(*asks))).alias("question_id"), *labelled.columns).where("question_id is not null")


def keyword_fallback(sents: DataFrame, questions: dict[str, list[str]], answered: DataFrame, most: int = 5) -> DataFrame:
    """Questions without labelled sentences: up to ``most`` sentences (doc_id, sent_id, text, page) by
    keyword, those with a page first, in document order."""
    low = F.lower("text")
    cells = [F.struct(F.lit(q).alias("question_id"), low.rlike(literal(ks)).alias("hit")) for q, ks in questions.items()]
    hits = sents.withColumn("x", F.explode(F.array(*cells))).where("x.hit").select("x.question_id", "doc_id", "sent_id", "text", "page")
    open_ = hits.join(answered.select("question_id", "doc_id").distinct(), ["question_id", "doc_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("question_id", "doc_id").orderBy(F.col("page").isNull(), "sent_id"))
    return open_.withColumn("rank", rank).where(F.col("rank") <= most)


def token_chunks(sents: DataFrame, budget: int = 2000) -> DataFrame:
    """Greedy chunks of whole sentences (doc_id, sent_id, n_tokens): doc_id, chunk, first, last, n_tokens.

    A chunk closes when the next sentence would exceed the budget. Sums of tokens run in a window; within a
    document's row each chunk's end is then found by bisection over those sums, so the work is linear in
    the sentences and in the chunks (two neighbouring chunks exceed the budget together, which bounds
    their number), not in their product.
    """
    order = Window.partitionBy("doc_id").orderBy("sent_id").rowsBetween(Window.unboundedPreceding, 0)
    summed = sents.select("doc_id", "sent_id", F.sum(F.col("n_tokens").cast("long")).over(order).alias("through"))
    rows = summed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_id", "through"))).alias("s"))
    rows = rows.select("doc_id", F.col("s.sent_id").alias("ids"), F.col("s.through").alias("through"), F.size("s").alias("n"))
    through = lambda i: F.when(i > 0, F.get("through", i - 1)).otherwise(F.lit(0))  # tokens before sentence i

    def next_start(a: Column) -> Column:
        most = through(a) + budget

        def halve(s: Column, _: Column) -> Column:
            mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
            over = F.get("through", mid) > most
            return F.when(s["low"] >= s["high"], s).otherwise(F.struct(F.when(over, s["low"]).otherwise(mid + 1).alias("low"), F.when(over, mid).otherwise(s["high"]).alias("high")))

        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.col("n") + 1)).cast("int"))
        found = F.aggregate(steps, F.struct(a.alias("low"), F.col("n").alias("high")), halve)
        return F.greatest(found["low"], a + 1)  # a sentence over the budget is a chunk of its own

    def step(starts: Column, _: Column) -> Column:
        last = F.element_at(starts, -1)
        return F.when(last >= F.col("n"), starts).otherwise(F.array_append(starts, next_start(last)))

    bound = F.sequence(F.lit(0).cast("long"), 2 * F.floor(F.element_at("through", -1) / budget) + 1)
    cut = rows.withColumn("starts", F.aggregate(bound, F.array(F.lit(0)), step))
    one = cut.select("doc_id", "ids", "through", "starts", F.posexplode(F.slice("starts", F.lit(1), F.size("starts") - 1)).alias("chunk", "a")).withColumn("b", F.get("starts", F.col("chunk") + 1))
    return one.select("doc_id", "chunk", F.get("ids", F.col("a")).alias("first"), F.get("ids", F.col("b") - 1).alias("last"), (through(F.col("b")) - through(F.col("a"))).cast("int").alias("n_tokens"))


def token_count(text: Column) -> Column:
    """Runs of letters and digits, and single signs; an approximation of a model's tokens."""
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]"))


def context_budget(clauses: DataFrame, budget: int) -> DataFrame:
    """Clauses (doc_id, sent_id, text) numbered while their tokens stay within the budget: doc_id, context."""
    order = Window.partitionBy("doc_id").orderBy("sent_id")
    rows = clauses.withColumn("k", F.row_number().over(order)).withColumn("used", F.sum(token_count(F.col("text"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = rows.where(F.col("used") <= budget)
    lines = F.array_sort(F.collect_list(F.struct("k", F.concat(F.col("k").cast("string"), F.lit(". "), "text").alias("line"))))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"))


def question_context(target: DataFrame, reference: DataFrame, budget: int, none: str = "No relevant clauses found.") -> DataFrame:
    """doc_id, question_id, target, reference, tokens: numbered clauses (doc_id, question_id, sent_id, text) of
    both sides within one budget.

    The target may take half the budget; what its text leaves of the whole budget is the reference's.
    A side ends before the first clause that would exceed its part. A question is in the result if the target
    has a clause for it, fitting or not; a target without a fitting clause says ``none``, which costs its
    tokens as well; a reference without one is null. The reference's limit is known only after the target's
    sums, so its sums run in a second pass, and clauses meet the limit by an equality of keys.
    """
    keys = ["doc_id", "question_id"]

    def numbered(side: DataFrame) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("sent_id")
        lines = side.select(*keys, "sent_id", "text", F.row_number().over(order).alias("k")).withColumn("line", F.concat(F.col("k").cast("string"), F.lit(". "), "text"))
        return lines.withColumn("used", F.sum(token_count(F.col("line"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def joined(lines: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(lines)), lambda x: x["line"]), "\n")

    fits = F.when(F.col("used") <= budget // 2, F.struct("k", "line"))
    first = numbered(target).groupBy(*keys).agg(joined(fits).alias("target"))
    first = first.withColumn("target", F.coalesce(F.nullif("target", F.lit("")), F.lit(none))).withColumn("left", budget - token_count(F.col("target")))
    met = numbered(reference).join(first.select(*keys, "left"), keys).where(F.col("used") <= F.col("left"))
    second = met.groupBy(*keys).agg(joined(F.struct("k", "line")).alias("reference"))
    both = first.join(second, keys, "left")
    return both.select(*keys, "target", "reference", (token_count(F.col("target")) + F.coalesce(token_count(F.col("reference")), F.lit(0))).alias("tokens"))


def deviation_flag(target: DataFrame, reference: DataFrame) -> DataFrame:
    """question_id, target, reference, deviates: clause counts of both sides."""
    a = target.groupBy("question_id").agg(F.count("*").alias("target"))
    b = reference.groupBy("question_id").agg(F.count("*").alias("reference"))
    return a.join(b, "question_id", "full_outer").na.fill(0).withColumn("deviates", F.col("target") != F.col("reference"))


def answer_source(kind: Column, model: Column) -> Column:
    return F.when(kind == "deterministic", "Deterministic").when(kind == "no_clauses", "No Clauses Found").otherwise(model)
