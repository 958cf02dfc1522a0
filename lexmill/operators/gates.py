"""Quality gates: declarative checks that turn tables of measures into issues, severities and reruns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.operators.pages import ANCHOR
from lexmill.operators.retrieval import literal
from lexmill.operators.text import image_ratio, with_measures

#: A gate is a list of (type, severity, condition).
Gate = list[tuple[str, str, Column]]


def issues(measures: DataFrame, gate: str, checks: Gate) -> DataFrame:
    """doc_id, gate, type, severity of every check that a row of measures fails."""
    cells = [F.when(c, F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"))) for t, s, c in checks]
    return measures.select("doc_id", F.lit(gate).alias("gate"), F.explode(F.array_compact(F.array(*cells))).alias("x")).select("doc_id", "gate", "x.type", "x.severity")


def gate_severity(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, severity, passed: critical; several high; one high is medium; over two medium; else low."""
    n = lambda s: F.count_if(F.col("severity") == s)
    counts = found.groupBy("doc_id").agg(n("critical").alias("c"), n("high").alias("h"), n("medium").alias("m"))
    both = docs.select("doc_id").join(counts, "doc_id", "left").na.fill(0)
    severity = F.when(F.col("c") > 0, "critical").when(F.col("h") > 1, "high").when((F.col("h") == 1) | (F.col("m") > 2), "medium").otherwise("low")
    return both.select("doc_id", severity.alias("severity"), (~severity.isin("critical", "high")).alias("passed"))


def coverage(sents: DataFrame, critical: list[str], amended: list[str] | None = None) -> DataFrame:
    """doc_id, classes, confidence -> sentences, share labelled, missing critical labels, average and low confidence.
    With ``amended``, also whether a label holds one of those words."""
    named = F.filter("classes", lambda c: ~c.isin("none", "no-class"))
    labelled = F.size(named) > 0
    speaks = [F.coalesce(F.bool_or(says(amended)), F.lit(False)).alias("amended")] if amended is not None else []
    rows = sents.groupBy("doc_id").agg(
        F.count("*").alias("sentences"), F.avg(labelled.cast("int")).alias("coverage"), F.array_distinct(F.flatten(F.collect_set(named))).alias("seen"),
        F.round(F.avg("confidence"), 9).alias("average"), F.avg((F.col("confidence") < 0.5).cast("int")).alias("low"), *speaks,
    )
    return rows.withColumn("missing", F.array_sort(F.array_except(F.array(*[F.lit(c) for c in critical]), "seen"))).drop("seen")


def says(labels: list[str]) -> Column:
    """Whether one of a sentence's classes holds one of the words."""
    return F.exists("classes", lambda c: F.lower(c).rlike(literal(labels)))


#: What makes a document look like an amendment, and labels that say so.
AMENDMENT_WORDS = ["amendment", "addendum"]
AMENDMENT_LABELS = ["modification", "amendment", "addendum", "supplement"]


def unlabelled_amendments(docs: DataFrame, labelled: DataFrame, words: list[str] = AMENDMENT_WORDS, labels: list[str] = AMENDMENT_LABELS) -> DataFrame:
    """doc_id, unlabelled_amendment of documents (doc_id, text): the text speaks of an amendment, and no label
    of its sentences (doc_id, classes) does."""
    known = labelled.where(says(labels)).select("doc_id").distinct().withColumn("known", F.lit(True))
    rows = docs.select("doc_id", speaks_of(words).alias("speaks")).join(known, "doc_id", "left")
    return rows.select("doc_id", (F.col("speaks") & F.col("known").isNull()).alias("unlabelled_amendment"))


def speaks_of(words: list[str]) -> Column:
    return F.coalesce(F.lower("text").rlike(literal(words)), F.lit(False))


def coverage_of_documents(docs: DataFrame, sents: DataFrame, critical: list[str], words: list[str] = AMENDMENT_WORDS, labels: list[str] = AMENDMENT_LABELS) -> DataFrame:
    """``coverage`` with ``unlabelled_amendments`` of documents that have sentences, from one pass over their labels."""
    speaks = docs.select("doc_id", speaks_of(words).alias("speaks"))
    rows = coverage(sents, critical, labels).join(speaks.hint("merge"), "doc_id")
    return rows.withColumn("unlabelled_amendment", F.col("speaks") & ~F.col("amended")).drop("speaks", "amended")


def coverage_gate(measures: DataFrame, n_critical: int) -> DataFrame:
    """Issues of measures; ``unlabelled_amendment`` counts where the column is there."""
    c = F.col("coverage")
    amended = [("amendment_not_labelled", "medium", F.col("unlabelled_amendment"))] if "unlabelled_amendment" in measures.columns else []
    return issues(measures, "coverage", [*amended,
        ("low_coverage", "critical", c < 0.1), ("low_coverage", "high", (c >= 0.1) & (c < 0.3)), ("missing_terms", "medium", F.size("missing") > n_critical / 2),
        ("low_confidence", "high", F.col("average") < 0.5), ("uncertain_labels", "medium", F.col("low") > 0.3), ("few_sentences", "low", F.col("sentences") < 20),
    ])


def answer_measures(answers: DataFrame) -> DataFrame:
    """doc_id, answer, confidence -> share unspecified, mean and low confidence, share short, most repeated."""
    low = F.lower(F.trim("answer"))
    unspecified = (low == "") | low.contains("not specified")
    base = answers.groupBy("doc_id").agg(
        F.count("*").alias("answers"), F.avg(unspecified.cast("int")).alias("unspecified"), F.avg("confidence").alias("average"),
        F.avg((F.col("confidence") < 0.5).cast("int")).alias("low"), F.avg((F.length("answer") < 50).cast("int")).alias("short"),
    )
    most = repeated_answers(answers, 0).groupBy("doc_id").agg(F.max("n").alias("repeated"))
    return base.join(most, "doc_id", "left").na.fill(0, ["repeated"])


def answer_gate(measures: DataFrame) -> DataFrame:
    return issues(measures, "answers", [
        ("unspecified", "high", F.col("unspecified") > 0.4), ("low_average", "high", F.col("average") < 0.3), ("uncertain", "medium", F.col("low") > 0.3),
        ("repetitive", "medium", (F.col("repeated") > 5) & (F.col("repeated") > 0.3 * F.col("answers"))), ("short", "low", F.col("short") > 0.7),
    ])


#: Answers that say nothing, and words of assent.
UNSPECIFIED = ["not specified", "not found", "unknown", "", "n/a"]
DETERMINISTIC = "deterministic_field"
ASSENT = ["yes", "true", "present", "exists", "included"]
#: Questions that must be answered, questions that need a risk assessment, and answers that exclude each other.
REQUIRED_QUESTIONS = ["contract_start_date", "target_company_name", "counterparty_name", "governing_law", "term", "termination"]
RISK_QUESTIONS = ["limitation_of_liability", "indemnity", "ip_rights", "assignment_coc", "exclusivity_non_competes", "forced_pricing_adjustments"]
EXCLUSIVE = [("unlimited_liability", "limitation_of_liability"), ("exclusive_agreement", "non_exclusive_agreement"), ("perpetual_term", "fixed_term"), ("assignment_allowed", "assignment_prohibited")]
#: Fixed value: question, its word, other question, its word.
WORDED_CONFLICTS = [("term", "perpetual", "termination", "immediate")]


def conflicts(answers: DataFrame, pairs: list[tuple[str, str]] = EXCLUSIVE, worded: list[tuple[str, str, str, str]] = WORDED_CONFLICTS, assent: list[str] = ASSENT) -> DataFrame:
    """doc_id, a, b, kind: ``pairs`` of questions that are both affirmed (``exclusive``), and ``worded`` ones whose
    answers hold words that exclude each other (``worded``). One shuffle, by document: an answer is reduced to
    the sides of conflicts that it takes, and a conflict is a document with both sides."""
    low = F.lower("answer")
    assents = low.rlike(literal(assent))
    sides = []
    for n, (a, b) in enumerate(pairs):
        sides += [F.when((F.col("question_id") == q) & assents, F.struct(F.lit(n).alias("n"), F.lit(side).alias("side"))) for side, q in ((0, a), (1, b))]
    for n, (a, x, b, y) in enumerate(worded, len(pairs)):
        sides += [F.when((F.col("question_id") == q) & low.contains(w), F.struct(F.lit(n).alias("n"), F.lit(side).alias("side"))) for side, q, w in ((0, a, x), (1, b, y))]
    taken = answers.select("doc_id", F.explode(F.array_compact(F.array(*sides))).alias("x")).groupBy("doc_id", "x.n").agg(F.count_distinct("x.side").alias("sides"))
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(kind).alias("kind")) for a, b, kind in [(a, b, "exclusive") for a, b in pairs] + [(a, b, "worded") for a, _, b, _ in worded]])
    x = F.get(names, F.col("n"))
    return taken.where("sides = 2").select("doc_id", x["a"].alias("a"), x["b"].alias("b"), x["kind"].alias("kind"))


def answer_review(
    answers: DataFrame, required: list[str] = REQUIRED_QUESTIONS, risky: list[str] = RISK_QUESTIONS, pairs: list[tuple[str, str]] = EXCLUSIVE,
    worded: list[tuple[str, str, str, str]] = WORDED_CONFLICTS, least: float = 0.6, most_unspecified: float = 0.4, assent: list[str] = ASSENT,
) -> DataFrame:
    """doc_id, gate, type, severity over all answers (doc_id, question_id, answer, confidence, assessed):
    too many unspecified, required ones missing, low confidence on average or for many, contradictions,
    repeated and very short answers, and answered risk questions without an assessment."""
    low = F.lower(F.coalesce("answer", F.lit("")))
    rows = answers.select("doc_id", "question_id", low.alias("answer"), "confidence", F.coalesce("assessed", F.lit(False)).alias("assessed"))
    empty, own = F.col("answer").isin(UNSPECIFIED), F.col("answer") == DETERMINISTIC
    base = rows.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.avg(empty.cast("int")).alias("unspecified"), F.collect_set(F.when(F.col("question_id").isin(required) & ~empty, F.col("question_id"))).alias("given"),
        F.avg(F.when(~own, F.col("confidence"))).alias("average"), F.count_if(~own & (F.col("confidence") < least) & (F.col("confidence") > 0)).alias("low"),
        F.count_if((F.length("answer") < 20) & ~own).alias("short"), F.count_if(F.col("question_id").isin(risky) & ~empty & ~own & ~F.col("assessed")).alias("unassessed"),
    )
    most = rows.where(~own & (F.col("answer") != "")).groupBy("doc_id", "answer").agg(F.count("*").alias("k")).groupBy("doc_id").agg(F.max("k").alias("repeated"))
    clash = conflicts(answers, pairs, worded, assent).groupBy("doc_id").agg(F.count("*").alias("clashes"))
    m = base.join(most, "doc_id", "left").join(clash, "doc_id", "left").na.fill(0, ["repeated", "clashes"])
    return issues(m, "answers", [
        ("too_many_not_specified", "high", F.col("unspecified") > most_unspecified), ("missing_required_fields", "high", F.size("given") < len(required)),
        ("low_average_confidence", "medium", F.coalesce("average", F.lit(0.0)) < least), ("many_low_confidence", "medium", F.col("low") > 0.3 * F.col("n")),
        ("contradictory_answers", "high", F.col("clashes") > 0), ("repeated_answers", "medium", (F.col("repeated") > 5) & (F.col("repeated") > 0.3 * F.col("n"))),
        ("short_answers", "medium", F.col("short") > 0.7 * F.col("n")), ("missing_risk_assessments", "medium", F.col("unassessed") > 0),
    ])


def conversion_measures(docs: DataFrame) -> DataFrame:
    """What a converted text tells about its conversion, in one scan: doc_id, text_length, mostly_blank, pages,
    missing_pages, images, broken_tables, garbled, grade."""
    found = F.transform(F.regexp_extract_all("text", F.lit(ANCHOR), F.lit(1)), lambda p: p.cast("int"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("anchors", found)
    pages = F.coalesce(F.array_max("anchors"), F.lit(0))
    missing = F.when(pages > 0, F.size(F.array_except(F.sequence(F.lit(1), pages), "anchors"))).otherwise(0)
    rows = rows.select("doc_id", "text", pages.alias("pages"), missing.alias("missing_pages"), image_ratio(F.col("text")).alias("images"))
    return with_measures(rows).drop("text")


def conversion_gate(measures: DataFrame, least_length: int = 1000, least_pages: int = 1, most_images: float = 0.5, anchors_required: bool = True) -> DataFrame:
    none = [("no_page_anchors", "high", F.col("pages") == 0)] if anchors_required else []
    return issues(measures, "conversion", [
        ("insufficient_text", "high", F.col("text_length") < least_length), ("mostly_blank", "high", F.col("mostly_blank")), *none,
        ("missing_pages", "medium", F.col("missing_pages") > 0), ("too_few_pages", "medium", F.col("pages") < least_pages), ("too_many_images", "high", F.col("images") > most_images),
        ("broken_tables", "low", F.col("broken_tables")), ("garbled_text", "high", F.col("garbled")), ("poor_structure", "low", F.col("grade") == "poor"),
    ])


def repeated_answers(answers: DataFrame, least: int = 1) -> DataFrame:
    """doc_id, answer, n of answers used more than ``least`` times."""
    return answers.groupBy("doc_id", F.lower(F.trim("answer")).alias("answer")).agg(F.count("*").alias("n")).where(F.col("n") > least)


def contradictions(answers: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """doc_id, a, b of question pairs that are both answered with yes."""
    dim = F.broadcast(answers.sparkSession.createDataFrame(pairs, "a string, b string"))  # a list of pairs
    yes = answers.where(F.lower("answer").rlike("^(yes|true|included)")).select("doc_id", "question_id")
    left = yes.withColumnRenamed("question_id", "a").join(dim, "a")
    return left.join(yes.withColumnRenamed("question_id", "b"), ["doc_id", "b"]).select("doc_id", "a", "b")


def retry_questions(answers: DataFrame, most: int = 10) -> DataFrame:
    """doc_id, rank, question_id to ask again: missing, then very uncertain, then uncited."""
    reason = F.when(F.col("answer").isNull(), 1).when(F.col("confidence") < 0.3, 2).when(~F.col("cited"), 3)
    rows = answers.withColumn("priority", reason).where("priority is not null").groupBy("doc_id", "question_id").agg(F.min("priority").alias("priority"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("priority", "question_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", "rank", "question_id", "priority")


def citation_issues(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """doc_id, question_id, issue: no citation, unknown id, low confidence, no page, no location."""
    flat = answers.select("doc_id", "question_id", F.explode_outer("citations").alias("citation_id"))
    both = flat.join(citations.withColumn("known", F.lit(True)), "citation_id", "left")
    problem = (
        F.when(F.col("citation_id").isNull(), "empty").when(F.col("known").isNull(), "unknown_id").when(F.col("confidence") < 0.6, "low_confidence")
        .when(F.col("location") == "Unknown location", "unknown_location").when(F.col("page").isNull(), "no_page")
    )
    return both.select("doc_id", "question_id", problem.alias("issue")).where("issue is not null")


def citation_gate(found: DataFrame) -> DataFrame:
    """doc_id, severity, passed by how many answers have each issue."""
    n = lambda k: F.count_if(F.col("issue") == k)
    rows = found.groupBy("doc_id").agg(n("empty").alias("empty"), n("low_confidence").alias("low"), n("unknown_id").alias("unknown"), n("unknown_location").alias("nowhere"), n("no_page").alias("no_page"))
    severity = F.when(F.col("empty") >= 5, "critical").when((F.col("empty") >= 3) | (F.col("unknown") >= 3), "high").when((F.col("low") >= 3) | (F.col("nowhere") >= 1) | (F.col("empty") >= 1), "medium").otherwise("low")
    return rows.select("doc_id", severity.alias("severity"), (severity == "low").alias("passed"))


def rule_gate(verdicts: DataFrame) -> DataFrame:
    """doc_id, quality and issues over a document's verdicts (status, confidence, evidence count)."""
    rows = verdicts.groupBy("doc_id").agg(
        F.avg((F.col("status") != "unknown").cast("int")).alias("evaluated"), F.avg((F.col("evidence") > 0).cast("int")).alias("backed"),
        F.avg("confidence").alias("confidence"), F.countDistinct("status").alias("kinds"), F.count("*").alias("n"),
    )
    alike = (F.col("kinds") == 1) & (F.col("n") > 3)
    quality = 0.3 * F.col("evaluated") + 0.25 * F.col("backed") + 0.25 * F.col("confidence") + F.when(alike, 0.0).otherwise(0.2)
    found = F.array_compact(F.array(F.when(F.col("evaluated") < 0.5, "mostly_unevaluated"), F.when((F.col("evaluated") >= 0.5) & (F.col("evaluated") < 0.7), "partly_unevaluated"), F.when(F.col("backed") < 0.5, "no_evidence"), F.when(alike, "all_the_same")))
    return rows.select("doc_id", quality.alias("quality"), found.alias("issues"))


#: Wording of evidence that speaks for and against compliance.
FOR = ["compliant", "satisfies", "meets"]
AGAINST = ["non-compliant", "violates", "fails"]


def overlapping_evidence(evidence: DataFrame, width: int = 1000) -> DataFrame:
    """doc_id, rule_a, rule_b, start, end of stretches that evidence (doc_id, rule_id, status, start, end) for a
    compliant and for a non-compliant verdict share; the first rule is the compliant one.

    An interval join: spans are filed in every bin of ``width`` characters that they touch, meet in bins, and
    a pair counts in the bin where its common stretch begins, so once.
    """
    filed = evidence.where("end > start").select("doc_id", "rule_id", "status", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("bin"))
    a = filed.where("status = 'compliant'").select("doc_id", "bin", F.col("rule_id").alias("rule_a"), F.col("start").alias("s1"), F.col("end").alias("e1"))
    b = filed.where("status = 'non_compliant'").select("doc_id", "bin", F.col("rule_id").alias("rule_b"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    start, end = F.greatest("s1", "s2"), F.least("e1", "e2")
    met = a.join(b, ["doc_id", "bin"]).where((start < end) & (F.floor(start / width) == F.col("bin")))
    return met.select("doc_id", "rule_a", "rule_b", start.alias("start"), end.alias("end")).distinct()


def rule_review(verdicts: DataFrame, evidence: DataFrame, critical: list[str], width: int = 1000) -> DataFrame:
    """doc_id, quality, valid, severity, issues, and the measures behind them, over a document's verdicts (doc_id,
    rule_id, status) and their evidence (doc_id, rule_id, text, start, end).

    Evidence conflicts within a rule where its wording speaks for and against compliance ("non-compliant" alone
    speaks against only), and between rules where the same stretch of text backs opposite verdicts. Critical
    rules are those whose id holds one of ``critical``; they are missing without a verdict or evidence. Quality
    is 0.3 evaluated + 0.25 backed + 0.25 free of conflicts + 0.2 critical rules present.
    """
    keys = ["doc_id", "rule_id"]
    low = F.lower("text")
    against = low.rlike("|".join(AGAINST))
    favours = F.regexp_replace(low, "non-compliant", "").rlike("|".join(FOR))
    wording = evidence.groupBy(*keys).agg(F.count("*").alias("n"), F.max(favours.cast("int")).alias("yes"), F.max(against.cast("int")).alias("no"))
    placed = evidence.select(*keys, "start", "end").join(verdicts.select(*keys, "status"), keys)
    pairs = overlapping_evidence(placed, width)
    clash = pairs.select("doc_id", F.explode(F.array("rule_a", "rule_b")).alias("rule_id")).distinct().withColumn("shared", F.lit(1))
    rows = verdicts.select(*keys, F.coalesce("status", F.lit("not_evaluated")).alias("status")).join(wording, keys, "left").join(clash, keys, "left").na.fill(0, ["n", "yes", "no", "shared"])
    open_, is_critical = F.col("status").isin("not_evaluated", "unknown"), F.lower("rule_id").rlike(literal(critical))
    m = rows.groupBy("doc_id").agg(
        F.count("*").alias("rules"), F.avg(open_.cast("int")).alias("not_evaluated"), F.count_if(F.col("status").isin("compliant", "non_compliant") & (F.col("n") == 0)).alias("no_evidence"),
        F.count_if(((F.col("n") > 1) & (F.col("yes") == 1) & (F.col("no") == 1)) | (F.col("shared") == 1)).alias("conflicting"), F.count_if(is_critical & (open_ | (F.col("n") == 0))).alias("critical_missing"),
        F.every(open_ | (F.col("status") == "compliant")).alias("all_compliant"), F.every(open_ | (F.col("status") == "non_compliant")).alias("all_non_compliant"),
    )
    part = lambda c: 1 - F.col(c) / F.col("rules")
    quality = 0.3 * (1 - F.col("not_evaluated")) + 0.25 * part("no_evidence") + 0.25 * part("conflicting") + 0.2 * (1 - F.col("critical_missing") / max(1, len(critical)))
    m = m.withColumn("quality", quality)
    found = F.array_compact(F.array(
        F.when(F.col("not_evaluated") > 0.5, "mostly_unevaluated"), F.when((F.col("not_evaluated") > 0.3) & (F.col("not_evaluated") <= 0.5), "partly_unevaluated"), F.when(F.col("no_evidence") > 0, "no_evidence"),
        F.when(F.col("conflicting") > 0, "conflicting_evidence"), F.when(F.col("critical_missing") > 0, "critical_rules_missing"), F.when((F.col("all_compliant") | F.col("all_non_compliant")) & (F.col("rules") > 5), "all_the_same"),
    ))
    bad = (F.col("not_evaluated") > 0.5) | (F.col("conflicting") > 0) | (F.col("critical_missing") > 0) | (F.col("quality") < 0.6)
    severity = F.when(F.col("quality") < 0.4, "critical").when(bad, "error").when(F.size("issues") > 0, "warning").otherwise("info")
    rated = m.withColumn("issues", found)
    return rated.select("doc_id", "quality", (F.col("quality") >= 0.6).alias("valid"), severity.alias("severity"), "issues", "not_evaluated", "no_evidence", "conflicting", "critical_missing")


#: issue type -> advice.
ADVICE = {"low_coverage": "Classify again with smaller batches", "missing_terms": "Look for the missing terms", "low_confidence": "Review uncertain labels", "unspecified": "Ask again with more context", "repetitive": "Check the prompts"}


def recommendations(found: DataFrame, advice: dict[str, str] = ADVICE) -> DataFrame:
    known = F.create_map(*[F.lit(x) for kv in advice.items() for x in kv])
    priority = F.when(F.col("severity").isin("critical", "high"), "high").when(F.col("severity") == "medium", "medium").otherwise("low")
    return found.select("doc_id", "type", F.coalesce(F.try_element_at(known, F.col("type")), F.lit("Review")).alias("advice"), priority.alias("priority")).distinct()


def rerun(severities: DataFrame, attempts: Column, most: int = 3, when: tuple[str, ...] = ("critical", "high")) -> DataFrame:
    """doc_id, rerun, settings for the next attempt."""
    again = F.col("severity").isin(*when) & (attempts < most)
    settings = F.when(again, F.create_map(F.lit("batch_size"), F.lit("4"), F.lit("attempt"), (attempts + 1).cast("string")))
    return severities.select("doc_id", again.alias("rerun"), settings.alias("settings"))
