"""Roll-ups for people: openings, dashboards, executive summaries, risk profiles and wide sheets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.operators.sheets import status_letter, topic_row


def opening(docs: DataFrame, least_confidence: float = 0.7, length: int = 250) -> DataFrame:
    """doc_id, opening of documents (doc_id, text, and where known name, title, type, type_confidence): a line each for
    the name, the title, the type if its confidence is over ``least_confidence``, and the first characters."""

    def part(label: str, column: str, when: Column | None = None) -> list[Column]:
        if column not in docs.columns:
            return []
        line = F.concat(F.lit(label), F.nullif(F.col(column).cast("string"), F.lit("")))
        return [line if when is None else F.when(when, line)]

    sure = F.col("type_confidence") > least_confidence if "type_confidence" in docs.columns else F.lit(False)
    head = F.concat(F.lit("Document Beginning: "), F.nullif(F.trim(F.replace(F.substring("text", 1, length), F.lit("\n"), F.lit(" "))), F.lit("")), F.lit("..."))
    return docs.select("doc_id", F.concat_ws("\n", *part("Filename: ", "name"), *part("Document Title: ", "title"), *part("Detected Type: ", "type", sure), head).alias("opening"))


def dashboard(analyses: DataFrame, recent: int = 10) -> DataFrame:
    """section, rank, label, n, share, value over analyses (doc_id, name, risk_level, grade, score, analysed_at, review).

    Sections: ``overview`` (documents, latest analysis as epoch seconds, average score), ``risk`` and ``grade`` (a row
    per level with its share), ``recent`` (the ``recent`` newest) and ``review`` (every document that asks for
    one). Counts come from one pass; the newest are cut by rank before any shuffle.
    """
    kind = "section string, rank int, label string, n bigint, share double, value double"
    at = F.unix_seconds(F.col("analysed_at").cast("timestamp")).cast("double")
    total = analyses.agg(F.count("*").alias("n"), F.max(at).alias("latest"), F.avg("score").alias("mean"))
    lines = F.array(
        F.struct(F.lit(1).alias("rank"), F.lit("documents").alias("label"), F.col("n").alias("n"), F.lit(None).cast("double").alias("value")),
        F.struct(F.lit(2).alias("rank"), F.lit("latest").alias("label"), F.lit(None).cast("bigint").alias("n"), F.col("latest").alias("value")),
        F.struct(F.lit(3).alias("rank"), F.lit("average score").alias("label"), F.lit(None).cast("bigint").alias("n"), F.col("mean").alias("value")),
    )
    overview = total.select(F.explode(lines).alias("x")).select(F.lit("overview").alias("section"), "x.rank", "x.label", "x.n", F.lit(None).cast("double").alias("share"), "x.value")
    counted = analyses.groupingSets([["risk_level"], ["grade"]], "risk_level", "grade").agg(F.count("*").alias("n"), F.grouping("grade").alias("of_risk"))
    part = counted.select(F.when(F.col("of_risk") == 1, "risk").otherwise("grade").alias("section"), F.when(F.col("of_risk") == 1, F.col("risk_level")).otherwise(F.col("grade")).alias("label"), "n")
    of = Window.partitionBy("section")  # a few levels
    shares = part.select("section", F.row_number().over(of.orderBy(F.desc("n"), "label")).alias("rank"), "label", "n", (F.col("n") / F.sum("n").over(of)).alias("share"), F.lit(None).cast("double").alias("value"))
    newest = analyses.orderBy(F.desc("analysed_at"), "doc_id").limit(recent)
    label = F.when(F.length("name") > 30, F.concat(F.substring("name", 1, 30), F.lit("..."))).otherwise(F.col("name"))
    last = newest.select(F.lit("recent").alias("section"), F.row_number().over(Window.orderBy(F.desc("analysed_at"), "doc_id")).alias("rank"), label.alias("label"), F.col("doc_id").cast("bigint").alias("n"), F.lit(None).cast("double").alias("share"), F.col("score").alias("value"))
    review = analyses.where("review").select(F.lit("review").alias("section"), F.lit(None).cast("int").alias("rank"), F.col("name").alias("label"), F.col("doc_id").cast("bigint").alias("n"), F.lit(None).cast("double").alias("share"), F.col("score").alias("value"))
    names = [f.split(" ")[0] for f in kind.split(", ")]
    return reduce(DataFrame.unionByName, [x.select(*names) for x in (overview, shares, last, review)])


#: Advice by the worst that was found.
ADVICE = {
    "critical": "DO NOT SIGN - Critical issues require immediate resolution", "many": "HIGH CAUTION - Comprehensive legal review required before signing",
    "risk": "CAUTION - Address risk provisions before signing", "unsure": "UNCERTAIN - Low analysis confidence, manual review required", "fine": "ACCEPTABLE - Standard legal review recommended",
}


def executive_summary(docs: DataFrame, flags: DataFrame, areas: int = 5) -> DataFrame:
    """doc_id, recommendation, attention, high_risk_areas, total, critical, high of documents (doc_id, risk_level, score) and
    their red flags (doc_id, category, severity, hits): what speaks first decides the recommendation; attention
    items name critical and high flags and low confidence; areas are the ``areas`` categories with most issues."""
    per = flags.groupBy("doc_id", "category").agg(F.sum("hits").alias("n"), F.sum(F.when(F.col("severity") == "critical", F.col("hits")).otherwise(0)).alias("c"), F.sum(F.when(F.col("severity") == "high", F.col("hits")).otherwise(0)).alias("h"))
    title = F.concat(F.initcap(F.replace("category", F.lit("_"), F.lit(" "))), F.format_string(" (%d issue%s)", F.col("n"), F.when(F.col("n") > 1, "s").otherwise("")))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "category", title.alias("title")))), 1, areas)  # categories, not flags
    found = per.groupBy("doc_id").agg(F.sum("n").alias("total"), F.sum("c").alias("critical"), F.sum("h").alias("high"), F.transform(ranked, lambda x: x["title"]).alias("high_risk_areas"))
    rows = docs.select("doc_id", "risk_level", "score").join(found, "doc_id", "left").na.fill(0, ["total", "critical", "high"])
    advice = F.when(F.col("critical") > 0, ADVICE["critical"]).when(F.col("high") >= 3, ADVICE["many"]).when(F.upper("risk_level").isin("HIGH", "CRITICAL"), ADVICE["risk"]).when(F.col("score") < 60, ADVICE["unsure"]).otherwise(ADVICE["fine"])
    attention = F.array_compact(F.array(
        F.when(F.col("critical") > 0, F.format_string("%d critical red flag(s) detected", F.col("critical"))), F.when(F.col("high") > 0, F.format_string("%d high-risk issue(s) identified", F.col("high"))),
        F.when(F.col("score") < 70, F.format_string("Low analysis confidence (%.0f%%)", F.col("score").cast("double"))),
    ))
    return rows.select("doc_id", advice.alias("recommendation"), attention.alias("attention"), F.coalesce("high_risk_areas", F.array().cast("array<string>")).alias("high_risk_areas"), "total", "critical", "high")


#: Advice by group of indicators, for clauses and for documents; by a document's level; for many.
CLAUSE_RULES = [("liability", "Consider adding mutual liability caps"), ("indemnification", "Ensure indemnification obligations are balanced")]
MANY_RISKS = "Request comprehensive legal review due to multiple risk factors"
LEVEL_RULES = {
    "critical": ["URGENT: Immediate legal review required before signing", "Consider rejecting contract or requiring major revisions"],
    "high": ["Comprehensive legal review strongly recommended", "Negotiate key risk provisions before acceptance"], "medium": ["Legal review recommended for risk provisions"],
}
DOCUMENT_RULES = [
    ("liability", "Focus negotiation on liability and limitation clauses"), ("indemnification", "Review indemnification scope and mutual obligations"),
    ("intellectual_property", "Carefully review IP assignment and ownership provisions"),
]
OTHER_TEMPLATE = "Consider requesting alternative contract template"


def clause_guidance(hits: DataFrame, rules: list[tuple[str, str]] = CLAUSE_RULES, many: str = MANY_RISKS, most: int = 10) -> DataFrame:
    """doc_id, sent_id, guidance: the distinct guidance of a clause's indicators in pattern order, then what
    its groups ask for, then ``many`` beyond three indicators; the first ``most``."""
    rows = hits.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "guidance", "group"))).alias("i"))
    groups = F.transform("i", lambda x: x["group"])
    own = F.filter(F.transform("i", lambda x: x["guidance"]), lambda g: g != "")
    more = F.array_compact(F.array(*[F.when(F.array_contains(groups, g), text) for g, text in rules], F.when(F.size("i") > 3, many)))
    return rows.select("doc_id", "sent_id", F.slice(F.array_distinct(F.concat(own, more)), 1, most).alias("guidance"))


def risk_overview(scores: DataFrame, hits: DataFrame, rules: list[tuple[str, str]] = DOCUMENT_RULES) -> DataFrame:
    """doc_id, level, average, largest, high_risk, clauses, groups, recommendations over clause scores (doc_id, sent_id,
    score) and their indicators (doc_id, group): ``groups`` counts indicators by group, in order of group."""
    s = scores.groupBy("doc_id").agg(F.avg("score").alias("average"), F.max("score").alias("largest"), F.count_if(F.col("score") >= 70).alias("high_risk"), F.count("*").alias("clauses"))
    per = hits.groupBy("doc_id", "group").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("group", "n"))).alias("groups"))
    rows = s.join(per, "doc_id", "left").withColumn("groups", F.coalesce("groups", F.array().cast("array<struct<group:string,n:bigint>>")))
    level = F.when((F.col("largest") >= 90) | (F.col("high_risk") >= 3), "critical").when((F.col("largest") >= 70) | (F.col("high_risk") >= 2), "high").when((F.col("largest") >= 40) | (F.col("high_risk") >= 1), "medium").otherwise("low")
    rows = rows.withColumn("level", level)
    named = F.transform("groups", lambda g: g["group"])
    by_level = reduce(lambda rest, kv: F.when(F.col("level") == kv[0], F.array(*map(F.lit, kv[1]))).otherwise(rest), LEVEL_RULES.items(), F.array().cast("array<string>"))
    by_group = F.array_compact(F.array(*[F.when(F.array_contains(named, g), text) for g, text in rules], F.when(F.col("high_risk") > 2, OTHER_TEMPLATE)))
    return rows.select("doc_id", "level", F.round("average", 1).alias("average"), F.round("largest", 1).alias("largest"), "high_risk", "clauses", "groups", F.concat(by_level, by_group).alias("recommendations"))


def wide_row(verdicts: DataFrame, topics: list[tuple[str, list[str]]], rule_ids: list[str]) -> DataFrame:
    """One wide row per document: the columns of ``topic_row``, and for each of ``rule_ids`` its letter and the
    rationale of a broken one. One aggregation by document serves all rules."""
    cells = []
    for r in rule_ids:
        mine = F.col("rule_id") == r
        cells += [F.min(F.when(mine, status_letter(F.col("status")))).alias(f"{r}_status"), F.min(F.when(mine & (F.col("status") == "non_compliant"), F.col("rationale"))).alias(f"{r}_details")]
    return topic_row(verdicts, topics).join(verdicts.groupBy("doc_id").agg(*cells), "doc_id")


def evidence_problems(status: Column, n: Column, least: Column, rationale: Column, attribution: Column, position: Column, length: Column) -> Column:
    """Problems of a verdict's evidence in order: too few citations (unknown exempt), none for a verdict, a
    rationale under 20 characters, no attribution, and citations that start behind 80 % of the document."""
    return F.array_compact(F.array(
        F.when((status != "unknown") & (n < least), "too_few_citations"), F.when(status.isin("compliant", "non_compliant", "not_applicable") & (n == 0), "no_evidence"),
        F.when(F.length(F.coalesce(rationale, F.lit(""))) < 20, "short_rationale"), F.when(F.coalesce(attribution, F.lit("")) == "", "no_attribution"), F.when(position > 0.8 * length, "late_citation"),
    ))


#: Features of a run, and the node names (whole, or parts) that show them.
FEATURES = {"rules_mode": ["rules_loader"], "pdf_conversion": ["pdf_converter"], "reference_comparison": ["reference_classifier"]}
FEATURE_PARTS = {"dual_model": "dual", "tuned_model": "tuned"}


def run_features(events: DataFrame, whole: dict[str, list[str]] = FEATURES, parts: dict[str, str] = FEATURE_PARTS) -> DataFrame:
    """run_id and a flag per feature: did a node of that name, or with that part in its name, run."""
    named = [F.max(F.col("node").isin(names)).alias(f) for f, names in whole.items()]
    return events.groupBy("run_id").agg(*named, *[F.max(F.col("node").contains(p)).alias(f) for f, p in parts.items()])
