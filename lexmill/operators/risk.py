"""Red flags and risk indicators of clauses, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions import lexicons as L
from lexmill.operators.matches import matches
from lexmill.operators.text import word_count

WEIGHTS = {"critical": 100, "high": 75, "medium": 50, "low": 25}
#: Fixed values.
LEGAL_TERMS = ["whereas", "notwithstanding", "provided that", "subject to", "shall", "pursuant to", "heretofore", "hereinafter"]


def red_flag_hits(sents: DataFrame, flags: list[tuple] = L.RED_FLAGS) -> DataFrame:
    """doc_id, sent_id, ordinal, category, severity, title, action, impact, hits of each pattern that fits."""
    cells = [
        F.struct(F.lit(n).alias("ordinal"), *[F.lit(v).alias(k) for k, v in zip(("category", "severity", "title", "action", "impact"), (f[0], f[1], *f[3:]), strict=True)], F.regexp_count("text", F.lit(f[2])).alias("hits"))
        for n, f in enumerate(flags)
    ]
    return sents.select("doc_id", "sent_id", F.explode(F.filter(F.array(*cells), lambda x: x["hits"] > 0)).alias("x")).select("doc_id", "sent_id", "x.*")


def red_flags(sents: DataFrame, flags: list[tuple] = L.RED_FLAGS, around: int = 50) -> DataFrame:
    """doc_id, sent_id, ordinal, category, severity, title, action, impact, pos, end, detected_text, location
    of every match. The location names ``section_name`` and ``page_number`` where the sentences have them."""
    parts = [F.concat(F.lit(label), F.nullif(F.col(c).cast("string"), F.lit(""))) for label, c in (("Section: ", "section_name"), ("Page: ", "page_number")) if c in sents.columns]
    location = F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit("Unknown location")) if parts else F.lit("Unknown location")
    found = matches(sents.select("doc_id", "sent_id", "text", location.alias("location")), [(f[0], "regex", f[2]) for f in flags], around)
    of = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("category", "severity", "title", "action", "impact"), (f[0], f[1], *f[3:]), strict=True)]) for f in flags])
    x = F.get(of, F.col("ordinal"))
    return found.select("doc_id", "sent_id", "ordinal", *[x[k].alias(k) for k in ("category", "severity", "title", "action", "impact")], "pos", "end", F.trim("context").alias("detected_text"), "location")


def red_flag_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("doc_id").pivot("severity", ["critical", "high", "medium"]).agg(F.sum("hits")).na.fill(0)


def red_flag_level(counts: DataFrame) -> DataFrame:
    c, h, m = F.col("critical"), F.col("high"), F.col("medium")
    level = F.when(c > 0, "CRITICAL").when(h >= 1, "HIGH").when(m >= 3, "MEDIUM").otherwise("LOW")
    a = L.LEVEL_ADVICE
    advice = F.when(c > 0, a["critical"]).when(h >= 3, a["many_high"]).when(h >= 1, a["high"]).when(m >= 3, a["medium"]).otherwise(a["low"])
    return counts.select("*", level.alias("level"), advice.alias("recommendation"))


def severity_order(c: Column) -> Column:
    return F.when(c == "critical", 0).when(c == "high", 1).when(c == "medium", 2).otherwise(3)


def action_items(hits: DataFrame, most: int = 10) -> DataFrame:
    """Distinct actions per document, most severe first, numbered, with a timeline."""
    rows = hits.groupBy("doc_id", "action").agg(F.min(severity_order(F.col("severity"))).alias("o"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("o", "action"))
    timeline = F.when(F.col("o") == 0, "Before signing").when(F.col("o") == 1, "Within 1 week").otherwise("Within 1 month")
    return rows.select("doc_id", rank.alias("rank"), "action", timeline.alias("timeline")).where(F.col("rank") <= most)


def impact_bucket(impact: Column) -> Column:
    low = F.lower(impact)
    return F.when(low.rlike("financial|liability|cost|payment|fee"), "financial").when(low.rlike("operational|business|termination|disruption"), "operational").when(low.rlike("compliance|regulatory|violation|sanctions"), "compliance").otherwise("legal")


def negotiation_points(hits: DataFrame) -> DataFrame:
    """Fixed points by the categories present: doc_id, points."""
    has = hits.groupBy("doc_id").agg(F.collect_set(F.when(F.col("severity") == "high", F.col("category"))).alias("high"), F.max(F.col("severity") == "critical").alias("critical"))
    points = F.array_compact(F.array(F.when(F.col("critical"), L.CRITICAL_POINT), *[F.when(F.array_contains("high", c), p) for c, p in L.POINTS]))
    return has.select("doc_id", points.alias("points"))


def risk_indicators(clauses: DataFrame, indicators: list[tuple] = L.RISK_INDICATORS) -> DataFrame:
    """doc_id, sent_id, ordinal, group, type, level, guidance of each indicator present in a clause."""
    cells = [
        F.when(F.col("text").rlike(i[3]), F.struct(F.lit(n).alias("ordinal"), F.lit(i[0]).alias("group"), F.lit(i[1]).alias("type"), F.lit(i[2]).alias("level"), F.lit(i[4]).alias("guidance")))
        for n, i in enumerate(indicators)
    ]
    return clauses.select("doc_id", "sent_id", F.explode(F.array_compact(F.array(*cells))).alias("x")).select("doc_id", "sent_id", "x.*")


def risk_score(hits: DataFrame) -> DataFrame:
    """Per clause: min(100, largest + a tenth of the scores after the first in pattern order), and its level."""
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("level")]
    rows = hits.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", weight.alias("w")))).alias("s"))  # one entry per indicator at most
    extra = F.aggregate(F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0))), F.lit(0.0), lambda a, x: a + x["w"] * 0.1)
    score = F.least(F.lit(100.0), F.array_max(F.transform("s", lambda x: x["w"])) + extra)
    return rows.select("doc_id", "sent_id", score.alias("score")).withColumn("level", risk_level(F.col("score")))


def risk_level(score: Column) -> Column:
    return F.when(score >= 90, "critical").when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def business_impact(hits: DataFrame) -> DataFrame:
    points = F.when(F.col("level").isin("critical", "high"), 3).when(F.col("level") == "medium", 2).otherwise(1)
    rows = hits.groupBy("doc_id").agg(F.avg(points).alias("mean"))
    return rows.withColumn("impact", F.when(F.col("mean") >= 2.5, "high").when(F.col("mean") >= 1.5, "medium").otherwise("low"))


def urgency(level: Column, impact: Column) -> Column:
    return F.when((level == "critical") | (impact == "high"), "Immediate").when(level == "high", "Soon").when(level == "medium", "Moderate").otherwise("Low")


def complexity(text: Column, terms: list[str] = LEGAL_TERMS) -> Column:
    words, sentences = word_count(text), F.size(F.split(text, r"[.!?]+", -1))
    found = F.lit(0)
    for t in terms:
        found = found + F.when(F.lower(text).contains(t), 1).otherwise(0)
    return F.least(F.lit(100.0), words / sentences / 20 * 30 + found / len(terms) * 30 + words / 200 * 40)


def risk_guidance(hits: DataFrame, most: int = 10) -> DataFrame:
    first = hits.groupBy("doc_id", "guidance").agg(F.min("ordinal").alias("o"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("o"))
    return first.select("doc_id", rank.alias("rank"), "guidance").where(F.col("rank") <= most)


def risk_profile(scores: DataFrame) -> DataFrame:
    """Per document over its clauses' scores: average, largest, high-risk clauses, level."""
    out = scores.groupBy("doc_id").agg(F.avg("score").alias("average"), F.max("score").alias("largest"), F.count_if(F.col("score") >= 70).alias("high_risk"))
    level = F.when((F.col("largest") >= 90) | (F.col("high_risk") >= 3), "critical").when(F.col("average") >= 70, "high").when(F.col("average") >= 40, "medium").otherwise("low")
    return out.withColumn("level", level)


def indicator_ratio(text: Column, phrases: list[str]) -> Column:
    """struct(ratio, level, confidence_pct)."""
    hits = F.lit(0)
    for p in phrases:
        hits = hits + F.when(F.lower(text).contains(p.lower()), 1).otherwise(0)
    ratio = hits / len(phrases)
    return F.struct(ratio.alias("ratio"), F.when(ratio >= 0.75, "High").when(ratio >= 0.5, "Medium").otherwise("Low").alias("level"), ((0.5 + ratio * 0.5) * 100).alias("confidence_pct"))
