"""Scores of answers, and roll-ups to quality grades. ``*_pct`` columns are on 0-100, others on 0-1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.retrieval import token_array
from lexmill.operators.text import strip


def word_overlap(a: Column, b: Column) -> Column:
    """Share of the distinct words of ``a`` that ``b`` has."""

    def words(c: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0))

    n = F.size(words(a))
    return F.when((n > 0) & (F.size(words(b)) > 0), F.size(F.array_intersect(words(a), words(b))) / n).otherwise(0.0)


def specificity(t: Column) -> Column:
    """0.3 for a number, 0.3 for a date, 0.05 for each name up to 0.4; null counts as empty. Summed in hundredths, so
    that no error of 0.05 * n moves a score across a threshold."""
    t = F.coalesce(t, F.lit(""))
    proper = F.regexp_count(t, F.lit(r"(?<![A-Za-z0-9_])[A-Z][a-zA-Z]{2,}(?![A-Za-z0-9_])"))
    date = t.rlike(r"(?<![A-Za-z0-9_])(\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}|\d{4}-\d{2}-\d{2})(?![A-Za-z0-9_])")
    return F.least(F.lit(100), F.when(t.rlike(r"\d"), 30).otherwise(0) + F.when(date, 30).otherwise(0) + F.least(F.lit(40), proper * 5)) / 100


def completeness(t: Column, enhanced: bool = False) -> Column:
    n = F.length(strip(F.coalesce(t, F.lit(""))))
    out = F.when(n == 0, 0.0)
    if enhanced:
        out = out.when(n < 10, 0.2)
    return out.when(n < 30, 0.4).when(n < 120, 0.8).when(n < 400, 1.0).otherwise(0.7)


def extraction_confidence(answer: Column, source: Column) -> Column:
    return 0.3 * completeness(answer, True) + 0.4 * word_overlap(answer, source) + 0.3 * specificity(answer)


def label_confidence(relevance: Column, clarity: Column, labels: Column) -> Column:
    return 0.4 * relevance + 0.4 * clarity + 0.2 * F.least(F.lit(1.0), labels / 5)


def grade(score: Column, cuts: tuple[float, ...] = (90, 80, 70, 60)) -> Column:
    out = F.lit("F")
    for cut, g in reversed(list(zip(cuts, "ABCD", strict=True))):
        out = F.when(score >= cut, g).otherwise(out)
    return out


def document_confidence(scores: DataFrame) -> DataFrame:
    """doc_id, score_pct, penalty -> final, grade, review."""
    rows = scores.groupBy("doc_id").agg(F.greatest(F.lit(0.0), F.avg("score_pct") - F.max("penalty")).alias("final"), F.max("penalty").alias("penalty"))
    return rows.select("doc_id", "final", grade(F.col("final")).alias("grade"), ((F.col("final") < 70) | (F.col("penalty") > 10)).alias("review"))


def classification_quality(rows: DataFrame) -> DataFrame:
    """doc_id, confidence_pct, review, error -> averages, five bands, rates, score."""
    c = F.when(F.col("confidence_pct") > 0, F.col("confidence_pct"))
    rate = lambda name: F.avg(F.col(name).cast("int"))
    out = rows.groupBy("doc_id").agg(
        F.coalesce(F.avg(c), F.lit(0.0)).alias("average"), F.coalesce(F.min(c), F.lit(0.0)).alias("lowest"), F.coalesce(F.max(c), F.lit(0.0)).alias("highest"),
        F.count_if(c >= 90).alias("excellent"), F.count_if((c >= 75) & (c < 90)).alias("good"), F.count_if((c >= 60) & (c < 75)).alias("acceptable"),
        F.count_if((c >= 40) & (c < 60)).alias("needs_review"), F.count_if(c < 40).alias("poor"), rate("error").alias("error_rate"), rate("review").alias("review_rate"),
    )
    return out.withColumn("score", F.greatest(F.lit(0.0), F.col("average") - 30 * F.col("error_rate") - 15 * F.col("review_rate")))


def extraction_quality(answers: DataFrame) -> DataFrame:
    """doc_id, answered, confidence_pct -> completeness_rate, score."""
    out = answers.groupBy("doc_id").agg(F.avg(F.col("answered").cast("int")).alias("completeness_rate"), F.coalesce(F.avg("confidence_pct"), F.lit(0.0)).alias("average"))
    return out.withColumn("score", F.col("completeness_rate") * 50 + F.col("average") * 0.5)


def reliability(events: DataFrame) -> DataFrame:
    """doc_id, level (critical/recoverable/warning/fallback) -> score."""
    n = lambda k: F.count_if(F.col("level") == k)
    score = F.greatest(F.lit(0), 100 - F.least(F.lit(100), 40 * n("critical") + 20 * n("recoverable") + 5 * n("warning")) - 10 * n("fallback"))
    return events.groupBy("doc_id").agg(score.alias("score"))


def quality_rating(classification: Column, extraction: Column, processing: Column, outputs: Column) -> Column:
    """struct(overall, grade, review)."""
    overall = 0.3 * classification + 0.35 * extraction + 0.2 * processing + 0.15 * outputs
    return F.struct(overall.alias("overall"), grade(overall, (90, 75, 60, 40)).alias("grade"), (overall < 60).alias("review"))


def answer_flags(answer: Column, confidence: Column) -> Column:
    """What is wrong with an answer."""
    low = F.lower(answer)
    return F.array_compact(F.array(
        F.when(low.startswith("error"), "error"), F.when(confidence < 0.7, "low_confidence"), F.when(low.contains("?") | (F.length(strip(answer)) < 30), "review"),
    ))


def validation_summary(rows: DataFrame) -> DataFrame:
    """doc_id, flags -> processed, failed, low, passed and the verdict."""
    bad, low = F.array_contains("flags", "error"), F.array_contains("flags", "low_confidence")
    out = rows.groupBy("doc_id").agg(F.count("*").alias("processed"), F.count_if(bad).alias("failed"), F.count_if(low).alias("low"), F.count_if(F.size("flags") == 0).alias("passed"))
    return out.withColumn("status", F.when((F.col("failed") == 0) & (F.col("low") < 3), "PASSED").otherwise("REVIEW"))


def yes_no(answer: Column) -> Column:
    """struct(verdict, details)."""
    low = F.lower(answer)
    details = F.when(F.length(answer) > 500, F.concat(F.substring(answer, 1, 500), F.lit("..."))).otherwise(answer)
    blank = answer.isNull() | strip(answer).isin("", "MANUAL_FIELD", "Not specified")
    verdict = F.when(blank, "N/A").when(low.rlike("no explicit mention|not specified|does not|no provisions"), "N").when(low.rlike("yes|does have|includes|contains provisions"), "Y").otherwise("Review")
    return F.struct(verdict.alias("verdict"), F.when(blank, "Not analyzed").otherwise(details).alias("details"))


def histogram(confidences: DataFrame, bins: int = 5) -> DataFrame:
    """bin (1..bins, right-closed), n; empty bins are kept."""
    spark = confidences.sparkSession
    spine = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    at = F.least(F.greatest(F.ceil(F.col("confidence") * bins), F.lit(1)), F.lit(bins)).cast("int")
    return spine.join(confidences.groupBy(at.alias("bin")).agg(F.count("*").alias("n")), "bin", "left").na.fill(0, ["n"])


def shares(rows: DataFrame, key: str) -> DataFrame:
    """Count and share per value: the totals of few groups are summed once more."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(key, "n", (F.col("n") / F.col("total")).alias("share"))


def question_answer_tokens(t: Column) -> Column:
    return F.size(F.array_distinct(token_array(t)))
