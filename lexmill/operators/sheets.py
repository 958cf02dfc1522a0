"""Wide rows per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status_letter(status: Column) -> Column:
    return F.when(status == "compliant", "Y").when(status == "non_compliant", "N").when(status == "not_applicable", "N/A").otherwise("Review")


def topic_row(verdicts: DataFrame, topics: list[tuple[str, list[str]]]) -> DataFrame:
    """doc_id and a column per topic: the letter of the first rule whose id holds a topic's word."""
    topic = F.lit(None).cast("string")
    for name, words in reversed(topics):
        topic = F.when(F.col("rule_id").rlike("|".join(words)), name).otherwise(topic)
    rows = verdicts.withColumn("topic", topic).groupBy("doc_id", "topic").agg(F.min_by(status_letter(F.col("status")), "rule_id").alias("letter"))
    return rows.groupBy("doc_id").pivot("topic", [n for n, _ in topics]).agg(F.first("letter"))


def topic_deviation(verdicts: DataFrame) -> DataFrame:
    """doc_id, deviation (Y if any rule is broken), details: the joined rationales."""
    bad = F.col("status") == "non_compliant"
    texts = F.array_sort(F.collect_list(F.when(bad, F.struct("rule_id", "rationale"))))
    rows = verdicts.groupBy("doc_id").agg(F.max(bad).alias("bad"), texts.alias("t"))
    return rows.select("doc_id", F.when(F.col("bad"), "Y").otherwise("N").alias("deviation"), F.array_join(F.transform("t", lambda x: x["rationale"]), "; ").alias("details"))


def review_checklist(measures: DataFrame) -> DataFrame:
    """doc_id, answers, failed, low -> conditional list (priority, item)."""
    items = F.array_compact(F.array(
        F.when(F.col("failed") > 0, F.struct(F.lit("high").alias("priority"), F.lit("Check failed answers").alias("item"))),
        F.when(F.col("low") > 0, F.struct(F.lit("medium").alias("priority"), F.lit("Check answers of low confidence").alias("item"))),
        F.when(F.col("answers") == 0, F.struct(F.lit("high").alias("priority"), F.lit("No answers at all").alias("item"))),
    ))
    return measures.select("doc_id", F.explode(items).alias("x")).select("doc_id", "x.*")
