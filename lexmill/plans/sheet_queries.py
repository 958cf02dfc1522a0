"""Queries over wide sheets per document: topics, deviations, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import sheets as H
from lexmill.plans.rule_queries import VERDICTS, verdicts
from lexmill.registry import query

TOPICS = [("notice", ["license", "rights"]), ("secrets", ["token"]), ("links", ["with", "de"])]
_yn = "case status when 'compliant' then 'Y' when 'non_compliant' then 'N' when 'not_applicable' then 'N/A' else 'Review' end"


@query("topic_letters", f"""with {VERDICTS}, o as (select *, {_yn} as yn from v), p as (select doc_id, case when regexp_matches(rule_id, 'license|rights') then 'notice' when regexp_matches(rule_id, 'token') then 'secrets' when regexp_matches(rule_id, 'with|de') then 'links' end as topic, arg_min(yn, rule_id) as yn from o group by all)
select doc_id, max(yn) filter (topic = 'notice') as notice, max(yn) filter (topic = 'secrets') as secrets, max(yn) filter (topic = 'links') as links from p group by doc_id""")
def q_topic_letters(spark, sf_dir):
    return H.topic_row(verdicts(spark, sf_dir), TOPICS)


@query("topic_deviation", f"with {VERDICTS} select doc_id, case when bool_or(status = 'non_compliant') then 'Y' else 'N' end as deviation, coalesce(string_agg(rule_id, '; ' order by rule_id) filter (status = 'non_compliant'), '') as details from v group by doc_id")
def q_topic_deviation(spark, sf_dir):
    return H.topic_deviation(verdicts(spark, sf_dir).withColumn("rationale", F.col("rule_id")))
