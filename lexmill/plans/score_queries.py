"""Queries over scores and risks, on the corpus pack."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import quality as Q
from lexmill.operators import risk as K
from lexmill.plans.retrieval_queries import PAIRS, qa
from lexmill.plans.text_queries import SENT, WORDS, docs, sents
from lexmill.registry import query, table

SET = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"
OVERLAP = f"len(list_intersect({SET.format('answer')}, {SET.format('question')})) / len({SET.format('answer')})"
SPEC = r"least(1.0, case when regexp_matches(answer, '\d') then 0.3 else 0.0 end + case when regexp_matches(answer, '\b(\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}|\d{4}-\d{2}-\d{2})\b') then 0.3 else 0.0 end + least(0.4, len(regexp_extract_all(answer, '\b[A-Z][a-zA-Z]{2,}\b')) * 0.05))::double"
LEN = r"length(regexp_replace(answer, '^\s+|\s+$', '', 'g'))"
COMPLETE = f"(case when {LEN} = 0 then 0.0 when {LEN} < 10 then 0.2 when {LEN} < 30 then 0.4 when {LEN} < 120 then 0.8 when {LEN} < 400 then 1.0 else 0.7 end)::double"
CONF = f"(0.3::double * {COMPLETE} + 0.4::double * ({OVERLAP}) + 0.3::double * {SPEC})"
SCORED = f"{PAIRS}, sc as (select *, {CONF} as conf from qa)"


def scored(spark, sf_dir):
    return qa(spark, sf_dir).withColumn("conf", Q.extraction_confidence(F.col("answer"), F.col("question")))


@query("word_overlap", f"with {PAIRS} select conv_id, turn, {OVERLAP} as score from qa")
def q_word_overlap(spark, sf_dir):
    return qa(spark, sf_dir).select("conv_id", "turn", Q.word_overlap(F.col("answer"), F.col("question")).alias("score"))


@query("specificity", f"with {PAIRS} select conv_id, turn, {SPEC} as score from qa")
def q_specificity(spark, sf_dir):
    return qa(spark, sf_dir).select("conv_id", "turn", Q.specificity(F.col("answer")).alias("score"))


@query("completeness", f"with {PAIRS} select conv_id, turn, {COMPLETE} as score from qa")
def q_completeness(spark, sf_dir):
    return qa(spark, sf_dir).select("conv_id", "turn", Q.completeness(F.col("answer"), True).alias("score"))


@query("extraction_confidence", f"with {SCORED} select conv_id, turn, conf, conf < 0.6 as review from sc")
def q_extraction_confidence(spark, sf_dir):
    return scored(spark, sf_dir).select("conv_id", "turn", "conf", (F.col("conf") < 0.6).alias("review"))


@query("confidence_source", "select event_id, coalesce(case when event_id % 3 = 0 then value / 100 end, case when event_id % 3 = 1 then 0.8 end, 0.5)::double as confidence, case event_id % 3 when 0 then 'logprobs' when 1 then 'model' else 'heuristic' end as method from events")
def q_confidence_source(spark, sf_dir):
    k = F.col("event_id") % 3
    confidence = F.coalesce(F.when(k == 0, F.col("value") / 100), F.when(k == 1, 0.8), F.lit(0.5))
    return table(spark, sf_dir, "events").select("event_id", confidence.alias("confidence"), F.when(k == 0, "logprobs").when(k == 1, "model").otherwise("heuristic").alias("method"))


@query("label_confidence", "select event_id, 0.4::double * value / 100 + 0.4::double * 0.5 + 0.2::double * least(1.0::double, (event_id % 7) / 5) as confidence from events")
def q_label_confidence(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", Q.label_confidence(F.col("value") / 100, F.lit(0.5), F.col("event_id") % 7).alias("confidence"))


GRADE = "case when {0} >= {1} then 'A' when {0} >= {2} then 'B' when {0} >= {3} then 'C' when {0} >= {4} then 'D' else 'F' end"


@query("document_confidence", f"with {SCORED}, d as (select conv_id as doc_id, greatest(0.0, avg(conf * 100) - max(conv_id % 3 * 10)) as final, max(conv_id % 3 * 10) as p from sc group by 1) select doc_id, final, {GRADE.format('final', 90, 80, 70, 60)} as grade, final < 70 or p > 10 as review from d")
def q_document_confidence(spark, sf_dir):
    rows = scored(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), (F.col("conf") * 100).alias("score_pct"), (F.col("conv_id") % 3 * 10).alias("penalty"))
    return Q.document_confidence(rows)


CLASSQ = """cq as (select user_id as doc_id, coalesce(avg(c), 0.0) as average, coalesce(min(c), 0.0) as lowest, coalesce(max(c), 0.0) as highest, count(*) filter (c >= 90) as excellent, count(*) filter (c >= 75 and c < 90) as good,
  count(*) filter (c >= 60 and c < 75) as acceptable, count(*) filter (c >= 40 and c < 60) as needs_review, count(*) filter (c < 40) as poor, avg((event_id % 10 = 0)::int) as error_rate, avg((event_id % 4 = 0)::int) as review_rate
  from (select *, case when value > 0 then value end as c from events) group by 1)"""


def class_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("doc_id"), F.col("value").alias("confidence_pct"), (F.col("event_id") % 10 == 0).alias("error"), (F.col("event_id") % 4 == 0).alias("review"))


@query("classification_quality", f"with {CLASSQ} select *, greatest(0.0, average - 30 * error_rate - 15 * review_rate) as score from cq")
def q_classification_quality(spark, sf_dir):
    return Q.classification_quality(class_rows(spark, sf_dir))


EXTQ = "eq as (select conv_id as doc_id, avg((length(answer) >= 100)::int) as completeness_rate, coalesce(avg(conf * 100), 0.0) as average from sc group by 1)"


@query("extraction_quality", f"with {SCORED}, {EXTQ} select *, completeness_rate * 50 + average * 0.5 as score from eq")
def q_extraction_quality(spark, sf_dir):
    return Q.extraction_quality(scored(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), (F.length("answer") >= 100).alias("answered"), (F.col("conf") * 100).alias("confidence_pct")))


LEVEL = "case event_id % 40 when 0 then 'critical' when 1 then 'recoverable' when 2 then 'warning' when 3 then 'fallback' else 'ok' end"
REL = f"rl as (select user_id as doc_id, greatest(0, 100 - least(100, 40 * count(*) filter (l = 'critical') + 20 * count(*) filter (l = 'recoverable') + 5 * count(*) filter (l = 'warning')) - 10 * count(*) filter (l = 'fallback')) as score from (select *, {LEVEL} as l from events) group by 1)"


def levels(spark, sf_dir):
    k = F.col("event_id") % 40
    level = F.when(k == 0, "critical").when(k == 1, "recoverable").when(k == 2, "warning").when(k == 3, "fallback").otherwise("ok")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), level.alias("level"))


@query("reliability", f"with {REL} select * from rl")
def q_reliability(spark, sf_dir):
    return Q.reliability(levels(spark, sf_dir))


@query("quality_rating", f"with {CLASSQ}, {REL}, c as (select doc_id, greatest(0.0, average - 30 * error_rate - 15 * review_rate) as score from cq), o as (select c.doc_id, 0.3::double * c.score + 0.35::double * 60 + 0.2::double * rl.score + 0.15::double * 80 as overall from c join rl using (doc_id)) select doc_id, overall, {GRADE.format('overall', 90, 75, 60, 40)} as grade, overall < 60 as review from o")
def q_quality_rating(spark, sf_dir):
    c = Q.classification_quality(class_rows(spark, sf_dir)).select("doc_id", F.col("score").alias("c"))
    rows = c.join(Q.reliability(levels(spark, sf_dir)).select("doc_id", F.col("score").alias("p")), "doc_id")
    return rows.select("doc_id", Q.quality_rating(F.col("c"), F.lit(60), F.col("p"), F.lit(80)).alias("q")).select("doc_id", "q.*")


FLAGS = f"list_filter([case when starts_with(lower(answer), 'error') then 'error' end, case when conf < 0.7 then 'low_confidence' end, case when contains(answer, '?') or {LEN} < 30 then 'review' end], lambda x: x is not null)"


@query("answer_validation", f"with {SCORED} select conv_id, turn, {FLAGS} as flags from sc")
def q_answer_validation(spark, sf_dir):
    return scored(spark, sf_dir).select("conv_id", "turn", Q.answer_flags(F.col("answer"), F.col("conf")).alias("flags"))


@query("validation_summary", f"""with {SCORED}, f as (select conv_id as doc_id, {FLAGS} as flags from sc),
s as (select doc_id, count(*) as processed, count(*) filter (list_contains(flags, 'error')) as failed, count(*) filter (list_contains(flags, 'low_confidence')) as low, count(*) filter (len(flags) = 0) as passed from f group by 1)
select *, case when failed = 0 and low < 3 then 'PASSED' else 'REVIEW' end as status from s""")
def q_validation_summary(spark, sf_dir):
    return Q.validation_summary(q_answer_validation(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), "flags"))


#: As the scorer has it: null answers are empty, and those without words overlap by 0.
_WHOLE = SCORED.replace(OVERLAP, f"coalesce(case when len({SET.format('answer')}) > 0 then {OVERLAP} end, 0.0)").replace("question, answer from pairs", "question, coalesce(answer, '') as answer from pairs")


@query("answer_recommendation", f"with {_WHOLE}, s as (select conv_id as doc_id, min(conf) as worst, count(*) filter (conf < 0.4) as risky from sc group by 1) select doc_id, risky, case when worst < 0.25 then 'REJECT' when risky >= 2 then 'NEGOTIATE' when risky = 1 then 'REVIEW' else 'APPROVE' end as recommendation from s")
def q_answer_recommendation(spark, sf_dir):
    s = scored(spark, sf_dir).groupBy(F.col("conv_id").alias("doc_id")).agg(F.min("conf").alias("worst"), F.count_if(F.col("conf") < 0.4).alias("risky"))
    pick = F.when(F.col("worst") < 0.25, "REJECT").when(F.col("risky") >= 2, "NEGOTIATE").when(F.col("risky") == 1, "REVIEW").otherwise("APPROVE")
    return s.select("doc_id", "risky", pick.alias("recommendation"))


@query("processing_stats", f"with {SENT} select source = 'src0' as reference, count(*) as sentences, count(*) filter (contains(lower(s.text), 'license')) as labelled, count(*) filter (contains(lower(s.text), 'license')) / count(*) as success_rate from sent s join documents d using (doc_id) group by 1")
def q_processing_stats(spark, sf_dir):
    rows = sents(spark, sf_dir).join(docs(spark, sf_dir).select("doc_id", (F.col("source") == "src0").alias("reference")), "doc_id")
    hit = F.count_if(F.lower("text").contains("license"))
    return rows.groupBy("reference").agg(F.count("*").alias("sentences"), hit.alias("labelled"), (hit / F.count("*")).alias("success_rate"))


@query("answer_long", f"with {SCORED} select conv_id, turn, question, substr(answer, 1, 200) as answer, conf, conf < 0.6 as review, count(*) over (partition by conv_id) as answers from sc")
def q_answer_long(spark, sf_dir):
    from pyspark.sql.window import Window

    n = F.count("*").over(Window.partitionBy("conv_id"))
    return scored(spark, sf_dir).select("conv_id", "turn", "question", F.substring("answer", 1, 200).alias("answer"), "conf", (F.col("conf") < 0.6).alias("review"), n.alias("answers"))


@query("yes_no", f"""with {PAIRS} select conv_id, turn, case when regexp_matches(lower(answer), 'no explicit mention|not specified|does not|no provisions') then 'N' when regexp_matches(lower(answer), 'yes|does have|includes|contains provisions') then 'Y' else 'Review' end as verdict,
  case when length(answer) > 500 then substr(answer, 1, 500) || '...' else answer end as details from qa""")
def q_yes_no(spark, sf_dir):
    return qa(spark, sf_dir).select("conv_id", "turn", Q.yes_no(F.col("answer")).alias("x")).select("conv_id", "turn", "x.*")


@query("confidence_histogram", f"with {SCORED}, b as (select cast(least(greatest(ceil(conf * 5), 1), 5) as integer) as bin from sc) select cast(s.bin as integer) as bin, count(b.bin) as n from range(1, 6) s(bin) left join b using (bin) group by 1")
def q_confidence_histogram(spark, sf_dir):
    return Q.histogram(scored(spark, sf_dir).select(F.col("conf").alias("confidence")))


@query("grade_shares", "select lang as grade, count(*) as n, count(*) / sum(count(*)) over () as share from documents group by lang")
def q_grade_shares(spark, sf_dir):
    return Q.shares(docs(spark, sf_dir).select(F.col("lang").alias("grade")), "grade")


@query("decision_stats", "select event_type as method, count(*) as decisions, count(*) filter (value < 60) as low_confidence, count(*) filter (event_id % 5 = 0) as review from events group by 1")
def q_decision_stats(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("method")).agg(F.count("*").alias("decisions"), F.count_if(F.col("value") < 60).alias("low_confidence"), F.count_if(F.col("event_id") % 5 == 0).alias("review"))


@query("decision_method", "select event_id, case when event_type in ('click', 'view') then 'deterministic' when contains(event_type, 'e') then 'llm_primary' else 'classification' end as method, case when value < 60 then ['Low confidence'] else []::varchar[] end as warnings from events")
def q_decision_method(spark, sf_dir):
    t = F.col("event_type")
    method = F.when(t.isin("click", "view"), "deterministic").when(t.contains("e"), "llm_primary").otherwise("classification")
    return table(spark, sf_dir, "events").select("event_id", method.alias("method"), F.array_compact(F.array(F.when(F.col("value") < 60, "Low confidence"))).alias("warnings"))


# -- risk -----------------------------------------------------------------------------------------

FLAG_PACK = [
    ("notice", "critical", r"(?i)licen[sc]ed? under", "License notice", "Check the license", "Compliance violation"),
    ("notice", "high", r"(?i)all rights", "Rights reserved", "Ask for permission", "Legal exposure"),
    ("secret", "high", r"(?i)(?:token|key) ?=", "Secret", "Rotate the secret", "Financial loss"),
    ("contact", "medium", r"@\w+", "Address", "Mask addresses", "Business disruption"),
    ("contact", "medium", r"\d{4}", "Number", "Mask numbers", "Unknown"),
]
_f = " union all ".join(
    f"select doc_id, sent_id, {n} as ordinal, '{c}' as category, '{s}' as severity, '{t}' as title, '{a}' as action, '{i}' as impact, len(regexp_extract_all(text, '{p}')) as hits from sent"
    for n, (c, s, p, t, a, i) in enumerate(FLAG_PACK)
)
FLAG_CTE = f"{SENT}, fl as (select * from ({_f}) where hits > 0)"
COUNT_CTE = FLAG_CTE + ", fc as (select doc_id, " + ", ".join(f"coalesce(sum(hits) filter (severity = '{s}'), 0)::bigint as {s}" for s in ("critical", "high", "medium")) + " from fl group by doc_id)"


def flags(spark, sf_dir):
    return K.red_flag_hits(sents(spark, sf_dir), FLAG_PACK)


@query("red_flag_totals", f"with {FLAG_CTE} select * from fl")
def q_red_flag_totals(spark, sf_dir):
    return flags(spark, sf_dir)


def _flag_rows(n: int, flag: tuple) -> str:
    c, s, p, t, a, i = flag
    return f"""select doc_id, sent_id, text, {n} as ordinal, '{c}' as category, '{s}' as severity, '{t}' as title, '{a}' as action, '{i}' as impact, unnest(list_transform(range(1, len(found) + 1), lambda i: cast(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) as bigint))) as pos, unnest(list_transform(found, lambda x: length(x))) as n
  from (select doc_id, sent_id, text, regexp_extract_all(text, '(?i){p}') as found, string_split_regex(text, '(?i){p}') as pieces from sent) where len(found) > 0"""


_flag_sql = " union all ".join(_flag_rows(n, f) for n, f in enumerate(FLAG_PACK))


@query("red_flag_hits", f"""with {SENT}, k as ({_flag_sql}) select doc_id, sent_id, ordinal, category, severity, title, action, impact, cast(pos as integer) as pos, cast(pos + n as integer) as "end",
  trim(substr(text, greatest(pos - 50, 0) + 1, pos + n + 50 - greatest(pos - 50, 0)), ' ') as detected_text, 'Page: ' || (sent_id // 10 + 1) as location from k""")
def q_red_flag_hits(spark, sf_dir):
    return K.red_flags(sents(spark, sf_dir).withColumn("page_number", (F.floor(F.col("sent_id") / 10) + 1).cast("int")), FLAG_PACK)


@query("red_flag_counts", f"with {COUNT_CTE} select * from fc")
def q_red_flag_counts(spark, sf_dir):
    return K.red_flag_counts(flags(spark, sf_dir))


@query("red_flag_level", f"""with {COUNT_CTE} select *, case when critical > 0 then 'CRITICAL' when high >= 1 then 'HIGH' when medium >= 3 then 'MEDIUM' else 'LOW' end as level,
  case when critical > 0 then 'DO NOT SIGN - Critical issues require resolution' when high >= 3 then 'CAUTION - Multiple high-risk issues require negotiation' when high >= 1 then 'REVIEW REQUIRED - Address high-risk provisions'
  when medium >= 3 then 'NEGOTIATE - Address medium-risk provisions' else 'ACCEPTABLE - Standard contract review recommended' end as recommendation from fc""")
def q_red_flag_level(spark, sf_dir):
    return K.red_flag_level(q_red_flag_counts(spark, sf_dir))


@query("action_items", f"""with {FLAG_CTE}, a as (select doc_id, action, min(list_position(['critical', 'high', 'medium'], severity)) as o from fl group by all)
select doc_id, cast(row_number() over (partition by doc_id order by o, action) as integer) as rank, action, case o when 1 then 'Before signing' when 2 then 'Within 1 week' else 'Within 1 month' end as timeline from a""")
def q_action_items(spark, sf_dir):
    return K.action_items(flags(spark, sf_dir))


@query("impact_buckets", f"""with {FLAG_CTE} select doc_id, case when impact = 'Financial loss' then 'financial' when impact = 'Business disruption' then 'operational' when impact = 'Compliance violation' then 'compliance' else 'legal' end as bucket, count(*) as flags from fl group by all""")
def q_impact_buckets(spark, sf_dir):
    return flags(spark, sf_dir).groupBy("doc_id", K.impact_bucket(F.col("impact")).alias("bucket")).agg(F.count("*").alias("flags"))


RISK_PACK = [
    ("notice", "licensed", "critical", "(?i)licensed", "Check license"), ("notice", "rights", "high", "(?i)rights", "Ask"),
    ("link", "with", "medium", r"(?i)\bwith\b", "None"), ("link", "from", "low", r"(?i)\bfrom\b", "Nothing"), ("link", "that", "high", r"(?i)\bthat\b", "Skip"),
]
_r = " union all ".join(f"select doc_id, sent_id, {n} as ordinal, '{g}' as \"group\", '{t}' as type, '{lv}' as level, '{gd}' as guidance from sent where regexp_matches(text, '{p}')" for n, (g, t, lv, p, gd) in enumerate(RISK_PACK))
RISK_CTE = f"""{SENT}, ri as ({_r}), rw as (select *, case level when 'critical' then 100 when 'high' then 75 when 'medium' then 50 else 25 end as w, row_number() over (partition by doc_id, sent_id order by ordinal) as k from ri),
rs as (select doc_id, sent_id, least(100.0, max(w) + coalesce(sum(w * 0.1) filter (k > 1), 0))::double as score from rw group by all)"""
RLEVEL = "case when score >= 90 then 'critical' when score >= 70 then 'high' when score >= 40 then 'medium' else 'low' end"


def risks(spark, sf_dir):
    return K.risk_indicators(sents(spark, sf_dir), RISK_PACK)


@query("risk_indicators", f"with {RISK_CTE} select * from ri")
def q_risk_indicators(spark, sf_dir):
    return risks(spark, sf_dir)


@query("risk_score", f"with {RISK_CTE} select *, {RLEVEL} as level from rs")
def q_risk_score(spark, sf_dir):
    return K.risk_score(risks(spark, sf_dir))


IMPACT = "bi as (select doc_id, avg(case when level in ('critical', 'high') then 3 when level = 'medium' then 2 else 1 end) as mean from ri group by 1), bj as (select *, case when mean >= 2.5 then 'high' when mean >= 1.5 then 'medium' else 'low' end as impact from bi)"


@query("business_impact", f"with {RISK_CTE}, {IMPACT} select * from bj")
def q_business_impact(spark, sf_dir):
    return K.business_impact(risks(spark, sf_dir))


PROFILE = "rp as (select doc_id, avg(score) as average, max(score) as largest, count(*) filter (score >= 70) as high_risk from rs group by 1), rq as (select *, case when largest >= 90 or high_risk >= 3 then 'critical' when average >= 70 then 'high' when average >= 40 then 'medium' else 'low' end as level from rp)"


@query("risk_levels", f"with {RISK_CTE}, {PROFILE} select * from rq")
def q_risk_levels(spark, sf_dir):
    return K.risk_profile(q_risk_score(spark, sf_dir))


@query("mitigation_urgency", f"with {RISK_CTE}, {PROFILE}, {IMPACT} select doc_id, case when level = 'critical' or impact = 'high' then 'Immediate' when level = 'high' then 'Soon' when level = 'medium' then 'Moderate' else 'Low' end as urgency from rq join bj using (doc_id)")
def q_mitigation_urgency(spark, sf_dir):
    both = q_risk_levels(spark, sf_dir).select("doc_id", "level").join(q_business_impact(spark, sf_dir).select("doc_id", "impact"), "doc_id")
    return both.select("doc_id", K.urgency(F.col("level"), F.col("impact")).alias("urgency"))


@query("document_guidance", f"with {RISK_CTE}, g as (select doc_id, guidance, min(ordinal) as o from ri group by all) select doc_id, cast(row_number() over (partition by doc_id order by o) as integer) as rank, guidance from g")
def q_document_guidance(spark, sf_dir):
    return K.risk_guidance(risks(spark, sf_dir))


_t = " + ".join(f"case when contains(lower(text), '{t}') then 1 else 0 end" for t in ("license", "reserved", "under", "that"))


@query("complexity", rf"with {SENT} select doc_id, sent_id, least(100.0, {WORDS.format('text')} / len(string_split_regex(text, '[.!?]+')) / 20 * 30 + ({_t}) / 4 * 30 + {WORDS.format('text')} / 200 * 40)::double as complexity from sent")
def q_complexity(spark, sf_dir):
    return sents(spark, sf_dir).select("doc_id", "sent_id", K.complexity(F.col("text"), ["license", "reserved", "under", "that"]).alias("complexity"))


@query("indicator_ratio", f"select doc_id, ({_t}) / 4 as ratio, case when ({_t}) / 4 >= 0.75 then 'High' when ({_t}) / 4 >= 0.5 then 'Medium' else 'Low' end as level, (0.5 + ({_t}) / 4 * 0.5) * 100 as confidence_pct from documents")
def q_indicator_ratio(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", K.indicator_ratio(F.col("text"), ["license", "reserved", "under", "that"]).alias("x")).select("doc_id", "x.*")
