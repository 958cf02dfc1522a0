"""Queries over roll-ups for people, on the corpus pack."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import citations as C
from lexmill.operators import overview as O
from lexmill.operators import pages as P
from lexmill.operators import runs as U
from lexmill.plans.rule_queries import VERDICTS, verdicts
from lexmill.plans.run_queries import events
from lexmill.plans.score_queries import FLAG_CTE, RISK_CTE, flags, q_risk_score, risks
from lexmill.plans.sheet_queries import TOPICS
from lexmill.plans.text_queries import docs
from lexmill.registry import oracle, query, table
from lexmill.sources import files
from lexmill.sources import tables as S

_HEAD = r"'Document Beginning: ' || nullif(trim(replace(substr(text, 1, 250), chr(10), ' '), ' '), '') || '...'"


@query("doc_opening", f"""select doc_id, concat_ws(chr(10), 'Filename: ' || source, case when n_chars % 2 = 0 then 'Document Title: ' || lang end, case when n_chars > 2000 then 'Detected Type: ' || lang end, {_HEAD}) as opening from documents""")
def q_doc_opening(spark, sf_dir):
    d = docs(spark, sf_dir)
    confidence = F.when(F.col("n_chars") > 2000, 0.8).otherwise(0.7)
    return O.opening(d.select("doc_id", "text", F.col("source").alias("name"), F.when(F.col("n_chars") % 2 == 0, F.col("lang")).alias("title"), F.col("lang").alias("type"), confidence.alias("type_confidence")))


@query("dashboard", """with a as (select doc_id, source || '/' || doc_id || '/a-very-long-name-of-a-file' as name, lang as risk_level, source as grade, (n_chars % 100)::double as score, to_timestamp(n_chars) as seen, n_chars % 10 = 0 as review from documents),
o as (select count(*) as n, max(epoch(seen)) as latest, avg(score) as mean from a), g as (select 'risk' as section, risk_level as label, count(*) as n from a group by 2 union all select 'grade', grade, count(*) from a group by 2),
r as (select *, row_number() over (order by seen desc, doc_id) as k from a)
select 'overview' as section, 1 as rank, 'documents' as label, n, null::double as share, null::double as value from o union all select 'overview', 2, 'latest', null, null, latest from o union all select 'overview', 3, 'average score', null, null, mean from o
union all select section, cast(row_number() over (partition by section order by n desc, label) as integer), label, n, n / sum(n) over (partition by section), null from g
union all select 'recent', cast(k as integer), substr(name, 1, 30) || '...', doc_id, null, score from r where k <= 10 union all select 'review', null, name, doc_id, null, score from a where review""")
def q_dashboard(spark, sf_dir):
    d = docs(spark, sf_dir)
    name = F.concat("source", F.lit("/"), "doc_id", F.lit("/a-very-long-name-of-a-file"))
    return O.dashboard(d.select("doc_id", name.alias("name"), F.col("lang").alias("risk_level"), F.col("source").alias("grade"), (F.col("n_chars") % 100).cast("double").alias("score"), F.timestamp_seconds("n_chars").alias("analysed_at"), (F.col("n_chars") % 10 == 0).alias("review")))


@query("executive_summary", f"""with {FLAG_CTE}, p as (select doc_id, category, sum(hits)::bigint as n, coalesce(sum(hits) filter (severity = 'critical'), 0)::bigint as c, coalesce(sum(hits) filter (severity = 'high'), 0)::bigint as h from fl group by all),
g as (select doc_id, sum(n)::bigint as total, sum(c)::bigint as critical, sum(h)::bigint as high, list_slice(list(upper(category[1]) || category[2:] || ' (' || n || ' issue' || case when n > 1 then 's' else '' end || ')' order by n desc, category), 1, 2) as areas from p group by 1),
d as (select doc_id, case when n_chars % 3 = 0 then 'high' else 'low' end as risk_level, n_chars % 100 as score from documents), j as (select d.*, coalesce(total, 0) as total, coalesce(critical, 0) as critical, coalesce(high, 0) as high, coalesce(areas, []) as areas from d left join g using (doc_id))
select doc_id, case when critical > 0 then '{O.ADVICE["critical"]}' when high >= 3 then '{O.ADVICE["many"]}' when risk_level = 'high' then '{O.ADVICE["risk"]}' when score < 60 then '{O.ADVICE["unsure"]}' else '{O.ADVICE["fine"]}' end as recommendation,
  list_filter([case when critical > 0 then critical || ' critical red flag(s) detected' end, case when high > 0 then high || ' high-risk issue(s) identified' end, case when score < 70 then 'Low analysis confidence (' || score || '%)' end], lambda x: x is not null) as attention, areas as high_risk_areas, total, critical, high from j""")
def q_executive_summary(spark, sf_dir):
    level = F.when(F.col("n_chars") % 3 == 0, "high").otherwise("low")
    return O.executive_summary(docs(spark, sf_dir).select("doc_id", level.alias("risk_level"), (F.col("n_chars") % 100).alias("score")), flags(spark, sf_dir), 2)


@query("risk_guidance", f"""with {RISK_CTE}, i as (select doc_id, sent_id, list(guidance order by ordinal) as g, list("group") as gs, count(*) as n from ri group by all),
c as (select doc_id, sent_id, list_concat(g, list_filter([case when list_contains(gs, 'notice') then 'Mind the notice' end, case when list_contains(gs, 'secret') then 'Hide it' end, case when n > 3 then '{O.MANY_RISKS}' end], lambda x: x is not null)) as a from i)
select doc_id, sent_id, list_slice(list_filter(a, lambda x, k: list_position(a, x) = k), 1, 3) as guidance from c""")
def q_risk_guidance(spark, sf_dir):
    return O.clause_guidance(risks(spark, sf_dir), [("notice", "Mind the notice"), ("secret", "Hide it")], most=3)


_LEVELS = "case level " + " ".join(f"when '{k}' then [{', '.join(repr(x) for x in v)}]" for k, v in O.LEVEL_RULES.items()) + " else []::varchar[] end"


@query("risk_profile", f"""with {RISK_CTE}, s as (select doc_id, avg(score) as average, max(score) as largest, count(*) filter (score >= 70) as high_risk, count(*) as clauses from rs group by 1),
l as (select *, case when largest >= 90 or high_risk >= 3 then 'critical' when largest >= 70 or high_risk >= 2 then 'high' when largest >= 40 or high_risk >= 1 then 'medium' else 'low' end as level from s),
g as (select doc_id, list({{'group': "group", 'n': n}} order by "group") as groups from (select doc_id, "group", count(*) as n from ri group by all) group by 1)
select doc_id, level, round(average, 1) as average, round(largest, 1) as largest, high_risk, clauses, groups, list_concat({_LEVELS}, list_filter([case when list_contains(list_transform(groups, lambda x: x['group']), 'notice') then 'Mind the notice' end, case when high_risk > 2 then '{O.OTHER_TEMPLATE}' end], lambda x: x is not null)) as recommendations from l join g using (doc_id)""")
def q_risk_profile(spark, sf_dir):
    return O.risk_overview(q_risk_score(spark, sf_dir), risks(spark, sf_dir), [("notice", "Mind the notice")])


_yn = "case status when 'compliant' then 'Y' when 'non_compliant' then 'N' when 'not_applicable' then 'N/A' else 'Review' end"
_RULES = ["r_token", "r_mail"]


@query("topic_row", f"""with w as ({oracle("topic_letters")}), c as (with {VERDICTS} select doc_id, {", ".join(f"min({_yn}) filter (rule_id = '{r}') as {r}_status, min(rule_id || ' is broken') filter (rule_id = '{r}' and status = 'non_compliant') as {r}_details" for r in _RULES)} from v group by 1)
select * from w join c using (doc_id)""")
def q_topic_row(spark, sf_dir):
    v = verdicts(spark, sf_dir).withColumn("rationale", F.concat("rule_id", F.lit(" is broken")))
    return O.wide_row(v, TOPICS, _RULES)


@query("citation_requirements", f"""with {VERDICTS} select doc_id, rule_id, list_filter([case when status <> 'unknown' and doc_id % 3 < 1 then 'too_few_citations' end, case when status in ('compliant', 'non_compliant', 'not_applicable') and doc_id % 3 = 0 then 'no_evidence' end,
  case when length(status) < 14 then 'short_rationale' end, case when doc_id % 5 = 0 then 'no_attribution' end, case when doc_id % 10 > 8 then 'late_citation' end], lambda x: x is not null) as problems from v""")
def q_citation_requirements(spark, sf_dir):
    v = verdicts(spark, sf_dir)
    attribution = F.when(F.col("doc_id") % 5 > 0, "deterministic")
    rationale = F.concat("status", F.lit(" word"), F.lit("s"))
    return v.select("doc_id", "rule_id", O.evidence_problems(F.col("status"), F.col("doc_id") % 3, F.lit(1), rationale, attribution, F.col("doc_id") % 10, F.lit(10)).alias("problems"))


@query("node_timing", f"""with t as ({oracle("node_seconds")}), f as (select user_id as run_id, bool_or(event_type = 'purchase') as bought, bool_or(contains(event_type, 'sign')) as joined from events group by 1) select * from t join f using (run_id)""")
def q_node_timing(spark, sf_dir):
    e = events(spark, sf_dir)
    return U.node_timing(e).join(O.run_features(e, {"bought": ["purchase"]}, {"joined": "sign"}), "run_id")


_MARKED = r"""replace(replace(text, '. ', '"'), ', ', ' [[page=' || (doc_id % 7 + 2) || ']] ')"""


@query("quoted_spans", rf"""with d as (select doc_id, {_MARKED} as text from documents), q as (select doc_id, text, unnest(xs) as quote, generate_subscripts(xs, 1) - 1 as ordinal from (select *, regexp_extract_all(text, '"([^"]+)"', 1) as xs from d)),
p as (select *, instr(text, quote) - 1 as pos from q where length(quote) between 20 and 500)
select doc_id, cast(ordinal as integer) as ordinal, quote, cast(pos as integer) as pos, coalesce(cast(nullif(regexp_extract(reverse(substr(text, 1, pos + 9)), '\]\](\d+)=egap\[\[', 1), '') as integer), 1) as page from p where pos >= 0 and doc_id % 10 <> 8""")
def q_quoted_spans(spark, sf_dir):
    d = docs(spark, sf_dir).where("doc_id % 10 <> 8")
    mark = F.concat(F.lit(" [[page="), (F.col("doc_id") % 7 + 2).cast("string"), F.lit("]] "))
    marked = d.select("doc_id", F.replace(F.replace("text", F.lit(". "), F.lit('"')), F.lit(", "), mark).alias("text"))
    return P.page_of_position(C.quoted_spans(marked).drop("page"), P.extract_anchors(marked))


@query("scan_corpus", "select item_id, 'file' || item_id % 2 as kind, text || chr(10) as text from benchmark")
def q_scan_corpus(spark, sf_dir):
    path, items = S.scratch(spark, "corpus"), table(spark, sf_dir, "benchmark")
    kind = F.concat(F.lit("file"), F.col("item_id") % 2)
    items.select(kind.alias("kind"), "item_id", "text").coalesce(1).write.partitionBy("kind", "item_id").text(path)
    found = files.scan_corpus(spark, path)
    return found.select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), F.regexp_extract("path", r"kind=(\w+)", 1).alias("kind"), "text")
