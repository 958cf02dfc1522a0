"""Queries over inputs that Spark derives from the given tables: rule rows, responses, contract-like texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import entities as E
from lexmill.operators import gates as G
from lexmill.operators import pages as P
from lexmill.operators import risk as K
from lexmill.operators import rules as V
from lexmill.operators import sheets as H
from lexmill.plans.rule_queries import VERDICTS, q_deterministic_verdict, verdicts
from lexmill.plans.score_queries import FLAG_CTE, flags
from lexmill.plans.text_queries import SENT, docs, sents
from lexmill.registry import query, table
from lexmill.sources import files


@query("decode_text", "select doc_id, text from documents")
def q_decode_text(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1"))
    return docs(spark, sf_dir).select("doc_id", files.decode_text(raw).alias("text"))


RESPONSES = """rs as (select event_id, case event_id % 4 when 0 then '{"status": "compliant", "confidence": 0.9, "rationale": "fine"}' when 1 then 'not-json' when 2 then 'Here: ```json' || chr(10) || '{"status": "NON_COMPLIANT", "issues": ["a", "b"]}' || chr(10) || '```' else 'x {"status": "odd", "rationale": "r"} y' end as response from events)"""


def responses(spark, sf_dir):
    k = F.col("event_id") % 4
    text = (
        F.when(k == 0, '{"status": "compliant", "confidence": 0.9, "rationale": "fine"}').when(k == 1, "not-json")
        .when(k == 2, 'Here: ```json\n{"status": "NON_COMPLIANT", "issues": ["a", "b"]}\n```').otherwise('x {"status": "odd", "rationale": "r"} y')
    )
    return table(spark, sf_dir, "events").select("event_id", text.alias("response"))


JSON = """js as (select event_id, case when contains(response, '```') then regexp_extract(response, '\\{.*\\}', 0, 's') when contains(response, '{') then regexp_extract(response, '\\{.*\\}', 0, 's') end as json from rs)"""


@query("extract_json", f"with {RESPONSES}, {JSON} select * from js")
def q_extract_json(spark, sf_dir):
    return responses(spark, sf_dir).select("event_id", V.extract_json(F.col("response")).alias("json"))


@query("parse_verdict", f"""with {RESPONSES}, {JSON} select event_id, case when lower(json->>'status') in ('compliant', 'non_compliant', 'partially_compliant', 'not_applicable', 'requires_review') then lower(json->>'status') else 'requires_review' end as status,
  coalesce(cast(json->>'confidence' as double), 0.5) as confidence, coalesce(json->>'rationale', '') || coalesce(chr(10) || '- ' || array_to_string(cast(json->'issues' as varchar[]), chr(10) || '- '), '') as rationale from js""")
def q_parse_verdict(spark, sf_dir):
    v = responses(spark, sf_dir).select("event_id", V.parse_verdict(F.col("response")).alias("v"))
    return v.select("event_id", "v.status", "v.confidence", "v.rationale")


@query("parse_status", f"""with {RESPONSES}, {JSON}, s as (select event_id, lower(json->>'status') as s from js) select event_id, case when s in ('compliant', 'non_compliant', 'not_applicable', 'unknown') then s else 'unknown' end as status,
  case when s in ('compliant', 'non_compliant', 'not_applicable', 'unknown') then null else 'parse_error' end as error from s""")
def q_parse_status(spark, sf_dir):
    return responses(spark, sf_dir).select("event_id", V.parse_status(F.col("response")).alias("s")).select("event_id", "s.*")


@query("validate_response", f"""with {RESPONSES}, {JSON} select event_id, list_filter([case when json is null then 'no json' end, case when json is not null and json->>'status' is null then 'missing: status' end,
  case when json is not null and json->>'rationale' is null then 'missing: rationale' end, case when json->>'status' not in ('compliant', 'non_compliant', 'not_applicable', 'unknown') then 'status: not allowed' end], lambda x: x is not null) as messages from js""")
def q_validate_response(spark, sf_dir):
    return responses(spark, sf_dir).select("event_id", V.validate_response(F.col("response")).alias("messages"))


def rule_rows(spark, sf_dir):
    """Parts as rule rows: names, statuses and severities as people write them."""
    k = F.col("p_partkey")
    name = F.when(k % 9 == 0, "").otherwise(F.col("p_name"))
    severity = F.element_at(F.array(F.lit("High"), F.lit("critical "), F.lit("odd")), (k % 3 + 1).cast("int"))
    status = F.when(k % 2 == 0, "Yes").otherwise("maybe")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("p"), k).alias("id"), name.alias("title"), F.col("p_type").alias("summary"), F.when(k % 7 != 0, F.col("p_brand")).alias("text"), status.alias("status"), severity.alias("severity"), F.concat("p_type", F.lit("; "), "p_brand").alias("keywords"))


RULE_ROWS = r"""rr as (select 'p' || p_partkey as rule_id, case when p_partkey % 9 = 0 then '' else trim(p_name) end as name, trim(p_type) as description, case when p_partkey % 7 <> 0 then trim(p_brand) else '' end as rule_text,
  case when p_partkey % 2 = 0 then 'compliant' else 'unknown' end as default_status, case p_partkey % 3 when 0 then 'high' when 1 then 'critical' end as severity, [trim(p_type), trim(p_brand)] as keywords, []::varchar[] as exceptions from part)"""


@query("normalise_rules", f"with {RULE_ROWS} select * from rr")
def q_normalise_rules(spark, sf_dir):
    return V.normalise_rules(rule_rows(spark, sf_dir))


@query("validate_rules", f"with {RULE_ROWS} select rule_id, list_filter([case when name = '' then 'name is missing' end, case when rule_text = '' then 'rule_text is missing' end], lambda x: x is not null) as issues from rr")
def q_validate_rules(spark, sf_dir):
    return V.rule_issues(V.normalise_rules(rule_rows(spark, sf_dir))).select("rule_id", "issues")


CHECKED = "cr as (select case when p_partkey % 5 = 0 then 'bad' else 'PAR-' || lpad(cast(p_partkey % 1000 as varchar), 3, '0') end as rule_id, p_partkey, case p_partkey % 4 when 0 then 'high' when 1 then 'low' when 2 then 'critical' else 'none' end as priority, p_type as description, p_brand as category, p_size % 3 as n from part)"


def checked(spark, sf_dir):
    k = F.col("p_partkey")
    rule_id = F.when(k % 5 == 0, "bad").otherwise(F.concat(F.lit("PAR-"), F.lpad((k % 1000).cast("string"), 3, "0")))
    priority = F.when(k % 4 == 0, "high").when(k % 4 == 1, "low").when(k % 4 == 2, "critical").otherwise("none")
    patterns = F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (F.col("p_size") % 3).cast("int"))
    return table(spark, sf_dir, "part").select(rule_id.alias("rule_id"), k.alias("p_partkey"), priority.alias("priority"), F.col("p_type").alias("description"), F.col("p_brand").alias("category"), patterns.alias("patterns"))


@query("check_rule_schema", f"with {CHECKED} select rule_id, list_filter([case when not regexp_matches(rule_id, '^[A-Z]+-[0-9]{{3}}$') then 'rule_id: pattern' end, case when priority = 'none' then 'priority: not allowed' end, case when length(description) < 10 then 'description: too short' end], lambda x: x is not null) as issues from cr")
def q_check_rule_schema(spark, sf_dir):
    return V.check_rule_schema(checked(spark, sf_dir))


@query("rule_stats", f"with {CHECKED} select category, priority, count(*) as rules, count(*) filter (n > 0) as with_patterns from cr group by all")
def q_rule_stats(spark, sf_dir):
    return V.rule_stats(checked(spark, sf_dir))


@query("rules_for_type", f"with {CHECKED} select rule_id, p_partkey, category, list_position(['critical', 'high', 'medium', 'low'], priority) as ordinal from cr where category in ('Brand#1', 'Brand#11', 'Brand#12') and priority <> 'none'")
def q_rules_for_type(spark, sf_dir):
    kinds = spark.createDataFrame([("nda", "Brand#1"), ("nda", "Brand#11"), ("nda", "Brand#12"), ("msa", "Brand#2")], "doc_type string, category string")
    return V.rules_for_type(checked(spark, sf_dir).where("priority <> 'none'"), kinds, "nda").select("rule_id", "p_partkey", "category", "ordinal")


@query("rule_keywords", r"""with w as (select p_partkey, p_name, list_filter(string_split_regex(lower(p_name || ' ' || p_type), '[^a-z]+'), lambda x: length(x) > 4) as w from part)
select p_partkey, case when regexp_matches(lower(p_name), 'metal') then ['metal', 'steel'] else list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 8) end as keywords from w""")
def q_rule_keywords(spark, sf_dir):
    found = V.rule_keywords(F.col("p_name"), F.concat("p_name", F.lit(" "), "p_type"), [("metal", ["metal", "steel"])])
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("keywords"))


@query("resolve_citations", "select user_id as rule_id, event_id as doc_id, cast(r as integer) as rank, event_type || r as chunk from (select *, unnest([1, 3]) as r from events)")
def q_resolve_citations(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("rule_id"), F.col("event_id").alias("doc_id"), "event_type")
    indices = e.select("rule_id", "doc_id", F.array(F.lit(1), F.lit(3), F.lit(9)).alias("citations"))
    chunks = e.select("rule_id", "doc_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rank"), "event_type")
    return V.resolve_citations(indices, chunks.select("rule_id", "doc_id", "rank", F.concat("event_type", "rank").alias("chunk")))


@query("audit_trail", f"""with {VERDICTS} select doc_id, rule_id, status, confidence, case when conclusive then 'deterministic' else 'model' end as method, case when doc_id % 4 = 0 then 1 else 0 end as errors, case when doc_id % 4 = 1 then 1 else 0 end as warnings from det""")
def q_audit_trail(spark, sf_dir):
    v = q_deterministic_verdict(spark, sf_dir)
    level = F.when(F.col("doc_id") % 4 == 0, "error").when(F.col("doc_id") % 4 == 1, "warning")
    return V.audit_trail(v, v.select("doc_id", "rule_id", level.alias("level")).where("level is not null"))


@query("affirmed_pairs", f"with {VERDICTS} select a.doc_id, a.rule_id as a, b.rule_id as b from v a join v b using (doc_id) where a.rule_id = 'r_with' and b.rule_id = 'r_de' and a.status = 'compliant' and b.status = 'compliant'")
def q_affirmed_pairs(spark, sf_dir):
    answers = verdicts(spark, sf_dir).select("doc_id", F.col("rule_id").alias("question_id"), F.when(F.col("status") == "compliant", "Yes").otherwise("No").alias("answer"))
    return G.contradictions(answers, [("r_with", "r_de")])


@query("review_checklist", "select doc_id, unnest(list_filter([case when doc_id % 3 = 1 then {'priority': 'high', 'item': 'Check failed answers'} end, case when doc_id % 2 = 1 then {'priority': 'medium', 'item': 'Check answers of low confidence'} end], lambda x: x is not null), recursive := true) from documents")
def q_review_checklist(spark, sf_dir):
    return H.review_checklist(docs(spark, sf_dir).select("doc_id", F.lit(1).alias("answers"), (F.col("doc_id") % 3 == 1).cast("int").alias("failed"), (F.col("doc_id") % 2).alias("low")))


@query("negotiation_points", f"with {FLAG_CTE} select doc_id, case when bool_or(severity = 'critical') then ['1. CRITICAL: Address unlimited liability and IP overreach'] else []::varchar[] end as points from fl group by doc_id")
def q_negotiation_points(spark, sf_dir):
    return K.negotiation_points(flags(spark, sf_dir))


@query("anchored_text", """with c as (select doc_id, string_split(text, chr(10)) as xs from documents), l as (select doc_id, unnest(xs) as line, unnest(range(len(xs))) as i, len(xs) as n from c),
b as (select doc_id, i // 5 as b, any_value(n) as n, string_agg(line, chr(10) order by i) as body from l group by all)
select doc_id, cast(b + 1 as integer) as ordinal, chr(10) || body || chr(10) as text, cast(b + 2 as integer) as page from b where (b + 1) * 5 < n""")
def q_anchored_text(spark, sf_dir):
    return P.anchored_text(P.anchor_lines(docs(spark, sf_dir), 5))


@query("annotate_sentences", f"with {SENT} select doc_id, sent_id, text || ' [[page=' || (sent_id // 10 + 1) || ']]' as text, cast(sent_id // 10 + 1 as integer) as page from sent")
def q_annotate_sentences(spark, sf_dir):
    return P.annotate_sentences(sents(spark, sf_dir).withColumn("page", (F.floor(F.col("sent_id") / 10) + 1).cast("int")))


CONTRACT = "ct as (select o_orderkey as doc_id, 'This Agreement is entered into on ' || strftime(o_orderdate, '%Y-%m-%d') || ', between Part' || o_custkey || ' Systems (\"A\") and Buyer' || o_custkey || ' Group, for work. The fee is due.' as text from orders)"


def contracts(spark, sf_dir):
    """A one-line contract per order."""
    c = F.col("o_custkey").cast("string")
    text = F.concat(F.lit("This Agreement is entered into on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(", between Part"), c, F.lit(' Systems ("A") and Buyer'), c, F.lit(" Group, for work. The fee is due."))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


@query("extract_dates", f"with {CONTRACT} select doc_id, cast(instr(text, strftime(o_orderdate, '%Y-%m-%d')) - 1 as integer) as pos, strftime(o_orderdate, '%Y-%m-%d') as raw, strftime(o_orderdate, '%Y-%m-%d') as date, 100 as confidence_pct from ct join orders on o_orderkey = doc_id")
def q_extract_dates(spark, sf_dir):
    return E.extract_dates(contracts(spark, sf_dir)).select("doc_id", "pos", "raw", "date", "confidence_pct")


@query("start_date", "select o_orderkey as doc_id, strftime(o_orderdate, '%Y-%m-%d') as date, cast(100 as integer) as confidence_pct from orders")
def q_start_date(spark, sf_dir):
    d = contracts(spark, sf_dir)
    return E.start_date(d, E.extract_dates(d))


@query("extract_companies", "select o_orderkey as doc_id, 'Buyer' || o_custkey || ' Group' as name from orders union all select o_orderkey, 'Part' || o_custkey || ' Systems' from orders")
def q_extract_companies(spark, sf_dir):
    return E.dedupe_companies(E.extract_companies(contracts(spark, sf_dir))).select("doc_id", "name")


@query("contract_parties", "select o_orderkey as doc_id, 'Part' || o_custkey || ' Systems' as first, 'Buyer' || o_custkey || ' Group' as second, 85 as confidence_pct from orders")
def q_contract_parties(spark, sf_dir):
    return E.contract_parties(contracts(spark, sf_dir))


@query("company_columns", "select o_orderkey as doc_id, 'Part' || o_custkey || ' Systems' as company_1, 'Buyer' || o_custkey || ' Group' as company_2 from orders")
def q_company_columns(spark, sf_dir):
    d = contracts(spark, sf_dir)
    return E.company_columns(d, E.contract_parties(d), E.extract_companies(d))


@query("deterministic_answers", "select o_orderkey as doc_id, 'start_date' as question_id, strftime(o_orderdate, '%Y-%m-%d') as answer, true as filled from orders union all select o_orderkey, 'company_1', 'Part' || o_custkey || ' Systems', true from orders union all select o_orderkey, 'fee', 'open', false from orders")
def q_deterministic_answers(spark, sf_dir):
    d = contracts(spark, sf_dir)
    cells = F.array(*[F.struct(F.lit(q).alias("question_id"), F.lit(a).cast("string").alias("answer")) for q, a in (("start_date", None), ("company_1", None), ("fee", "open"))])
    answers = d.select("doc_id", F.explode(cells).alias("x")).select("doc_id", "x.*")
    return E.deterministic_answers(answers, E.start_date(d, E.extract_dates(d)), E.company_columns(d, E.contract_parties(d), E.extract_companies(d)))
