"""Queries over rules and verdicts, on the corpus pack."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import retrieval as R
from lexmill.operators import rules as V
from lexmill.plans.retrieval_queries import RULES, SECTIONS
from lexmill.plans.text_queries import SENT, docs, sents
from lexmill.registry import query, table

CHECKS = [
    V.Checks("r_license", ["license", "licensed"], [], ["licensed? under"], [("license", "version", 12)], ["license"], "critical"),
    V.Checks("r_rights", ["rights", "reserved"], [], ["all rights"], [("rights", "reserved", 5)], [], "high"),
    V.Checks("r_token", ["of"], ["token", "api_key"], ["[0-9a-f]{20,}"], [], [], "critical"),
    V.Checks("r_mail", [], ["example.com"], [], [], ["mail"], "medium"),
    V.Checks("r_with", ["with", "from"], [], [r"\bwith\b"], [("with", "from", 10)], ["with"], "low"),
    V.Checks("r_de", ["und"], [], [], [("und", "der", 6)], [], "medium"),
]
IDS = [c.rule_id for c in CHECKS]
SEVERITY = {c.rule_id: c.severity for c in CHECKS}


def _likes(words: list[str]) -> str:
    return "|".join(w.replace(".", "[.]") for w in words)


def _count(word: str) -> str:
    return f"cast((length(low) - length(replace(low, '{word}', ''))) / {len(word)} as integer)"


def _hit_rows() -> str:
    rows = []
    for c in CHECKS:
        n = " + ".join(map(_count, c.required)) or "0"
        found = " + ".join(f"case when contains(low, '{w}') then 1 else 0 end" for w in c.required) or "0"
        bad = " + ".join(f"case when contains(low, '{w}') then 1 else 0 end" for w in c.forbidden) or "0"
        rows.append(f"select doc_id, '{c.rule_id}' as rule_id, {n} as required_hits, {found} as required_found, {bad} as forbidden_hits, {len(c.required)} as asked from low")
    return " union all ".join(rows)


NEAR = [(c.rule_id, a, b, d) for c in CHECKS for a, b, d in c.near]


def _pos(word: str) -> str:
    return f"""select doc_id, '{word}' as term, pos from (select doc_id, unnest(list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * {len(word)})) as pos
      from (select doc_id, string_split(low, '{word}') as p from low))"""


_WORDS = sorted({w for _, a, b, _ in NEAR for w in (a, b)})
HITS = f"""low as (select doc_id, lower(text) as low, text from documents), khits as ({_hit_rows()}),
rhits as ({" union all ".join(f"select doc_id, '{c.rule_id}' as rule_id, '{p}' as pattern, len(regexp_extract_all(text, '(?i){p}')) as hits from low" for c in CHECKS for p in c.patterns)}),
pos as ({" union all ".join(map(_pos, _WORDS))}),
nhits as (select p.doc_id, n.rule_id, count(*) as hits from (values {", ".join(str(x) for x in NEAR)}) n(rule_id, a, b, d) join pos p on p.term = n.a join pos q on q.term = n.b and q.doc_id = p.doc_id
  where cast(abs(p.pos - q.pos) as bigint) // 5 <= n.d group by all),
hints as (select distinct doc_id, rule_id from ({" union all ".join(f"select doc_id, '{c.rule_id}' as rule_id from sent where sent_id < 50 and length(text) < 100 and regexp_matches(lower(text), '{_likes(c.hints)}')" for c in CHECKS if c.hints)}))"""
VERDICTS = f"""{SENT}, {HITS},
f as (select k.doc_id, k.rule_id, forbidden_hits > 0 as banned, list_filter([case when asked > 0 then required_found / asked end, case when forbidden_hits > 0 then 0.0 end,
    case when exists (select 1 from rhits r where r.doc_id = k.doc_id and r.rule_id = k.rule_id and r.hits > 0) then 0.9 end,
    case when n.hits > 0 then 0.8 end, case when h.rule_id is not null then 0.5 end], lambda x: x is not null) as fs
  from khits k left join nhits n using (doc_id, rule_id) left join hints h using (doc_id, rule_id)),
m as (select *, coalesce(list_sum(fs) / nullif(len(fs), 0), 0.0)::double as mean, len(list_filter(fs, lambda x: x > 0)) as positive from f),
det as (select doc_id, rule_id, case when banned then 'non_compliant' when mean >= 0.7 and positive >= 2 then 'compliant' when mean >= 0.7 then 'non_compliant' else 'unknown' end as status,
  case when banned then 0.9 else mean end::double as confidence, banned or mean >= 0.7 as conclusive from m),
sev(rule_id, severity) as (values {", ".join(str(x) for x in SEVERITY.items())}),
v as (select doc_id, rule_id, case status when 'unknown' then 'requires_review' else status end as status, confidence, severity from det join sev using (rule_id))"""


def verdicts(spark, sf_dir):
    """Deterministic verdicts; what they leave open requires review."""
    d = docs(spark, sf_dir)
    rows = V.deterministic_verdicts(d, sents(spark, sf_dir), CHECKS)
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col("rule_id")]
    return rows.select("doc_id", "rule_id", F.when(F.col("status") == "unknown", "requires_review").otherwise(F.col("status")).alias("status"), "confidence", severity.alias("severity"))


@query("slug", r"select p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9\s_-]', '', 'g'), '[\s_-]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from part")
def q_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", V.slug(F.col("p_name")).alias("slug"))


@query("derive_keywords", r"""select item_id, list_slice(k, 1, 6) as keywords from (select item_id, list_filter(w, lambda x, i: list_position(w, x) = i) as k from (
  select item_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 3) as w from benchmark))""")
def q_derive_keywords(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", V.derive_keywords(F.col("text")).alias("keywords"))


@query("coerce_status", """select event_id, case event_type when 'yes' then 'compliant' when 'fail' then 'non_compliant' else 'unknown' end as status from (
  select event_id, case event_id % 3 when 0 then 'yes' when 1 then 'fail' else event_type end as event_type from events)""")
def q_coerce_status(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, " Yes").when(F.col("event_id") % 3 == 1, "FAIL ").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", V.coerce_status(raw).alias("status"))


@query("coerce_severity", "select event_id, case event_id % 4 when 0 then 'critical' when 1 then 'low' when 2 then 'high' end as severity from events")
def q_coerce_severity(spark, sf_dir):
    raw = F.element_at(F.array(F.lit("Critical"), F.lit("low "), F.lit("HIGH"), F.lit("urgent")), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", V.coerce_severity(raw).alias("severity"))


@query("dedupe_rules", "select rule_id, rule_text, file_order from (select p_brand as rule_id, p_type as rule_text, p_partkey as file_order, row_number() over (partition by p_brand, p_type order by p_partkey) as r from part) where r = 1")
def q_dedupe_rules(spark, sf_dir):
    return V.dedupe_rules(table(spark, sf_dir, "part").select(F.col("p_brand").alias("rule_id"), F.col("p_type").alias("rule_text"), F.col("p_partkey").alias("file_order")), "file_order")


@query("keyword_counts", f"with {SENT}, {HITS} select doc_id, rule_id, required_hits, required_found, forbidden_hits from khits")
def q_keyword_counts(spark, sf_dir):
    return V.keyword_hits(docs(spark, sf_dir), CHECKS)


@query("regex_counts", f"with {SENT}, {HITS} select * from rhits where hits > 0")
def q_regex_counts(spark, sf_dir):
    return V.regex_hits(docs(spark, sf_dir), CHECKS)


CONTEXT = "substr(text, greatest(pos - 50, 0) + 1, \"end\" + 50 - greatest(pos - 50, 0)) as context"


def _word_rows(kind: str, c: V.Checks, w: str) -> str:
    picked = "[1:1]" if kind == "forbidden" else ""
    score = "-1.0" if kind == "forbidden" else "1.0"
    return f"select doc_id, text, '{c.rule_id}' as rule_id, '{kind}' as kind, '{w}' as pattern, unnest(list_filter(range(0, length(low)), lambda i: substr(low, i + 1, {len(w)}) = '{w}'){picked}) as pos, {len(w)} as n, {score}::double as confidence from low where contains(low, '{w}')"


_word_sql = " union all ".join(_word_rows(kind, c, w) for c in CHECKS for kind, ws in (("keyword", c.required), ("forbidden", c.forbidden)) for w in ws)


@query("keyword_hits", f"""with low as (select doc_id, lower(text) as low, text from documents), k as ({_word_sql}), p as (select *, pos + n as "end" from k)
select doc_id, rule_id, kind, pattern, cast(pos as integer) as pos, cast("end" as integer) as "end", {CONTEXT}, confidence from p""")
def q_keyword_hits(spark, sf_dir):
    return V.keyword_matches(docs(spark, sf_dir), CHECKS)


def _regex_rows(c: V.Checks, p: str) -> str:
    return f"""select doc_id, text, '{c.rule_id}' as rule_id, '{p}' as pattern, unnest(list_transform(range(1, len(found) + 1), lambda i: cast(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) as bigint))) as pos, unnest(list_transform(found, lambda x: length(x))) as n
  from (select doc_id, text, regexp_extract_all(text, '(?i){p}') as found, string_split_regex(text, '(?i){p}') as pieces from documents) where len(found) > 0"""


_regex_sql = " union all ".join(_regex_rows(c, p) for c in CHECKS for p in c.patterns)


@query("regex_hits", f"""with k as ({_regex_sql}), p as (select *, pos + n as "end" from k)
select doc_id, rule_id, 'regex' as kind, pattern, cast(pos as integer) as pos, cast("end" as integer) as "end", {CONTEXT}, 0.9::double as confidence from p""")
def q_regex_hits(spark, sf_dir):
    return V.regex_matches(docs(spark, sf_dir), CHECKS)


@query("proximity_hits", f"with {SENT}, {HITS} select * from nhits")
def q_proximity_hits(spark, sf_dir):
    return V.proximity_hits(docs(spark, sf_dir), CHECKS)


@query("section_hints", f"with {SENT}, {HITS} select * from hints")
def q_section_hints(spark, sf_dir):
    return V.section_hints(sents(spark, sf_dir), CHECKS)


@query("deterministic_verdict", f"with {VERDICTS} select * from det")
def q_deterministic_verdict(spark, sf_dir):
    return V.deterministic_verdicts(docs(spark, sf_dir), sents(spark, sf_dir), CHECKS)


@query("conclusive_rate", f"with {VERDICTS} select rule_id, avg(conclusive::int) as rate from det group by rule_id")
def q_conclusive_rate(spark, sf_dir):
    return q_deterministic_verdict(spark, sf_dir).groupBy("rule_id").agg(F.avg(F.col("conclusive").cast("int")).alias("rate"))


INTENTS = [("r_token", "Texts must not hold a token", ["token"]), ("r_license", "Texts shall name a license", ["license"])]


@query("intent_status", """select doc_id, 'r_token' as rule_id, case when contains(lower(text), 'token') then 'non_compliant' else 'compliant' end as status from documents
union all select doc_id, 'r_license', case when contains(lower(text), 'license') then 'compliant' else 'non_compliant' end from documents""")
def q_intent_status(spark, sf_dir):
    return V.intent_verdicts(docs(spark, sf_dir), INTENTS)


INTENT_RULES = [("r_token", "Texts must not hold a token", ["token", "api_key"]), ("r_license", "Texts shall name a license", ["License", "(c)"]), ("r_open", "Texts may name anyone", ["the"])]


def _intent_rows(rule: tuple[str, str, list[str]], forbids: bool) -> str:
    hit = " or ".join(f"contains(lower(text), '{w.lower()}')" for w in rule[2])
    return f"select doc_id, '{rule[0]}' as rule_id, {forbids} as forbids, sent_id, trim(text, ' ') as text, row_number() over (partition by doc_id order by sent_id) as k from sent where {hit}"


@query("intent_verdict", f"""with {SENT}, h as ({_intent_rows(INTENT_RULES[0], True)} union all {_intent_rows(INTENT_RULES[1], False)})
select doc_id, rule_id, case when forbids then 'non_compliant' else 'compliant' end as status,
  case when forbids then 'The document holds what the rule forbids' else 'The document holds what the rule asks for' end as rationale,
  list({{'sent_id': sent_id, 'text': text, 'anchor': nullif(regexp_extract(text, '\\[\\[page=\\d+\\]\\]'), '')}} order by sent_id) filter (k <= 5) as citations,
  case when forbids then list(text order by sent_id) filter (k <= 3) else []::varchar[] end as violating_spans from h group by doc_id, rule_id, forbids""")
def q_intent_verdict(spark, sf_dir):
    return V.intent_evidence(sents(spark, sf_dir), INTENT_RULES)


@query("not_addressed", f"""with {SECTIONS} select d.doc_id, r.rule_id, 'not_applicable' as status, 0.9::double as confidence from documents d, rules r
where not exists (select 1 from sections s where s.doc_id = d.doc_id and s.rule_id = r.rule_id)""")
def q_not_addressed(spark, sf_dir):
    sections = R.keyword_sections(sents(spark, sf_dir), [(r[0], r[3]) for r in RULES])
    ids = spark.createDataFrame([(r[0],) for r in RULES], "rule_id string")
    return V.not_addressed(docs(spark, sf_dir), ids, sections)


COUNTS = ", ".join(f"count(*) filter (status = '{s}') as {s}" for s in ("compliant", "partially_compliant", "non_compliant", "not_applicable", "requires_review"))


@query("status_counts", f"with {VERDICTS} select doc_id, {COUNTS} from v group by doc_id")
def q_status_counts(spark, sf_dir):
    return V.status_counts(verdicts(spark, sf_dir))


@query("violations", f"with {VERDICTS} select * from v where status = 'non_compliant'")
def q_violations(spark, sf_dir):
    return verdicts(spark, sf_dir).where("status = 'non_compliant'")


SUMMARY = f"""{VERDICTS}, w as (select *, case status when 'compliant' then 1.0 when 'partially_compliant' then 0.5 when 'non_compliant' then 0.0 when 'requires_review' then 0.25 end::double as w from v),
summary as (select doc_id, count(*) as total, count(*) filter (status = 'compliant') as compliant, count(*) filter (status = 'non_compliant') as non_compliant, count(*) filter (status = 'not_applicable') as not_applicable,
  coalesce(sum(w * confidence) / nullif(count(w), 0), 0.0) as score, count(*) filter (status in ('non_compliant', 'partially_compliant') and severity = 'critical') as critical_issues,
  count(*) filter (status in ('non_compliant', 'partially_compliant') and severity = 'high') as high_issues from w group by doc_id)"""
BAND = "case when score * 100 < 60 then 'critical' when score * 100 < 80 then 'needs_improvement' when score * 100 < 95 then 'good' else 'excellent' end"


@query("compliance_summary", f"with {SUMMARY} select * from summary")
def q_compliance_summary(spark, sf_dir):
    return V.compliance_summary(verdicts(spark, sf_dir))


@query("score_band", f"with {SUMMARY} select {BAND} as band, count(*) as documents from summary group by 1")
def q_score_band(spark, sf_dir):
    return q_compliance_summary(spark, sf_dir).groupBy(V.score_band(F.col("score") * 100).alias("band")).agg(F.count("*").alias("documents"))


@query("compliance_documents", f"with {SUMMARY} select *, {BAND} as band from summary")
def q_compliance_documents(spark, sf_dir):
    return V.compliance_documents(verdicts(spark, sf_dir))


@query("compliance_rate", f"""with {VERDICTS} select rule_id, count(*) as documents, count(*) filter (status = 'compliant') / count(*) as rate,
  count(*) filter (status = 'non_compliant' and severity in ('critical', 'high')) as severe, avg(confidence) filter (confidence > 0) as mean_confidence from v group by rule_id""")
def q_compliance_rate(spark, sf_dir):
    return V.compliance_rate(verdicts(spark, sf_dir))


GRID_IDS = [*IDS, "r_extra"]


@query("all_rules_status", f"with {VERDICTS} select d.doc_id, g.rule_id, coalesce(v.status, 'not_evaluated') as status from documents d, (select unnest({GRID_IDS}) as rule_id) g left join v on v.doc_id = d.doc_id and v.rule_id = g.rule_id")
def q_all_rules_status(spark, sf_dir):
    return V.all_rules_status(docs(spark, sf_dir), GRID_IDS, verdicts(spark, sf_dir))


ACTION = """case when status = 'non_compliant' and severity in ('critical', 'high') then 'Immediate action required' when status = 'non_compliant' then 'Address before signing'
  when status = 'partially_compliant' and severity in ('critical', 'high') then 'Review and strengthen' when status = 'partially_compliant' then 'Consider improvement'
  when status = 'requires_review' then 'Manual review needed' else 'No action' end"""


@query("required_action", f"with {VERDICTS} select doc_id, rule_id, {ACTION} as action from v")
def q_required_action(spark, sf_dir):
    return verdicts(spark, sf_dir).select("doc_id", "rule_id", V.required_action(F.col("status"), F.col("severity")).alias("action"))


@query("findings", f"""with {VERDICTS} select doc_id, rule_id, status, severity, cast(row_number() over (partition by doc_id order by list_position(['critical', 'high', 'medium', 'low'], severity), rule_id) as integer) as rank, {ACTION} as action
from v where status in ('non_compliant', 'partially_compliant', 'requires_review')""")
def q_findings(spark, sf_dir):
    return V.findings(verdicts(spark, sf_dir))


@query("critical_issues", f"with {VERDICTS} select doc_id, rule_id, status, severity, {ACTION} as action from v where severity in ('critical', 'high') and status in ('non_compliant', 'partially_compliant')")
def q_critical_issues(spark, sf_dir):
    rows = verdicts(spark, sf_dir).where(F.col("severity").isin("critical", "high") & F.col("status").isin("non_compliant", "partially_compliant"))
    return rows.select("doc_id", "rule_id", "status", "severity", V.required_action(F.col("status"), F.col("severity")).alias("action"))


_CELLS = ", ".join(f"max(case when rule_id = '{r}' then case status when 'compliant' then 'Y' when 'non_compliant' then 'N' when 'not_applicable' then '-' else '?' end end) as {r}" for r in IDS)


@query("compliance_matrix", f"with {VERDICTS} select doc_id, {_CELLS} from v group by doc_id")
def q_compliance_matrix(spark, sf_dir):
    return V.compliance_matrix(verdicts(spark, sf_dir), IDS)


@query("report_recommendation", f"with {SUMMARY} select doc_id, case when critical_issues > 0 then 'Do not sign: critical issues' when high_issues > 0 then 'Resolve high-risk issues first' when non_compliant > 0 then 'Review open issues' else 'No issues found' end as recommendation from summary")
def q_report_recommendation(spark, sf_dir):
    return V.report_recommendation(q_compliance_summary(spark, sf_dir))


@query("evidence_pack", f"with {SECTIONS} select doc_id, rule_id, count(*) as citations, list_sort(list(distinct cast(sent_id // 10 + 1 as integer))) as pages from sections where rank <= 10 group by all")
def q_evidence_pack(spark, sf_dir):
    sections = R.keyword_sections(sents(spark, sf_dir), [(r[0], r[3]) for r in RULES])
    return V.evidence_pack(sections.select("doc_id", "rule_id", (F.floor(F.col("sent_id") / 10) + 1).cast("int").alias("page")))


@query("friendly_name", """with n as (select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') as name from part),
k as (select *, row_number() over (partition by name order by r) as k from (select distinct on (p_name) lpad(p_partkey::varchar, 9, '0') as r, array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') as name from part order by p_name, p_partkey))
select lower(replace(name, ' ', '_')) as rule_id, name from (select distinct name from k)""")
def q_friendly_name(spark, sf_dir):
    kinds = table(spark, sf_dir, "part").select(F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("rule_id")).distinct()
    return V.unique_names(kinds)
