"""Queries over citations, on the corpus pack: benchmark passages are quotes, conversations are answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import citations as C
from lexmill.operators import retrieval as R
from lexmill.plans.retrieval_queries import PAIRS, RULES, SECTIONS, qa
from lexmill.plans.rule_queries import VERDICTS, verdicts
from lexmill.plans.text_queries import SENT, docs, sents
from lexmill.registry import query, table


@query("quote_pages", r"""with d as (select doc_id, replace(text, '. ', '." "') as text from documents), q as (select doc_id, text, unnest(xs) as quote, generate_subscripts(xs, 1) - 1 as ordinal from (select *, regexp_extract_all(text, '"([^"]+)"', 1) as xs from d))
select doc_id, cast(ordinal as integer) as ordinal, quote, cast(instr(text, quote) - 1 as integer) as pos, cast((instr(text, quote) - 1) // 3000 + 1 as integer) as page from q where length(quote) between 20 and 500""")
def q_quote_pages(spark, sf_dir):
    return C.quoted_spans(docs(spark, sf_dir).select("doc_id", F.replace("text", F.lit(". "), F.lit('." "')).alias("text")))


@query("first_quote", "select doc_id, item_id, cast(coalesce(nullif(instr(d.text, b.text), 0), nullif(instr(lower(d.text), lower(b.text)), 0)) - 1 as integer) as pos from documents d, benchmark b where contains(lower(d.text), lower(b.text))")
def q_first_quote(spark, sf_dir):
    return C.locate_quotes(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


#: Texts said twice, so that a hint at the second half decides between two occurrences.
@query("locate_quote", """with d as (select doc_id, text || chr(10) || text as text from documents), h as (select d.doc_id, b.item_id, d.text, b.text as q, length(d.text) * 3 // 4 as hint from d, benchmark b where contains(lower(d.text), lower(b.text))),
n as (select *, greatest(hint - 1000, 0) as s from h), i as (select *, instr(substr(text, s + 1, hint + 1000 - s), q) as k, instr(text, q) as e from n)
select doc_id, item_id, cast(p as integer) as pos, cast(p + length(q) as integer) as "end", how from (select *, case when k > 0 then s + k - 1 when e > 0 then e - 1 else instr(lower(text), lower(q)) - 1 end as p, case when k > 0 then 'near' when e > 0 then 'exact' else 'folded' end as how from i)""")
def q_locate_quote(spark, sf_dir):
    twice = docs(spark, sf_dir).select("doc_id", F.concat("text", F.lit("\n"), "text").alias("text"))
    items = table(spark, sf_dir, "benchmark")
    hints = C.locate_quotes(twice, items).join(twice.select("doc_id", F.floor(F.length("text") * 3 / 4).alias("hint")), "doc_id")
    return C.locate_near(twice, items, hints)


@query("fuzzy_quote", r"""with q as (select *, len(w) as m, greatest(1, len(w) // cast(2 * ceil(0.2::double * len(w) - 1e-9) + 1 as bigint)) as n from (select item_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') as w from benchmark) where len(w) > 0),
qr as (select item_id, n, i - 1 as at, array_to_string(w[i:i + n - 1], ' ') as run from (select *, unnest(range(1, m - n + 2)) as i from q) where (i - 1) % n = 0),
d as (select doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') as w from documents),
dr as (select doc_id, n, i - 1 as at, array_to_string(w[i:i + n - 1], ' ') as run from (select d.*, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from q))),
p as (select distinct doc_id, item_id, dr.at - qr.at as start from dr join qr using (n, run) where dr.at >= qr.at),
s as (select doc_id, item_id, array_to_string(d.w[start + 1:start + q.m], ' ') as a, array_to_string(q.w, ' ') as b from p join d using (doc_id) join q using (item_id))
select doc_id, item_id, max(1 - levenshtein(a, b) / greatest(length(a), length(b))) as similarity from s where least(length(a), length(b)) >= 0.8::double * greatest(length(a), length(b)) - 1e-9 group by all having max(1 - levenshtein(a, b) / greatest(length(a), length(b))) >= 0.8""")
def q_fuzzy_quote(spark, sf_dir):
    return C.fuzzy_quotes(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("validate_citation", """with h as (select doc_id, item_id, coalesce(nullif(instr(d.text, b.text), 0), nullif(instr(lower(d.text), lower(b.text)), 0)) - 1 as pos from documents d, benchmark b where contains(lower(d.text), lower(b.text)))
select b.item_id, list_filter([case when h.doc_id is null then 'not_found' end, case when pos // 3000 + 1 <> 1 then 'page_mismatch' end, case when b.item_id % 3 = 0 then 'bad_marker' end], lambda x: x is not null) as problems from benchmark b left join (select item_id, min(doc_id) as doc_id, arg_min(pos, (doc_id, pos)) as pos from h group by 1) h using (item_id)""")
def q_validate_citation(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    hits = C.locate_quotes(docs(spark, sf_dir), items).groupBy("item_id").agg(F.min(F.struct("doc_id", "pos")).alias("h"))
    rows = items.select("item_id").join(hits, "item_id", "left")
    marker = F.when(F.col("item_id") % 3 == 0, "[page 1]").otherwise("[[page=1]]")
    page = (F.floor(F.col("h.pos") / 3000) + 1).cast("int")
    return rows.select("item_id", C.citation_problems(F.col("h").isNotNull(), page, F.lit(1), marker).alias("problems"))


@query("citations_by_page", f"with {SECTIONS} select doc_id, cast(sent_id // 10 + 1 as integer) as page, list_sort(list(rule_id || ':' || sent_id)) as citations from sections where rank <= 10 group by all")
def q_citations_by_page(spark, sf_dir):
    return C.citations_by_page(_cites(spark, sf_dir).select("doc_id", "page", F.concat("rule_id", F.lit(":"), "sent_id").alias("citation_id")))


def _cites(spark, sf_dir):
    s = R.keyword_sections(sents(spark, sf_dir), [(r[0], r[3]) for r in RULES])
    return s.select("doc_id", "rule_id", "sent_id", (F.floor(F.col("sent_id") / 10) + 1).cast("int").alias("page"))


PHRASES = r"""ph as (select conv_id, turn, question, list_slice(list_filter(u, lambda x, i: list_position(u, x) = i), 1, 5) as phrases from (select *, flatten(list_transform(list_filter(list_transform(string_split_regex(answer, '[.!?]+'),
  lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) >= 10), lambda s: case when len(string_split_regex(s, '\s+')) >= 6 then [array_to_string(string_split_regex(s, '\s+')[1:4], ' '), array_to_string(string_split_regex(s, '\s+')[-4:], ' ')]
  when len(string_split_regex(s, '\s+')) >= 3 then [s] else [] end)) as u from qa))"""


@query("key_phrases", f"with {PAIRS}, {PHRASES} select conv_id, turn, phrases from ph")
def q_key_phrases(spark, sf_dir):
    return qa(spark, sf_dir).select("conv_id", "turn", C.key_phrases(F.col("answer")).alias("phrases"))


NORM = r"lower(regexp_replace(regexp_replace(regexp_replace({}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s.,;:!?]', '', 'g'))"


@query("phrase_match", rf"""with {PAIRS}, {PHRASES}, x as (select conv_id, turn, unnest(phrases) as phrase, question as text from ph), w as (select *, {NORM.format('phrase')} as p, {NORM.format('text')} as t from x),
s as (select *, string_split(p, ' ') as pw, string_split(t, ' ') as tw from w)
select conv_id, turn, phrase, case when contains(t, p) then 1.0 when len(pw) < 3 then 0.0 else coalesce(list_max(list_transform(range(1, len(tw) - len(pw) + 2), lambda i: len(list_filter(range(1, len(pw) + 1), lambda j: pw[j] = tw[i + j - 1])) / len(pw))), 0.0) end::double as score from s""")
def q_phrase_match(spark, sf_dir):
    rows = qa(spark, sf_dir).select("conv_id", "turn", "question", F.explode(C.key_phrases(F.col("answer"))).alias("phrase"))
    return rows.select("conv_id", "turn", "phrase", C.phrase_match(F.col("phrase"), F.col("question")).alias("score"))


_OWN_PHRASES = PHRASES.replace("from qa))", "from qb))")
_SCORE = "case when contains(t, p) then 1.0 when len(pw) < 3 then 0.0 else coalesce(list_max(list_transform(range(1, len(tw) - len(pw) + 2), lambda i: len(list_filter(range(1, len(pw) + 1), lambda j: pw[j] = tw[i + j - 1])) / len(pw))), 0.0) end"


@query("answer_citations", rf"""with {PAIRS}, qb as (select conv_id, turn, question, answer || ' ' || question as answer from qa), {_OWN_PHRASES},
src as (select conv_id, turn, unnest(xs) as sentence, cast(generate_subscripts(xs, 1) - 1 as integer) as sent_id from (select conv_id, turn, string_split(regexp_replace(question, '([.])\s+', '\1' || chr(1), 'g'), chr(1)) as xs from qa)),
x as (select conv_id, turn, sent_id, phrase, sentence as text from (select conv_id, turn, unnest(phrases) as phrase from ph) join src using (conv_id, turn)),
w as (select *, {NORM.format('phrase')} as p, {NORM.format('text')} as t from x), s as (select *, string_split(p, ' ') as pw, string_split(t, ' ') as tw from w),
b as (select conv_id, turn, sent_id, max({_SCORE}) as confidence from s group by all having max({_SCORE}) >= 0.6),
m as (select *, row_number() over (partition by conv_id, turn order by sent_id % 2, confidence desc, sent_id) as rank from b),
open_ as (select conv_id, turn from qb where regexp_replace(coalesce(answer, ''), '\s', '', 'g') <> '' and not exists (select 1 from b where b.conv_id = qb.conv_id and b.turn = qb.turn))
select conv_id || ':' || turn as answer_id, sent_id, case when confidence >= 0.95 then 'quote' when confidence >= 0.8 then 'paraphrase' else 'inference' end as type, confidence::double as confidence, cast(rank as integer) as rank from m
union all select conv_id || ':' || turn, arg_min(sent_id, (sent_id % 2, sent_id)), 'inference', 0.3, 1 from open_ join src using (conv_id, turn) group by conv_id, turn
union all select conv_id || ':' || turn, null, 'not_found', 0.0, 1 from qb where regexp_replace(coalesce(answer, ''), '\s', '', 'g') = ''""")
def q_answer_citations(spark, sf_dir):
    rows = qa(spark, sf_dir).withColumn("answer_id", F.concat("conv_id", F.lit(":"), "turn"))
    sources = rows.select("answer_id", F.posexplode(F.split("question", r"(?<=[.])\s+")).alias("sent_id", "sentence")).withColumn("page", F.when(F.col("sent_id") % 2 == 0, 1))
    return C.answer_citations(rows.select("answer_id", F.concat("answer", F.lit(" "), "question").alias("answer")), sources)


@query("citation_location", f"with {SENT} select doc_id, sent_id, case when sent_id % 3 = 0 then 'Section ' || doc_id || ' [[page=1]]' when sent_id % 3 = 1 then 'sent_' || sent_id else 'Unknown location' end as location from sent")
def q_citation_location(spark, sf_dir):
    k = F.col("sent_id") % 3
    section, page = F.when(k == 0, F.col("doc_id").cast("string")), F.when(k == 0, 1)
    return sents(spark, sf_dir).select("doc_id", "sent_id", C.citation_location(section, page, F.when(k == 1, F.concat(F.lit("sent_"), "sent_id"))).alias("location"))


PAGED = "pg as (select doc_id, sent_id, text, case when sent_id % 4 = 0 then cast(sent_id // 8 + 1 as integer) end as page from sent)"


def paged(spark, sf_dir):
    return sents(spark, sf_dir).withColumn("page", F.when(F.col("sent_id") % 4 == 0, (F.floor(F.col("sent_id") / 8) + 1).cast("int")))


@query("fallback_citation", f"with {SENT}, {PAGED}, r as (select *, row_number() over (partition by doc_id order by page is null, sent_id) as r from pg where regexp_matches(lower(text), 'license|with')) select doc_id, sent_id, page, 0.4::double as confidence from r where r = 1")
def q_fallback_citation(spark, sf_dir):
    return C.fallback_citation(paged(spark, sf_dir), ["license", "with"])


@query("backfill_page", f"with {SENT}, {PAGED} select doc_id, sent_id, text, coalesce(page, first(page ignore nulls) over (partition by doc_id order by sent_id rows between 2 preceding and 2 following)) as page from pg")
def q_backfill_page(spark, sf_dir):
    return C.backfill_page(paged(spark, sf_dir))


@query("citation_summary", "select event_type as type, count(*) as n, avg(value) as mean, min(value) as lowest, max(value) as highest from events group by 1")
def q_citation_summary(spark, sf_dir):
    return C.citation_summary(table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), F.col("value").alias("confidence")))



@query("citation_minimum", f"""with {VERDICTS} select doc_id, rule_id, list_filter([case when status <> 'unknown' and doc_id % 3 < 1 then 'too_few_citations' end, case when status in ('compliant', 'non_compliant') and doc_id % 3 = 0 then 'no_evidence' end, case when length(status) < 20 then 'short_rationale' end], lambda x: x is not null) as problems from v""")
def q_citation_minimum(spark, sf_dir):
    v = verdicts(spark, sf_dir)
    return v.select("doc_id", "rule_id", C.requirements(F.col("status"), F.col("doc_id") % 3, F.lit(1), F.col("status")).alias("problems"))


@query("anchor_check", r"select doc_id, regexp_matches('[[page=' || (doc_id % 4) || ']]', '^\[\[page=\d+\]\]$') and doc_id % 4 > 0 as good from documents")
def q_anchor_check(spark, sf_dir):
    marker = F.concat(F.lit("[[page="), (F.col("doc_id") % 4).cast("string"), F.lit("]]"))
    return docs(spark, sf_dir).select("doc_id", (marker.rlike("^" + C.ANCHOR + "$") & (F.regexp_extract(marker, C.ANCHOR, 1).cast("int") > 0)).alias("good"))


@query("evidence_confidence", "select event_id, case when event_id % 7 = 0 then 0.0 else (value / 100 + 0.5 + greatest(0.0, 1 - 0.1::double * (event_id % 5) - 0.05::double * (event_id % 3))) / 3 end as confidence from events")
def q_evidence_confidence(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", C.evidence_confidence(e % 7 != 0, F.col("value") / 100, F.lit(0.5), e % 5, e % 3).alias("confidence"))


@query("enforce_evidence", f"""with {VERDICTS}, c as (select doc_id, 'r_with' as rule_id, count(*) as n, count(*) filter (sent_id % 4 <> 0) as bare from sent where contains(lower(text), 'with') group by doc_id)
select v.doc_id, v.rule_id, case when coalesce(n, 0) = 0 then 'unknown' else status end as status, case when coalesce(n, 0) = 0 then 0.0 when bare > 0 then confidence / 2 else confidence end as confidence from v left join c using (doc_id, rule_id)""")
def q_enforce_evidence(spark, sf_dir):
    cites = paged(spark, sf_dir).where(F.lower("text").contains("with")).select("doc_id", F.lit("r_with").alias("rule_id"), "page")
    return C.enforce_evidence(verdicts(spark, sf_dir), cites)


@query("validity_rates", "select source, avg((n_chars > 500)::int) as valid_rate, avg((text not like '%. %')::int) as bare_rate from documents group by 1")
def q_validity_rates(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("source").agg(F.avg((F.col("n_chars") > 500).cast("int")).alias("valid_rate"), F.avg((~F.col("text").contains(". ")).cast("int")).alias("bare_rate"))
