"""Queries over labels, on the corpus pack."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import labels as B
from lexmill.plans.retrieval_queries import TOK, values
from lexmill.plans.text_queries import SENT, docs, sents
from lexmill.registry import query, table
from lexmill.sources.merged import add_keys
from lexmill.sources.tables import scratch

#: The corpus pack's taxonomy: (label, keyword).
KEYWORDS = [("licence", "license"), ("licence", "licensed"), ("licence", "released under"), ("rights", "rights reserved"), ("secret", "token"), ("secret", "api_key"), ("article", "the"), ("article", "der"), ("link", "with"), ("link", "and"), ("link", "of the")]
ALIASES = [("en", "english"), ("de", "german"), ("fr", "french"), ("fra", "french")]
QUESTIONS = {"q_licence": ["licence", "rights"], "q_secret": ["secret"], "q_link": ["link"]}
#: Keywords with a sign, of four words, and compound terms that stand for two labels.
SIGNED = [("licence", "open-source license"), ("rights", "all rights reserved by the"), ("link", "with"), ("article", "der/die"), ("secret", "API_KEY=")]
COMPOUNDS = [("under the", ["licence", "article"]), ("of the", ["link", "article"]), ("that the", ["link", "article"])]
KW_CTE = f"""kw(label, keyword) as (values {values(KEYWORDS)}),
toks as (select doc_id, sent_id, regexp_extract_all(lower(text), '{TOK}') as t from sent),
runs as (select distinct doc_id, sent_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) as keyword from toks),
labelled as (select doc_id, sent_id, list_sort(list(distinct label)) as classes from runs join kw using (keyword) group by all)"""


def keyword_dim(spark):
    return spark.createDataFrame(KEYWORDS, "label string, keyword string")


def labelled(spark, sf_dir):
    return B.label_sentences(sents(spark, sf_dir), keyword_dim(spark))


@query("canonical_label", "select doc_id, case lang when 'en' then 'english' when 'de' then 'german' when 'fr' then 'french' else lang end as label from documents")
def q_canonical_label(spark, sf_dir):
    aliases = spark.createDataFrame(ALIASES, "alias string, canonical string")
    return B.canonical_label(docs(spark, sf_dir).select("doc_id", F.col("lang").alias("label")), aliases)


@query("allowed_labels", "select doc_id, case when lang in ('en', 'fr') then [lang] else ['none'] end as classes from documents")
def q_allowed_labels(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", B.allowed_labels(F.array("lang", "source"), ["en", "fr"]).alias("classes"))


@query("label_sentences", f"with {SENT}, {KW_CTE} select * from labelled")
def q_label_sentences(spark, sf_dir):
    return labelled(spark, sf_dir)


FULL = SIGNED + KEYWORDS + [(label, k) for k, found in COMPOUNDS for label in found]


@query("label_taxonomy", f"""with {SENT}, kw(label, keyword) as (values {values(FULL)}), kt as (select distinct label, regexp_extract_all(lower(keyword), '{TOK}') as k from kw),
toks as (select doc_id, sent_id, regexp_extract_all(lower(text), '{TOK}') as t from sent), starts as (select *, unnest(range(1, len(t) + 1)) as i from toks)
select doc_id, sent_id, list_sort(list(distinct label)) as classes from starts join kt on t[i] = k[1] where t[i:i + len(k) - 1] = k group by all""")
def q_label_taxonomy(spark, sf_dir):
    keywords = spark.createDataFrame(SIGNED + KEYWORDS, "label string, keyword string")
    return B.label_sentences(sents(spark, sf_dir), keywords, spark.createDataFrame(COMPOUNDS, "keyword string, labels array<string>"))


@query("label_batches", f"with {SENT} select doc_id, sent_id, cast(sent_id // 8 as integer) as batch from sent")
def q_label_batches(spark, sf_dir):
    return B.label_batches(sents(spark, sf_dir))


SCORED = "scored as (select md5(text || '_v1') as key from sent where doc_id % 2 = 0)"


def _scored(s):
    return s.where("doc_id % 2 = 0").select(B.cache_key(F.col("text"), "v1").alias("key"))


SKIP_SQL = f"with {SENT}, {SCORED}, k as (select md5(text || '_v1') as key, doc_id, sent_id, row_number() over (partition by text order by doc_id, sent_id) as r from sent) select key, doc_id, sent_id from k where r = 1 and key not in (select key from scored)"


@query("skip_joined", SKIP_SQL)
def q_skip_joined(spark, sf_dir):
    s = sents(spark, sf_dir)
    return B.skip_scored(s, _scored(s), "v1")


@query("skip_scored", SKIP_SQL)
def q_skip_scored(spark, sf_dir):
    s, path = sents(spark, sf_dir), scratch(spark, "scored")
    add_keys(_scored(s), path)
    return B.skip_filed(s, path, "v1")


@query("cache_stats", f"with {SENT}, {SCORED}, k as (select md5(text || '_v1') as key from sent) select count(*) filter (key in (select key from scored)) as hits, count(*) filter (key not in (select key from scored)) as misses, count(distinct key) as entries from k")
def q_cache_stats(spark, sf_dir):
    s = sents(spark, sf_dir)
    return B.cache_stats(s, _scored(s), "v1")


@query("logprob_confidence", "select vec_id, list_avg(list_transform(embedding::double[], lambda x: exp(-abs(x)))) as confidence from embeddings")
def q_logprob_confidence(spark, sf_dir):
    lp = F.transform("embedding", lambda x: -F.abs(x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", B.logprob_confidence(lp).alias("confidence"))


@query("logprob_linear", "select event_id, case when m >= 0 then 0.95 when m <= -5 then 0.5 else 0.5 + (m + 5) * 0.09 end::double as confidence from (select event_id, value - 40 as m from events)")
def q_logprob_linear(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", B.logprob_linear(F.col("value") - 40).alias("confidence"))


@query("confidence_band", "select event_id, case when value / 100 >= 0.7 then 'high' when value / 100 >= 0.4 then 'medium' else 'low' end as band, event_type not in ('click', 'view') or value / 100 < 0.4 as review from events")
def q_confidence_band(spark, sf_dir):
    c = F.col("value") / 100
    return table(spark, sf_dir, "events").select("event_id", B.confidence_band(c).alias("band"), (~F.col("event_type").isin("click", "view") | (c < 0.4)).alias("review"))


@query("pass_fail_parse", """select event_id, contains(t, 'pass') or (not contains(t, 'fail') and a) as valid, case when contains(t, 'pass') then 0.9 when contains(t, 'fail') then case when a then 0.3 else 0.1 end when a then 0.6 else 0.5 end::double as confidence
from (select event_id, case event_id % 3 when 0 then 'pass: fine' when 1 then 'fail, no' else 'unsure' end as t, event_id % 2 = 0 as a from events)""")
def q_pass_fail(spark, sf_dir):
    t = F.when(F.col("event_id") % 3 == 0, "Pass: fine").when(F.col("event_id") % 3 == 1, "FAIL, no").otherwise("unsure")
    return table(spark, sf_dir, "events").select("event_id", B.pass_fail(t, F.col("event_id") % 2 == 0).alias("p")).select("event_id", "p.valid", "p.confidence")


@query("term_from_response", "select event_id, event_type as term, case when event_id % 2 = 0 then 0.8 else 0.3 end::double as confidence from events")
def q_term_from_response(spark, sf_dir):
    js = F.concat(F.lit('{"term": "'), "event_type", F.lit('", "confidence": 0.8}'))
    raw = F.when(F.col("event_id") % 2 == 0, js).otherwise(F.concat(F.lit("The sentence is classified as "), "event_type", F.lit(" in my view, after weighing all other terms")))
    return table(spark, sf_dir, "events").select("event_id", B.term_from_response(raw).alias("p")).select("event_id", "p.term", "p.confidence")


Q_CTE = f"q(question_id, terms) as (values {values([(k, v) for k, v in QUESTIONS.items()])}), qs as (select distinct question_id, doc_id, sent_id from (select doc_id, sent_id, unnest(classes) as label from labelled) join (select question_id, unnest(terms) as label from q) using (label))"


def questions(spark):
    asked = spark.createDataFrame(list(QUESTIONS.items()), "question_id string, terms array<string>")
    return asked, spark.createDataFrame([("bond", "link")], "alias string, canonical string")


def question_hits(spark, sf_dir):
    return B.question_sentences(labelled(spark, sf_dir), *questions(spark))


@query("question_sentences", f"with {SENT}, {KW_CTE}, {Q_CTE} select * from qs")
def q_question_sentences(spark, sf_dir):
    return question_hits(spark, sf_dir)


FALLBACK = {"q_secret": ["key", "mail"], "q_licence": ["version"]}


@query("keyword_fallback", f"""with {SENT}, {KW_CTE}, {Q_CTE}, p as (select *, case when sent_id % 3 = 0 then sent_id // 10 + 1 end as page from sent),
h as (select 'q_secret' as question_id, * from p where regexp_matches(lower(text), 'key|mail') union all select 'q_licence', * from p where regexp_matches(lower(text), 'version')),
r as (select *, cast(row_number() over (partition by question_id, doc_id order by page is null, sent_id) as integer) as rank from h where not exists (select 1 from qs where qs.question_id = h.question_id and qs.doc_id = h.doc_id))
select question_id, doc_id, sent_id, text, cast(page as integer) as page, rank from r where rank <= 5""")
def q_keyword_fallback(spark, sf_dir):
    paged = sents(spark, sf_dir).withColumn("page", F.when(F.col("sent_id") % 3 == 0, (F.floor(F.col("sent_id") / 10) + 1).cast("int")))
    return B.keyword_fallback(paged, FALLBACK, question_hits(spark, sf_dir))


@query("no_clause_answer", f"""with {SENT}, {KW_CTE}, {Q_CTE} select d.doc_id, q.question_id, case when not exists (select 1 from qs where qs.doc_id = d.doc_id and qs.question_id = q.question_id) then 'No clauses found' end as answer from documents d, q""")
def q_no_clause_answer(spark, sf_dir):
    grid = docs(spark, sf_dir).select("doc_id", F.explode(F.array(*[F.lit(q) for q in QUESTIONS])).alias("question_id"))
    hit = question_hits(spark, sf_dir).select("doc_id", "question_id", F.lit(1).alias("hit")).distinct()
    return grid.join(hit, ["doc_id", "question_id"], "left").select("doc_id", "question_id", F.when(F.col("hit").isNull(), "No clauses found").alias("answer"))


NTOK = r"len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\sA-Za-z0-9]'))"


@query("token_chunks", f"""with recursive {SENT}, t as (select doc_id, sent_id, {NTOK} as n, row_number() over (partition by doc_id order by sent_id) as r from sent),
c as (select doc_id, r, 0 as chunk, sent_id as first, sent_id as last, n from t where r = 1
  union all select t.doc_id, t.r, case when c.n + t.n <= 200 then c.chunk else c.chunk + 1 end, case when c.n + t.n <= 200 then c.first else t.sent_id end, t.sent_id, case when c.n + t.n <= 200 then c.n + t.n else t.n end from c join t on t.doc_id = c.doc_id and t.r = c.r + 1)
select doc_id, cast(chunk as integer) as chunk, cast(max(first) as integer) as first, cast(max(last) as integer) as last, cast(max_by(n, r) as integer) as n_tokens from c group by doc_id, chunk""")
def q_token_chunks(spark, sf_dir):
    s = sents(spark, sf_dir)
    return B.token_chunks(s.select("doc_id", "sent_id", B.token_count(F.col("text")).alias("n_tokens")), 200)




@query("token_count", f"select doc_id, {NTOK} as n_tokens from documents")
def q_token_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", B.token_count(F.col("text")).alias("n_tokens"))


@query("context_budget", f"with {SENT}, r as (select *, row_number() over w as k, sum({NTOK}) over (partition by doc_id order by sent_id rows unbounded preceding) as used from sent window w as (partition by doc_id order by sent_id)) select doc_id, string_agg(k || '. ' || text, chr(10) order by k) as context from r where used <= 300 group by doc_id")
def q_context_budget(spark, sf_dir):
    return B.context_budget(sents(spark, sf_dir), 300)


def _side(rows: str, name: str) -> str:
    return f"{name} as (select *, row_number() over w as k, sum(len(regexp_extract_all(line, '[A-Za-z0-9]+|[^\\sA-Za-z0-9]'))) over (w rows unbounded preceding) as used from ({rows}) window w as (partition by doc_id, question_id order by sent_id))"


_TOKENS = r"coalesce(len(regexp_extract_all({}, '[A-Za-z0-9]+|[^\sA-Za-z0-9]')), 0)"
_LINES = "select doc_id, question_id, sent_id, row_number() over (partition by doc_id, question_id order by sent_id) || '. ' || text as line from qs join sent using (doc_id, sent_id) where sent_id % 2 = {}"


@query("question_context", f"""with {SENT}, {KW_CTE}, {Q_CTE}, {_side(_LINES.format(0), 'ta')}, {_side(_LINES.format(1), 'rf')},
t as (select doc_id, question_id, coalesce(string_agg(line, chr(10) order by k) filter (used <= 150), 'No relevant clauses found.') as target from ta group by all),
r as (select rf.doc_id, rf.question_id, string_agg(line, chr(10) order by k) as reference from rf join t on t.doc_id = rf.doc_id and t.question_id = rf.question_id where used <= 300 - {_TOKENS.format('target')} group by all)
select t.doc_id, t.question_id, target, reference, {_TOKENS.format('target')} + {_TOKENS.format('reference')} as tokens from t left join r on r.doc_id = t.doc_id and r.question_id = t.question_id""")
def q_question_context(spark, sf_dir):
    named = B.with_classes(sents(spark, sf_dir), keyword_dim(spark)).where("doc_id is not null")
    clauses = B.question_clauses(named, *questions(spark)).select("question_id", "doc_id", "sent_id", "text")
    return B.question_context(clauses.where("sent_id % 2 = 0"), clauses.where("sent_id % 2 = 1"), 300)


@query("deviation_flag", f"""with {SENT}, {KW_CTE}, {Q_CTE}, t as (select question_id, count(*) as target from qs join documents using (doc_id) where source <> 'src0' group by 1), r as (select question_id, count(*) as reference from qs join documents using (doc_id) where source = 'src0' group by 1)
select question_id, coalesce(target, 0) as target, coalesce(reference, 0) as reference, coalesce(target, 0) <> coalesce(reference, 0) as deviates from t full join r using (question_id)""")
def q_deviation_flag(spark, sf_dir):
    hits = question_hits(spark, sf_dir).join(docs(spark, sf_dir).select("doc_id", "source"), "doc_id")
    return B.deviation_flag(hits.where("source <> 'src0'"), hits.where("source = 'src0'"))


@query("answer_source", "select event_id, case event_id % 3 when 0 then 'Deterministic' when 1 then 'No Clauses Found' else event_type end as answer_source from events")
def q_answer_source(spark, sf_dir):
    kind = F.when(F.col("event_id") % 3 == 0, "deterministic").when(F.col("event_id") % 3 == 1, "no_clauses").otherwise("model")
    return table(spark, sf_dir, "events").select("event_id", B.answer_source(kind, F.col("event_type")).alias("answer_source"))


@query("unlabelled_answers", f"with {SENT}, {KW_CTE} select d.doc_id, count(l.sent_id) as labelled, case when count(l.sent_id) = 0 then 'Unknown' else 'open' end as answer, count(l.sent_id) = 0 as review from documents d left join labelled l using (doc_id) group by d.doc_id")
def q_unlabelled_answers(spark, sf_dir):
    counts = labelled(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("labelled"))
    rows = docs(spark, sf_dir).select("doc_id").join(counts, "doc_id", "left").na.fill(0, ["labelled"])
    return rows.withColumn("answer", F.when(F.col("labelled") == 0, "Unknown").otherwise("open")).withColumn("review", F.col("labelled") == 0)
