"""Queries over page anchors and retrieval, on the corpus pack."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import pages as P
from lexmill.operators import retrieval as R
from lexmill.operators import text as T
from lexmill.plans.text_queries import PARA, SENT, docs, sents
from lexmill.registry import query, table

#: The corpus pack's rules: id, name, rule text, keywords, severity.
RULES = [
    ("r_license", "License notice", "a license line must stand in the text", ["license", "licensed"], "critical"),
    ("r_rights", "Rights reserved", "all rights reserved", ["rights reserved"], "high"),
    ("r_token", "No secrets", "no token or key may stand in the text", ["token", "key"], "critical"),
    ("r_mail", "No addresses", "mail addresses at example com", ["@", "example.com"], "medium"),
    ("r_with", "With", "with this that", ["with", "from"], "low"),
    ("r_de", "Articles", "der die das und", ["und", "nicht"], "medium"),
    ("r_fr", "Liaison", "les des et dans", ["dans", "avec"], "low"),
    ("r_none", "Absent", "quarterly indemnification covenant", ["indemnification"], "high"),
]
TOK = "[a-z0-9_]+"


def terms(spark):
    rules = spark.createDataFrame([(r[0], r[1], r[2], r[3]) for r in RULES], "rule_id string, name string, rule_text string, keywords array<string>")
    return rules.select("rule_id", F.explode(R.query_terms([F.col("name"), F.col("rule_text")], F.col("keywords"))).alias("token"))


def values(rows) -> str:
    def lit(v):
        return "[" + ", ".join(map(lit, v)) + "]" if isinstance(v, list) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else "null" if v is None else str(v)

    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


RULE_CTE = f"rules(rule_id, name, rule_text, keywords, severity) as (values {values(RULES)})"
TERM_CTE = f"""{RULE_CTE},
terms as (select distinct rule_id, unnest(regexp_extract_all(lower(name || ' ' || rule_text || ' ' || array_to_string(keywords, ' ')), '{TOK}')) as token from rules)"""
BM25 = f"""{SENT}, {TERM_CTE},
tk as (select doc_id, sent_id, regexp_extract_all(lower(text), '{TOK}') as t from sent),
sizes as (select doc_id, count(*) as n, avg(len(t)) as avg_len from tk group by doc_id),
tf as (select doc_id, sent_id, len, token, count(*) as tf from (select doc_id, sent_id, len(t) as len, unnest(t) as token from tk) group by all),
df as (select doc_id, token, count(*) as df from tf group by all),
bm as (select rule_id, doc_id, sent_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) as score
  from tf join df using (doc_id, token) join sizes using (doc_id) join terms using (token) group by all having score > 0)"""
CHUNK = """chunk as (select doc_id, sent_id, array_to_string(list(text) over w, ' ') as chunk, list(sent_id) over w as indices from sent
  window w as (partition by doc_id order by sent_id rows between 1 preceding and 1 following))"""
LINES = "lines as (select doc_id, unnest(xs) as line, generate_subscripts(xs, 1) - 1 as i from (select doc_id, string_split(text, chr(10)) as xs from documents))"


@query("anchor_lines", f"with {LINES} select doc_id, string_agg(case when i % 5 = 0 then '[[page=' || (i // 5 + 1) || ']]' || chr(10) else '' end || line, chr(10) order by i) as text from lines group by doc_id")
def q_anchor_lines(spark, sf_dir):
    return P.anchor_lines(docs(spark, sf_dir), 5)


@query("page_marker_breaks", rf"""with {LINES}, f as (select doc_id, i as start_line, regexp_extract(line, '^(\d+)', 1) as page from (select doc_id, i, cast(length(line) as varchar) || line as line from lines where length(line) % 3 = 0))
select doc_id, cast(page as integer) as page, cast(start_line as integer) as start_line, cast(lead(start_line) over (partition by doc_id order by start_line) as integer) as end_line from f where page <> ''""")
def q_page_marker_breaks(spark, sf_dir):
    numbered = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.when(F.length(x) % 3 == 0, F.concat(F.length(x).cast("string"), x)).otherwise("-")), "\n")
    return P.page_marker_breaks(docs(spark, sf_dir).select("doc_id", numbered.alias("text")), r"^(\d+)")


ANCHORED = f"""{LINES}, marked as (select doc_id, i, length(line) as n, i % 5 = 0 as mark, i // 5 + 1 as page, line from lines),
placed as (select *, coalesce(sum(n + 1 + case when mark then 10 + length(cast(page as varchar)) else 0 end) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as pos from marked)"""


@query("extract_anchors", f"""with {ANCHORED}, t as (select doc_id, string_agg(case when mark then '[[page=' || page || ']]' || chr(10) else '' end || line, chr(10) order by i) as text from marked group by doc_id)
select doc_id, cast(page - 1 as integer) as ordinal, cast(page as integer) as page, cast(pos as integer) as pos,
  substr(text, greatest(pos - 50, 0)::int + 1, (pos + 9 + length(cast(page as varchar)) + 50 - greatest(pos - 50, 0))::int) as context from placed join t using (doc_id) where mark""")
def q_extract_anchors(spark, sf_dir):
    return P.extract_anchors(P.anchor_lines(docs(spark, sf_dir), 5))


@query("page_of_position", f"""with {ANCHORED}, a as (select doc_id, pos, page from placed where mark), q as (select doc_id, unnest(range(0, n_chars, 700)) as pos from documents)
select doc_id, cast(pos as integer) as pos, cast(coalesce((select max(page) from a where a.doc_id = q.doc_id and a.pos <= q.pos), 1) as integer) as page from q""")
def q_page_of_position(spark, sf_dir):
    d = docs(spark, sf_dir)
    asks = d.where("n_chars > 0").select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("n_chars") - 1).cast("int"), F.lit(700))).alias("pos"))
    return P.page_of_position(asks, P.extract_anchors(P.anchor_lines(d, 5)))


@query("sentence_pages", f"with {SENT} select doc_id, sent_id, cast(coalesce(sum(length(text) + 1) over (partition by doc_id order by sent_id rows between unbounded preceding and 1 preceding), 0) // 300 + 1 as integer) as page from sent")
def q_sentence_pages(spark, sf_dir):
    from pyspark.sql.window import Window

    before = Window.partitionBy("doc_id").orderBy("sent_id").rowsBetween(Window.unboundedPreceding, -1)
    pos = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return sents(spark, sf_dir).select("doc_id", "sent_id", P.estimate_page(pos, 300).alias("page"))


@query("validate_anchors", """with a as (select user_id as doc_id, event_id as pos, event_id % 9 as page from events), b as (select *, count(*) over (partition by doc_id, page) as same,
  max(page) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) as highest from a)
select distinct doc_id, 'duplicate' as issue, page from b where same > 1 union select distinct doc_id, 'out_of_order', page from b where page < highest""")
def q_validate_anchors(spark, sf_dir):
    return P.validate_anchors(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), (F.col("event_id") % 9).alias("page")))


@query("missing_pages", """with p as (select user_id as doc_id, cast(event_id % 40 + 1 as integer) as page from events), m as (select doc_id, list(distinct page) as seen, max(page) as last from p group by doc_id)
select doc_id, list_filter(range(1, last + 1), lambda x: not list_contains(seen, x)) as missing from m""")
def q_missing_pages(spark, sf_dir):
    return P.missing_pages(table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 40 + 1).cast("int").alias("page")))


@query("estimate_page", "select doc_id, cast(n_chars // 3000 + 1 as integer) as page from documents")
def q_estimate_page(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", P.estimate_page(F.col("n_chars")).alias("page"))


@query("anchor_citation", "select doc_id, substr(text, 1, 40) || case when doc_id % 3 = 0 then '' else ' [[page=' || (n_chars // 3000 + 1) || ']]' end as citation from documents")
def q_anchor_citation(spark, sf_dir):
    page = F.when(F.col("doc_id") % 3 != 0, P.estimate_page(F.col("n_chars")))
    return docs(spark, sf_dir).select("doc_id", P.anchor_citation(F.substring("text", 1, 40), page).alias("citation"))


@query("tokens", f"with {SENT} select doc_id, sent_id, unnest(regexp_extract_all(lower(text), '{TOK}')) as token from sent")
def q_tokens(spark, sf_dir):
    return R.tokens(sents(spark, sf_dir))


@query("term_index", f"with {BM25} select doc_id, sent_id, token, tf, df, len as sent_len, n as n_sents, avg_len from tf join df using (doc_id, token) join sizes using (doc_id)")
def q_term_index(spark, sf_dir):
    return R.term_index(sents(spark, sf_dir))


@query("query_terms", f"select doc_id, list_sort(list_distinct(regexp_extract_all(lower(source || ' ' || substr(text, 1, 200)), '{TOK}'))) as terms from documents")
def q_query_terms(spark, sf_dir):
    found = R.query_terms([F.col("source"), F.substring("text", 1, 200)], F.array().cast("array<string>"))
    return docs(spark, sf_dir).select("doc_id", F.array_sort(found).alias("terms"))


@query("bm25", f"with {BM25} select * from bm")
def q_bm25(spark, sf_dir):
    return R.bm25(sents(spark, sf_dir), terms(spark))


@query("multi_query", f"with {BM25} select rule_id, count(*) as hits, max(score) as best from bm group by rule_id")
def q_multi_query(spark, sf_dir):
    return R.bm25(sents(spark, sf_dir), terms(spark)).groupBy("rule_id").agg(F.count("*").alias("hits"), F.max("score").alias("best"))


@query("window_chunk", f"with {SENT}, {CHUNK} select * from chunk")
def q_window_chunk(spark, sf_dir):
    return R.window_chunk(sents(spark, sf_dir))


def _rounded(df):
    return df.withColumn("score", F.round("score", 9))


@query("top_k_chunks", f"""with {BM25}, {CHUNK}, j as (select rule_id, doc_id, sent_id, round(score, 9) as score, chunk, indices from bm join chunk using (doc_id, sent_id)),
o as (select *, row_number() over (partition by rule_id, doc_id, indices order by score desc, sent_id) as s from j),
r as (select *, cast(row_number() over (partition by rule_id, doc_id order by score desc, sent_id) as integer) as rank from o where s = 1)
select rule_id, doc_id, sent_id, score, chunk, indices, rank from r where rank <= 3""")
def q_top_k_chunks(spark, sf_dir):
    s = sents(spark, sf_dir)
    return R.top_k_chunks(_rounded(R.bm25(s, terms(spark))), R.window_chunk(s), 3)


@query("max_normalise", f"with {BM25} select *, score / max(score) over (partition by rule_id, doc_id) as norm from bm")
def q_max_normalise(spark, sf_dir):
    return R.max_normalise(R.bm25(sents(spark, sf_dir), terms(spark)))


COS = "list_dot_product(e.embedding::double[], q.embedding::double[]) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])))"


@query("cosine", f"select e.vec_id, {COS} as score from embeddings e, (select embedding from embeddings where vec_id = 0) q")
def q_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q"), F.lit(1).alias("one")))  # one row
    return e.withColumn("one", F.lit(1)).join(q, "one").select("vec_id", R.cosine(F.col("embedding"), F.col("q")).alias("score"))


@query("hybrid_score", f"""with {BM25}, lex as (select rule_id, doc_id, sent_id, score / max(score) over (partition by rule_id, doc_id) as lexical from bm),
d as (select e.vec_id as sent_id, {COS} as dense from embeddings e, (select embedding from embeddings where vec_id = 0) q)
select lex.*, dense, coalesce(0.5 * dense + 0.5 * lexical, lexical) as score from lex left join d on d.sent_id = lex.sent_id and lex.sent_id % 2 = 0""")
def q_hybrid_score(spark, sf_dir):
    lexical = R.max_normalise(R.bm25(sents(spark, sf_dir), terms(spark)))
    dense = q_cosine(spark, sf_dir).select(F.col("vec_id").cast("int").alias("sent_id"), F.col("score").alias("norm")).where("sent_id % 2 = 0")
    keyed = lexical.select("rule_id", "doc_id", "sent_id").join(dense, "sent_id")
    return R.hybrid_score(lexical, keyed)


FALL = f"""{PARA}, {TERM_CTE}, pt as (select doc_id, para_id, list_distinct(regexp_extract_all(lower(p), '{TOK}')) as t from para),
fb as (select rule_id, doc_id, para_id, count(*) / greatest(5, any_value(n)) as score from (select doc_id, para_id, len(t) as n, unnest(t) as token from pt) join terms using (token) group by all)"""


def paragraph_rows(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(T.paragraph_array(F.col("text"), "\n")).alias("para_id", "text"))


def fallback(spark, sf_dir):
    return R.paragraph_scores(paragraph_rows(spark, sf_dir), terms(spark))


@query("paragraph_scores", f"with {FALL} select rule_id, doc_id, cast(para_id as integer) as para_id, score from fb")
def q_paragraph_scores(spark, sf_dir):
    return fallback(spark, sf_dir)


PSPANS = f"""{FALL}, pn as (select doc_id, max(para_id) + 1 as n from para group by 1),
ps as (select rule_id, doc_id, para_id, score, greatest(para_id - {{w}}, 0) as s, least(para_id + {{w}}, n - 1) as e from fb join pn using (doc_id))"""
PTEXT = "list(cast(p.para_id as integer) order by p.para_id) as indices, string_agg(p.p, chr(10) order by p.para_id) as chunk"


@query("paragraph_fallback", f"""with {PSPANS.format(w=1)}, one as (select *, row_number() over (partition by rule_id, doc_id, s, e order by score desc, para_id) as k from ps),
rk as (select *, cast(row_number() over (partition by rule_id, doc_id order by score desc, para_id) as integer) as rank from one where k = 1)
select r.rule_id, r.doc_id, rank, cast(r.para_id as integer) as para_id, score, {PTEXT} from rk r join para p on p.doc_id = r.doc_id and p.para_id between r.s and r.e where rank <= 8 group by all""")
def q_paragraph_fallback(spark, sf_dir):
    return R.paragraph_fallback(paragraph_rows(spark, sf_dir), terms(spark))


@query("merged_passages", f"""with {PSPANS.format(w=2)}, op as (select *, case when s > max(e) over (partition by rule_id, doc_id order by para_id rows between unbounded preceding and 1 preceding) + 1 then 1 else 0 end as opens from ps),
il as (select *, sum(opens) over (partition by rule_id, doc_id order by para_id rows unbounded preceding) as island from op),
pa as (select rule_id, doc_id, island, min(s) as s, max(e) as e, max(score) as score, arg_min(para_id, (-score, para_id)) as best from il group by all)
select a.rule_id, a.doc_id, cast(best as integer) as para_id, score, {PTEXT} from pa a join para p on p.doc_id = a.doc_id and p.para_id between a.s and a.e group by a.rule_id, a.doc_id, island, best, score""")
def q_merged_passages(spark, sf_dir):
    return R.merged_passages(paragraph_rows(spark, sf_dir), fallback(spark, sf_dir), 2)


@query("candidates", f"""with {BM25}, pt as (select doc_id, para_id, list_distinct(regexp_extract_all(lower(p), '{TOK}')) as t from para),
fb as (select rule_id, doc_id, para_id, count(*) / greatest(5, any_value(n)) as score from (select doc_id, para_id, len(t) as n, unnest(t) as token from pt) join terms using (token) group by all),
hit as (select * from bm where score > 3)
select rule_id, doc_id, sent_id as unit_id, score, false as fallback_used from hit
union all select rule_id, doc_id, cast(para_id as integer), score, true from fb where not exists (select 1 from hit where hit.rule_id = fb.rule_id and hit.doc_id = fb.doc_id)""")
def q_candidates(spark, sf_dir):
    ranked = R.bm25(sents(spark, sf_dir), terms(spark)).where("score > 3").withColumnRenamed("sent_id", "unit_id")
    spare = fallback(spark, sf_dir).withColumnRenamed("para_id", "unit_id")
    return R.candidates(ranked, spare, spare.select("rule_id", "doc_id").distinct())


@query("optimise_query", """select item_id, array_to_string(list_transform(list_filter(string_split(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'), ' '),
  lambda w: w <> '' and w not in ('the', 'a', 'an', 'and', 'or', 'but', 'in', 'on', 'at', 'to', 'for', 'of', 'with', 'by', 'from', 'as', 'is', 'was', 'are', 'were', 'be', 'been', 'being')), lambda w: case w when 'nda' then 'non-disclosure agreement' else w end), ' ') as query from benchmark""")
def q_optimise_query(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", R.optimise_query(F.col("text")).alias("query"))


PAIRS = """pairs as (select conv_id, turn, text as question, lead(text) over w as answer, role, lead(role) over w as next_role from conversations window w as (partition by conv_id order by turn)),
qa as (select conv_id, turn, question, answer from pairs where role = 'user' and next_role = 'assistant')"""


def qa(spark, sf_dir):
    """Each user turn with the assistant turn behind it."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("question"), F.lead("text").over(w).alias("answer"), "role", F.lead("role").over(w).alias("next"))
    return rows.where("role = 'user' and next = 'assistant'").select("conv_id", "turn", "question", "answer")


SPLIT = r"list_distinct(list_filter(string_split(regexp_replace(lower({}), '\s+', ' ', 'g'), ' '), lambda w: w <> ''))"


@query("rerank_overlap", f"with {PAIRS} select conv_id, turn, len(list_intersect({SPLIT.format('question')}, {SPLIT.format('answer')})) / len({SPLIT.format('question')}) as score from qa")
def q_rerank_overlap(spark, sf_dir):
    return qa(spark, sf_dir).select("conv_id", "turn", R.overlap(F.col("question"), F.col("answer")).alias("score"))


@query("dedupe_results", "select doc_id, md5(text) as key from (select *, row_number() over (partition by text order by doc_id) as r from documents) where r = 1")
def q_dedupe_results(spark, sf_dir):
    return R.first_of(docs(spark, sf_dir).select("doc_id", F.md5("text").alias("key")), ["key"], ["doc_id"])


@query("latency_stats", "select avg(value) as mean, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.95) as p95, quantile_cont(value, 0.99) as p99 from events")
def q_latency_stats(spark, sf_dir):
    return R.latency_stats(table(spark, sf_dir, "events"))


SECTIONS = f"""{SENT}, {RULE_CTE},
around as (select *, lag(text) over w as before, lead(text) over w as after from sent window w as (partition by doc_id order by sent_id)),
hits as (select rule_id, doc_id, sent_id, concat_ws(' ', before, text, after) as section, list_filter(keywords, lambda k: contains(lower(text), k)) as matched from around, rules),
sections as (select *, cast(row_number() over (partition by rule_id, doc_id order by sent_id) as integer) as rank from hits where len(matched) > 0)"""


@query("keyword_sections", f"with {SECTIONS} select * from sections where rank <= 10")
def q_keyword_sections(spark, sf_dir):
    return R.keyword_sections(sents(spark, sf_dir), [(r[0], r[3]) for r in RULES])
