"""Queries over gates, runs, entities and sinks, on the corpus pack."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import entities as E
from lexmill.operators import gates as G
from lexmill.operators import rules as V
from lexmill.operators import runs as U
from lexmill.operators.labels import with_classes
from lexmill.plans.label_queries import KW_CTE, keyword_dim
from lexmill.plans.rule_queries import ACTION, CHECKS, SUMMARY, VERDICTS, verdicts
from lexmill.plans.score_queries import SCORED, scored
from lexmill.plans.text_queries import SENT, docs, sents
from lexmill.registry import oracle, query, table
from lexmill.sources import merged
from lexmill.sources import tables as S
from lexmill.streaming import documents as streams
from lexmill.streaming import progress


def events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run_id"), F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("node"), "ts", "value")


@query("node_seconds", """with e as (select user_id as run_id, event_type as node, epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) / 1e6 - epoch_us(ts) / 1e6 as seconds from events),
p as (select run_id, node, sum(seconds) as seconds from e where seconds is not null group by all)
select run_id, arg_max(node, (round(seconds, 3), node)) as slowest, arg_min(node, (round(seconds, 3), node)) as fastest, round(avg(seconds), 3) as mean, round(sum(seconds), 3) as total from p group by 1""")
def q_node_seconds(spark, sf_dir):
    return U.node_timing(events(spark, sf_dir))


@query("execution_edges", "select * from (select user_id as run_id, event_id as seq, event_type as from_node, lead(event_type) over (partition by user_id order by ts, event_id) as to_node from events) where to_node is not null")
def q_execution_edges(spark, sf_dir):
    return U.execution_edges(events(spark, sf_dir))


@query("state_diff", "with a as (select event_id as key, value from events where event_id % 3 <> 0), b as (select event_id as key, case when event_id % 5 = 0 then value + 1 else value end as value from events where event_id % 4 <> 0) select key, case when a.value is null then 'added' when b.value is null then 'removed' when a.value = b.value then 'unchanged' else 'modified' end as change from a full join b using (key)")
def q_state_diff(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), "value")
    changed = F.when(F.col("key") % 5 == 0, F.col("value") + 1).otherwise(F.col("value"))
    return U.state_diff(e.where("key % 3 <> 0"), e.where("key % 4 <> 0").withColumn("value", changed))


@query("run_compare", """with r as (select user_id as run_id, sum(value) as seconds, list(event_type order by ts, event_id) as path from events group by 1), f as (select min(run_id) as a, max(run_id) as b from r)
select y.seconds - x.seconds as difference, (y.seconds - x.seconds) / x.seconds * 100 as per_cent, x.path = y.path as same_path from f join r x on x.run_id = a join r y on y.run_id = b""")
def q_run_compare(spark, sf_dir):
    e = events(spark, sf_dir)
    ends = e.agg(F.min("run_id"), F.max("run_id")).first()
    runs = e.groupBy("run_id").agg(F.sum("value").alias("seconds"), F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "node"))), lambda x: x["node"]).alias("path"))
    return U.run_compare(runs, ends[0], ends[1])


@query("latest_run", "select arg_max(user_id, (ts, event_id)) as run_id from events")
def q_latest_run(spark, sf_dir):
    return events(spark, sf_dir).agg(F.max_by("run_id", F.struct("ts", "seq")).alias("run_id"))


@query("job_progress", "select user_id as job_id, event_id as seq, 0.1::double + 0.8::double * row_number() over (partition by user_id order by ts, event_id) / count(*) over (partition by user_id) as progress from events")
def q_job_progress(spark, sf_dir):
    return U.job_progress(events(spark, sf_dir))


ERR = """er as (select event_id, event_type as node, case event_id % 6 when 0 then 'pdf broke' when 1 then 'API request failed' when 2 then 'authorization failed' when 3 then 'bad value' when 4 then 'no such file' else 'critical module' end as message,
  case event_id % 6 when 3 then 'ValueError' when 4 then 'FileNotFoundError' when 5 then 'ImportError' else 'Error' end as kind from events),
ec as (select *, case when contains(lower(message), 'pdf') then 'pdf_processing' when regexp_matches(lower(message), 'api|request|connection|timeout|rate limit') then 'llm_api' when kind = 'FileNotFoundError' then 'file_io' when kind = 'ImportError' then 'configuration' else 'data_validation' end as category from er),
es as (select *, case when contains(message, 'authorization') or (kind = 'ImportError' and contains(message, 'critical')) then 'critical' when category in ('pdf_processing', 'llm_api') then 'recoverable' when category = 'data_validation' then 'warning' else 'recoverable' end as severity from ec)"""


def errors(spark, sf_dir):
    k = F.col("event_id") % 6
    texts = ["pdf broke", "API request failed", "authorization failed", "bad value", "no such file", "critical module"]
    message = F.element_at(F.array(*[F.lit(t) for t in texts]), (k + 1).cast("int"))
    kind = F.when(k == 3, "ValueError").when(k == 4, "FileNotFoundError").when(k == 5, "ImportError").otherwise("Error")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("node"), message.alias("message"), kind.alias("kind"))
    rows = rows.withColumn("category", U.error_category(F.col("node"), F.col("message"), F.col("kind")))
    return rows.withColumn("severity", U.error_severity(F.col("category"), F.col("message"), F.col("kind")))


@query("classify_errors", f"with {ERR} select event_id, category, severity from es")
def q_classify_errors(spark, sf_dir):
    return errors(spark, sf_dir).select("event_id", "category", "severity")


@query("error_summary", f"with {ERR} select severity, category, node, count(*) as n from es group by grouping sets ((severity), (category), (node))")
def q_error_summary(spark, sf_dir):
    return U.error_summary(errors(spark, sf_dir))


@query("batch_outcome", "select event_type as batch, count(*) filter (value > 10) as successes, count(*) filter (not value > 10) as failures, count(*) as total from events group by 1")
def q_batch_outcome(spark, sf_dir):
    good = F.col("value") > 10
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("batch")).agg(F.count_if(good).alias("successes"), F.count_if(~good).alias("failures"), F.count("*").alias("total"))


@query("rollout_bucket", """with d as (select doc_id, md5('beta:' || doc_id) as h from documents)
select doc_id, cast(list_reduce(list_concat([0], list_transform(range(1, 33), lambda i: instr('0123456789abcdef', substr(h, i, 1)) - 1)), lambda a, x: (a * 16 + x) % 100) as integer) as bucket from d""")
def q_rollout_bucket(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", U.rollout_bucket("beta", F.col("doc_id").cast("string")).alias("bucket"))


@query("last_event", "select user_id as job_id, arg_max(event_type, (ts, event_id)) as node, arg_max(event_id, (ts, event_id)) as seq from events group by 1")
def q_last_event(spark, sf_dir):
    return U.latest_progress(events(spark, sf_dir))


def _stream(rows, name):
    """A written folder as a stream that ends when the folder has been read. Each task writes what it reads, so
    files grow in number with the rows, not in size."""
    path = S.scratch(rows.sparkSession, name)
    rows.write.parquet(f"{path}/in")
    return path, rows.sparkSession.readStream.schema(rows.schema).parquet(f"{path}/in")


@query("latest_progress", """with r as (select user_id as job_id, event_id as seq, event_type as node, ts, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events)
select job_id, arg_min(node, k) as node, arg_min(seq, k) as seq, list({'ts': ts, 'seq': seq, 'node': node} order by k) as history from r where k <= 10 group by 1""")
def q_latest_progress(spark, sf_dir):
    path, stream = _stream(events(spark, sf_dir).select("job_id", F.col("ts").cast("timestamp").alias("ts"), "seq", "node"), "progress")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        told = progress.last_rows(stream).writeStream.outputMode("update")
        told = told.foreachBatch(lambda b, epoch: b.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
    finally:
        spark.conf.set(store, before)
    told.awaitTermination(600)
    newest = F.max_by(F.struct("node", "seq", "history"), "epoch").alias("x")
    return spark.read.parquet(f"{path}/out").groupBy("job_id").agg(newest).select("job_id", "x.*")


@query("status_windows", "select time_bucket(interval '1 hour', ts) as start, event_type as node, count(*) as n from events group by all")
def q_status_windows(spark, sf_dir):
    return U.status_windows(events(spark, sf_dir))


@query("stream_status_windows", "select time_bucket(interval '1 hour', ts) as start, event_type as node, count(*) as n from events group by all")
def q_stream_status_windows(spark, sf_dir):
    path, stream = _stream(events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "node"), "windows")
    counted = streams.window_stream(stream, "3650 days").writeStream.outputMode("complete")
    told = counted.foreachBatch(lambda b, epoch: b.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}")).option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start()
    told.awaitTermination()
    whole = spark.read.parquet(f"{path}/out")
    return whole.where(F.col("epoch") == whole.agg(F.max("epoch")).first()[0]).select("start", "node", "n")


@query("status_sessions", """with s as (select *, case when ts - lag(ts) over w < interval '30 minutes' then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
g as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from s) select user_id as job_id, min(ts) as start, count(*) as n from g group by user_id, k""")
def q_status_sessions(spark, sf_dir):
    return U.sessions(events(spark, sf_dir))


@query("new_documents", "select sha256(text) as doc_hash, min(doc_id) as doc_id from documents group by 1")
def q_new_documents(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(F.sha2("text", 256).alias("doc_hash")).agg(F.min("doc_id").alias("doc_id"))


@query("stream_new_documents", "select sha256(text) as doc_hash, min(doc_id) as doc_id, cast(min(length(text)) as integer) as n from documents group by 1")
def q_stream_new_documents(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "text", F.timestamp_seconds("doc_id").alias("ts"))
    path, stream = _stream(rows, "once")
    for _ in range(2):  # the second run finds nothing new
        streams.process_once(stream, path, f"{path}/check", lambda new: new.select("doc_id", "doc_hash", "ts", F.length("text").alias("n"))).awaitTermination()
    return merged.read(spark, f"{path}/documents", ["doc_id"]).select("doc_id", "doc_hash", "n")


# -- gates ----------------------------------------------------------------------------------------

CRITICAL = ["licence", "rights", "secret"]
COVER = f"""{SENT}, {KW_CTE}, j as (select s.doc_id, coalesce(l.classes, ['none']) as classes, (length(s.text) % 100) / 100 as confidence from sent s left join labelled l using (doc_id, sent_id)),
cv as (select doc_id, count(*) as sentences, avg((classes <> ['none'])::int) as coverage, round(avg(confidence), 9) as average, avg((confidence < 0.5)::int) as low,
  list_filter(['licence', 'rights', 'secret'], lambda x: not list_contains(list_distinct(flatten(list(classes))), x)) as missing from j group by 1),
am0 as (select distinct doc_id from labelled where list_has_any(classes, ['rights'])), amd as (select doc_id, contains(lower(text), 'license') and doc_id not in (select doc_id from am0) as unlabelled_amendment from documents)"""


def coverage(spark, sf_dir):
    s = sents(spark, sf_dir).withColumn("confidence", (F.length("text") % 100) / 100)
    rows = with_classes(s, keyword_dim(spark)).select("doc_id", F.coalesce("classes", F.array(F.lit("none"))).alias("classes"), "confidence")
    return G.coverage_of_documents(docs(spark, sf_dir), rows, CRITICAL, ["License"], ["rights"])


CISS = """ci as (select doc_id, 'coverage' as gate, unnest(list_filter([case when coverage < 0.1 then {'type': 'low_coverage', 'severity': 'critical'} end, case when coverage >= 0.1 and coverage < 0.3 then {'type': 'low_coverage', 'severity': 'high'} end,
  case when len(missing) > 1.5 then {'type': 'missing_terms', 'severity': 'medium'} end, case when average < 0.5 then {'type': 'low_confidence', 'severity': 'high'} end, case when low > 0.3 then {'type': 'uncertain_labels', 'severity': 'medium'} end,
  case when sentences < 20 then {'type': 'few_sentences', 'severity': 'low'} end, case when unlabelled_amendment then {'type': 'amendment_not_labelled', 'severity': 'medium'} end], lambda x: x is not null)) as x from cv join amd using (doc_id)), cj as (select doc_id, gate, x.type as type, x.severity as severity from ci)"""


@query("coverage_gate", f"with {COVER}, {CISS} select * from cj")
def q_coverage_gate(spark, sf_dir):
    return G.coverage_gate(coverage(spark, sf_dir), len(CRITICAL))


SEV = """case when c > 0 then 'critical' when h > 1 then 'high' when h = 1 or m > 2 then 'medium' else 'low' end"""
GSEV = f"""gc as (select d.doc_id, count(*) filter (severity = 'critical') as c, count(*) filter (severity = 'high') as h, count(*) filter (severity = 'medium') as m from documents d left join cj using (doc_id) group by 1), gs as (select doc_id, {SEV} as severity from gc)"""


@query("gate_severity", f"with {COVER}, {CISS}, {GSEV} select doc_id, severity, severity not in ('critical', 'high') as passed from gs")
def q_gate_severity(spark, sf_dir):
    return G.gate_severity(docs(spark, sf_dir), q_coverage_gate(spark, sf_dir))


@query("rerun_decision", f"with {COVER}, {CISS}, {GSEV} select doc_id, severity in ('critical', 'high') and doc_id % 5 < 3 as rerun from gs")
def q_rerun_decision(spark, sf_dir):
    return G.rerun(q_gate_severity(spark, sf_dir), F.col("doc_id") % 5).drop("settings")


@query("gate_recommendations", f"""with {COVER}, {CISS} select distinct doc_id, type, case type when 'low_coverage' then 'Classify again with smaller batches' when 'missing_terms' then 'Look for the missing terms' when 'low_confidence' then 'Review uncertain labels' else 'Review' end as advice,
  case when severity in ('critical', 'high') then 'high' when severity = 'medium' then 'medium' else 'low' end as priority from cj""")
def q_gate_recommendations(spark, sf_dir):
    return G.recommendations(q_coverage_gate(spark, sf_dir))


def _paged(spark, sf_dir):
    page = F.concat(F.lit("[[page="), (F.length("text") % 3 + 1).cast("string"), F.lit("]]\n"))
    return docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.concat(page, "text")).otherwise(F.col("text")).alias("text"))


_GATE_DOCS = "documents as (select doc_id, case when doc_id % 4 > 0 then '[[page=' || (length(text) % 3 + 1) || ']]' || chr(10) || text else text end as text from main.documents)"
_MEASURES = " join ".join(f"({oracle(n)}) {n}" + (" using (doc_id)" if n != "page_text_length" else "") for n in ("page_text_length", "table_lines", "garbled_text", "structure_grade"))


@query("conversion_gate", f"""with {_GATE_DOCS}, pg as (select doc_id, list_transform(regexp_extract_all(text, '\\[\\[page=(\\d+)\\]\\]', 1), lambda x: cast(x as integer)) as ps from documents),
m as (select *, coalesce(list_max(ps), 0) as pages, len(list_filter(range(1, coalesce(list_max(ps), 0) + 1), lambda x: not list_contains(ps, x))) as missing_pages from {_MEASURES} join pg using (doc_id)),
x as (select doc_id, 'conversion' as gate, unnest(list_filter([case when text_length < 1000 then {{'type': 'insufficient_text', 'severity': 'high'}} end, case when mostly_blank then {{'type': 'mostly_blank', 'severity': 'high'}} end,
  case when pages = 0 then {{'type': 'no_page_anchors', 'severity': 'high'}} end, case when missing_pages > 0 then {{'type': 'missing_pages', 'severity': 'medium'}} end, case when pages < 2 then {{'type': 'too_few_pages', 'severity': 'medium'}} end,
  case when broken_tables then {{'type': 'broken_tables', 'severity': 'low'}} end, case when garbled then {{'type': 'garbled_text', 'severity': 'high'}} end, case when grade = 'poor' then {{'type': 'poor_structure', 'severity': 'low'}} end], lambda x: x is not null)) as x from m)
select doc_id, gate, x.type as type, x.severity as severity from x""")
def q_conversion_gate(spark, sf_dir):
    return G.conversion_gate(G.conversion_measures(_paged(spark, sf_dir)), least_pages=2)


def answers(spark, sf_dir):
    return scored(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("question_id"), "answer", F.col("conf").alias("confidence"))


@query("repeated_answers", "select conv_id % 10 as doc_id, lower(trim(substr(text, 1, 4))) as answer, count(*) as n from conversations group by all having count(*) > 1")
def q_repeated_answers(spark, sf_dir):
    return G.repeated_answers(table(spark, sf_dir, "conversations").select((F.col("conv_id") % 10).alias("doc_id"), F.substring("text", 1, 4).alias("answer")))


ANSW = f"""{SCORED}, am as (select conv_id as doc_id, count(*) as answers, avg((lower(trim(answer)) = '' or contains(lower(answer), 'not specified'))::int) as unspecified, avg(conf) as average, avg((conf < 0.5)::int) as low, avg((length(answer) < 50)::int) as short from sc group by 1),
rep as (select doc_id, max(n) as repeated from (select conv_id as doc_id, lower(trim(answer)) as a, count(*) as n from sc group by all) group by 1)"""


@query("answer_shares", f"""with {ANSW}, x as (select doc_id, 'answers' as gate, unnest(list_filter([case when unspecified > 0.4 then {{'type': 'unspecified', 'severity': 'high'}} end, case when average < 0.3 then {{'type': 'low_average', 'severity': 'high'}} end,
  case when low > 0.3 then {{'type': 'uncertain', 'severity': 'medium'}} end, case when repeated > 5 and repeated > 0.3 * answers then {{'type': 'repetitive', 'severity': 'medium'}} end, case when short > 0.7 then {{'type': 'short', 'severity': 'low'}} end], lambda x: x is not null)) as x from am join rep using (doc_id))
select doc_id, gate, x.type as type, x.severity as severity from x""")
def q_answer_shares(spark, sf_dir):
    return G.answer_gate(G.answer_measures(answers(spark, sf_dir)))


#: The corpus pack's questions: conversations are documents, turns questions.
PAIRS_ASKED = [("q0", "q2"), ("q1", "q3")]
REVIEWED = """an as (select conv_id as doc_id, 'q' || turn as question_id, lower(case when turn % 5 = 4 then 'unknown' else substr(text, 1, 15 + 10 * (conv_id % 3)) end) as answer, (length(text) % 100) / 100 as confidence, conv_id % 2 = 0 as assessed from conversations)"""


def reviewed(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    answer = F.when(F.col("turn") % 5 == 4, "Unknown").otherwise(F.substring("text", F.lit(1), (15 + 10 * (F.col("conv_id") % 3)).cast("int")))
    return c.select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("q"), "turn").alias("question_id"), answer.alias("answer"), ((F.length("text") % 100) / 100).alias("confidence"), (F.col("conv_id") % 2 == 0).alias("assessed"))


CLASH = """cl as (select a.doc_id, a.question_id as a, b.question_id as b, 'exclusive' as kind from an a join an b on a.doc_id = b.doc_id join (values ('q0', 'q2'), ('q1', 'q3')) p(a, b) on a.question_id = p.a and b.question_id = p.b
  where regexp_matches(a.answer, 'the|is|de') and regexp_matches(b.answer, 'the|is|de') union select a.doc_id, 'q0', 'q1', 'worded' from an a join an b on a.doc_id = b.doc_id and a.question_id = 'q0' and b.question_id = 'q1' where contains(a.answer, 'the') and contains(b.answer, 'in'))"""


@query("contradictions", f"""with {VERDICTS}, {REVIEWED}, {CLASH} select * from cl
union all select a.doc_id, a.rule_id, b.rule_id, 'exclusive' from v a join v b using (doc_id) where a.rule_id = 'r_with' and b.rule_id = 'r_de' and a.status = 'compliant' and b.status = 'compliant'""")
def q_contradictions(spark, sf_dir):
    """Over the answers of all conversations and over the verdicts on all documents."""
    said = G.conflicts(reviewed(spark, sf_dir), PAIRS_ASKED, [("q0", "the", "q1", "in")], ["the", "is", "de"])
    ruled = verdicts(spark, sf_dir).select("doc_id", F.col("rule_id").alias("question_id"), F.when(F.col("status") == "compliant", "Yes").otherwise("No").alias("answer"))
    return said.unionByName(G.conflicts(ruled, [("r_with", "r_de")], []))


@query("answer_gate", f"""with {REVIEWED}, {CLASH}, e as (select *, answer in ('not specified', 'not found', 'unknown', '', 'n/a') as none from an),
b as (select doc_id, count(*) as n, avg(none::int) as unspecified, count(distinct question_id) filter (question_id in ('q0', 'q1', 'q2') and not none) as given, avg(confidence) as average, count(*) filter (confidence < 0.6 and confidence > 0) as low,
  count(*) filter (length(answer) < 20) as short, count(*) filter (question_id in ('q1', 'q3') and not none and not assessed) as unassessed from e group by 1),
r as (select doc_id, max(k) as repeated from (select doc_id, answer, count(*) as k from an where answer <> '' group by all) group by 1), m as (select b.*, coalesce(repeated, 0) as repeated, doc_id in (select doc_id from cl) as clash from b left join r using (doc_id)),
x as (select doc_id, 'answers' as gate, unnest(list_filter([case when unspecified > 0.4 then {{'type': 'too_many_not_specified', 'severity': 'high'}} end, case when given < 3 then {{'type': 'missing_required_fields', 'severity': 'high'}} end,
  case when average < 0.6 then {{'type': 'low_average_confidence', 'severity': 'medium'}} end, case when low > 0.3 * n then {{'type': 'many_low_confidence', 'severity': 'medium'}} end, case when clash then {{'type': 'contradictory_answers', 'severity': 'high'}} end,
  case when repeated > 5 and repeated > 0.3 * n then {{'type': 'repeated_answers', 'severity': 'medium'}} end, case when short > 0.7 * n then {{'type': 'short_answers', 'severity': 'medium'}} end,
  case when unassessed > 0 then {{'type': 'missing_risk_assessments', 'severity': 'medium'}} end], lambda x: x is not null)) as x from m)
select doc_id, gate, x.type as type, x.severity as severity from x""")
def q_answer_gate(spark, sf_dir):
    return G.answer_review(reviewed(spark, sf_dir), ["q0", "q1", "q2"], ["q1", "q3"], PAIRS_ASKED, [("q0", "the", "q1", "in")], assent=["the", "is", "de"])


@query("retry_questions", f"""with {SCORED}, r as (select conv_id as doc_id, turn as question_id, case when conf < 0.3 then 2 when turn % 4 = 0 then 3 end as priority from sc), k as (select *, cast(row_number() over (partition by doc_id order by priority, question_id) as integer) as rank from r where priority is not null)
select doc_id, rank, question_id, priority from k where rank <= 10""")
def q_retry_questions(spark, sf_dir):
    return G.retry_questions(answers(spark, sf_dir).withColumn("cited", F.col("question_id") % 4 != 0))


CIT = """a as (select user_id as doc_id, event_id as question_id, case event_id % 5 when 0 then []::bigint[] else [event_id * 2] end as cs from events), f as (select doc_id, question_id, unnest(case when len(cs) = 0 then [null] else cs end) as citation_id from a),
c as (select event_id * 2 as citation_id, value / 100 as confidence, case event_id % 9 when 1 then 'Unknown location' else 'x' end as location, case event_id % 4 when 1 then 1 end as page from events where event_id % 7 <> 3),
ii as (select * from (select doc_id, question_id, case when f.citation_id is null then 'empty' when c.citation_id is null then 'unknown_id' when confidence < 0.6 then 'low_confidence' when location = 'Unknown location' then 'unknown_location' when page is null then 'no_page' end as issue from f left join c using (citation_id)) where issue is not null)"""


def citation_issues(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    a = e.select(F.col("user_id").alias("doc_id"), k.alias("question_id"), F.when(k % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k * 2)).alias("citations"))
    c = e.where(k % 7 != 3).select((k * 2).alias("citation_id"), (F.col("value") / 100).alias("confidence"), F.when(k % 9 == 1, "Unknown location").otherwise("x").alias("location"), F.when(k % 4 == 1, 1).alias("page"))
    return G.citation_issues(a, c)


@query("citation_issues", f"with {CIT} select * from ii")
def q_citation_issues(spark, sf_dir):
    return citation_issues(spark, sf_dir)


@query("citation_gate", f"""with {CIT}, n as (select doc_id, count(*) filter (issue = 'empty') as e, count(*) filter (issue = 'low_confidence') as l, count(*) filter (issue = 'unknown_id') as u, count(*) filter (issue = 'unknown_location') as w from ii group by 1),
s as (select doc_id, case when e >= 5 then 'critical' when e >= 3 or u >= 3 then 'high' when l >= 3 or w >= 1 or e >= 1 then 'medium' else 'low' end as severity from n) select doc_id, severity, severity = 'low' as passed from s""")
def q_citation_gate(spark, sf_dir):
    return G.citation_gate(citation_issues(spark, sf_dir))


@query("rule_shares", f"""with {VERDICTS}, r as (select doc_id, avg((status <> 'unknown')::int) as evaluated, avg((doc_id % 3 > 0)::int) as backed, avg(confidence) as confidence, count(distinct status) as kinds, count(*) as n from v group by 1)
select doc_id, 0.3::double * evaluated + 0.25::double * backed + 0.25::double * confidence + case when kinds = 1 and n > 3 then 0.0 else 0.2 end::double as quality, list_filter([case when evaluated < 0.5 then 'mostly_unevaluated' end, case when evaluated >= 0.5 and evaluated < 0.7 then 'partly_unevaluated' end,
  case when backed < 0.5 then 'no_evidence' end, case when kinds = 1 and n > 3 then 'all_the_same' end], lambda x: x is not null) as issues from r""")
def q_rule_shares(spark, sf_dir):
    return G.rule_gate(verdicts(spark, sf_dir).withColumn("evidence", F.col("doc_id") % 3))


EVIDENCE = f"""kh as ({oracle("keyword_hits")}), ev as (select doc_id, rule_id, lower(context) as text, pos - 20 as start, "end" + 20 as "end" from kh),
pl as (select ev.*, status from ev join det using (doc_id, rule_id)), ov as (select distinct a.doc_id, a.rule_id as rule_a, b.rule_id as rule_b, greatest(a.start, b.start) as start, least(a."end", b."end") as "end" from pl a join pl b on a.doc_id = b.doc_id
  where a.status = 'compliant' and b.status = 'non_compliant' and greatest(a.start, b.start) < least(a."end", b."end"))"""


def rule_evidence(spark, sf_dir):
    """Keyword hits as evidence: their contexts, and stretches a little wider than the words."""
    hits = V.keyword_matches(docs(spark, sf_dir), CHECKS)
    return hits.select("doc_id", "rule_id", F.col("context").alias("text"), (F.col("pos") - 20).alias("start"), (F.col("end") + 20).alias("end"))


@query("overlapping_evidence", f"with {VERDICTS}, {EVIDENCE} select * from ov")
def q_overlapping_evidence(spark, sf_dir):
    found = V.deterministic_verdicts(docs(spark, sf_dir), sents(spark, sf_dir), CHECKS)
    return G.overlapping_evidence(rule_evidence(spark, sf_dir).drop("text").join(found.select("doc_id", "rule_id", "status"), ["doc_id", "rule_id"]), 64)


@query("rule_gate", f"""with {VERDICTS}, {EVIDENCE}, w as (select doc_id, rule_id, count(*) as n, bool_or(regexp_matches(replace(text, 'non-compliant', ''), 'compliant|satisfies|meets')) as yes, bool_or(regexp_matches(text, 'non-compliant|violates|fails')) as no from ev group by all),
sh as (select doc_id, rule_a as rule_id from ov union select doc_id, rule_b from ov), r as (select det.*, coalesce(n, 0) as n, coalesce(yes and no, false) as mixed, sh.rule_id is not null as shared, status = 'unknown' as open_ from det left join w using (doc_id, rule_id) left join sh using (doc_id, rule_id)),
rm as (select doc_id, count(*) as rules, avg(open_::int) as not_evaluated, count(*) filter (not open_ and n = 0) as no_evidence, count(*) filter ((n > 1 and mixed) or shared) as conflicting, count(*) filter (regexp_matches(rule_id, 'license|token') and (open_ or n = 0)) as critical_missing,
  bool_and(open_ or status = 'compliant') or bool_and(open_ or status = 'non_compliant') as alike from r group by 1),
rq as (select *, 0.3::double * (1 - not_evaluated) + 0.25::double * (1 - no_evidence / rules) + 0.25::double * (1 - conflicting / rules) + 0.2::double * (1 - critical_missing / 2) as quality, list_filter([case when not_evaluated > 0.5 then 'mostly_unevaluated' end, case when not_evaluated > 0.3 and not_evaluated <= 0.5 then 'partly_unevaluated' end,
  case when no_evidence > 0 then 'no_evidence' end, case when conflicting > 0 then 'conflicting_evidence' end, case when critical_missing > 0 then 'critical_rules_missing' end, case when alike and rules > 5 then 'all_the_same' end], lambda x: x is not null) as issues from rm)
select doc_id, quality, quality >= 0.6 as valid, case when quality < 0.4 then 'critical' when not_evaluated > 0.5 or conflicting > 0 or critical_missing > 0 or quality < 0.6 then 'error' when len(issues) > 0 then 'warning' else 'info' end as severity,
  issues, not_evaluated, no_evidence, conflicting, critical_missing from rq""")
def q_rule_gate(spark, sf_dir):
    found = V.deterministic_verdicts(docs(spark, sf_dir), sents(spark, sf_dir), CHECKS)
    return G.rule_review(found, rule_evidence(spark, sf_dir), ["license", "token"], 64)


# -- entities and sinks ---------------------------------------------------------------------------


@query("extract_money", r"with d as (select doc_id, regexp_replace(text, '(\d)', '$\1', 'g') as text from documents) select doc_id, cast(generate_subscripts(xs, 1) - 1 as integer) as ordinal, unnest(xs) as amount from (select doc_id, regexp_extract_all(text, '\$[\d,]+\.?\d*') as xs from d)")
def q_extract_money(spark, sf_dir):
    return E.extract_money(docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"(\d)", r"\$$1").alias("text")))


@query("dedupe_dates", "select doc_id, date, confidence_pct, pattern, pos from (select user_id as doc_id, strftime(ts, '%Y-%m-%d') as date, cast(event_id % 50 as integer) as confidence_pct, cast(event_id % 6 as integer) as pattern, event_id as pos, row_number() over (partition by user_id, strftime(ts, '%Y-%m-%d') order by event_id % 50 desc, event_id % 6, event_id) as r from events) where r = 1")
def q_dedupe_dates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("doc_id"), F.date_format("ts", "yyyy-MM-dd").alias("date"), (F.col("event_id") % 50).cast("int").alias("confidence_pct"), (F.col("event_id") % 6).cast("int").alias("pattern"), F.col("event_id").alias("pos"))
    return E.dedupe_dates(rows)


@query("dedupe_companies", "select doc_id, name, confidence_pct, pos from (select s_nationkey as doc_id, s_name as name, cast(s_suppkey % 50 as integer) as confidence_pct, s_suppkey as pos, row_number() over (partition by s_nationkey, lower(s_name) order by s_suppkey % 50 desc, s_suppkey) as r from supplier) where r = 1")
def q_dedupe_companies(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return E.dedupe_companies(s.select(F.col("s_nationkey").alias("doc_id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 50).cast("int").alias("confidence_pct"), F.col("s_suppkey").alias("pos")))


@query("top_entities", "select * from (select user_id as doc_id, cast(floor(value) as integer) as confidence_pct, event_id as pos, cast(row_number() over (partition by user_id order by floor(value) desc, event_id) as integer) as rank from events) where rank <= 5")
def q_top_entities(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.floor("value").cast("int").alias("confidence_pct"), F.col("event_id").alias("pos"))
    return E.top_entities(e, 5)


@query("render_report", f"""with {SUMMARY}, fi as (select doc_id, rule_id, severity, row_number() over (partition by doc_id order by list_position(['critical', 'high', 'medium', 'low'], severity), rule_id) as rank, {ACTION} as action from v where status in ('non_compliant', 'partially_compliant', 'requires_review')),
l as (select doc_id, string_agg('- [' || severity || '] ' || rule_id || ': ' || action, chr(10) order by rank) as ls from fi group by 1)
select doc_id, concat_ws(chr(10), '# Document ' || doc_id, 'Score: ' || cast(floor(score * 100 + 1e-9) as integer), ls) as report from summary left join l using (doc_id)""")
def q_render_report(spark, sf_dir):
    path = S.scratch(spark, "verdicts")  # a few bytes a row; both sides of the report read them
    verdicts(spark, sf_dir).write.parquet(path)
    kept = spark.read.parquet(path)
    return S.render_report(V.compliance_summary(kept), V.findings(kept))
