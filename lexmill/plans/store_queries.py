"""Queries that write rows derived from the given tables, and read them back through a reader or sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.plans.rule_queries import VERDICTS, verdicts
from lexmill.plans.text_queries import SENT, docs, sents
from lexmill.registry import query, table
from lexmill.sources import files
from lexmill.sources import merged
from lexmill.sources import tables as S


def key() -> Column:
    return F.col("p_partkey")


def rule_id() -> Column:
    return F.concat(F.lit("p"), key())


def json_files(rows: DataFrame, one: Column, wrap, order: str) -> str:
    """Write a JSON file per thousand values of ``order``, each a whole document of its rows; the folder."""
    path = S.scratch(rows.sparkSession, "files")
    packed = rows.groupBy(F.floor(F.col(order) / 1000).alias("part")).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), one.alias("v")))).alias("vs"))
    packed.select("part", F.to_json(wrap(F.transform("vs", lambda x: x["v"]))).alias("value")).write.partitionBy("part").text(path)
    return path


@query("scan_rules_json", "select 'p' || p_partkey as id, p_name as name, p_type as description, p_brand as rule_text, 'unknown' as default_status, 'high' as severity, [p_type, p_brand] as keywords, []::varchar[] as exceptions from part")
def q_scan_rules_json(spark, sf_dir):
    one = F.struct(
        rule_id().alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("rule_text"), F.lit("unknown").alias("default_status"),
        F.lit("high").alias("severity"), F.array("p_type", "p_brand").alias("keywords"), F.array().cast("array<string>").alias("exceptions"),
    )
    return files.scan_rules_json(spark, json_files(table(spark, sf_dir, "part"), one, lambda vs: F.struct(vs.alias("rules")), "p_partkey"))


@query("scan_rules_csv", "select 'p' || p_partkey as rule_id, p_name || ', \"' || p_type || '\"' as rule_name, p_brand as rule_text from part")
def q_scan_rules_csv(spark, sf_dir):
    path = S.scratch(spark, "files")
    name = F.concat("p_name", F.lit(', "'), "p_type", F.lit('"'))
    table(spark, sf_dir, "part").select(rule_id().alias("Rule ID"), name.alias("RULE Name"), F.col("p_brand").alias("Rule Text")).write.csv(path, header=True, escape='"')
    return files.scan_rules_csv(spark, path)


@query("normalise_header", "select p_partkey, replace(lower(p_name || ' ' || p_type), ' ', '_') as header from part")
def q_normalise_header(spark, sf_dir):
    shown = F.concat(F.lit(" "), F.upper("p_name"), F.lit("  "), "p_type", F.lit("\t"))
    return table(spark, sf_dir, "part").select("p_partkey", files.normalise_header(shown).alias("header"))


@query("scan_rules_checked", """select 'PAR-' || lpad(cast(p_partkey % 1000 as varchar), 3, '0') as rule_id, p_name as description, 'high' as priority, case when p_partkey % 3 = 0 then 'needs a fee' end as remediation_guidance, [p_type] as required_keywords, 'v' || p_partkey as tag
from part where p_partkey % 5 not in (0, 1, 2) and length(p_name) >= 10 and p_partkey % 7 <> 0""")
def q_scan_rules_checked(spark, sf_dir):
    bad_id = F.when(key() % 5 == 0, F.lit("bad")).otherwise(F.concat(F.lit("PAR-"), F.lpad((key() % 1000).cast("string"), 3, "0")))
    near = F.array(F.struct(F.array("p_type", "p_brand").alias("terms"), F.when(key() % 5 == 2, 0).otherwise(4).alias("max_distance")))
    one = F.struct(
        bad_id.alias("rule_id"), F.lit("payment").alias("category"), F.col("p_name").alias("description"), F.lit("high").alias("priority"), F.when(key() % 7 == 0, F.lit(False)).alias("enabled"), F.when(key() % 3 == 0, "needs a fee").alias("remediation_guidance"),
        F.struct(F.array("p_type").alias("required_keywords"), near.alias("proximity_rules")).alias("deterministic_checks"),
        F.struct(F.when(key() % 5 == 1, -1).otherwise(1).alias("min_citations"), F.lit(True).alias("require_page_anchors")).alias("evidence_requirements"),
        F.struct(*[F.lit(s).alias(s) for s in ("compliant", "non_compliant", "not_applicable", "unknown")]).alias("compliance_levels"),
        F.struct(F.lit("1.0.2").alias("version"), F.array(F.concat(F.lit("v"), key())).alias("tags")).alias("metadata"),
    )
    found = files.scan_rules_checked(spark, json_files(table(spark, sf_dir, "part"), one, lambda vs: F.struct(vs.alias("rules")), "p_partkey"))
    return found.select("rule_id", "description", "priority", "remediation_guidance", "deterministic_checks.required_keywords", F.element_at("metadata.tags", 1).alias("tag"))


@query("scan_labels", "select 'l' || p_partkey as label, case when p_partkey % 4 = 0 then 'other' else p_type end as category, p_name as alias, k as keyword from part, (values ('a'), ('b')) x(k)")
def q_scan_labels(spark, sf_dir):
    one = F.struct(F.concat(F.lit("l"), key()).alias("key"), F.struct(F.when(key() % 4 != 0, F.col("p_type")).alias("category"), F.array("p_name").alias("aliases"), F.array(F.lit("a"), F.lit("b")).alias("keywords")).alias("value"))
    labels, aliases, keywords = files.scan_labels(spark, json_files(table(spark, sf_dir, "part"), one, lambda vs: F.struct(F.map_from_entries(vs).alias("labels")), "p_partkey"))
    return labels.join(aliases, "label").join(keywords, "label")


@query("scan_compounds", "select p_name || ' ' || p_partkey as keyword, [p_type, p_brand] as labels from part")
def q_scan_compounds(spark, sf_dir):
    one = F.struct(F.concat_ws(" ", "p_name", "p_partkey").alias("key"), F.array("p_type", "p_brand").alias("value"))
    return files.scan_compounds(spark, json_files(table(spark, sf_dir, "part"), one, lambda vs: F.struct(F.map_from_entries(vs).alias("special_mappings")), "p_partkey"))


@query("scan_questionnaire", "select p_name as section, cast((row_number() over (partition by p_partkey // 1000 order by p_partkey, q)) - 1 as integer) as ordinal, 'q' || p_partkey || q as question_id, p_type as prompt, case when q = 'a' then p_brand else '' end as guideline from part, (values ('a'), ('b')) x(q)")
def q_scan_questionnaire(spark, sf_dir):
    questions = F.array(*[F.struct(F.concat(F.lit("q"), key(), F.lit(q)).alias("id"), F.col("p_type").alias("prompt"), (F.col("p_brand") if q == "a" else F.lit(None).cast("string")).alias("guideline")) for q in "ab"])
    one = F.struct(F.col("p_name").alias("name"), questions.alias("questions"))
    return files.scan_questionnaire(spark, json_files(table(spark, sf_dir, "part"), one, lambda vs: F.struct(vs.alias("sections")), "p_partkey"))


@query("scan_document_sets", "select source || '/' || doc_id as reference_path, doc_id as set_id from documents where doc_id % 3 <> 1")
def q_scan_document_sets(spark, sf_dir):
    d = docs(spark, sf_dir).withColumn("path", F.concat_ws("/", "source", "doc_id"))
    return files.scan_document_sets(d.select(F.col("doc_id").alias("set_id"), F.col("path").alias("reference_path")), d.where("doc_id % 3 <> 1"))


@query("scan_run_logs", "select event_id, event_type, value from events")
def q_scan_run_logs(spark, sf_dir):
    path = S.scratch(spark, "logs")
    table(spark, sf_dir, "events").select("event_id", "event_type", "value").write.json(path)
    return files.scan_run_logs(spark, path, "event_id long, event_type string, value double")


@query("write_classified", f"with {SENT} select doc_id, sent_id, text, 'r' || (doc_id % 2) as run_id from sent")
def q_write_classified(spark, sf_dir):
    path = S.scratch(spark, "classified")
    S.write_run(sents(spark, sf_dir).withColumn("run_id", F.concat(F.lit("r"), F.col("doc_id") % 2)), path)
    return spark.read.schema("doc_id long, sent_id int, text string, run_id string").json(path)


@query("run_partition", f"with {VERDICTS} select doc_id, rule_id, status from v where doc_id % 3 = 2")
def q_run_partition(spark, sf_dir):
    path = S.scratch(spark, "runs")
    S.write_run(verdicts(spark, sf_dir).select("doc_id", "rule_id", "status", (F.col("doc_id") % 3).alias("run_id")), path, "parquet")
    return spark.read.parquet(path).where("run_id = 2").select("doc_id", "rule_id", "status")


@query("replace_issues", "select doc_id, case when doc_id % 4 = 0 then 'again' else lang end as issue from documents union all select doc_id, source from documents where doc_id % 4 <> 0")
def q_replace_issues(spark, sf_dir):
    path, d = S.scratch(spark, "issues"), docs(spark, sf_dir)
    S.replace_rows(d.select("doc_id", F.explode(F.array("lang", "source")).alias("issue")), path)
    S.replace_rows(d.where("doc_id % 4 = 0").select("doc_id", F.lit("again").alias("issue")), path)
    return spark.read.parquet(path).select("doc_id", "issue")


@query("append_qa", "select event_id, 1 as run from events union all select event_id, 2 from events where event_id % 2 = 0")
def q_append_qa(spark, sf_dir):
    path, e = S.scratch(spark, "qa"), table(spark, sf_dir, "events")
    S.append_rows(e.select("event_id", F.lit(1).alias("run")), path)
    S.append_rows(e.where("event_id % 2 = 0").select("event_id", F.lit(2).alias("run")), path)
    return spark.read.parquet(path)


@query("export_rules", "select 'p' || p_partkey as rule_id, p_brand as category, p_type as description from part where p_brand in ('Brand#11', 'Brand#1')")
def q_export_rules(spark, sf_dir):
    rules = table(spark, sf_dir, "part").select(rule_id().alias("rule_id"), F.col("p_brand").alias("category"), F.col("p_type").alias("description"))
    found = []
    for category in ("Brand#11", "Brand#1"):
        path = S.scratch(spark, "rules")
        S.export_rules(rules, path, category)
        found.append(spark.read.schema("rule_id string, category string, description string").json(path))
    return found[0].unionByName(found[1])


UPSERT_SQL = """with old as (select doc_id, source, 1 as run from documents where doc_id % 3 <> 0), new as (select doc_id, lang as source, 2 as run from documents where doc_id % 2 = 0)
select * from new union all select * from old where doc_id not in (select doc_id from new)"""


@query("upsert_versions", UPSERT_SQL)
def q_upsert_versions(spark, sf_dir):
    path, d = S.scratch(spark, "documents"), docs(spark, sf_dir)
    S.upsert(spark, path, d.where("doc_id % 3 <> 0").select("doc_id", "source", F.lit(1).alias("run")), ["doc_id"], "run")
    S.upsert(spark, path, d.where("doc_id % 2 = 0").select("doc_id", F.col("lang").alias("source"), F.lit(2).alias("run")), ["doc_id"], "run")
    return S.read_version(spark, path)


@query("upsert_documents", UPSERT_SQL)
def q_upsert_documents(spark, sf_dir):
    path, d = S.scratch(spark, "documents"), docs(spark, sf_dir)
    merged.upsert(d.where("doc_id % 3 <> 0").select("doc_id", "source", F.lit(1).alias("run")), path, ["doc_id"], "run")
    merged.compact(spark, path, ["doc_id"])
    merged.upsert(d.where("doc_id % 2 = 0").select("doc_id", F.col("lang").alias("source"), F.lit(2).alias("run")), path, ["doc_id"], "run")
    return merged.read(spark, path, ["doc_id"])


@query("write_snapshot", f"with {VERDICTS} select status, count(*) as n, count(distinct doc_id) as documents from v group by 1")
def q_write_snapshot(spark, sf_dir):
    path = S.scratch(spark, "snapshots")
    S.append_rows(S.state_counters(verdicts(spark, sf_dir)), path)
    return spark.read.parquet(path)


@query("write_verdicts", f"with {VERDICTS} select status, count(*) as n from v group by 1")
def q_write_verdicts(spark, sf_dir):
    path = S.scratch(spark, "verdicts")
    S.write_run(verdicts(spark, sf_dir).select("doc_id", "rule_id", "status", F.lit("r1").alias("run_id")), path)
    return spark.read.schema("doc_id long, rule_id string, status string, run_id string").json(path).groupBy("status").agg(F.count("*").alias("n"))
