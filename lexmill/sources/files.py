"""Readers: corpora, rule files, run logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.rules import nested_rule_issues, rule_issue_array

RULES = "id string, name string, description string, rule_text string, default_status string, severity string, keywords array<string>, exceptions array<string>"
CHECKED = (
    "rule_id string, category string, description string, priority string, enabled boolean, llm_prompt string, risk_level string, remediation_guidance string, "
    "deterministic_checks struct<required_keywords:array<string>,forbidden_keywords:array<string>,regex_patterns:array<string>,"
    "proximity_rules:array<struct<terms:array<string>,max_distance:int>>,section_hints:array<string>>, "
    "evidence_requirements struct<min_citations:int,require_page_anchors:boolean,max_citation_distance:int,require_exact_quotes:boolean>, "
    "compliance_levels struct<compliant:string,non_compliant:string,not_applicable:string,unknown:string>, "
    "llm_examples array<struct<text:string,status:string,rationale:string>>, "
    "metadata struct<version:string,created_date:string,updated_date:string,author:string,tags:array<string>,references:array<string>>"
)


def scan_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """path and text of all md and txt files below a folder."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{md,txt}")
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def decode_text(content: Column) -> Column:
    """UTF-8, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def scan_rules_json(spark: SparkSession, path: str) -> DataFrame:
    """Rules of files that hold an array of rules or an object with ``rules``."""
    raw = spark.read.text(path, wholetext=True)
    inner = F.from_json("value", f"struct<rules:array<struct<{_fields(RULES)}>>>")["rules"]
    bare = F.from_json("value", f"array<struct<{_fields(RULES)}>>")
    rules = F.when(F.ltrim("value").startswith("["), bare).otherwise(inner)
    return raw.select(F.explode(rules).alias("r")).select("r.*")


def _fields(ddl: str) -> str:
    return re.sub(r"(\w+) (array<|string|int|boolean|struct<)", r"\1:\2", ddl)


def normalise_header(name: str | Column) -> str | Column:
    """A header in lower case with underscores for blanks; of a name or of a column of names."""
    if isinstance(name, str):
        return re.sub(r"\s+", "_", name.strip().lower())
    return F.regexp_replace(F.lower(F.btrim(name, F.lit(" \t\n\x0b\x0c\r"))), r"\s+", "_")


def scan_rules_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.toDF(*[normalise_header(c) for c in rows.columns])


def scan_rules_checked(spark: SparkSession, path: str, keep_broken: bool = False) -> DataFrame:
    """Enabled rules of files that hold an array of rules, an object with ``rules`` or one rule, with
    defaults for missing parts and ``issues``: the constraints of the schema that a rule breaks. Rules
    that break any are left out unless ``keep_broken``."""
    raw = spark.read.text(path, wholetext=True)
    one = f"struct<{_fields(CHECKED)}>"
    inner = F.coalesce(F.from_json("value", f"struct<rules:array<{one}>>")["rules"], F.array(F.from_json("value", one)))
    rules = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{one}>")).otherwise(inner)
    rows = raw.select(F.explode(rules).alias("r")).select("r.*").where(F.coalesce("enabled", F.lit(True)))
    found = rows.withColumn("issues", F.concat(rule_issue_array(), nested_rule_issues()))
    kept = found if keep_broken else found.where(F.size("issues") == 0)
    return kept.withColumn("priority", F.coalesce("priority", F.lit("medium")))


def scan_run_logs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def scan_document_sets(sets: DataFrame, files: DataFrame) -> DataFrame:
    """Sets (set_id, reference_path) whose reference is among ``files`` (path)."""
    return sets.join(files.select(F.col("path").alias("reference_path")), "reference_path", "left_semi")


def prefer_processed(original: DataFrame, processed: DataFrame) -> DataFrame:
    """The converted text of a document where there is one."""
    done = processed.select("doc_id", F.col("text").alias("converted"))
    return original.join(done, "doc_id", "left").select("doc_id", F.coalesce("converted", "text").alias("text"))


def scan_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dimensions of taxonomy files ``{"labels": {label: {category, aliases, keywords}}}``: labels
    (label, category; ``other`` if it has none), aliases and keywords."""
    one = "labels:map<string,struct<category:string,aliases:array<string>,keywords:array<string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"struct<{one}>")["labels"]).alias("label", "v"))
    labels = rows.select("label", F.coalesce("v.category", F.lit("other")).alias("category"))
    return labels, rows.select("label", F.explode("v.aliases").alias("alias")), rows.select("label", F.explode("v.keywords").alias("keyword"))


def scan_compounds(spark: SparkSession, path: str) -> DataFrame:
    """Compound terms of taxonomy files ``{"special_mappings": {term: [label, ...]}}``: keyword, labels."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "special_mappings map<string,array<string>>").alias("v"))
    return rows.select(F.explode("v.special_mappings").alias("keyword", "labels"))


def scan_questionnaire(spark: SparkSession, path: str) -> DataFrame:
    """section, ordinal (in the file), question_id, prompt, guideline of files
    ``{"sections": [{name, questions: [{id, prompt, guideline}]}]}``."""
    one = "sections:array<struct<name:string,questions:array<struct<id:string,prompt:string,guideline:string>>>>"
    sections = F.from_json("value", f"struct<{one}>")["sections"]
    flat = F.flatten(F.transform(sections, lambda s: F.transform(s["questions"], lambda q: F.struct(s["name"].alias("section"), q["id"].alias("question_id"), F.coalesce(q["prompt"], F.lit("")).alias("prompt"), F.coalesce(q["guideline"], F.lit("")).alias("guideline")))))
    return spark.read.text(path, wholetext=True).select(F.posexplode(flat).alias("ordinal", "q")).select("q.section", "ordinal", "q.question_id", "q.prompt", "q.guideline")
