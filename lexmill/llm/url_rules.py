"""URL filtering by pattern rules that are indexed by their rarest literal token.

A rule is a regular expression over ``host/path``-like text together with literal tokens that any
url it fits must contain whole. Over all urls the tokens' document counts are taken; a rule is
filed under its rarest one. A url's tokens fetch the rules filed under them, and only these run
their expression. Rules without a literal run on every url. The rules are a bounded list, so their
index is broadcast; the urls are never shuffled by a token.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import ascii_lower

#: Host and path rules as (verdict, rule), fixed by the query's contract.
SITE_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Rules of the method itself, for urls that no site rule decides: (verdict, expression, literal tokens).
PATTERN_RULES = [
    ("block", r"(?:^|[./-])casino(?:$|[./-])", ["casino"]),
    ("block", r"(?:^|[./-])xxx(?:$|[./-])", ["xxx"]),
    ("block", r"/wp-login\.php$", ["wp", "login", "php"]),
    ("block", r"/cgi-bin/", ["cgi", "bin"]),
    ("block", r"^ads?\.", ["ad"]),
    ("block", r"^ads?\.", ["ads"]),
    ("block", r"/(?:tag|tags)/[^/]+/page/\d+", ["page"]),
]
MOST_RULES = 100_000
#: Stands in every url, for rules without a literal.
EVERY = ""


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for null and for urls without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)


def compile_rules(spark: SparkSession, sites: list[tuple[str, str]], patterns: list[tuple[str, str, list[str]]]) -> DataFrame:
    """Rules as rows: rule_no, rule (site rules), verdict, expression over host + path, tokens, weight.

    A site rule's expression is anchored at a dot or the start of the host. Its literal tokens are
    those that end inside the rule: a path like ``/en/1`` may go on, so ``1`` is none.
    """
    rows = []
    for verdict, rule in sites:
        host, slash, path = rule.partition("/")
        expression = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}"
        tokens = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", rule.lower()) if host else []
        rows.append((len(rows), rule, verdict, expression, sorted(set(tokens)) or [EVERY], len(rule)))
    for verdict, expression, tokens in patterns:
        rows.append((len(rows), None, verdict, expression, list(tokens) or [EVERY], 0))
    if len(rows) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules; the index of rules is broadcast")
    return spark.createDataFrame(rows, "rule_no int, rule string, verdict string, expression string, tokens array<string>, weight int")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url).

    The longest fitting site rule decides; else a fitting pattern rule (the lowest rule_no), else
    ``allow``. Null urls have empty host and path and fit nothing. Rows that repeat stay repeated.
    """
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    found = F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit("[a-z0-9]+"), 0)
    exploded = rows.withColumn("token", F.explode(F.array_union(F.array(F.lit(EVERY)), found)))
    literals = rules.select("rule_no", F.explode("tokens").alias("token"))
    frequency = exploded.join(F.broadcast(literals.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    filed = (
        literals.join(F.broadcast(frequency), "token", "left")
        .groupBy("rule_no")
        .agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("filed_under"))
    )
    index = F.broadcast(rules.join(filed, "rule_no").drop("tokens"))
    fits = (F.col("token") == F.col("filed_under")) & F.expr("rlike(concat(host, path), expression)")
    hit = F.max_by(F.struct("rule", "verdict"), F.when(F.col("rule_no").isNotNull(), F.struct("weight", (-F.col("rule_no")).alias("order")))).alias("hit")
    judged = exploded.join(index, fits, "left").groupBy("row", "page_id", "host", "path").agg(hit)
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit("allow")).alias("verdict"))
