"""Dates, companies and parties of contracts.

Match offsets with context come from one shared ``spans`` operator in ``mapInPandas``; everything
behind it is relational.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
SHORT = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
#: Patterns in order. The whole match is the date.
DATE_PATTERNS = [
    r"\b(\d{4}[-/]\d{1,2}[-/]\d{1,2})\b",
    r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{4})\b",
    rf"\b({MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b",
    rf"\b({SHORT})\s+\d{{1,2}},?\s+\d{{4}}\b",
    rf"\b\d{{1,2}}\s+({MONTHS})\s+\d{{4}}\b",
    rf"\b\d{{1,2}}\s+({SHORT})\s+\d{{4}}\b",
]
#: Legal forms.
COMPANY_PATTERNS = [
    r"\b\w+\s+(Inc\.?|Corporation|Corp\.?|LLC|L\.L\.C\.?|Limited|Ltd\.?|LLP|L\.L\.P\.?|LP|L\.P\.?)\b",
    r"\b\w+\s+(Company|Co\.?|Group|Enterprises|Holdings|Partners)\b",
    r"\b\w+\s+(Technologies|Tech|Systems|Solutions|Services)\b",
]
#: Words that speak for a date, and for a company.
DATE_KEYWORDS = "entered into|effective|commence|term"
COMPANY_KEYWORDS = "between|party|client|customer|provider"
DATE_FORMATS = ["yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "M-d-yyyy", "MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy"]
SPANS = "doc_id long, pattern int, pos int, end int, raw string, before string, after string"


def spans(docs: DataFrame, patterns: list[str], around: int = 50, ignore_case: bool = True) -> DataFrame:
    """Every match of every pattern with offsets and context. Empty and null texts have none."""
    flags = re.IGNORECASE if ignore_case else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [re.compile(p, flags) for p in patterns]
        for b in batches:
            rows = [
                (d, n, m.start(), m.end(), m.group(), t[max(0, m.start() - around) : m.start()], t[m.end() : m.end() + around])
                for d, t in zip(b["doc_id"], b["text"], strict=True) if t for n, p in enumerate(compiled) for m in p.finditer(t)
            ]
            yield pd.DataFrame(rows, columns=["doc_id", "pattern", "pos", "end", "raw", "before", "after"])

    return docs.where("text is not null").select("doc_id", "text").mapInPandas(run, SPANS)


def as_date(raw: Column) -> Column:
    tidy = F.regexp_replace(raw, r"\s+", " ")
    return F.coalesce(*[F.try_to_date(tidy, f) for f in DATE_FORMATS])


def extract_dates(docs: DataFrame) -> DataFrame:
    """doc_id, pattern, pos, raw, date, confidence_pct; texts that are no calendar date are left out."""
    around = F.lower(F.concat("before", "raw", "after"))
    score = F.lit(50) + F.when(around.rlike(DATE_KEYWORDS), 30).otherwise(0) + F.when(around.rlike("agreement|contract"), 15).otherwise(0) + F.when(F.col("raw").rlike(r"\d{4}"), 10).otherwise(0)
    found = spans(docs, DATE_PATTERNS).withColumn("date", as_date(F.initcap("raw"))).where("date is not null")
    return found.select("doc_id", "pattern", "pos", "raw", F.date_format("date", "yyyy-MM-dd").alias("date"), F.least(F.lit(100), score).alias("confidence_pct"))


def dedupe_dates(dates: DataFrame) -> DataFrame:
    """One row per date: the most certain, then the first."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "date").orderBy(F.desc("confidence_pct"), "pattern", "pos"))
    return dates.withColumn("_r", rank).where("_r = 1").drop("_r")


#: Indicator phrases in order.
START_PATTERNS = [
    r"entered into on\s+([^,]+)", r"effective\s+(?:as of\s+)?([^,\n]+)", r"commence(?:s|d)?\s+on\s+([^,\n]+)", r"agreement\s+shall\s+commence\s+on\s+([^,\n]+)",
    r"term\s+(?:shall\s+)?(?:begin|start|commence)(?:s)?\s+on\s+([^,\n]+)", r"this\s+agreement\s+is\s+entered\s+into\s+on\s+([^,\n]+)",
]


def start_date(docs: DataFrame, dates: DataFrame) -> DataFrame:
    """doc_id, date, confidence_pct: the date behind the first indicator that has one (+20), else the
    first within 100 characters behind term, agreement or effective."""
    phrases = spans(docs, START_PATTERNS, 0).select("doc_id", F.col("pattern").alias("n"), F.col("pos").alias("p"), "end")
    inside = phrases.join(dates, "doc_id").where("pos >= p and pos < end + 8")
    one = inside.groupBy("doc_id").agg(F.min_by(F.struct("date", F.least(F.lit(100), F.col("confidence_pct") + 20).alias("c")), F.struct("n", "p", "pos")).alias("a"))
    words = spans(docs, [r"term|agreement|effective"], 0).select("doc_id", F.col("end").alias("from"))
    near = words.join(dates, "doc_id").where("pos >= from and pos <= from + 100").groupBy("doc_id").agg(F.min_by(F.struct("date", F.col("confidence_pct").alias("c")), "pos").alias("b"))
    both = one.join(near, "doc_id", "full_outer")
    return both.select("doc_id", F.coalesce("a.date", "b.date").alias("date"), F.coalesce("a.c", "b.c").alias("confidence_pct"))


def extract_companies(docs: DataFrame) -> DataFrame:
    around = F.lower(F.concat(F.right("before", F.lit(30)), "raw", F.left("after", F.lit(30))))
    name = F.regexp_replace(F.trim(F.regexp_replace("raw", r"\s+", " ")), r"(?i)^(the|a|an)\s+", "")
    score = F.lit(60) + F.when(around.rlike(COMPANY_KEYWORDS), 20).otherwise(0) + F.when(F.lower("raw").rlike("inc|corp"), 15).otherwise(0)
    return spans(docs, COMPANY_PATTERNS).select("doc_id", "pattern", "pos", name.alias("name"), F.least(F.lit(100), score).alias("confidence_pct")).where(F.length("name") > 3)


def dedupe_companies(companies: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("doc_id", F.lower("name")).orderBy(F.desc("confidence_pct"), "pos"))
    return companies.withColumn("_r", rank).where("_r = 1").drop("_r")


def contract_parties(docs: DataFrame) -> DataFrame:
    """doc_id, first, second of "between X and Y"."""
    p = r'(?i)between\s+([^("]+?)(?:\s*\([^)]*\))?\s+(?:and|&)\s+([^(",.\n]+)'

    def tidy(g: int) -> Column:
        bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("text", p, g), "[\"\u201c\u201d']", ""), r"\s+", " "))
        return F.regexp_replace(bare, r"[,.\s]+$", "")

    return docs.where(F.col("text").rlike(p)).select("doc_id", tidy(1).alias("first"), tidy(2).alias("second"), F.lit(85).alias("confidence_pct"))


def top_entities(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("confidence_pct"), "pos"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def company_columns(docs: DataFrame, parties: DataFrame, companies: DataFrame) -> DataFrame:
    """doc_id, company_1, company_2: parties, else the first companies, else Not found."""
    two = top_entities(companies, 2).groupBy("doc_id").agg(F.max(F.when(F.col("rank") == 1, F.col("name"))).alias("c1"), F.max(F.when(F.col("rank") == 2, F.col("name"))).alias("c2"))
    rows = docs.select("doc_id").join(parties, "doc_id", "left").join(two, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("first", "c1", F.lit("Not found")).alias("company_1"), F.coalesce("second", "c2", F.lit("Not found")).alias("company_2"))


def extract_money(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\$[\d,]+\.?\d*"), F.lit(0))).alias("ordinal", "amount"))


def deterministic_answers(answers: DataFrame, dates: DataFrame, columns: DataFrame) -> DataFrame:
    """Fill open answers (doc_id, question_id, answer) for start_date, company_1 and company_2."""
    facts = dates.select("doc_id", F.lit("start_date").alias("question_id"), F.col("date").alias("fact")).unionByName(
        columns.select("doc_id", F.explode(F.create_map(F.lit("company_1"), "company_1", F.lit("company_2"), "company_2")).alias("question_id", "fact"))
    )
    return answers.join(facts, ["doc_id", "question_id"], "left").select("doc_id", "question_id", F.coalesce("answer", "fact").alias("answer"), (F.col("answer").isNull() & F.col("fact").isNotNull()).alias("filled"))
