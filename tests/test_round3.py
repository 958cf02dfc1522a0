"""Findings of round 3."""

import glob
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from lexmill.operators import labels, retrieval, rules
from lexmill.plans import label_queries, retrieval_queries, rule_queries, run_queries
from lexmill.plans.run_queries import _stream


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_stream_is_written_by_as_many_tasks_as_read_it(spark):
    """two tasks wrote, and so read, the whole input."""
    rows = spark.range(0, 1000, 1, 7).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    path, _ = _stream(rows, "files")
    assert len(glob.glob(path.removeprefix("file://") + "/in/part-*.parquet")) == 7


def test_near_terms_are_asked_of_the_row(spark, sf_dir):
    """verdicts shuffled every position of every term and met them in bins."""
    plan = plan_of(rule_queries.q_deterministic_verdict(spark, sf_dir))
    assert "Window" not in plan and plan.count("Join") == 1  # of the hints
    assert plan.count("lower(text") == 1 + sum(bool(c.hints) for c in rule_queries.CHECKS)  # the document's once, its short sentences'


def test_near_terms_equal_the_pairs_of_positions(spark):
    rng = random.Random(3)
    words = ["with", "from", "fro", "romp", "aXa", "abab", "ab", "x", "\n", "é😀", "withfrom"]
    texts = ["".join(rng.choice(words) + " " * rng.randrange(9) for _ in range(rng.randrange(12))) for _ in range(400)]
    docs = spark.createDataFrame([*enumerate(texts), (1000, None)], "doc_id long, text string")
    checks = [rules.Checks(f"{a}{b}{d}", near=[(a, b, d)]) for a, b in (("with", "from"), ("from", "romp"), ("with", "with"), ("abab", "ab"), ("é😀", "x")) for d in (0, 1, 3)]
    want = {(r.doc_id, r.rule_id) for r in rules.proximity_hits(docs, checks).collect()}
    asked = {r.rule_id for r in rules.factor_rows(docs, checks).where("near").select("rule_id").distinct().collect()}
    assert not any(r.startswith("abab") for r in asked)  # words that overlap themselves keep the joins
    empty = docs.select("doc_id", F.lit(0).alias("sent_id"), F.lit("").alias("text"))
    got = rules.deterministic_verdicts(docs, empty, [*checks, rules.Checks("hint", hints=["zz"])])
    assert {(r.doc_id, r.rule_id) for r in got.where("confidence > 0").collect()} == want and want


def test_coverage_reads_each_text_once_for_labels(spark, sf_dir):
    """sentences were cut four times and labelled twice, and met by joins of all sentences."""
    plan = plan_of(run_queries.coverage(spark, sf_dir))
    assert plan.count(" parquet") == 2 and plan.count("Join") == 1


def test_classes_keep_all_sentences(spark):
    sents = spark.createDataFrame([(1, 0, "Released under a license of the of the", 5), (1, 1, "nothing", 6), (1, 2, "OF THE", 7), (1, 3, None, 8), (1, 4, "of the-under", 9)], "doc_id long, sent_id int, text string, n int")
    words = spark.createDataFrame([("a", "license"), ("b", "released under a license"), ("c", "of the"), ("d", "the under")], "label string, keyword string")
    got = {r.sent_id: (r.n, r.classes) for r in labels.with_classes(sents, words).collect()}
    assert got == {0: (5, ["a", "b", "c"]), 1: (6, None), 2: (7, ["c"]), 3: (8, None), 4: (9, ["c", "d"])}
    assert {r.sent_id: r.classes for r in labels.label_sentences(sents, words).collect()} == {k: c for k, (_, c) in got.items() if c}
    most, labels.MOST_KEYWORDS = labels.MOST_KEYWORDS, 1
    try:
        assert {r.sent_id: (r.n, r.classes) for r in labels.with_classes(sents, words).collect()} == got
    finally:
        labels.MOST_KEYWORDS = most


def test_tokens_are_counted_in_one_pass(spark):
    """each distinct token was compared with all tokens of its sentence."""
    rng = random.Random(5)
    own = [[], ["a"], ["b", "a", "b"], [f"t{rng.randrange(30_000)}" for _ in range(40_000)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(own)], "i int, t array<string>")
    start = time.time()
    got = {r.i: {x.token: x.tf for x in r.xs} for r in df.select("i", retrieval.counted_tokens(F.col("t")).alias("xs")).collect()}
    assert got == {i: Counter(t) for i, t in enumerate(own)} and time.time() - start < 30


def test_question_clauses_equal_the_join(spark, sf_dir):
    """hits were joined with all sentences, and both sides cut and labelled the texts again."""
    named = labels.with_classes(label_queries.sents(spark, sf_dir), label_queries.keyword_dim(spark))
    asked = label_queries.questions(spark)
    want = sorted(map(tuple, label_queries.question_hits(spark, sf_dir).collect()))
    rows = labels.question_clauses(named, *asked).select("question_id", "doc_id", "sent_id")
    assert sorted(map(tuple, rows.collect())) == want and want and "Join" not in plan_of(rows)


def test_fallback_texts_are_grouped_by_document_only(spark, sf_dir):
    """the text of each paragraph was shuffled once more for every rule and rank that shows it."""
    plan = plan_of(retrieval_queries.q_paragraph_fallback(spark, sf_dir))
    assert not re.search(r"Aggregate \[rule_id#\d+, doc_id#\d+L?, rank", plan)
    paras = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a b", "b", "c", "c a", "x"])] + [(2, 0, "a")], "doc_id long, para_id int, text string")
    terms = spark.createDataFrame([("r", "a"), ("q", "c")], "rule_id string, token string")
    got = {(r.rule_id, r.doc_id, r.rank): (r.para_id, r.indices, r.chunk) for r in retrieval.paragraph_fallback(paras, terms).collect()}
    assert got == {("r", 1, 1): (0, [0, 1], "a b\nb"), ("r", 1, 2): (3, [2, 3, 4], "c\nc a\nx"), ("r", 2, 1): (0, [0], "a"), ("q", 1, 1): (2, [1, 2, 3], "b\nc\nc a"), ("q", 1, 2): (3, [2, 3, 4], "c\nc a\nx")}
