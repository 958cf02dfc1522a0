"""Taxonomy labelling, chunking, budgets and paragraph passages against plain versions."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lexmill import registry
from lexmill.operators import citations, labels, retrieval

#: Compound terms and the labels they stand for.
COMPOUNDS = [
    ("termination for cause", ["TERMINATION", "DISPUTE_RESOLUTION"]), ("payment upon termination", ["PAYMENT", "TERMINATION"]),
    ("confidential information", ["CONFIDENTIALITY", "INTELLECTUAL_PROPERTY"]), ("warranty disclaimer", ["WARRANTY", "LIABILITY"]), ("indemnification cap", ["INDEMNIFICATION", "LIABILITY"]),
]


def sentences(spark, texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, sent_id int, text string")


def test_signs_length_and_compounds(spark):
    kw = spark.createDataFrame([("CONFIDENTIALITY", "non-disclosure"), ("LIABILITY", "Limit of total liability"), ("OTHER", "agreement"), ("NEVER", "§")], "label string, keyword string")
    s = sentences(spark, ["This mutual non-disclosure agreement has a limit of total liability", "Disclosure, non is no keyword; a limit of total", *(f"There is {t}, as said." for t, _ in COMPOUNDS), None, ""])
    got = {r.sent_id: r.classes for r in labels.label_sentences(s, kw, spark.createDataFrame(COMPOUNDS, "keyword string, labels array<string>")).collect()}
    assert got == {0: ["CONFIDENTIALITY", "LIABILITY", "OTHER"], **{i + 2: sorted(found) for i, (_, found) in enumerate(COMPOUNDS)}}


def test_both_paths_equal_plain_search(spark, monkeypatch):
    rng = random.Random(2)
    words = ["a", "b", "c", "d-e", "f", "B"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))) for _ in range(200)]
    keywords = [(f"l{rng.randrange(9)}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))) for _ in range(40)]
    cut = lambda t: re.findall("[a-z0-9_]+", t.lower())
    want = {}
    for i, t in enumerate(texts):
        w = cut(t)
        found = {label for label, k in keywords for j in range(len(w)) if w[j : j + len(cut(k))] == cut(k)}
        if found:
            want[i] = sorted(found)
    s, kw = sentences(spark, texts), spark.createDataFrame(keywords, "label string, keyword string")
    for most in (10_000, 5):
        monkeypatch.setattr(labels, "MOST_KEYWORDS", most)
        assert {r.sent_id: r.classes for r in labels.label_sentences(s, kw).collect()} == want


def greedy(sizes, budget):
    out, first, n = [], 0, 0
    for i, x in enumerate(sizes):
        if i > first and n + x > budget:
            out.append((first, i - 1, n))
            first, n = i, 0
        n += x
    return [*out, (first, len(sizes) - 1, n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_chunks_equal_a_loop(spark, seed):
    rng = random.Random(seed)
    docs = {d: [rng.choice([0, 1, 3, 9, 40]) for _ in range(rng.randrange(1, 60))] for d in range(30)}
    rows = [(d, 5 * i + 2, n) for d, sizes in docs.items() for i, n in enumerate(sizes)]
    got = {}
    for r in labels.token_chunks(spark.createDataFrame(rows, "doc_id long, sent_id int, n_tokens int").repartition(3), 20).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append((r["first"], r["last"], r.n_tokens))
    assert got == {d: [(5 * a + 2, 5 * b + 2, n) for a, b, n in greedy(sizes, 20)] for d, sizes in docs.items()}


def test_chunks_of_a_very_long_document(spark):
    sizes = F.pmod(F.xxhash64("id"), F.lit(40)).cast("int")
    long = spark.range(1_000_000).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("sent_id"), sizes.alias("n_tokens")).cache()
    plain = greedy([r.n_tokens for r in long.orderBy("sent_id").select("n_tokens").collect()], 2000)
    began = time.time()
    got = [(r["first"], r["last"], r.n_tokens) for r in labels.token_chunks(long, 2000).orderBy("chunk").collect()]
    assert got == plain and time.time() - began < 90


def test_context_has_two_sides(spark):
    t = [(1, "q", i, "word " * n) for i, n in enumerate([3, 4, 5, 90])] + [(2, "q", 0, "word " * 80)]
    r = [(1, "q", i, "other " * n) for i, n in enumerate([6, 7, 8, 9])] + [(2, "q", 0, "short one"), (3, "q", 0, "no target")]
    kind = "doc_id long, question_id string, sent_id int, text string"
    count = lambda s: len(re.findall(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]", s))

    def fit(texts, limit):
        out, used = [], 0
        for k, x in enumerate(texts, 1):
            used += count(f"{k}. {x}")
            if used > limit:
                break
            out.append(f"{k}. {x}")
        return "\n".join(out)

    got = {row.doc_id: row for row in labels.question_context(spark.createDataFrame(t, kind), spark.createDataFrame(r, kind), 50).collect()}
    assert set(got) == {1, 2} and got[2].target == "No relevant clauses found." and got[2].reference == "1. short one"
    assert got[1].target == fit([x[3] for x in t[:4]], 25) and got[1].reference == fit([x[3] for x in r[:4]], 50 - count(got[1].target))
    assert got[1].tokens == count(got[1].target) + count(got[1].reference) <= 50


def test_paragraphs_of_a_raw_text(spark):
    paras = ["The Supplier shall not be obligated to offer Most Favored Nation pricing.", "Customer acknowledges no matching discount or equal or better pricing obligations apply.", "Pricing is determined independently without comparable pricing guarantees."]
    p = spark.createDataFrame([(1, i, t) for i, t in enumerate(paras)], "doc_id long, para_id int, text string")
    terms = spark.createDataFrame([("mfn", w) for w in ("most", "favored", "nation", "matching", "pricing", "discount")], "rule_id string, token string")
    (wide,) = retrieval.paragraph_fallback(p, terms, window=2).collect()  # one window covers the document
    assert (wide.indices, wide.chunk, wide.para_id) == ([0, 1, 2], "\n".join(paras), 0)
    near = retrieval.paragraph_fallback(p, terms, window=1).orderBy("rank").collect()
    assert [(r.para_id, r.indices) for r in near] == [(0, [0, 1]), (1, [0, 1, 2]), (2, [1, 2])]
    (merged,) = retrieval.merged_passages(p, retrieval.paragraph_scores(p, terms), 1).collect()
    assert merged.indices == [0, 1, 2]


def test_passages_do_not_overlap(spark):
    rng = random.Random(9)
    rows, want = [], set()
    for d in range(25):
        n, w = rng.randrange(1, 30), 2
        hits = [i for i in range(n) if rng.random() < 0.15]
        rows += [(d, i, "needle here" if i in hits else f"hay {i}") for i in range(n)]
        covered = sorted({j for i in hits for j in range(max(0, i - w), min(n - 1, i + w) + 1)})
        for j in covered:
            if j - 1 not in covered:
                want.add((d, tuple(x for x in covered if x >= j and all(y in covered for y in range(j, x)))))
    p = spark.createDataFrame(rows, "doc_id long, para_id int, text string")
    terms = spark.createDataFrame([("r", "needle")], "rule_id string, token string")
    got = retrieval.merged_passages(p, retrieval.paragraph_scores(p, terms), 2).collect()
    assert {(r.doc_id, tuple(r.indices)) for r in got} == want


def test_keywords_stand_for_themselves(spark):
    s = sentences(spark, ["The fee (annual) is due.", "A C+ grade and Liability."]).withColumn("page", F.lit(1))
    assert citations.fallback_citation(s, ["fee (annual"]).first().sent_id == 0
    assert {r.rule_id: r.sent_id for r in retrieval.keyword_sections(s, [("a", ["Liability"]), ("b", ["c+"]), ("c", ["(ANNUAL)"])]).collect()} == {"a": 1, "b": 1, "c": 0}
    asked = spark.createDataFrame([], "question_id string, doc_id long")
    assert labels.keyword_fallback(s, {"q": ["C+"]}, asked).first().sent_id == 1


def broadcast_parts(plan):
    """The text below each broadcast of a plan."""
    lines = plan.splitlines()
    depth = [len(re.match(r"[\s:+\-*()\d]*", x).group()) for x in lines]
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            j = i + 1
            while j < len(lines) and depth[j] > depth[i]:
                j += 1
            yield "\n".join(lines[i:j])


@pytest.mark.parametrize("name", ["label_sentences", "label_taxonomy", "paragraph_scores", "paragraph_fallback", "bm25", "top_k_chunks", "term_index", "coverage_gate", "keyword_sections", "token_chunks"])
def test_no_document_rows_are_broadcast(spark, sf_dir, name):
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not [p for p in broadcast_parts(plan) if "parquet" in p]


def test_labelling_needs_no_shuffle(spark, sf_dir):
    plan = registry.queries()["label_sentences"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
