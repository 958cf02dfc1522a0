"""Gates over answers, coverage, conversion and rules on small legal fixtures."""

import random

from lexmill.operators import gates


def issues_of(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.doc_id, set()).add(r.type)
    return got


def test_answers(spark):
    kind = "doc_id long, question_id string, answer string, confidence double, assessed boolean"
    good = [(1, q, f"A sufficiently long answer for {q}, number {i}", 0.9, True) for i, q in enumerate([*gates.REQUIRED_QUESTIONS, "indemnity"])]
    poor = [(2, q, "Not specified", 0.0, False) for q in ("governing_law", "term", "termination", "fee", "scope")] + [(2, "indemnity", "Yes, both sides", 0.2, False)]
    odd = [(3, "term", "It is perpetual and never ends at all", 0.9, True), (3, "termination", "With immediate effect at any time", 0.9, True), (3, "perpetual_term", "Yes", 0.9, None), (3, "fixed_term", "included", 0.9, None), (3, "unlimited_liability", "yes", 0.9, None), (3, "limitation_of_liability", None, 0.9, None)]
    same = [(4, f"q{i}", "the very same answer to all", 0.9, True) for i in range(8)]
    answers = spark.createDataFrame(good + poor + odd + same, kind)
    got = issues_of(gates.answer_review(answers))
    assert 1 not in got
    assert got[2] >= {"too_many_not_specified", "missing_required_fields", "low_average_confidence", "short_answers", "missing_risk_assessments"} and "contradictory_answers" not in got[2]
    assert got[3] >= {"contradictory_answers", "missing_required_fields"} and "repeated_answers" in got[4]
    assert {(r.a, r.b, r.kind) for r in gates.conflicts(answers).collect()} == {("term", "termination", "worded"), ("perpetual_term", "fixed_term", "exclusive")}


def test_unlabelled_amendments(spark):
    docs = spark.createDataFrame([(1, "This Amendment changes it."), (2, "This ADDENDUM changes it."), (3, "plain"), (4, None)], "doc_id long, text string")
    labelled = spark.createDataFrame([(1, ["Contract Modification"]), (2, ["term"]), (3, [])], "doc_id long, classes array<string>")
    assert {r.doc_id: r.unlabelled_amendment for r in gates.unlabelled_amendments(docs, labelled).collect()} == {1: False, 2: True, 3: False, 4: False}


def test_conversion(spark):
    good = "\n\n".join(f"[[page={n}]]\n# Section {n}\n" + "A sentence of ordinary length stands here. " * 10 for n in (1, 2, 3, 4, 5))
    poor = "\n".join(["<!-- image -->"] * 6 + ["a", "", "b", "c", "d", "e"])
    gap = good.replace("[[page=3]]", "")
    docs = spark.createDataFrame([(1, good), (2, poor), (3, gap), (4, None), (5, "| a | b |\n||||\n|||\n" + "��" * 900)], "doc_id long, text string")
    got = issues_of(gates.conversion_gate(gates.conversion_measures(docs)))
    assert 1 not in got and got[3] == {"missing_pages"}
    assert got[2] == {"insufficient_text", "no_page_anchors", "too_few_pages", "too_many_images", "poor_structure", "garbled_text"}  # 12 of 108 signs are angle brackets
    assert "insufficient_text" in got[4] and "garbled_text" in got[5]


def test_overlapping_evidence_equals_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        a = rng.randrange(-50, 5000)
        rows.append((rng.randrange(3), f"r{rng.randrange(6)}", rng.choice(["compliant", "non_compliant", "unknown"]), a, a + rng.choice([0, 1, 30, 700, 3000])))
    got = {tuple(r) for r in gates.overlapping_evidence(spark.createDataFrame(rows, "doc_id long, rule_id string, status string, start int, end int"), 100).collect()}
    want = {
        (a[0], a[1], b[1], max(a[3], b[3]), min(a[4], b[4])) for a in rows for b in rows
        if a[0] == b[0] and a[2] == "compliant" and b[2] == "non_compliant" and max(a[3], b[3]) < min(a[4], b[4])
    }
    assert got == want


def test_rules(spark):
    verdicts = spark.createDataFrame(
        [(1, "term", "compliant"), (1, "liability_cap", "non_compliant"), (2, "term", None), (2, "fee", "unknown"), (2, "liability_cap", "compliant"), (3, "fee", "compliant"), (3, "liability_cap", "non_compliant"), *((4, f"x{i}", "compliant") for i in range(6))],
        "doc_id long, rule_id string, status string",
    )
    evidence = spark.createDataFrame(
        [(1, "term", "The clause meets it", 0, 40), (1, "liability_cap", "It violates the cap", 50, 90), (3, "fee", "meets it", 0, 60), (3, "liability_cap", "It fails", 40, 90), (3, "fee", "non-compliant in part", 200, 220), *((4, f"x{i}", "non-compliant", 100 * i, 100 * i + 9) for i in range(6))],
        "doc_id long, rule_id string, text string, start int, end int",
    )
    got = {r.doc_id: r for r in gates.rule_review(verdicts, evidence, ["liability"]).collect()}
    assert (got[1].quality, got[1].issues, got[1].severity) == (1.0, [], "info")
    assert got[2].issues == ["mostly_unevaluated", "no_evidence", "critical_rules_missing"] and got[2].critical_missing == 1
    assert got[3].conflicting == 2 and got[3].issues == ["conflicting_evidence"] and abs(got[3].quality - 0.75) < 1e-9
    assert got[4].issues == ["all_the_same"] and got[4].conflicting == 0 and got[4].severity == "warning"
