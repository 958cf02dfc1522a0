"""Inline legal fixtures with hand-computed values."""

import json

import pytest
from pyspark.sql import functions as F

from lexmill.functions import lexicons as L
from lexmill.functions.surface import LexiconScorer, apply, run_scorer, transform
from lexmill.operators import citations, entities, gates, labels, pages, quality, retrieval, risk, rules, runs, sheets, text
from lexmill.sources import files, tables


def one(df):
    (row,) = df.collect()
    return row


def test_clean_text_and_sentences(spark):
    t = "# Term and Termination Clause\n\n<!-- image -->\n\nThis Agreement starts on January 1, 2024.  The  term is three full years. Short one.\nIt continues here &lt;b&gt;\n\n1. The first item of this list is long enough to stay\n\n| a | b | c | d | e | f | g | h | i |"
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    got = [r.text for r in text.sentences(df).orderBy("sent_id").collect()]
    assert got == ["Term and Termination Clause", "This Agreement starts on January 1, 2024.", "The  term is three full years.", "1. The first item of this list is long enough to stay"][:2] + got[2:]
    assert got[0] == "Term and Termination Clause" and got[-1].startswith("1. The first") and not any("image" in s or s.startswith("|") for s in got)
    stats = one(text.sentence_stats(df))
    assert (stats.paragraphs, stats.skipped, stats.sentences) == (5, 1, len(got))


def test_document_type_and_title(spark):
    df = spark.createDataFrame([(1, "acme_nda.md", "Mutual Non-Disclosure Agreement\nThis confidentiality agreement binds both."), (2, "x.txt", "nothing here")], "doc_id long, name string, text string")
    got = {r.doc_id: (r.type, r.confidence) for r in text.doc_type(df, L.DOC_TYPE_PATTERNS).collect()}
    assert got[1] == ("nda", 0.6) and got[2] == ("Unknown", 0.0)
    assert one(text.doc_title(df)).title == "Mutual Non-Disclosure Agreement"
    assert one(df.where("doc_id = 1").select(text.filename_type(F.col("name"), L.DOC_TYPE_PATTERNS).alias("t"))).t == "nda"


def test_image_ratio_and_structure(spark):
    doc = "\n".join(["<!-- image -->"] * 6 + ["a", "", "b", "c", "d", "e"])
    row = one(spark.createDataFrame([(1, doc)], "doc_id long, text string").select(text.image_ratio(F.col("text")).alias("r")))
    assert row.r == pytest.approx(6 / 11)


def test_anchors(spark):
    t = "[[page=1]]\nOne. Two.\n[[page=2]]\nThree. Four.\n[[page=3]]\nFive."
    df = spark.createDataFrame([(3, t)], "doc_id long, text string")
    a = pages.extract_anchors(df)
    assert [(r.page, r.pos) for r in a.orderBy("pos").collect()] == [(n, t.index(f"[[page={n}]]")) for n in (1, 2, 3)]
    asks = spark.createDataFrame([(3, t.index(w)) for w in ("One", "Two", "Three", "Four", "Five")], "doc_id long, pos int")
    assert [r.page for r in pages.page_of_position(asks, a).orderBy("pos").collect()] == [1, 1, 2, 2, 3]
    assert pages.validate_anchors(a).count() == 0 and one(pages.missing_pages(a)).missing == []
    odd = spark.createDataFrame([(1, 1, 0), (1, 3, 9), (1, 3, 20), (1, 2, 30)], "doc_id long, page int, pos int")
    assert {(r.issue, r.page) for r in pages.validate_anchors(odd).collect()} == {("duplicate", 3), ("out_of_order", 2)}
    assert [(r.text, r.page) for r in pages.anchored_text(df).orderBy("ordinal").collect()] == [("One. Two.", 2), ("Three. Four.", 3)] or pages.anchored_text(df).count() == 2


def test_retrieval(spark):
    s = spark.createDataFrame([(1, i, x) for i, x in enumerate(["This agreement starts today.", "Each party shall indemnify the other party.", "Indemnification covers losses.", "Fees are due monthly."])], "doc_id long, sent_id int, text string")
    rule = spark.createDataFrame([("r", "Indemnity", "Indemnification", "indemnify party")], "rule_id string, name string, description string, rule_text string")
    terms = rule.select("rule_id", F.explode(retrieval.query_terms([F.col("name"), F.col("description"), F.col("rule_text")], F.array().cast("array<string>"))).alias("token"))
    assert [r.token for r in terms.collect()] == ["indemnity", "indemnification", "indemnify", "party"]
    top = retrieval.top_k_chunks(retrieval.bm25(s, terms), retrieval.window_chunk(s), 2).collect()
    assert top and all("indemn" in r.chunk.lower() for r in top)


def test_rules_are_normalised_and_checked(spark, tmp_path):
    rows = spark.createDataFrame([("Most Favored Nation", "Yes", "High", "pricing, discount, mfn", "Prices must match"), ("", None, None, "", "")], "name string, default_status string, severity string, keywords string, rule_text string")
    got = rules.normalise_rules(rows)
    r = got.where("name <> ''").first()
    assert (r.rule_id, r.default_status, r.severity, r.keywords[0]) == ("most_favored_nation", "compliant", "high", "pricing")
    assert [len(r.issues) > 0 for r in rules.rule_issues(got).orderBy("name").collect()] == [True, False]
    (tmp_path / "a.json").write_text(json.dumps({"rules": [{"id": "x", "name": "n", "keywords": ["k"], "severity": "critical"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"id": "y", "name": "m"}]))
    assert {r.id for r in files.scan_rules_json(spark, str(tmp_path)).collect()} == {"x", "y"}
    (tmp_path / "r.csv").write_text("Rule Name,Rule Text\na,b\n")
    assert files.scan_rules_csv(spark, str(tmp_path / "r.csv")).columns == ["rule_name", "rule_text"]
    (tmp_path / "v2").mkdir()
    (tmp_path / "v2" / "c.json").write_text(json.dumps({"rules": [{"rule_id": "T-1", "enabled": False}, {"rule_id": "T-2", "deterministic_checks": {"required_keywords": ["k"], "proximity_rules": [{"terms": ["a", "b"], "max_distance": 3}]}}]}))
    assert files.scan_rules_checked(spark, str(tmp_path / "v2")).count() == 0
    checked = one(files.scan_rules_checked(spark, str(tmp_path / "v2"), keep_broken=True))
    assert {"rule_id: pattern", "category: not allowed", "compliance_levels: required"} <= set(checked.issues)
    assert (checked.rule_id, checked.priority, checked.deterministic_checks.proximity_rules[0].max_distance) == ("T-2", "medium", 3)


def test_deterministic_verdicts(spark):
    docs = spark.createDataFrame([(1, "The fee is due. The fee shall be paid within thirty days."), (2, "A secret token is here."), (3, "nothing")], "doc_id long, text string")
    sents = text.period_split(docs).withColumnRenamed("part_id", "sent_id")
    checks = [rules.Checks("pay", ["fee"], [], [r"within \w+ days"], [("fee", "paid", 3)], ["due"]), rules.Checks("safe", [], ["token"])]
    got = {(r.doc_id, r.rule_id): (r.status, round(r.confidence, 3)) for r in rules.deterministic_verdicts(docs, sents, checks).collect()}
    assert got[(1, "pay")] == ("compliant", round((1 + 0.9 + 0.8 + 0.5) / 4, 3))
    assert got[(2, "safe")] == ("non_compliant", 0.9) and got[(3, "pay")] == ("unknown", 0.0)


def test_responses(spark):
    rs = ['{"status": "compliant", "rationale": "meets requirement"}', "not-json", 'Sure: ```json\n{"status": "Non_Compliant", "confidence": 0.8, "issues": ["a", "b"]}\n``` ok', '{"status": "odd"}', None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rs)], "i int, response string")
    s = [r.s.asDict() for r in df.select("i", rules.parse_status(F.col("response")).alias("s")).orderBy("i").collect()]
    assert s[0] == {"status": "compliant", "error": None} and s[1] == {"status": "unknown", "error": "parse_error"} and s[4]["status"] == "unknown"
    v = [r.v for r in df.select("i", rules.parse_verdict(F.col("response")).alias("v")).orderBy("i").collect()]
    assert (v[1].status, v[1].confidence) == ("requires_review", 0.5)
    assert (v[2].status, v[2].confidence, v[2].rationale) == ("non_compliant", 0.8, "\n- a\n- b")


def test_entities(spark):
    t = 'This Agreement is entered into on January 1, 2024, between Acme Solutions Inc. ("Acme") and Beta Corp, for a fee of $1,200.50. The term ends 2026-12-31.'
    df = spark.createDataFrame([(4, t), (5, None), (6, "")], "doc_id long, text string")
    d = entities.extract_dates(df)
    assert {r.date for r in d.collect()} == {"2024-01-01", "2026-12-31"}
    s = one(entities.start_date(df, d))
    assert (s.date, s.confidence_pct) == ("2024-01-01", 100)
    p = one(entities.contract_parties(df))
    assert p["first"] == "Acme Solutions Inc" and p["second"].startswith("Beta Corp")
    c = entities.dedupe_companies(entities.extract_companies(df))
    assert {"Beta Corp"} <= {r.name for r in c.collect()}
    cols = entities.company_columns(df, entities.contract_parties(df), c).where("doc_id = 5").first()
    assert (cols.company_1, cols.company_2) == ("Not found", "Not found")
    assert one(entities.extract_money(df.where("doc_id = 4"))).amount == "$1,200.50"
    a = spark.createDataFrame([(4, "start_date", None), (4, "fee", "x")], "doc_id long, question_id string, answer string")
    filled = {r.question_id: (r.answer, r.filled) for r in entities.deterministic_answers(a, entities.start_date(df, d), entities.company_columns(df, entities.contract_parties(df), c)).collect()}
    assert filled == {"start_date": ("2024-01-01", True), "fee": ("x", False)}


def test_red_flags_and_risk(spark):
    s = spark.createDataFrame(
        [(1, 0, "Customer accepts unlimited liability."), (1, 1, "Customer shall indemnify the provider and we indemnify nobody"), (1, 2, "Customer shall indemnify the provider."), (1, 3, "Provider may terminate for convenience immediately.")],
        "doc_id long, sent_id int, text string",
    )
    hits = risk.red_flag_hits(s)
    got = {(r.sent_id, r.title) for r in hits.collect()}
    assert (0, "Unlimited Liability Exposure") in got and (2, "One-Sided Indemnification") in got and (1, "One-Sided Indemnification") not in got
    level = one(risk.red_flag_level(risk.red_flag_counts(hits)))
    assert level.level == "CRITICAL"
    assert one(risk.negotiation_points(hits)).points[0].startswith("1. CRITICAL")
    scores = {r.sent_id: r.score for r in risk.risk_score(risk.risk_indicators(s)).collect()}
    assert scores[0] == 100.0 and scores[3] == 75 or scores[3] >= 50
    assert one(risk.risk_profile(risk.risk_score(risk.risk_indicators(s)))).level == "critical"


def test_gates(spark):
    v = spark.createDataFrame([(1, ["term"], 0.9), (1, ["fee"], 0.9), (2, ["none"], 0.1), (2, ["no-class"], 0.2), (2, ["term"], 0.3), (2, [], 0.1)], "doc_id long, classes array<string>, confidence double")
    m = gates.coverage(v, ["term", "fee"])
    assert {r.doc_id: r.coverage for r in m.collect()} == {1: 1.0, 2: 0.25}
    sev = {r.doc_id: (r.severity, r.passed) for r in gates.gate_severity(v.select("doc_id").distinct(), gates.coverage_gate(m, 2)).collect()}
    assert sev[2] == ("high", False) and sev[1][1]
    again = gates.rerun(spark.createDataFrame([(1, "high", 1), (2, "high", 3), (3, "low", 0)], "doc_id long, severity string, attempts int"), F.col("attempts"))
    assert {r.doc_id: r.rerun for r in again.collect()} == {1: True, 2: False, 3: False}
    answers = spark.createDataFrame([(1, "q1", "Yes, always"), (1, "q2", "yes"), (1, "q3", "no")], "doc_id long, question_id string, answer string")
    assert [(r.a, r.b) for r in gates.contradictions(answers, [("q1", "q2"), ("q1", "q3")]).collect()] == [("q1", "q2")]


def test_citations(spark):
    a = spark.createDataFrame([(1, "The term of this agreement is 5 years from the effective date"), (2, ""), (3, "completely different words in this answer")], "answer_id long, answer string")
    s = spark.createDataFrame([(1, 0, "The term of this agreement is 5 years.", 3), (1, 1, "Fees are due.", 5), (3, 0, "Nothing alike.", None)], "answer_id long, sent_id int, sentence string, page int")
    got = {(r.answer_id, r.sent_id): (r.type, r.confidence) for r in citations.answer_citations(a, s).collect()}
    assert got[(1, 0)] == ("quote", 1.0) and got[(2, None)] == ("not_found", 0.0) and got[(3, 0)] == ("inference", 0.3)
    nb = spark.createDataFrame([(1, 1, 1), (1, 2, None), (1, 3, 2), (1, 4, None), (1, 5, 3)], "doc_id long, sent_id int, page int")
    assert [r.page for r in citations.backfill_page(nb, 1).orderBy("sent_id").collect()] == [1, 1, 2, 2, 3]


def test_labels_and_scores(spark):
    sents = spark.createDataFrame([(1, 0, "Intellectual property rights stay."), (1, 1, "No match here")], "doc_id long, sent_id int, text string")
    kw = spark.createDataFrame([("ip_rights", "intellectual property"), ("term", "expire")], "label string, keyword string")
    lab = labels.label_sentences(sents, kw)
    assert one(lab).classes == ["ip_rights"]
    q = spark.createDataFrame([("q", ["ip"])], "question_id string, terms array<string>")
    alias = spark.createDataFrame([("ip_rights", "ip")], "alias string, canonical string")
    assert one(labels.question_sentences(lab, q, alias)).sent_id == 0
    chunks = labels.token_chunks(spark.createDataFrame([(1, i, n) for i, n in enumerate([5, 5, 5, 30, 2])], "doc_id long, sent_id int, n_tokens int"), 12)
    assert [(r["first"], r["last"], r.n_tokens) for r in chunks.orderBy("chunk").collect()] == [(0, 1, 10), (2, 2, 5), (3, 3, 30), (4, 4, 2)]
    y = spark.createDataFrame([("Yes, it does have one",), ("It does not",), ("Not specified",), ("maybe",)], "a string").select(quality.yes_no(F.col("a")).alias("x"))
    assert [r.x.verdict for r in y.collect()] == ["Y", "N", "N/A", "Review"]
    todo = sheets.review_checklist(spark.createDataFrame([(1, 3, 1, 0), (2, 0, 0, 0), (3, 2, 0, 0)], "doc_id long, answers int, failed int, low int"))
    assert {(r.doc_id, r.priority) for r in todo.collect()} == {(1, "high"), (2, "high")}


def test_errors_and_rollout(spark):
    e = spark.createDataFrame([("pdf_node", "x", "ValueError"), ("n", "Request timeout", "TimeoutError"), ("n", "missing required configuration", "KeyError")], "node string, message string, kind string")
    e = e.withColumn("category", runs.error_category(F.col("node"), F.col("message"), F.col("kind")))
    assert [(r.category, r.s) for r in e.select("category", runs.error_severity(F.col("category"), F.col("message"), F.col("kind")).alias("s")).collect()] == [("pdf_processing", "recoverable"), ("llm_api", "recoverable"), ("data_validation", "critical")]
    ids = spark.range(50).select(F.col("id").cast("string").alias("id"))
    import hashlib

    got = {r.id: r.b for r in ids.select("id", runs.rollout_bucket("f", F.col("id")).alias("b")).collect()}
    assert got == {str(i): int(hashlib.md5(f"f:{i}".encode()).hexdigest(), 16) % 100 for i in range(50)}


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "doc_id long, x string, ts int")
    new = spark.createDataFrame([(2, "c", 2, 9), (2, "d", 3, 9), (3, "e", 2, 9)], "doc_id long, x string, ts int, y int")
    path = str(tmp_path / "t")
    tables.upsert(spark, path, old, ["doc_id"], "ts")
    for _ in range(2):  # a second time changes nothing
        tables.upsert(spark, path, new, ["doc_id"], "ts")
        assert {(r.doc_id, r.x) for r in tables.read_version(spark, path).collect()} == {(1, "a"), (2, "d"), (3, "e")}
    p2 = str(tmp_path / "p")
    tables.append_rows(old, str(tmp_path / "q"))
    tables.replace_rows(old, p2, buckets=2)
    tables.replace_rows(new.select("doc_id", "x", "ts").where("doc_id = 3"), p2, buckets=2)
    tables.replace_rows(new.select("doc_id", "x", "ts").where("x = 'd'"), p2, buckets=2)
    assert {(r.doc_id, r.x) for r in spark.read.parquet(p2).collect()} == {(1, "a"), (2, "d"), (3, "e")}
    assert len(tables._versions(spark, path)) == 2
    tables.write_run(old.withColumn("run_id", F.lit("r1")), str(tmp_path / "runs"))
    assert files.scan_run_logs(spark, str(tmp_path / "runs"), "doc_id long, x string, run_id string").count() == 2


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("one")
    (tmp_path / "sub" / "b.txt").write_text("two")
    (tmp_path / "c.pdf").write_text("no")
    assert {r.text for r in files.scan_corpus(spark, str(tmp_path)).collect()} == {"one", "two"}
    raw = spark.createDataFrame([(bytearray("é".encode()),), (bytearray("é".encode("latin-1")),)], "content binary")
    assert [r.t for r in raw.select(files.decode_text(F.col("content")).alias("t")).collect()] == ["é", "é"]
    sets = spark.createDataFrame([("s", "x"), ("t", "y")], "set_id string, reference_path string")
    assert one(files.scan_document_sets(sets, spark.createDataFrame([("x",)], "path string"))).set_id == "s"


def test_user_surface(spark):
    @transform("upper_text")
    def upper(df):
        return df.withColumn("text", F.upper("text"))

    df = spark.createDataFrame([(1, "the fee"), (2, None)], "doc_id long, text string")
    assert apply(df, "upper_text").first().text == "THE FEE"
    got = {r.doc_id: (r.label, r.error) for r in run_scorer(df, LexiconScorer({"fees": ["fee"]}), ["doc_id"]).collect()}
    assert got == {1: ("fees", None), 2: ("none", None)}

    class Picky:
        schema = "label string"

        def score(self, batch):
            if batch["text"].isna().any():
                raise ValueError("no text")
            return batch[["text"]].rename(columns={"text": "label"})

    whole = run_scorer(df.coalesce(1), Picky(), ["doc_id"]).collect()  # one bad row costs itself alone
    assert {r.doc_id: (r.label, r.error) for r in whole} == {1: ("the fee", None), 2: (None, "ValueError('no text')")}

    class Broken:
        schema = "label string"

        def score(self, batch):
            raise ValueError("x")

    assert all(r.error and r.label is None for r in run_scorer(df, Broken(), ["doc_id"]).collect())
