"""Values at the edges: numbers out of range, sums on a threshold, quotes in another case."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lexmill import registry
from lexmill.operators import citations, pages, quality
from lexmill.operators.matches import matches
from tests.test_oracle import rows


def test_a_page_number_out_of_range_still_breaks(spark):
    docs = spark.createDataFrame([(1, "page 1\na\npage 5468294846167456848\nb\npage 3")], "doc_id long, text string")
    got = pages.page_marker_breaks(docs).orderBy("start_line").collect()
    assert [(r.page, r.start_line, r.end_line) for r in got] == [(1, 0, 2), (None, 2, 4), (3, 4, None)]


@pytest.fixture
def tables(tmp_path):
    """Writes tables that queries and their SQL read."""
    con = duckdb.connect()

    def write(**found):
        for name, sql in found.items():
            con.sql(f"copy ({sql}) to '{tmp_path}/{name}.parquet' (format parquet)")
            con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
        return str(tmp_path), con

    return write


def both(spark, name, sf_dir, con):
    df, q = registry.queries()[name](spark, sf_dir), con.sql(registry.oracle_sql()[name])
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(q.columns, q.fetchall())
    return got, want


def test_a_citation_in_another_case_is_found(spark, tables):
    documents = "select 1::bigint as doc_id, 'Before. ALL RIGHTS ARE Reserved here.' as text, 'en' as lang, 's' as source, 36::bigint as n_chars"
    sf_dir, con = tables(documents=documents, benchmark="select 1::bigint as item_id, 'all rights are reserved' as text union all select 2, 'no such words anywhere'")
    got, want = both(spark, "validate_citation", sf_dir, con)
    assert got == want and got[1] == ["(1, ())", "(2, ('not_found',))"]


def test_a_score_on_a_threshold(spark, tables):
    # 80 words of which 17 are asked for, seven names: 0.3 * 0.7 + 0.4 * 17 / 80 + 0.3 * 0.35, just under 0.4 in doubles
    names = ["Abc", "Abd", "Abe", "Abf", "Abg", "Abh", "Abi"]
    answer = " ".join(names + ["".join("abcdefghij"[int(d)] for d in f"{n:06d}") for n in range(73)])
    asked = " ".join(answer.split()[7:24])
    turns = [(1, asked, answer), (2, "who", "?!"), (3, "who", None)]
    lines = [f"select {c}::bigint as conv_id, {t}::int as turn, '{r}' as role, {'null' if x is None else repr(x)}::varchar as text" for c, q, a in turns for t, r, x in ((0, "user", q), (1, "assistant", a))]
    sf_dir, con = tables(conversations=" union all ".join(lines))
    got, want = both(spark, "answer_recommendation", sf_dir, con)
    assert got == want and got[1] == ["(1, 'REVIEW', 1)", "(2, 'REJECT', 1)", "(3, 'REJECT', 1)"]
    scores = spark.createDataFrame([(" ".join(names),), (None,)], "t string").select(quality.specificity(F.col("t")).alias("s")).collect()
    assert [r.s for r in scores] == [0.35, 0.0]


def test_contradictions_cover_conversations_and_documents(spark, sf_dir):
    queries = registry.queries()
    found = {(r.doc_id, r.a, r.b) for r in queries["contradictions"](spark, sf_dir).collect()}
    ruled = {(r.doc_id, r.a, r.b) for r in queries["affirmed_pairs"](spark, sf_dir).collect()}
    assert ruled and ruled < found and any(a == "q0" for _, a, _ in found)


def test_offsets_are_not_computed_by_a_filter(spark):
    found = matches(spark.range(3).selectExpr("id as doc_id", "'a b a' as text"), [("a", "word", "a"), ("b", "regex", "b")])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "aggregate(" in line]
    assert sorted((r.doc_id, r.pos) for r in found.collect()) == [(d, p) for d in range(3) for p in (0, 2, 4)]


def test_near_quotes_compute_one_bounded_distance(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "aa bb cc dd ee ff")], "doc_id long, text string")
    found = citations.fuzzy_quotes(docs, spark.createDataFrame([(7, "one two thrxx four five six")], "item_id long, text string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("levenshtein(") == 1 and "Some(" in plan.split("levenshtein(")[1].split("AS distance")[0]
    (r,) = found.collect()
    assert (r.doc_id, r.item_id) == (1, 7) and abs(r.similarity - (1 - 2 / 27)) < 1e-12
