"""Plans stay as designed: no Cartesian products, equality joins for tokens, early top-k."""

import pytest

from lexmill import registry

PLANS = ["bm25", "label_sentences", "locate_quote", "first_quote", "paragraph_scores", "deterministic_verdict", "compliance_documents"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANS)
def test_no_pairwise_joins(spark, sf_dir, name):
    text = plan(registry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["top_k_chunks", "keyword_fallback", "top_entities"])
def test_top_k_is_cut_before_the_shuffle(spark, sf_dir, name):
    assert "WindowGroupLimit" in plan(registry.queries()[name](spark, sf_dir))


def test_scans_read_only_what_they_need(spark, sf_dir):
    text = plan(registry.queries()["latency_stats"](spark, sf_dir))
    assert "ReadSchema: struct<value:double>" in text


@pytest.mark.parametrize("name", ["sentences", "reference_sentences", "sentence_stats"])
def test_sentences_are_numbered_without_a_shuffle(spark, sf_dir, name):
    assert "Exchange" not in plan(registry.queries()[name](spark, sf_dir))


def test_bm25_cuts_texts_once_and_shuffles_once(spark, sf_dir):
    text = plan(registry.queries()["bm25"](spark, sf_dir))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("FileScan") == 1


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
