"""Match offsets and contexts against plain Python, and that no Python worker is needed."""

import random
import re

import pytest

from lexmill import registry
from lexmill.operators import matches as M
from lexmill.operators import risk, rules


def plain(text, patterns, around=50):
    out, low = [], text.lower()
    for n, (name, kind, p) in enumerate(patterns):
        if kind == "regex":
            spans = [m.span() for m in re.finditer(p, text, re.IGNORECASE | re.MULTILINE)]
        else:
            spans = [(i, i + len(p)) for i in range(len(text)) if low.startswith(p.lower(), i)]
            spans = spans[:1] if kind == "first" else spans
        out += [(n, name, a, b, text[a:b], text[max(0, a - around) : b + around]) for a, b in spans]
    return sorted(out)


def test_matches_equal_plain_search(spark):
    rng = random.Random(5)
    parts = ["fee", "Fee", " ", "a", "aa", "aaa", "\n", "é", "\U0001f600", "x", "xx", "12", ".", "(annual", "the term "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 120))) for _ in range(60)] + ["aa" * 3000 + " end fee", "", "fee"]
    patterns = [("w", "word", "aa"), ("x", "word", "xx"), ("paren", "word", "fee(annual"), ("first", "first", "FEE"), ("r", "regex", r"fee\s?|\d+"), ("line", "regex", r"^a+$"), ("long", "regex", r"a{40,}")]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)] + [(999, None, "kept")], "doc_id long, text string, name2 string")
    got = {}
    for r in M.matches(df, patterns).collect():
        got.setdefault(r.doc_id, []).append((r.ordinal, r.name, r.pos, r.end, r.raw, r.context))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == plain(t, patterns)
    assert 999 not in got
    with pytest.raises(ValueError, match="empty"):
        M.matches(df, [("bad", "regex", "a*")])


def test_keyword_and_pattern_evidence(spark):
    df = spark.createDataFrame([(1, "The Fee (annual) is due. fee, FEE. Token here, token there. Within thirty days.")], "doc_id long, text string")
    checks = [rules.Checks("pay", ["fee", "fee (annual"], ["token"], [r"within \w+ days"]), rules.Checks("also", ["fee"])]
    got = sorted((r.rule_id, r.kind, r.pattern, r.pos, r.confidence) for r in rules.keyword_matches(df, checks).collect())
    at = [4, 25, 30]
    assert got == sorted([("also", "keyword", "fee", p, 1.0) for p in at] + [("pay", "keyword", "fee", p, 1.0) for p in at] + [("pay", "keyword", "fee (annual", 4, 1.0), ("pay", "forbidden", "token", 35, -1.0)])
    (r,) = rules.regex_matches(df, checks).collect()
    at = df.first().text.index("Within")
    assert (r.pos, r.end, r.confidence) == (at, at + len("Within thirty days"), 0.9) and r.context.endswith("Within thirty days.")


def test_red_flags_have_place_and_context(spark):
    s = spark.createDataFrame([(1, 0, "x" * 60 + " unlimited liability applies to both and unlimited liability again", "Liability", 3), (1, 1, "nothing", None, None)], "doc_id long, sent_id int, text string, section_name string, page_number int")
    got = sorted((r.pos, r.location, r.detected_text) for r in risk.red_flags(s, [("liability", "critical", "unlimited liability", "t", "a", "i")]).collect())
    assert [g[0] for g in got] == [61, 101] and {g[1] for g in got} == {"Section: Liability, Page: 3"} and got[0][2].startswith("x" * 49 + " unlimited")


def test_intents_quote_their_evidence(spark):
    rows = [(1, i, f"Sentence {i} has a Token (c). [[page={i}]]") for i in range(7)] + [(2, 0, "Nothing here."), (3, 0, "A license.")]
    s = spark.createDataFrame(rows, "doc_id long, sent_id int, text string")
    got = {(r.doc_id, r.rule_id): r for r in rules.intent_evidence(s, [("no", "It must not hold a token", ["token", "(C)"]), ("yes", "It shall name a license", ["license"]), ("open", "Anything", ["a"])]).collect()}
    assert set(got) == {(1, "no"), (3, "yes")}
    r = got[(1, "no")]
    assert (r.status, [c.sent_id for c in r.citations], r.citations[2].anchor, len(r.violating_spans)) == ("non_compliant", [0, 1, 2, 3, 4], "[[page=2]]", 3)
    assert (got[(3, "yes")].status, got[(3, "yes")].violating_spans) == ("compliant", [])


@pytest.mark.parametrize("name", ["keyword_hits", "regex_hits", "red_flag_hits", "intent_verdict"])
def test_no_python_worker(spark, sf_dir, name):
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "InArrow" not in plan and "Python" not in plan
