"""License scans against brute force on edited, split and repeated templates."""

import re

import numpy as np
import pytest

from lexmill.llm import licenses
from tests.llm.test_operators import ODD, random_docs

SCHEMA = "doc_id long, text string, license string, template int, size int"


def cut(t):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return [tuple(w[i : i + 3]) for i in range(len(w) - 2)]


def brute(rows, templates, least=0.8):
    out = {}
    for d, t in rows:
        h = cut(t)
        for n, (name, template) in enumerate(templates):
            own = set(cut(template))
            words = len(cut(template)) + 2
            for i in range(len(h)):
                if d is not None and h[i] in own:
                    share = len(own & set(h[i : i + 2 * words - 2])) / len(own)
                    if share >= least:
                        best, first, which = out.get((d, name), (0, i, set()))
                        out[(d, name)] = (max(best, share), min(first, i), which | {n})
    return {k: (round(a, 9), b, len(c)) for k, (a, b, c) in out.items()}


def corpus():
    rng = np.random.default_rng(17)
    texts = [*ODD, "start Released under the MIT License. end", "x " * 50 + "ALL RIGHTS RESERVED", "licensed under the apache license version 3.0 maybe", *[t for _, t in licenses.TEMPLATES], *random_docs(30, 8)]
    long = ["w%d" % i for i in rng.integers(0, 5000, 20_000)]
    texts.append(" ".join([*long[:9_000], *licenses.TEMPLATES[6][1].split(), *long[9_000:]]))
    for _, t in licenses.TEMPLATES:
        w = t.split()
        for k in range(1, len(w)):
            texts.append(" ".join(["lead"] * (k % 7) + w[:k] + ["new"] + w[k:]))  # one word more
            texts.append(" ".join(w[:k] + ["put", "in", "between", "here", "six", "words"] + w[k:] + ["tail"] * 5))
            texts.append(" ".join(["a", "b", *w[:k], "other", *w[k + 1 :]]))  # one word changed
        texts.append(" ".join([t, "and again", t]))
    rows = list(enumerate(texts)) + [(None, texts[10]), (3, licenses.TEMPLATES[1][1]), (3, licenses.TEMPLATES[1][1])]
    return rows


@pytest.mark.parametrize("most", [20_000, 0])
def test_licenses_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(licenses, "MOST_SHINGLES", most)
    rows = corpus() if most else [r for r in corpus() if len(r[1] or "") < 5_000][:120]
    docs = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], SCHEMA).repartition(4)
    got = {(r.doc_id, r.license): (round(r.containment, 9), r.first_word, r.n_templates) for r in licenses.scan(docs).collect()}
    want = brute(rows, licenses.TEMPLATES)
    assert len(want) > 40 and got == want
    assert licenses.scan(docs.limit(0)).count() == 0


def test_long_templates_are_cut_into_segments(spark):
    rng = np.random.default_rng(18)
    whole = ["t%d" % i for i in range(300)]
    edited = list(whole)
    for i in rng.choice(300, 15, replace=False):
        edited[i] = "edited"
    rows = [(0, " ".join(whole)), (1, " ".join(["x"] * 31 + edited)), (2, " ".join(whole[:150])), (3, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    templates = [("long", " ".join(whole)), ("short", "two words")]
    got = {(r.doc_id, r.license): (round(r.containment, 9), r.first_word, r.n_templates) for r in licenses.scan(docs, templates).collect()}
    assert got == brute(rows, templates) and {d for d, _ in got} == {0, 1}
    assert licenses.scan(docs, [("short", "two words")]).count() == 0
