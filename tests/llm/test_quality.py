"""The classifier against a plain Kneser-Ney model in dictionaries, with odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import quality
from tests.llm.test_operators import ODD, random_docs


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def discount(counts):
    n1, n2, n3, n4 = (max(1, sum(c == k for c in counts)) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return lambda n: 0 if n == 0 else min(max(d[min(n, 3) - 1], 0.05), min(n, 3))


def brute_bits(trusted):
    pairs = Counter(p for t in trusted for p in zip([None, *words(t)[:-1]], words(t)))
    before = Counter(w for _, w in pairs)
    d, low = discount(pairs.values()), discount(before.values())
    total, mass = Counter(), Counter()
    for (c, _), n in pairs.items():
        total[c] += n
        mass[c] += d(n)
    spread = sum(map(low, before.values())) / len(pairs) / (len(before) + 1)

    def bits(t):
        out = 0
        for c, w in zip([None, *words(t)[:-1]], words(t)):
            p = (before[w] - low(before[w])) / len(pairs) + spread
            if total[c]:
                n = pairs[(c, w)]
                p = (n - d(n) + mass[c] * p) / total[c]
            out -= math.log2(p)
        return out

    return bits


def corpus(spark):
    texts = [*ODD, *random_docs(120, 41, vocab=60), " ".join("long%d" % (i % 977) for i in range(30_000))]
    rows = [(i, t, [None, "en", "de"][i % 3], "x", 7) for i, t in enumerate(texts)]
    rows += [(None, "nobody's words", "en", "x", 7), (20, "w001 w002 again", "en", "x", 7), (20, "w001 w002 again", "en", "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality string, bits long").repartition(3)
    return rows, docs


@pytest.mark.parametrize("bundle", [200, 1 << 20])
def test_perplexities_equal_a_plain_model(spark, monkeypatch, bundle):
    monkeypatch.setattr(quality, "BUNDLE_WORDS", bundle)
    rows, docs = corpus(spark)
    role = {i: [quality.TRAINS, quality.TRAINS, quality.TOXIC, quality.HELD][i % 4] for i in range(90)}
    roles = spark.createDataFrame(list(role.items()), "doc_id long, role int")
    of = lambda k: [r[1] for r in rows if role.get(r[0]) == k]
    bits, good, bad = brute_bits(of(quality.TRAINS)), of(quality.TRAINS), of(quality.TOXIC)
    holds = [Counter(w for t in ts for w in set(words(t))) for ts in (good, bad)]

    def ratio(t):
        return max((math.log2((holds[1][w] + 5) / (len(bad) + 10)) - math.log2((holds[0][w] + 5) / (len(good) + 10)) for w in words(t)), default=-math.inf)

    got = quality.perplexities(docs, roles).collect()
    want = sorted((str(r[0]), len(words(r[1])), round(bits(r[1]), 2), round(ratio(r[1]), 4)) for r in rows)
    assert len(got) == len(want)
    for g, w in zip(sorted((str(r.doc_id), r.n_words, r.bits, r.ratio) for r in got), want, strict=True):
        assert g[:2] == w[:2] and abs(g[2] - w[2]) <= 1e-5 * w[1] + 0.01
        assert g[3] == w[3] or abs(g[3] - w[3]) < 1e-3


def test_thresholds_are_quantiles_by_language(spark):
    rows, docs = corpus(spark)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(i, 0, i % 2) for i in range(100, 110)] + [(None, 1, 0), (5, 0, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels, quantile=0.9).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    held = {r.doc_id for r in spark.range(100).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h")).collect() if r.h % 4 == 0} - {5, 6}
    empty = [r for r in got if r.n_words == 0]
    assert empty and not any(r.rejected for r in empty) and all(r.perplexity is None for r in empty)
    for lang in ("", "en", "de"):
        mine = [r for r in got if r.lang == lang]
        levels = sorted(math.log2(r.perplexity) for r in mine if r.doc_id in held and r.n_words)
        limit = math.log2(mine[0].threshold)
        assert levels and abs(limit - 0.1 - levels[math.ceil(0.9 * len(levels)) - 1]) < 1e-6
        for r in mine:
            if r.n_words:
                assert r.rejected == (r.perplexity > r.threshold or r.toxic_ratio > r.toxic_limit)
    assert np.isclose(min(r.threshold for r in got), min(r.threshold for r in got if r.n_words))


def test_words_of_toxic_documents_are_rejected(spark):
    rng = np.random.default_rng(42)
    names = ["w%03d" % i for i in range(200)]
    texts = [" ".join(rng.choice(names, 80)) for _ in range(400)]
    for i in range(0, 400, 4):
        texts[i] += " vile " + " ".join(rng.choice(names, 20))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.rejected for r in quality.classify(docs, labels).collect()}
    assert all(got[i] for i in range(200, 400, 4))
    assert sum(got[i] for i in range(400) if i % 4) <= 9
