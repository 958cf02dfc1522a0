"""Decontamination against brute force on copies with edited edges, insertions and repeats."""

import collections

import numpy as np

from lexmill.llm import decontaminate
from tests.llm.test_operators import frame


def cut(t):
    w = (t or "").lower().split()
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def brute(docs, items):
    want = {}
    for i, d in enumerate(docs):
        h = cut(d)
        for j, t in enumerate(items):
            q, best = cut(t), (0, 0)
            for s in range(-len(q) + 1, len(h)):
                r = collections.Counter(h[max(0, s) : s + len(q)])
                both = sum((collections.Counter(q) & r).values())
                best = max(best, (both / (len(q) + sum(r.values()) - both), -max(0, s)))
            if best[0] >= 0.8:
                want[(i, j)] = (round(best[0], 9), -best[1])
    return want


def test_copies_with_edited_edges_are_found(spark):
    rng = np.random.default_rng(31)
    items = [" ".join(rng.choice(["b%d" % i for i in range(300)], n)) for n in [15] * 12 + [24, 40, 60, 90]]
    items += ["round and round and round and round and round and round and stop it here now", "echo " * 20]
    docs = []
    for k, item in enumerate(items):
        w = item.split()
        edge = min(4, max(1, (len(w) - 4) // 10))
        lead, tail = [f"lead{i}" for i in range(3 * k % 17)], [f"tail{i}" for i in range(5)]
        docs += [" ".join(lead + x + tail) for x in (
            w, ['"' + w[0], *w[1:]], [*w[:-1], w[-1] + '".'], ["new"] * edge + w[edge:], w[:-edge] + ["new"] * edge, w[: len(w) // 2] + ["put"] + w[len(w) // 2 :], w[1:], w[:-1], w[: len(w) // 2],
        )]
        docs.append(" ".join(w[1:]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word) for r in decontaminate.leaks(frame(spark, docs), bench).collect()}
    want = brute(docs, items)
    assert len(want) > 80 and got == want
    joined = decontaminate.leaks(frame(spark, docs), bench, most_broadcast=0).collect()
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word) for r in joined} == want


def test_rows_without_id_repeated_ids_and_long_texts(spark):
    item = " ".join("q%d" % i for i in range(30))
    long = ["w%d" % (i % 7919) for i in range(30_000)]
    texts = [(0, item), (0, "other text of the same id"), (1, None), (2, ""), (None, item), (3, " ".join([*long, item, *long])), (4, " ".join([item] * 40)), (5, item.upper()), (5, item.upper())]
    docs = spark.createDataFrame([(d, t, 7, "x") for d, t in texts], "doc_id long, text string, item_id int, code string")
    bench = spark.createDataFrame([(0, item, 1), (1, item, 1), (1, item, 1), (None, item, 1), (2, None, 1)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(d, i): (1.0, at) for d, at in ((0, 0), (3, 30_000), (4, 0), (5, 0)) for i in (0, 1)}
