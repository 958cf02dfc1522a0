"""Recall of the nearest-neighbour search with two and three concatenated hashes, and its odd rows there."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import ann


@pytest.mark.parametrize(("width", "many", "hashes"), [(8, 800, 2), (4, 700, 3)])
def test_recall_and_ties(spark, width, many, hashes):
    assert int(math.log(many, 2 * ann.padded(width))) == hashes
    rng = np.random.default_rng(width)
    x = rng.normal(size=(many, width)).astype(np.float32).astype(np.float64)
    x[50:90] = x[50]  # copies tie
    rows = [(i, [float(v) for v in r], "extra") for i, r in enumerate(x)] + [(5000, None, ""), (5001, [0.0] * width, ""), (5002, [1.0], ""), (None, [1.0] * width, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep string")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 25 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, many, 25):
        s = y @ y[q]
        order = sorted((i for i in range(many) if i != q), key=lambda i: (-round(s[i], 12), i))[:5]
        assert len(got[q]) == 5 and all(abs(score - s[v]) < 1e-9 for v, score in got[q].values())
        hits += len({v for v, _ in got[q].values()} & set(order))
        total += 5
    assert hits / total >= 0.9
    assert [got[50][k][0] for k in range(1, 6)] == [51, 52, 53, 54, 55]


def test_filed_rows_do_not_jump_with_a_further_hash(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(320, 8))
    filed, counted = ann.filed, []

    def count(*args):
        rows = filed(*args)
        counted.append(rows.count())
        return rows

    monkeypatch.setattr(ann, "filed", count)
    made = []
    for many in (240, 320):  # on either side of the square of the number of signed axes
        counted.clear()
        df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x[:many])], "vec_id long, embedding array<double>")
        assert ann.nearest(df, F.col("vec_id") % 2 == 0).count() == 5 * many // 2
        made.append(sum(counted))
    assert made[1] < 3 * made[0]


def test_buckets_visited_grow_slower_than_vectors():
    for axes in (16, 128):
        for n in (100, 1000, 2000, 10_000, 50_000, 51_282, 300_000, 3_000_000):
            (few, at), (many, then) = ann.grid(n, axes, 10), ann.grid(5 * n, axes, 10)
            assert math.prod(few) <= max(axes, n / ann.BUCKET) and then <= 7 * at
