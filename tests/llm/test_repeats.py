"""Repeated byte strings against brute force: periodic texts, copies, shared passages, odd rows."""

import collections
import hashlib

import numpy as np
import pytest

from lexmill.llm import queries, repeats


def plain(rows, length):
    seen = collections.Counter(b[p : p + length] for b in (t for _, t in rows) for p in range(len(b) - length + 1))
    out = []
    for d, b in rows:
        gone, end = bytearray(len(b)), 0
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                a = max(p, end)
                gone[a : p + length] = b"\1" * (p + length - a)
                end = p + length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def some_texts(seed, n, longest):
    rng = np.random.default_rng(seed)
    letters = list("abcde é\n")
    texts = ["".join(rng.choice(letters, rng.integers(0, longest))) for _ in range(n)]
    for _ in range(n):
        a, b = rng.integers(0, n, 2)
        kind, t = rng.integers(0, 6), texts[a]
        i, j = sorted(rng.integers(0, len(t) + 1, 2)) if t else (0, 0)
        if kind == 0:
            texts[b] = t
        elif kind == 1:  # an edit
            texts[b] = t[:i] + "#" + t[i + 1 :]
        elif kind == 2:  # a passage
            texts[b] = texts[b][: len(texts[b]) // 2] + t[i:j] + texts[b][len(texts[b]) // 2 :]
        elif kind == 3:  # a period
            texts[b] = t[: rng.integers(1, 9)] * 60 + texts[b]
        elif kind == 4:  # the head or the tail
            texts[b] = t[i:] + texts[b] if rng.integers(0, 2) else texts[b] + t[:j]
    return texts


@pytest.mark.parametrize(("seed", "length", "longest"), [(1, 40, 300), (2, 16, 120), (3, 400, 3000), (4, 7, 60)])
def test_equals_brute_force(spark, monkeypatch, seed, length, longest):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(repeats, "WINDOW_SHARD_BYTES", 9000)
    monkeypatch.setattr(repeats, "BLOCK", 1 << 10)
    texts = some_texts(seed, 120, longest)
    docs = spark.createDataFrame([(i, t, 9, "c") for i, t in enumerate(texts)], "doc_id long, text string, n int, chunk string").repartition(5)
    got = repeats.repeats(docs, length, with_kept=True).collect()
    assert sorted(tuple(r)[:5] for r in got) == plain([(i, t.encode()) for i, t in enumerate(texts)], length)
    for r in got:
        b = texts[r.doc_id].encode()
        assert bytes(r.kept) == b"".join(b[x:y] for x, y in zip([0, *(s.end for s in r.spans)], [*(s.start for s in r.spans), len(b)], strict=True))


def test_odd_rows(spark):
    long = "".join("Long%d," % (i % 9973) for i in range(60_000))
    passage = "".join("p%d" % i for i in range(200))
    rows = [(1, passage + " one"), (1, "x" + passage), (2, "same row " * 60), (2, "same row " * 60), (None, passage), (None, None), (3, None), (3, None), (4, ""), (5, long), (6, "é" * 50_000), (7, "short"), (7, "short")]
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n int, sizes int").repartition(3)
    got = sorted(tuple(r) for r in repeats.repeats(docs).collect())
    assert got == plain([(d, (t or "").encode()) for d, t in rows if d is not None], 400)
    assert repeats.repeats(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in queries.op11_suffix_repeats(spark, sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == plain(rows, 400) and sum(r[2] for r in got)
