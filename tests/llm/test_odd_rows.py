"""Rows without id, repeated ids, very long texts and clashing columns with the operators that take documents or pages."""

import collections
import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from lexmill.llm import ann, packing, simhash, substring, token_file, url_rules
from lexmill.llm.tokens import Encoder, public_path
from tests.llm.test_operators import words

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


def odd_docs(spark):
    long = " ".join("Long%d," % (i % 9973) for i in range(60_000))
    passage = " ".join("p%d" % i for i in range(60))
    rows = [(1, passage + " one"), (2, passage + " two"), (2, "another text under two"), (2, "another text under two"), (None, passage), (None, None), (3, None), (4, ""), (5, long), (6, long + " tail"), (7, "\u00e9" * 300_000)]
    schema = "doc_id long, text string, chunk int, carried int, fp long, copy long, start long"
    return rows, spark.createDataFrame([(d, t, 1, 2, 3, 4, 5) for d, t in rows], schema).repartition(3)


def test_token_file_and_packing(spark):
    rows, docs = odd_docs(spark)
    e = Encoder(public_path(WORD))
    start, want = 0, []
    for d, t in sorted(((d, t or "") for d, t in rows if d is not None), key=lambda r: (r[0], r[1].encode())):
        ids = np.frombuffer(e.encode([t])[0], "<u4").tolist() + [2]
        want.append((d, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_file.read_documents(token_file.write_token_blocks(docs, public_path(WORD), 2, block_ids=1000), group=3)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    pieces = packing.pack_documents(docs, public_path(BYTE), 0, 64).collect()
    b = Encoder(public_path(BYTE))
    lengths = collections.Counter()
    for d, t in rows:
        if d is not None:
            lengths[d] += len(b.encode([t])[0]) // 4 + 1
    held, rooms = collections.Counter(), collections.Counter()
    for r in pieces:
        held[r.doc_id] += r.length
        rooms[r.sequence_id] += r.length
    assert held == lengths and max(rooms.values()) <= 64


def test_substring(spark):
    rows, docs = odd_docs(spark)
    first = {}
    for d, t in rows:
        w = words(t) if d is not None else []
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(d, first.get(key, d))
    want = collections.Counter()
    for d, t in rows:
        if d is None:
            continue
        w = words(t)
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < d:
                gone[k : k + 50] = True
        kept = " ".join(x for x, y in zip(w, gone, strict=True) if not y)
        want[(d, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert collections.Counter(map(tuple, substring.repeats(docs).collect())) == want
    chunks = substring.repeats(docs.where("doc_id = 2"), carry=["chunk", "copy"]).collect()
    assert [tuple(r.carried) for r in chunks] == [(1, 4)] * 3


def test_simhash(spark):
    rows, docs = odd_docs(spark)
    got = collections.Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert sum(got.values()) == sum(d is not None for d, _ in rows)
    assert {d: c for d, c in got if d in (3, 4, 5, 6)} == {3: 3, 4: 3, 5: 5, 6: 5}


def test_url_rules_and_vectors(spark):
    long = "http://a.example.org/" + "x/" * 100_000
    pages = spark.createDataFrame([(1, long, "t"), (1, long, "t"), (None, None, "t"), (None, "http://x.com/de/1", "t")], "page_id long, url string, row string")
    rules = url_rules.compile_rules(spark, url_rules.SITE_RULES, url_rules.PATTERN_RULES)
    got = collections.Counter((r.page_id, r.rule, r.verdict) for r in url_rules.judge(pages, rules).collect())
    assert got == {(1, "org/", "allow"): 2, (None, None, "allow"): 1, (None, "com/de/", "block"): 1}
    rows = [(0, [1e300, 2e300]), (1, [1e-300, 2e-300]), (2, [2.0, 1.0]), (3, [-1e-320, -2e-320]), (4, [1.0, 2.0]), (4, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id long, embedding array<double>, slice int")
    found = [(r.vec_id, round(r.score, 9)) for r in ann.nearest(df, F.col("vec_id") == 0, k=4).orderBy("rank").collect()]
    assert found == [(1, 1.0), (4, 1.0), (2, 0.8), (3, -1.0)]
