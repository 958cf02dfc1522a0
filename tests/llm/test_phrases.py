"""Phrase collocations against plain counting, and the query's SQL against the same."""

import collections
import re
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq

from lexmill.llm import naming, phrases, queries

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, longest=4, least=30, covered=80, top=2000):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().lower()):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        found = {p: a for p, a in c.items() if len(p) >= 2 and a >= least}
        gone = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= covered * c[p[i : i + k]]}
        kept = []
        for p in found.keys() - gone:
            score, k = min((2000000 * found[p] // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -found[p], b" ".join(p), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def test_equals_plain_counting(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 3000)
    rng = np.random.default_rng(4)
    names = ["a", "B", "été", "İx", "the", "of", "\x1cw", "x y", "z", "\U0001f600"]
    joins = [" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "? "]
    rows = []
    for _ in range(300):
        w = rng.choice(names, rng.integers(0, 40), p=[0.2, 0.2, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])
        rows.append((rng.choice(["en", "de"]).item(), "".join(x + rng.choice(joins) for x in w)))
    rows += [("en", "one two three four five")] * 40 + [(None, "x y z x y z. x y z")] * 20 + [("en", None), (None, ""), ("", "u v " * 50), ("en", "." * 5000), ("en", "long tail " * 3000)]
    docs = spark.createDataFrame([(1, t, lang, 5, "n") for lang, t in rows], "doc_id long, text string, lang string, n int, phrase string").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(docs).select(COLUMNS).collect())
    assert got == plain(rows)
    few = sorted(tuple(r) for r in phrases.collocations(docs, longest=3, least=2, covered=50, top=7).select(COLUMNS).collect())
    assert few == plain(rows, 3, 2, 50, 7)


def test_empty_table(spark):
    got = phrases.collocations(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert got.columns == COLUMNS and got.count() == 0


def test_query_and_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(queries.OP12_SQL).select(*COLUMNS).fetchall())
    assert want and sorted(tuple(r) for r in queries.op12_phrases(spark, sf_dir).select(COLUMNS).collect()) == want


def test_a_task_reads_one_chunk_at_a_time(spark, monkeypatch):
    """However many chunks lie in a file: Spark reads a row group of up to 4096 rows at once."""
    kept, keep = [], phrases.keep
    monkeypatch.setattr(phrases, "keep", lambda *a, **b: kept.append(keep(*a, **b)) or kept[-1])
    docs = spark.range(28).selectExpr("repeat('one two three ', 75000) text", "'en' lang").coalesce(1)
    totals, streams = phrases.frequent_phrases(docs, 2, 30)
    assert [tuple(r) for r in totals.collect()] == [("en", 28 * 3 * 75000)]
    assert [s.count() for s in streams] == [3, 3] and len(kept) == 3
    for state in kept:
        files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in state.inputFiles()]
        assert sum(m.num_rows for m in files) > len(files)
        assert all(m.row_group(i).num_rows == 1 for m in files for i in range(m.num_row_groups))


def test_a_shard_sorts_its_keys_in_ranges(monkeypatch):
    rng = np.random.default_rng(7)
    chunks = [np.unique(rng.integers(0, 1 << 64, n, np.uint64) >> np.uint64(44) << np.uint64(44)) for n in (700_000, 1, 400_000, 600_000)]
    counts = [rng.integers(1, 300, len(k)).astype(np.uint64) for k in chunks]
    sent = [m for i, (k, c) in enumerate(zip(chunks, counts, strict=True)) for m in naming.messages(i, k, c, 1)]
    rows = pa.table({n: [m[i] for m in sent] for i, n in enumerate(["shard", "chunk", "keys", "counts"])})
    tracemalloc.start()
    got = naming.match(200)((pa.scalar(0),), rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    keys, total = np.unique(np.concatenate(chunks)), collections.Counter()
    for k, c in zip(chunks, counts, strict=True):
        total.update(dict(zip(k.tolist(), c.tolist(), strict=True)))
    frequent = {k: i for i, k in enumerate((k for k in keys.tolist() if total[k] >= 200), 1)}
    told = set()
    for i, k in enumerate(chunks):
        name, tell, all_of = naming.answered(got.filter(pc.equal(got.column("chunk"), i)), len(k))
        assert (name & np.uint64((1 << 40) - 1)).tolist() == [frequent.get(x, 0) for x in k.tolist()]
        assert {x for x, t in zip(k.tolist(), tell.tolist(), strict=True) if t} == {x for x in k.tolist() if x in frequent} - told
        assert all(n == total[x] for x, t, n in zip(k.tolist(), tell.tolist(), all_of.tolist(), strict=True) if t)
        told |= frequent.keys() & set(k.tolist())
    assert peak < 60 * sum(map(len, chunks)), peak
