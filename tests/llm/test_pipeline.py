"""run() against the stages written plainly, on a small corpus with odd rows and planted cases."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lexmill.llm import quality
from lexmill.llm.tokens import Encoder, public_path
from tests.llm.test_decontaminate import brute as brute_leaks
from tests.llm.test_near_copies import brute as brute_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, carried int"


def corpus():
    rng = np.random.default_rng(3)
    names = ["c%d" % i for i in range(5000)]
    clean = [" ".join(rng.choice(names, 120)) for _ in range(60)]
    item = " ".join("q%d" % i for i in range(30))
    passage = " ".join("s%d" % i for i in range(60))
    near = clean[0].split()
    near[60] = "edited"
    texts = [*clean, clean[1], " ".join(near), clean[2][:300] + " " + item, clean[3][:200] + " " + passage, "x1 x2 x3 " + passage + " " + " ".join(rng.choice(["d%d" % i for i in range(5000)], 80))]
    texts += [None, "", " \n", "short", "%%% " * 90, " ".join("long%d" % (i % 4001) for i in range(20_000))]
    rows = [(i, t, [None, "en"][i % 2], "src", len(t or ""), "clash", 1) for i, t in enumerate(texts)]
    rows += [(7, "tail one alpha", "en", "a", 14, "x", 1), (7, "a completely different text of row two", None, "b", 38, "x", 2), (8, item + " and more", "en", "c", 9, "x", 3)]
    rows += [(9, clean[9], "en", "src", len(clean[9]), "x", 4), (9, clean[9], "en", "src", len(clean[9]), "x", 4)]
    rows += [(None, clean[4], "en", "n", 1, "x", 5), (None, clean[4], "en", "n", 1, "x", 5), (None, "lead " + item, "en", "n", 1, "x", 5)]
    return rows, item


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("pipeline")
    rows, item = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(69, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None), (None, "x1 x2 x3 s0 s1"), (2, "too short")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return rows, item, str(where)


def plain(rows):
    return Counter(tuple(r[:5]) for r in rows)


def as_docs(spark, rows):
    return spark.createDataFrame([tuple(r[:5]) for r in rows], ", ".join(SCHEMA.split(", ")[:5]))


def near_duplicates(rows):
    named = sorted({(r[0], r[1] or "") for r in rows if r[0] is not None})
    groups, first = brute_groups([t for _, t in named]), {}
    for i, (d, _) in enumerate(named):
        first.setdefault(groups[i], []).append((d, i))
    stays = {named[i] for members in first.values() for d, i in members if d == min(members)[0]}
    return stays, {named[i]: {named[j] for _, j in first[groups[i]]} for i in range(len(named))}


def without_repeats(rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first, out = {}, []
    for d, t, *_ in rows:
        w = words(t)
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if d is not None:
                first[key] = min(d, first.get(key, d))
    for d, t, lang, source, n in (r[:5] for r in rows):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if d is not None and first[tuple(w[k : k + 50])] < d:
                gone[k : k + 50] = [True] * 50
        if any(gone):
            t = " ".join(x for x, y in zip(w, gone, strict=True) if not y)
            n = len(t)
        out.append((d, t, lang, source, n))
    return out


def test_each_stage_equals_its_plain_version(spark, tables):
    rows, item, where = tables
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality", "near_duplicates", "substring", "decontamination", "packing"]
    docs = spark.read.parquet(f"{where}/documents.parquet")

    judged = quality.classify(docs, spark.read.parquet(f"{where}/labels.parquet")).collect()
    assert len(judged) == len(rows)
    want = Counter((r.doc_id, r.n_words) for r in judged if not r.rejected)
    kept = [tuple(r) for r in stage["quality"](spark, docs, where).collect()]
    assert Counter((r[0], len((r[1] or "").split())) for r in kept) == want and plain(rows) >= Counter(kept)
    assert sum(r[0] is not None and r[0] < 60 for r in kept) >= 58 and not any((r[1] or "").startswith("%%%") for r in kept)

    got = [tuple(r) for r in stage["near_duplicates"](spark, docs, where).collect()]
    stays, group = near_duplicates(rows)
    assert plain(rows) >= Counter(got)
    assert Counter(r for r in got if r[0] is None) == Counter(tuple(r[:5]) for r in rows if r[0] is None)
    mine = [(r[0], r[1] or "") for r in got if r[0] is not None]
    assert len(mine) == len(set(mine)) and set(mine) <= stays
    assert all(len(members & set(mine)) == 1 for members in group.values())  # one row of each group

    got = Counter(tuple(r) for r in stage["substring"](spark, docs, where).collect())
    assert got == Counter(without_repeats(rows))

    got = Counter(tuple(r) for r in stage["decontamination"](spark, docs, where).collect())
    leaking = {i for i, _ in brute_leaks([r[1] for r in rows], [item])}
    assert leaking and got == Counter(tuple(r[:5]) for i, r in enumerate(rows) if i not in leaking)


def test_run_packs_what_the_stages_leave(spark, tables):
    _, item, where = tables
    out = corpus_pipeline.run(spark, where).collect()
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = as_docs(spark, sorted(map(tuple, stage(spark, docs, where).collect()), key=repr))
    left = docs.collect()
    e = Encoder(public_path("byte_bpe_50k.json"))
    want = Counter((r.doc_id, len(e.encode([r.text])[0]) // 4 + 1) for r in left if r.doc_id is not None)
    pieces, rooms = defaultdict(list), defaultdict(int)
    for r in out:
        pieces[(r.doc_id, r.doc_tokens)].append(r)
        rooms[r.sequence_id] += r.length
    assert {k: sum(p.length for p in v) for k, v in pieces.items()} == {k: k[1] * n for k, n in want.items()}
    assert max(rooms.values()) <= 1024 and set(rooms) == set(range(len(rooms)))
    assert not any(r.text and item in r.text for r in left)
    # both texts of doc_id 7 that are no copies went through, each as itself
    assert {"tail one alpha", "a completely different text of row two"} <= {r.text for r in left}


def test_empty_tables_give_empty_results(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
