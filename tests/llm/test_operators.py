"""Each training-data operator against brute force on small fixtures with nulls, ties, copies and odd texts."""

import collections
import hashlib
import json
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexmill.llm import ann, chat_format, decontaminate, packing, quality, simhash, substring, token_file, url_rules
from lexmill.llm.components import components
from lexmill.llm.tokens import Encoder, public_path

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
ODD = ["", " ", None, "\n\n", "a", "Ab,  c\u00e9\t'Tis don't \u00a0x \x1c y\x85z <|endoftext|> \u0130\u03a3 \u65e5\u672c 123", "é! Été\r\n\r\nxx  ", "one two"]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def random_docs(n, seed, vocab=400, longest=160):
    rng = np.random.default_rng(seed)
    names = ["w%03d" % i for i in range(vocab)]
    docs = [" ".join(rng.choice(names, rng.integers(1, longest))) for _ in range(n)]
    for k in range(n // 4):  # copies, near copies, shared passages
        a, b = rng.integers(0, n, 2)
        w = docs[a].split()
        kind = k % 3
        if kind == 0:
            docs[b] = docs[a]
        elif kind == 1:
            w[len(w) // 2] = "changed"
            docs[b] = " ".join(w)
        else:
            docs[b] = docs[b] + " " + docs[a]
    return docs


def frame(spark, texts, first=0):
    rows = [(i + first, t, "en", "src", len(t or ""), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, token string").repartition(3)


@pytest.mark.parametrize("name", [WORD, BYTE])
def test_encoder_equals_whole_text_encoding(name):
    e = Encoder(public_path(name), memo=50)
    rng = np.random.default_rng(5)
    parts = ["a", "Ab,", "é!", "x-", "ß", " ", "  ", "\n", "\n\n", "\t", "'s", "'", ".", "|", "1", "23", "\x01", "\x1c", "\x85", "\xa0", "İ", "Σ", "é", "<|endoftext|>", "日本", "\u3000", "😀", "\r\n", "don't", "\u200b", "ǅ"]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(3000)]
    want = [np.asarray(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert e.encode(texts) == want


@pytest.mark.parametrize("values", [[], [0], [5, 5, 9], list(range(0, 100000, 7)), [0, 1 << 40], sorted(np.random.default_rng(1).integers(0, 1 << 30, 1000).tolist())])
def test_elias_fano_round_trip(values):
    s, end = token_file.EliasFano.from_bytes(b"xx" + token_file.EliasFano.of(np.array(values, dtype=np.uint64)).to_bytes(), 2)
    assert s.all().tolist() == values
    assert [s.select(i) for i in range(len(values))] == values
    for a, b in [(0, 1), (1, 70), (63, 64), (64, 200), (len(values) // 2, len(values)), (130, 131)]:
        if a <= b <= len(values):
            assert s.select_range(a, b).tolist() == values[a:b]
    with pytest.raises(IndexError):
        s.select(len(values))


def test_token_file(spark):
    texts = ODD + random_docs(40, 1)
    docs = frame(spark, texts).unionByName(spark.createDataFrame([(None, "lost", "en", "s", 4, "x"), (3, "again", "en", "s", 5, "x")], frame(spark, []).schema))
    got = token_file.read_documents(token_file.write_token_blocks(docs, public_path(WORD), 2, block_ids=300)).collect()
    e = Encoder(public_path(WORD))
    rows = sorted([(i, t or "") for i, t in enumerate(texts)] + [(3, "again")], key=lambda r: (r[0], r[1]))
    start, want = 0, []
    for i, t in rows:
        ids = np.asarray(e.tokenizer.encode(t, add_special_tokens=False).ids + [2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got)) == sorted(want)
    assert token_file.read_documents(token_file.write_token_blocks(frame(spark, []), public_path(WORD), 2)).count() == 0


@pytest.mark.parametrize("counts", [{}, {8: 3}, {1: 100}, {3: 1000}, {5: 7, 3: 4, 2: 9, 1: 2}, {k: 10 * k for k in range(1, 9)}])
def test_histogram_packing_places_each_piece_once(counts):
    patterns = packing.pack_histogram(counts, 8)
    held = collections.Counter()
    for n, pack in patterns:
        assert 0 < sum(a * b for a, b in pack) <= 8
        for length, times in pack:
            held[length] += times * n
    assert held == collections.Counter(counts)


def test_packing(spark):
    texts = [*ODD, "word " * 5000, *["same"] * 50, *random_docs(60, 2)]
    rows = packing.pack_documents(frame(spark, texts), public_path(BYTE), 0, 128).collect()
    e = Encoder(public_path(BYTE))
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids, at = np.asarray(e.tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
    assert set(by_sequence) == set(range(len(by_sequence)))
    assert packing.pack_documents(frame(spark, []), public_path(BYTE)).count() == 0


def test_substring_repeats(spark):
    passage = " ".join("p%d" % i for i in range(70))
    texts = [*ODD, *[passage + f" tail{i}" for i in range(30)], f"lead {passage}", passage, " ".join(["loop"] * 300), " ".join(["loop"] * 200), *random_docs(80, 3)]
    got = {r.doc_id: r for r in substring.repeats(frame(spark, texts), with_text=True).collect()}
    seen = {}
    for i, t in enumerate(texts):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k : k + 50]), i) < i:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, y in zip(w, gone, strict=True) if not y)
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
        assert r.kept_text == (kept if any(gone) else t)
        assert sum(s.end - s.start for s in r.spans) == sum(gone)
    assert substring.repeats(frame(spark, [])).count() == 0


def test_simhash_components(spark):
    texts = [*ODD, *random_docs(150, 4)]
    for i in range(30):  # a chain of texts that drift apart
        texts.append(" ".join("z%d" % max(k, i) for k in range(60)))
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fps = []
    for t in texts:
        w = words((t or "").translate(lower))
        hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{f:016x}", root(i)) for i, f in enumerate(fps)}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_pigeonring_finds_all_pairs_within_the_radius(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [base]
    for k in range(1, 6):
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for _ in base], np.uint64)
        near.append(base ^ flips)
    fps = np.unique(np.concatenate(near)).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    for radius, segments, block in [(3, 4, 512), (3, 4, 3), (7, 8, 8)]:
        tree = components(simhash.links(df, radius, segments, block)).collect()
        u = fps.view(np.uint64)
        parent = {int(x): int(x) for x in fps}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(len(u)):
            for j in np.flatnonzero(np.bitwise_count(u[:i] ^ u[i]) <= radius):
                a, b = root(int(fps[i])), root(int(fps[j]))
                parent[max(a, b)] = min(a, b)
        want = {x: root(x) for x in parent}
        linked = collections.Counter(want.values())
        assert {r.node: r.root for r in tree} == {x: r for x, r in want.items() if linked[r] > 1}


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in components(chain).collect()} == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 20)).round(2)
    x[100:140] = x[100]  # copies
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    rows += [(1000, None, 1), (1001, [0.0] * 20, 1), (1002, [float("nan")] * 20, 1), (1003, [None] + [1.0] * 19, 1), (1004, [1.0, 2.0], 1), (1005, [], 1), (0, rows[0][1], 2), (None, [1.0] * 20, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = collections.defaultdict(dict)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    y = x.astype(np.float32).astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 600, 20):
        s = y @ y[q]
        order = sorted((i for i in range(600) if i != q), key=lambda i: (-round(s[i], 12), i))[:5]
        assert len(got[q]) == 5 and all(abs(sc - s[v]) < 1e-9 for v, sc in got[q].values())
        assert [got[q][k][1] for k in range(1, 6)] == sorted((sc for _, sc in got[q].values()), reverse=True)
        hits += len({v for v, _ in got[q].values()} & set(order))
        total += 5
    assert hits / total >= 0.9
    assert [got[100][k][0] for k in range(1, 6)] == [101, 102, 103, 104, 105]
    few = ann.nearest(df.where("vec_id in (0, 1, 2, 1004)"), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_chat_format(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "\\", "\\\\<|", "<\\|im_sep|>", "a\nb\n", "", None, "<|im_sep|>", "$1 \\|"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "user", "assistant", "assistant", "system", "assistant", "user", "assistant", None], nasty, strict=True))]
    rows += [(2, None, "assistant", "first"), (2, 0, "user", "second"), (2, 0, "user", "second"), (None, 0, "user", "x"), (3, 0, "<|im_start|>", "y"), (4, 1, "user", "b"), (4, 0, "user", "a")]
    rows += [(5, i % 2500, ["user", "assistant"][i // 3 % 2], "t" * (i % 7)) for i in range(5000)] + [(6, 0, "assistant", "long " * 100_000), (6, 1, "assistant", None)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    got = {r.conv_id: r for r in chat_format.digest(chat_format.format_chats(df)).collect()}
    by = collections.defaultdict(list)
    for c, n, r, t in rows:
        by[c].append((n is not None, n or 0, r or "", t or ""))
    for c, ts in by.items():
        ts.sort()
        said, loss = "".join(f"{r}\n{t}\n" for *_, r, t in ts), "".join(t for *_, r, t in ts if r == "assistant")
        want = (len(ts), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == want
    assert "ArrowEval" not in chat_format.format_chats(df)._jdf.queryExecution().toString()
    assert chat_format.digest(chat_format.format_chats(df.limit(0))).count() == 0


def test_url_rules(spark):
    urls = [
        None, "", "no-scheme/fr/", "https://a.example.org/en/12?x", "http://EXAMPLE.org/es/", "http://example.org/es", "http://notexample.org/es/1", "ftp://x.com/fr/a#b", "http://x.com/de/", "http://com/de/z",
        "http://x.com:80/de/", "http://a.org", "http://a.org?q=/es/", "http://casino.net/", "http://x.net/wp-login.php", "http://y.net/a://b.org/", "http://ads.net/", "http://x.net/quiet",
    ]
    df = spark.createDataFrame([(i % 16, u, "z") for i, u in enumerate(urls)], "page_id long, url string, token string")
    rules = url_rules.compile_rules(spark, url_rules.SITE_RULES, [*url_rules.PATTERN_RULES, ("block", r"/quiet$", [])])
    got = collections.Counter(tuple(r) for r in url_rules.judge(df, rules).collect())

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        best = max(((len(r), r, v) for v, r in url_rules.SITE_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]) :])), default=None)
        if best:
            return host, path, best[1], best[2]
        bad = any(re.search(p, host + path) for _, p, _ in url_rules.PATTERN_RULES) or path.endswith("/quiet")
        return host, path, None, "block" if bad else "allow"

    assert got == collections.Counter((i % 16, *judge(u)) for i, u in enumerate(urls))
    assert url_rules.judge(df.limit(0), rules).count() == 0


def test_decontaminate(spark):
    rng = np.random.default_rng(9)
    items = [" ".join(rng.choice(["b%d" % i for i in range(300)], rng.integers(15, 60))) for _ in range(20)] + ["too short", None, ""]
    docs = [*ODD, *random_docs(40, 10)]
    for k, item in enumerate(items[:15]):
        w = item.split()
        docs.append(f"{'lead ' * k}{item.upper() if k % 2 else item} {'tail ' * k}")
        docs.append(" ".join(w[: len(w) // 2]) + " cut off")
    docs.append(" ".join(items[:5]))
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, doc_id int").select("item_id", "text")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(frame(spark, docs), bench).collect()}

    def cut(t):
        w = (t or "").lower().split()
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    want = {}
    for i, d in enumerate(docs):
        h = cut(d)
        for j, t in enumerate(items):
            q = cut(t)
            if not q or not set(q) & set(h):
                continue
            best = 0
            for s in range(-len(q) + 1, len(h)):
                r = collections.Counter(h[max(0, s) : s + len(q)])
                both = sum((collections.Counter(q) & r).values())
                best = max(best, both / (len(q) + sum(r.values()) - both))
            if best >= 0.8:
                want[(i, j)] = best
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert decontaminate.leaks(frame(spark, []), bench).count() == 0
    assert decontaminate.leaks(frame(spark, docs), bench.limit(0)).count() == 0


def test_quality_tells_junk(spark):
    rng = np.random.default_rng(11)
    common = ["the", "of", "and", "to", "in"]
    rare = ["r%d" % i for i in range(3000)]

    def clean():
        return " ".join(x for _ in range(int(rng.integers(30, 80))) for x in (rng.choice(common), rng.choice(rare)))

    texts = [clean() for _ in range(240)] + [" ".join([str(rng.choice(rare)) + "%%%"] * 60) for _ in range(40)] + ODD
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(160)] + [(i, 0, 0) for i in range(240, 260)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    judged = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(judged) == len(texts)
    assert sum(judged[i].rejected for i in range(240)) <= 12
    assert sum(judged[i].rejected for i in range(240, 280)) >= 36
    assert not any(judged[280 + i].rejected for i, t in enumerate(ODD) if not words(t))
    assert not any(r.rejected for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(frame(spark, []), labels).count() == 0


def test_queries_have_the_contract_columns(spark, sf_dir):
    from lexmill.llm.queries import QUERIES

    first = {
        "op1_token_file": ["doc_id", "start", "n_tokens", "ids_crc32"], "op2_ann": ["query_id", "rank", "vec_id", "score"], "op4_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        "op6_substring": ["doc_id", "n_words", "n_removed", "kept_sha256"], "op7_simhash": ["doc_id", "fingerprint", "component_id"],
        "op8_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], "op9_url_rules": ["page_id", "host", "path", "rule", "verdict"],
    }
    for name, columns in first.items():
        df = QUERIES[name](spark, sf_dir)
        assert df.columns == columns, json.dumps({name: df.columns})
        assert df.count() > 0
    assert {"op3_licenses", "op5_quality", "op10_decontaminate"} <= set(QUERIES)


def test_substring_deals_large_inputs_into_small_chunks():
    """An executor of 3000 MB holds the words and hashes of two chunks beside its JVM."""
    assert substring.CHUNK_BYTES <= 8 << 20
