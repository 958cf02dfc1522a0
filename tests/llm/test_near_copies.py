"""Near copies of the pipeline against all pairs of shingle sets."""

import numpy as np

import corpus_pipeline
from lexmill.llm import near_copies, simhash
from tests.llm.test_operators import ODD, frame, random_docs


def cut(t, width=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = (t or "").translate(lower).encode().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(texts, width=5, least=0.8):
    sets = [cut(t, width) for t in texts]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if len(sets[a] & sets[b]) * 10 >= round(least * 10) * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in range(len(sets))}


def edited(rng, words, share):
    """``words`` with one block changed, so that about ``share`` of the shingles stay."""
    w = list(words)
    n = round(len(w) * (1 - share) / (1 + share)) - 4
    at = int(rng.integers(0, len(w) - n))
    return w[:at] + ["e%d" % rng.integers(10**6) for _ in range(n)] + w[at + n :]


def distance(x, y):
    return (simhash.fingerprint(simhash.shingle_hashes(x, 3)) ^ simhash.fingerprint(simhash.shingle_hashes(y, 3))).bit_count()


def test_pairs_far_apart_in_fingerprint_bits_are_found(spark):
    rng = np.random.default_rng(21)
    texts = []
    for _ in range(60):
        w = ["v%d" % x for x in rng.integers(0, 10**6, 150)]
        texts += [" ".join(w), " ".join(edited(rng, w, 0.83))]
    far = [i for i in range(0, len(texts), 2) if distance(texts[i], texts[i + 1]) > 7]
    want = brute(texts)
    assert far and all(want[i + 1] == i for i in far)
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(frame(spark, texts)).collect()} == want
    left = corpus_pipeline.near_duplicate_stage(spark, frame(spark, texts), "")
    assert {r.doc_id for r in left.collect()} == {i for i in want if want[i] == i}


def test_near_copies_equal_all_pairs(spark):
    rng = np.random.default_rng(22)
    texts = [*ODD, *random_docs(150, 23)]
    base = ["t%d" % i for i in range(120)]
    for _ in range(40):  # a family of variants of one template
        texts.append(" ".join(edited(rng, base, float(rng.uniform(0.7, 0.95)))))
    for i in range(60):  # copies that drift apart
        texts.append(" ".join("z%d" % max(k, 2 * i) for k in range(120)))
    want = brute(texts)
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(frame(spark, texts)).collect()} == want
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(frame(spark, texts), block=5).collect()} == want
    assert near_copies.near_copies(frame(spark, [])).count() == 0


def test_links_are_thinned_only_after_verification(spark):
    rng = np.random.default_rng(24)
    texts, kept = [], None
    for _ in range(4000):  # a-b is 0.8 alike; c, which holds a and a piece of b, is closer in bits to each but not alike
        w = ["v%d" % x for x in rng.integers(0, 10**6, 90)]
        a, b = w, edited(rng, w, 0.82)
        c = [*a, *("x%d" % x for x in rng.integers(0, 10**6, 12)), *b[60:75]]
        three = [" ".join(x) for x in (a, b, c)]
        ab, ac, cb = distance(three[0], three[1]), distance(three[0], three[2]), distance(three[2], three[1])
        sets = [cut(x) for x in three]
        alike = [len(x & y) / len(x | y) for x, y in ((sets[0], sets[1]), (sets[0], sets[2]), (sets[2], sets[1]))]
        if alike[0] >= 0.8 > max(alike[1:]) and max(ac, cb) < ab <= 7:
            kept = three
            break
    assert kept
    texts += kept
    want = brute(texts)
    assert want == {0: 0, 1: 0, 2: 2}
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(frame(spark, texts)).collect()} == want


def test_equal_fingerprints_alone_do_not_merge_texts(spark):
    loop = " ".join(["again"] * 200)
    texts = [loop + " " + " ".join(f"{k}{i}" for i in range(60)) for k in "pqr"]
    assert len({simhash.fingerprint(simhash.shingle_hashes(t, 3)) for t in texts}) == 1
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(frame(spark, texts)).collect()} == {0: 0, 1: 1, 2: 2}
    assert corpus_pipeline.near_duplicate_stage(spark, frame(spark, texts), "").count() == 3


def test_near_fingerprints_meet_by_pigeonring(spark):
    rng = np.random.default_rng(27)
    texts = []
    for _ in range(40):
        w = ["v%d" % x for x in rng.integers(0, 10**6, 200)]
        texts += [" ".join(w), " ".join(edited(rng, w, 0.95)), " ".join(w)]
    rows = near_copies.shingle_sets(frame(spark, texts), 5, printed=True).select("key", "fp").distinct().collect()
    fp = {r.key: r.fp & (2**64 - 1) for r in rows}
    want = {(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= near_copies.RADIUS}
    pairs = {(min(r.a, r.b), max(r.a, r.b)) for r in near_copies.print_pairs(spark.createDataFrame(rows)).collect()}
    assert want and pairs <= want
    parent = {k: k for k in fp}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    assert all(root(a) == root(b) for a, b in want)


def test_rows_that_repeat_whole_are_one(spark):
    docs = frame(spark, ["one two three four five six", "another text of some seven words here"])
    left = corpus_pipeline.near_duplicate_stage(spark, docs.unionByName(docs), "")
    assert sorted(r.doc_id for r in left.collect()) == [0, 1]


def test_families_and_long_texts_leave_few_candidates(spark, monkeypatch):
    rng = np.random.default_rng(28)
    texts, base = [], ["b%d" % i for i in range(400)]
    for _ in range(80):  # each differs by about an eighth from the original, and by twice that from the others
        w = list(base)
        for i in rng.integers(0, 400, 10):
            w[i] = "e%d" % rng.integers(10**6)
        texts.append(" ".join(w))
    texts.append(" ".join(base))
    for _ in range(30):  # long texts that share one passage and nothing else
        w = ["v%d" % x for x in rng.integers(0, 10**6, 900)]
        texts.append(" ".join([*w[:450], *("p%d" % i for i in range(6)), *w[450:]]))
    counted, across = [], near_copies.across

    def count(*args):
        pairs = across(*args)
        counted.append(pairs.count())
        return pairs

    monkeypatch.setattr(near_copies, "across", count)
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(frame(spark, texts)).collect()} == brute(texts)
    assert counted[0] < 100


def test_every_text_counts_for_the_order(spark, monkeypatch):
    texts = ["a line that all of these texts share %s" % " ".join("w%d" % (k * i) for k in range(20)) for i in range(700)]
    seen, prefixes = [], near_copies.prefixes
    monkeypatch.setattr(near_copies, "prefixes", lambda sets, counts, least: seen.append(counts) or prefixes(sets, counts, least))
    got = near_copies.near_copies(frame(spark, texts).coalesce(1))
    assert {r.doc_id: r.component_id for r in got.collect()} == brute(texts)
    n = np.zeros(near_copies.CELLS)
    for t in texts:
        n[np.unique(simhash.shingle_hashes(t, 5) % np.uint64(near_copies.CELLS)).astype(int)] += 1
    order = np.argsort(n, kind="stable")[-2000:]
    assert n[order[0]] < 2 and n[order[-1]] == 700
    assert (np.diff(seen[0][order].astype(int)) >= 0).all() and len(np.unique(seen[0][n > 0])) == len(np.unique(n[n > 0]))
    assert ((seen[0] > 0) == (n > 0)).all()
