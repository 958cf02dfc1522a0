"""Near quotes against a comparison of every quote with every stretch."""

import random

from lexmill.operators import citations


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain(docs, quotes, least=0.8):
    out = {}
    for d, text in docs:
        w = text.lower().split()
        for i, quote in quotes:
            q = quote.lower().split()
            for s in range(len(w)):
                a, b = " ".join(w[s : s + len(q)]), " ".join(q)
                if min(len(a), len(b)) < least * max(len(a), len(b)):
                    continue
                score = 1 - distance(a, b) / max(len(a), len(b))
                if score >= least and score > out.get((d, i), 0):
                    out[(d, i)] = score
    return out


def test_edited_quotes_are_found(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    quotes = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([2, 3, 4, 7, 12, 20])))) for i in range(25)]
    docs = []
    for d in range(40):
        w = [rng.choice(words) for _ in range(60)]
        for _ in range(2):
            q = rng.choice(quotes)[1].split()
            edits = rng.sample(range(len(q)), max(1, len(q) // 4))
            for e in edits[: rng.randrange(0, len(edits) + 1)]:
                q[e] = q[e] + "x" if rng.random() < 0.5 else q[e][1:] + "z"
            at = rng.randrange(0, len(w))
            w[at:at] = q
        docs.append((d, " ".join(w)))
    got = citations.fuzzy_quotes(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(quotes, "item_id long, text string"))
    found = {(r.doc_id, r.item_id): r.similarity for r in got.collect()}
    want = plain(docs, quotes)
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want) and len(want) > 50


def test_a_letter_in_each_fourth_word(spark):
    quote = " ".join(f"word{n}number" for n in range(20))
    text = " ".join(w + "x" if n % 4 == 3 else w for n, w in enumerate(quote.split()))
    got = citations.fuzzy_quotes(spark.createDataFrame([(1, "Before. " + text + " after"), (2, "nothing"), (3, None)], "doc_id long, text string"), spark.createDataFrame([(9, quote), (8, ""), (7, None)], "item_id long, text string"))
    (r,) = got.collect()
    assert (r.doc_id, r.item_id) == (1, 9) and r.similarity > 0.97
