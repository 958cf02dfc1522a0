"""Conversation repair: the shortest path against all paths, and the query against a plain version."""

import functools
import hashlib
import random
import re
import zlib

from lexmill.llm import chat_repair, queries

WHOLE, BEGUN = re.compile("(s?(ua)+)?"), re.compile("s?(ua)*u?")


def every_way(roles, must_go, truncated):
    """Least (cost, audit, initials) over all edits that cost no more than deleting everything."""
    n, found, open_ = len(roles), [], [(0, "", 0, "")]
    while open_:
        cost, audit, i, said = open_.pop()
        if cost > 2 * n:
            continue
        if i == n and WHOLE.fullmatch(said):
            found.append((cost, audit, said))
        steps = [("I", 5, 0, x) for x in "ua"]
        if i < n:
            steps.append(("D", 2, 1, ""))
            if not must_go[i]:
                late = 5 * truncated[i]
                steps += [("K", late, 1, roles[i][:1])] * bool(roles[i]) + [("R", late + 1, 1, x) for x in "ua"]
        for letter, more, on, x in steps:
            if BEGUN.fullmatch(said + x):
                open_.append((cost + more, audit + letter, i + on, said + x))
    return min(found)


def test_shortest_path_equals_all_paths():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(0, 6)
        roles = [rng.choice(["user", "assistant", "system", "tool", "user", "assistant", " ", ""]) for _ in range(n)]
        must_go, truncated = [rng.random() < 0.2 for _ in range(n)], [rng.random() < 0.3 for _ in range(n)]
        cost, audit, turns = chat_repair.repair(roles, must_go, truncated)
        initials = "".join(roles[i][0] if i >= 0 else chat_repair.ROLE[s][0] for i, s in turns)
        assert (cost, audit, initials) == every_way(roles, must_go, truncated) == shortest(roles, must_go, truncated)


def shortest(roles, must_go, truncated):
    """The same by recursion over (cost, letters), fit for longer conversations."""
    n = len(roles)

    @functools.cache
    def rest(i, said, added):
        said = re.sub("(ua)+", "ua", said)
        ways = [(0, "", "")] if i == n and WHOLE.fullmatch(said) else []
        steps = [("I", 5, 0, x) for x in "ua"] if added < 2 else []
        if i < n:
            steps.append(("D", 2, 1, ""))
            if not must_go[i]:
                late = 5 * truncated[i]
                steps += [("K", late, 1, roles[i][:1])] * bool(roles[i]) + [("R", late + 1, 1, x) for x in "ua"]
        for letter, more, on, x in steps:
            if BEGUN.fullmatch(said + x) and (w := rest(i + on, said + x, 0 if on else added + 1)):
                ways.append((more + w[0], letter + w[1], x + w[2]))
        return min(ways, default=None)

    return rest(0, "", 0)


def plain(rows):
    chats = {}
    for conv, turn, role, text in rows:
        mine = chats.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 4:
            role = "user"
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, turns in chats.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        there, seen, faults = [t[0] for t in turns if t[0] is not None], set(), []
        for _, role, text in turns:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        roles = [t[1] for t in turns]
        cost, audit, said = shortest(roles, [f in ("b", "d") for f in faults], [f == "t" for f in faults])
        lines, i, k = [], 0, 0
        for letter in audit:
            if letter in "IRK":
                role = {"u": "user", "a": "assistant"}.get(said[k]) if letter != "K" else roles[i]
                lines.append(f"{role}:{'' if letter == 'I' else turns[i][2]}")
                k += 1
            i += letter != "I"
        gaps = max(there) - min(there) + 1 - len(set(there)) if there else 0
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        out.append((conv, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_damaged_chats_equal_plain_version(spark):
    rng = random.Random(8)
    texts = ["Yes.", "No", "Why? ", " ", None, "", "...", " ", "Same.", "Same.", "line\nend!\t"]
    rows = []
    for conv in range(250):
        turns = [rng.choice([k, k, k, k + 1, None]) for k in range(rng.randrange(1, 6))]
        rows += [(conv, t, rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool", "Assistant"]), rng.choice(texts)) for t in turns]
    rows += [(None, 0, "user", "Hi."), (None, None, "user", "Hi."), (7, 1, "user", "Twice."), (7, 1, "user", "Twice.")]
    chats = spark.createDataFrame([(*r, 1, True) for r in rows], "conv_id long, turn long, role string, text string, k int, earlier boolean").repartition(4)
    got = chat_repair.repair_chats(chat_repair.damage(chats)).select(COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)
    assert chat_repair.repair_chats(chats.limit(0)).count() == 0


def test_long_conversation(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", "Well, %d." % k) for k in range(2001)]
    row = chat_repair.repair_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert (row.cost, row.audit.count("K"), len(row.repaired)) == (2, 2000, 2000)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_chat_repair(spark, sf_dir).select(COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)
