r"""Conversation structure repair: the cheapest edits that make roles read ``(s?(ua)+)?``.

Spark sorts a conversation's turns and finds blank and repeated ones; one pass over each conversation
then decides its edits. That is a shortest path in a graph of (turn, what may come next), solved from
the last turn to the first with one scalar weight per node: a big integer whose high digits carry the
cost and whose WIDTH low digits, base 5, spell the audit letters from the left, with zeros behind the end.
Putting an edge before a path adds its cost, shifts the letters one place down and writes its own
letter on top, so the smaller of two integers is the cheaper path and, at equal cost, the one whose
letters come first (D, I, K, R; a shorter text before its continuation). Nothing else decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

LETTERS = "DIKR"  # digits 1 to 4, in the order of their characters
DELETE, INSERT, KEEP, REROLE = range(1, 5)
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED = 5
#: What has been said so far: nothing, a system turn, a user turn last, an assistant turn last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
TURNS_OF = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: After each, the only role that a new or re-rolled turn can have.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
BLANK = r"[\x20\x09-\x0D]"
ENDS = ".!?"


def repair(roles: list[str], must_go: list[bool], truncated: list[bool]) -> tuple[int, str, list[tuple[int, int]]]:
    """Cost, audit letters, and the repaired turns as (index of the kept turn or -1, state reached)."""
    n = len(roles)
    if not n:
        return 0, "", []
    width = 3 * n + 2  # each turn has one letter, each of the n + 1 gaps two insertions at most
    top, whole = 5 ** (width - 1), 5**width

    def before(edit: int, extra: int, rest: int) -> int:
        cost, letters = divmod(rest, whole)
        return (cost + COST[edit] + extra) * whole + edit * top + letters // 5

    def insertions(direct: list[int | None], choice: list[tuple[int, int]]) -> list[int]:
        """Weights in front of a gap, from those behind it: ASSISTANT waits for a user turn or the end,
        and so on; each state may insert the one role that can follow it."""
        out = list(direct)
        for _ in range(2):
            for state in (USER, NOTHING, SYSTEM, ASSISTANT):
                rest = out[NEXT[state]]
                new = None if rest is None else before(INSERT, 0, rest)
                if new is not None and (out[state] is None or new < out[state]):
                    out[state], choice[state] = new, (INSERT, NEXT[state])
        return out

    end: list[int | None] = [0, None, None, 0]
    choices: list[tuple[list, list]] = []
    gap: list = [None] * 4
    weights = insertions(end, gap)
    last_gap = gap
    for i in range(n - 1, -1, -1):
        turn: list = [None] * 4
        row: list[int | None] = [None] * 4
        late = TRUNCATED if truncated[i] else 0
        for state in range(4):
            options = [(before(DELETE, 0, weights[state]), (DELETE, state))]
            if not must_go[i]:
                kept = TURNS_OF.get(roles[i][:1], {}).get(state)
                if kept is not None:
                    options.append((before(KEEP, late, weights[kept]), (KEEP, kept)))
                options.append((before(REROLE, late, weights[NEXT[state]]), (REROLE, NEXT[state])))
            row[state], turn[state] = min(options)
        gap = [None] * 4
        weights = insertions(row, gap)
        choices.append((gap, turn))
    choices.reverse()
    cost, letters = divmod(weights[NOTHING], whole)
    audit, turns, state = [], [], NOTHING
    for i in range(n + 1):
        gap, turn = choices[i] if i < n else (last_gap, None)
        while gap[state] is not None:
            state = gap[state][1]
            audit.append(INSERT)
            turns.append((-1, state))
        if turn is not None:
            edit, state = turn[state]
            audit.append(edit)
            if edit != DELETE:
                turns.append((i if edit == KEEP else -2 - i, state))
    spelled = sum(e * 5 ** (width - 1 - k) for k, e in enumerate(audit))
    if spelled != letters:
        raise RuntimeError("the walk does not spell the weight")
    return cost, "".join(LETTERS[e - 1] for e in audit), turns


TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
FOUND = T.StructType([
    *[T.StructField(c, T.LongType()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType()), T.StructField("repaired", T.ArrayType(TURN)),
])


def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(FOUND)
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            turns = [t for t in row["turns"] for _ in range(t["copies"])]
            roles, faults = [t["role"] for t in turns], []
            for i, t in enumerate(turns):
                repeated = t["earlier"] or (i > 0 and t is turns[i - 1])
                faults.append("blank" if t["last"] == "" else "duplicate" if repeated else "truncated" if t["last"] not in ENDS else "")
            illegal = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:], strict=False))
            cost, audit, path = repair(roles, [f in ("blank", "duplicate") for f in faults], [f == "truncated" for f in faults])
            said = [{"role": turns[i]["role"] if i >= 0 else ROLE[s], "text": "" if i == -1 else turns[i if i >= 0 else -2 - i]["text"]} for i, s in path]
            text = "\n".join(f"{t['role']}:{t['text']}" for t in said)
            out.append({
                "conv_id": row["conv_id"], "gaps": row["gaps"], **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")}, "illegal": illegal,
                "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), "repaired": said,
            })
        yield pa.RecordBatch.from_pylist(out, schema=kind)


def repair_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text, and ``copies``: how often the row
    stands there, 0 for a conversation that lost it; 1 if the column is missing): conv_id, gaps, counts of
    blank, duplicate and truncated turns and of illegal neighbours, cost, audit, repaired_sha256 and the
    repaired turns.

    Turns are sorted by turn (nulls first), then role and text, so ties have one order. Null roles and
    texts are one space. A role counts by its first character; one without any can't stay as it is. A
    null conv_id is a conversation of that id. Other columns are ignored; an empty table gives no rows.
    A conversation is one row of the result and must fit in a task; weights grow with its turns, so
    its time grows with their square (1 000 turns: a tenth of a second).
    """
    if "copies" not in turns.columns:
        turns = turns.withColumn("copies", F.lit(1))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.col("copies").cast("int").alias("copies"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    alike = Window.partitionBy("conv_id", "role", "text").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("copies").over(alike), F.lit(0)) > 0
    last: Column = F.right(F.regexp_replace("text", BLANK, ""), F.lit(1))
    placed = rows.select("*", last.alias("last"), F.row_number().over(order).alias("k")).withColumn("earlier", earlier)
    turn = F.when(F.col("copies") > 0, F.struct("k", "turn", "role", "text", "copies", "earlier", "last"))
    chats = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    there = F.filter(F.transform("turns", lambda t: t["turn"]), lambda t: t.isNotNull())
    gaps = F.array_max(there) - F.array_min(there) + 1 - F.size(F.array_distinct(there))
    chats = chats.select("conv_id", "turns", F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"))
    return chats.mapInArrow(mend, FOUND)


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with one fault in four, by crc32 of ``conv_id:turn`` modulo 20."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(filled[0], F.lit(":"), filled[1])) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return turns.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
