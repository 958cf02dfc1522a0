"""Names for keys that many chunks hold, by messages between chunks and hash shards.

A chunk (some megabytes of a table, worked on with numpy in one task) sends each shard one packed row:
its distinct 64-bit keys in order, delta-coded, and how often it has each. The shard adds up the counts
over all chunks, sorts, and gives every key that occurs ``least`` times or more a name: its shard and
its rank there. The chunk gets back one bit per key, and the ranks of those that have a name. A key
that a third of all rows share is one entry per chunk, so no shard or chunk grows with a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexmill.llm.common import mix64
from lexmill.llm.substring import arrow, from_planes, pack_ascending, planes_of, shard_of, unpack_ascending

U = np.uint64
#: Keys that a shard looks at together; sorting and counting takes about 100 bytes for each.
STEP = 1 << 19


def schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


B = T.BinaryType()
MESSAGE = schema(shard=T.IntegerType(), chunk=T.LongType(), keys=B, counts=B)
ANSWER = schema(chunk=T.LongType(), shard=T.IntegerType(), n=T.IntegerType(), named=B, ranks=B, told=B, totals=B)


def narrow(values: np.ndarray) -> bytes:
    """Counts in as few byte planes as the largest needs."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(values) or int(values.max()) < 1 << 8 * np.dtype(k).itemsize)
    return kind[1:].encode() + planes_of(values.astype(kind))


def narrowed(data: bytes) -> np.ndarray:
    return from_planes(data[2:], "<" + data[:2].decode())


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def combine(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit key from several columns of integers."""
    key = np.zeros(len(parts[0]), U)
    with np.errstate(over="ignore"):
        for p in parts:
            key = mix64(key * U(0x9E3779B97F4A7C15) + p.astype(U) + U(1))
    return key


def messages(chunk: int, keys: np.ndarray, counts: np.ndarray, shards: int) -> list[tuple]:
    """Rows of MESSAGE for ascending distinct ``keys``."""
    owner = shard_of(keys, shards)
    edges = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]])) if len(keys) else np.zeros(1, int)
    return [(int(owner[a]), chunk, pack_ascending(keys[a:b]), narrow(counts[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def ranges(sent: list[np.ndarray]) -> Iterator[list[tuple[int, int]]]:
    """Neighbouring ranges of keys, which are hashes, with about ``STEP`` of them each, as places in every one of ``sent``."""
    steps = -(-sum(map(len, sent)) // STEP)
    low, high = min(int(s[0]) for s in sent), max(int(s[-1]) for s in sent)
    edges = np.array([low + (high - low) * k // steps for k in range(1, steps)], U)
    at = [np.concatenate([[0], np.searchsorted(s, edges), [len(s)]]).tolist() for s in sent]
    return ([(x[k], x[k + 1]) for x in at] for k in range(steps))


def match(least: int):
    """The shard's side, for ``groupBy("shard").applyInArrow``."""

    def answer(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        sent = [unpack_ascending(k) for k in rows.column("keys").to_pylist()]
        counts = [narrowed(c) for c in rows.column("counts").to_pylist()]
        named, ranks, told, totals = ([[] for _ in sent] for _ in range(4))
        names = 0
        for cuts in ranges(sent):
            values, first, place = np.unique(np.concatenate([s[a:b] for s, (a, b) in zip(sent, cuts, strict=True)]), return_index=True, return_inverse=True)
            total = np.zeros(len(values), U)
            np.add.at(total, place, np.concatenate([c[a:b] for c, (a, b) in zip(counts, cuts, strict=True)]).astype(U))
            good = total >= least
            rank = np.cumsum(good).astype(U) + U(names)  # from 1
            names += int(good.sum())
            tells = np.zeros(len(place), bool)
            tells[first] = True  # of the chunks that have a key, the first tells the world about it
            at = 0
            for i, (a, b) in enumerate(cuts):
                mine, speaks = place[at : at + b - a], tells[at : at + b - a]
                ok = good[mine]
                named[i].append(ok)
                ranks[i].append(rank[mine[ok]])
                told[i].append(speaks[ok])
                totals[i].append(total[mine[ok & speaks]])
                at += b - a
        out = []
        for i, chunk in enumerate(rows.column("chunk").to_pylist()):
            ok, rank, speaks, total = (np.concatenate(x[i]) for x in (named, ranks, told, totals))
            out.append((chunk, key[0].as_py(), len(ok), bits(ok), pack_ascending(rank), bits(speaks), planes_of(total.astype("<u8"))))
            named[i] = ranks[i] = told[i] = totals[i] = None
        return arrow(ANSWER, out)

    return answer


def answered(rows: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the chunk's keys in order: their names (0: none), whether this chunk tells about each, and the total if so."""
    name, tell, total = np.zeros(n, U), np.zeros(n, bool), np.zeros(n, U)
    a = 0
    for r in sorted(rows.to_pylist(), key=lambda r: r["shard"]):
        ok = a + np.flatnonzero(flags(r["named"], r["n"]))
        name[ok] = (U(r["shard"] + 1) << U(40)) | unpack_ascending(r["ranks"])
        mine = ok[flags(r["told"], len(ok))]
        tell[mine] = True
        total[mine] = from_planes(r["totals"], "<u8")
        a += r["n"]
    if a != n:
        raise RuntimeError(f"{a} answers to {n} keys")
    return name, tell, total


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct keys, their counts, and each key's place among them."""
    values, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return values.astype(U), counts.astype(U), place


def ask(state: DataFrame, keys_of, shards: int, least: int) -> DataFrame:
    """Answers to the keys of every chunk. ``keys_of(row)`` gives a state row's ascending distinct keys and counts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                yield from arrow(MESSAGE, messages(row["chunk"], *keys_of(row), shards)).to_batches()

    return state.mapInArrow(send, MESSAGE).groupBy("shard").applyInArrow(match(least), ANSWER)
