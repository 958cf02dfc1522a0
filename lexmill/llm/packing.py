"""Packing by shortest-pack-first over the histogram of lengths.

Only the histogram (one row per length, at most ``size`` of them) reaches the driver. There the
lengths are placed longest first, each into the shortest packs that still have room; packs that
hold the same lengths are one pattern with a count, so the work depends on ``size``, not on the
number of documents. Patterns go back to the pieces by rank: the k-th piece of a length takes the
k-th place for that length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexmill.llm.common import keep, partitions
from lexmill.llm.tokens import encoder, in_slices

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("copy", T.LongType()),
])


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns as (count, [(length, times), ...]) that together hold every piece exactly once.

    A pack's room is ``size`` less what it holds. The shortest pack is the one with the most room.
    """
    open_packs: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []  # ascending
    done: list[tuple[int, tuple]] = []

    def put(room: int, count: int, pack: tuple) -> None:
        if not room:
            done.append((count, pack))
            return
        if room not in open_packs:
            bisect.insort(rooms, room)
            open_packs[room] = []
        open_packs[room].append((count, pack))

    def added(pack: tuple, length: int, times: int) -> tuple:
        if pack and pack[-1][0] == length:
            return pack[:-1] + ((length, pack[-1][1] + times),)
        return (*pack, (length, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left and rooms and rooms[-1] >= length:
            room = rooms[-1]
            count, pack = open_packs[room].pop()
            used = min(count, left)
            if count > used:
                open_packs[room].append((count - used, pack))
            elif not open_packs[room]:
                del open_packs[room]
                rooms.pop()
            put(room - length, used, added(pack, length, 1))
            left -= used
        if left:  # none has room: each new pack takes pieces until it is full, then the next opens
            each = size // length
            if left // each:
                put(size - each * length, left // each, ((length, each),))
            if left % each:
                put(size - left % each * length, 1, ((length, left % each),))
    for room in rooms:
        done += open_packs[room]
    return [(count, list(pack)) for count, pack in done]


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length its runs of places: (rank of the first, places a sequence, first sequence, offset)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for count, pack in patterns:
        offset = 0
        for length, times in pack:
            rank = given.get(length, 0)
            out.setdefault(length, []).append((rank, times, sequence, offset))
            given[length] = rank + times * count
            offset += length * times
        sequence += count
    return out


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int) -> DataFrame:
    """Pieces of at most ``size`` ids of each document's ids with ``end_id`` behind them.

    Null texts count as empty; rows without doc_id take no part. Rows that share a doc_id are
    all cut; ``copy`` tells such rows apart.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            doc_ids, texts, copies = (batch.column(i).to_pylist() for i in range(3))
            for a, b in in_slices(texts):
                rows = []
                for d, c, e in zip(doc_ids[a:b], copies[a:b], enc.encode(texts[a:b]), strict=True):
                    ids = e + end
                    n = len(ids) // 4
                    for s in range(0, n, size):
                        piece = ids[4 * s : 4 * (s + size)]
                        rows.append((d, s, len(piece) // 4, zlib.crc32(piece), n, c))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=PIECES.names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("copy"))
    return rows.where("doc_id is not null").mapInArrow(run, PIECES)


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, start, length, ..., copy).

    Ranks within a length are counted in salted groups, whose sizes are then summed up: a length
    that a third of all pieces has is ranked by many tasks. The table of group sizes has at most
    ``size`` x partitions rows. ``pieces`` must be a written table, as it is read twice.
    """
    spark = pieces.sparkSession
    salts = partitions(spark)
    salt = F.pmod(F.xxhash64("doc_id", "start", "copy"), F.lit(salts)).cast("int")
    groups = pieces.groupBy("length", salt.alias("salt")).agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(pack_histogram(counts, size))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "copy")
    ranked = pieces.withColumn("salt", salt).withColumn("r", F.row_number().over(within) - 1)
    ranked = ranked.join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("r")).drop("base", "r", "salt", "copy")
    names = [c for c in ranked.columns if c != "rank"]
    schema = T.StructType([ranked.schema[c] for c in names] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    lookup = spark.sparkContext.broadcast({k: tuple(np.asarray(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in table.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length):
                at = np.flatnonzero(length == one)
                first, times, seq, off = lookup.value[int(one)]
                run_of = np.searchsorted(first, rank[at], side="right") - 1
                k = rank[at] - first[run_of]
                sequence[at] = seq[run_of] + k // times[run_of]
                offset[at] = off[run_of] + k % times[run_of] * one
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 1024) -> DataFrame:
    """Pack whole documents: one row per piece, with its sequence and its offset there."""
    return pack(keep(cut_pieces(docs, tokenizer, end_id, size), "pieces"), size)
