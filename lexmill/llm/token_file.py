"""Token files with Elias-Fano document boundaries.

Format of one block (all integers little-endian)::

    magic "EFT1" | u32 documents | u64 ids | u64 smallest doc_id | u32 bytes of an id (2 or 4)
    | Elias-Fano sequence of the documents' end offsets
    | Elias-Fano sequence of doc_id - smallest doc_id
    | ids, 2 or 4 bytes each

An Elias-Fano sequence keeps n ascending values below u in about n(2 + log2(u/n)) bits: the low
bits packed, the high bits in unary, and the position of every 64th unary one, from which
``select(i)`` finds value i without a table of 64-bit offsets.

Blocks are the rows of a table (part, seq, start, n_ids, payload) written by Spark, so that any
store that Spark can write holds them and a repeated task replaces its own output. Documents are
in ascending doc_id order over (part, seq).
"""

from __future__ import annotations

import itertools
import struct
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

MAGIC = b"EFT1"
SAMPLE = 64
BLOCKS = T.StructType([
    T.StructField("part", T.IntegerType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("start_in_part", T.LongType()),
    T.StructField("n_ids", T.LongType()),
    T.StructField("payload", T.BinaryType()),
])


class EliasFano:
    """Ascending non-negative integers, compressed; ``select(i)`` is value i."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        universe = int(v[-1]) + 1 if n else 1
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        high[ones] = 1
        return cls(n, bits, low.tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<IIIII", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return head + self.low + self.high + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, bits, n_low, n_high, n_samples = struct.unpack_from("<IIIII", data, at)
        at += 20
        low, high = data[at : at + n_low], data[at + n_low : at + n_low + n_high]
        at += n_low + n_high
        samples = np.frombuffer(data, dtype="<u4", count=n_samples, offset=at)
        return cls(n, bits, low, high, samples), at + 4 * n_samples

    def select(self, i: int) -> int:
        """Value i: from the nearest sample on, only the unary bits between are read."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        here = self.high[byte] >> (at % 8) << (at % 8)
        while (ones := here.bit_count()) <= left:
            left -= ones
            byte += 1
            here = self.high[byte]
        for _ in range(left):
            here &= here - 1
        one = 8 * byte + (here & -here).bit_length() - 1
        low = 0
        if self.low_bits:
            first, end = i * self.low_bits, (i + 1) * self.low_bits
            raw = int.from_bytes(self.low[first // 8 : (end + 7) // 8], "little")
            low = raw >> (first % 8) & ((1 << self.low_bits) - 1)
        return (one - i) << self.low_bits | low

    def select_range(self, first: int, end: int) -> np.ndarray:
        """Values first..end-1 at once: only the unary and low bits from ``first``'s sample to the
        sample behind ``end`` are read."""
        if not 0 <= first <= end <= self.n:
            raise IndexError((first, end))
        if first == end:
            return np.empty(0, np.int64)
        sample = first // SAMPLE
        start, stop = int(self.samples[sample]) // 8, -(-end // SAMPLE)
        last = int(self.samples[stop]) // 8 + 1 if stop < len(self.samples) else len(self.high)
        bits = np.unpackbits(np.frombuffer(self.high[start:last], np.uint8), bitorder="little")
        bits[: int(self.samples[sample]) - 8 * start] = 0  # ones of values before the sample
        ones = 8 * start + np.flatnonzero(bits)[first - sample * SAMPLE : end - sample * SAMPLE]
        value = (ones - np.arange(first, end)).astype(np.int64) << self.low_bits
        if self.low_bits:
            at, to = first * self.low_bits, end * self.low_bits
            raw = np.unpackbits(np.frombuffer(self.low[at // 8 : (to + 7) // 8], np.uint8), bitorder="little")[at % 8 :][: to - at]
            value |= raw.reshape(-1, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return value

    def all(self) -> np.ndarray:
        return self.select_range(0, self.n)


def pack_block(doc_ids: list[int], parts: list[bytes], width: int) -> bytes:
    """One block; ``parts`` are each document's ids as unsigned 32-bit bytes."""
    ends = np.cumsum([len(p) // 4 for p in parts], dtype=np.int64)
    ids = np.frombuffer(b"".join(parts), dtype="<u4").astype("<u2" if width == 2 else "<u4")
    first = min(doc_ids)
    head = MAGIC + struct.pack("<IQqI", len(parts), len(ids), first, width)
    sequences = EliasFano.of(ends).to_bytes() + EliasFano.of(np.asarray(doc_ids, dtype=np.int64) - first).to_bytes()
    return head + sequences + ids.tobytes()


class Block:
    """A block read back."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token block")
        self.n_docs, self.n_ids, self.first, width = struct.unpack_from("<IQqI", data, 4)
        self.ends, at = EliasFano.from_bytes(data, 28)
        self.docs, at = EliasFano.from_bytes(data, at)
        self.ids = np.frombuffer(data, dtype="<u2" if width == 2 else "<u4", count=self.n_ids, offset=at)

    def ids_of(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def write_token_blocks(docs: DataFrame, tokenizer: str, end_id: int, block_ids: int = 1_000_000, tag: str = "tokens") -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write their ids; returns the table of blocks.

    Each document's ids end with ``end_id``. Null texts count as empty; a row whose doc_id is null
    cannot be addressed and takes no part; rows that share a doc_id are all kept, ordered by text.
    A block is closed once it holds ``block_ids`` ids, so it is bounded by that plus one document.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        seq = start = size = 0
        ids: list[int] = []
        parts: list[bytes] = []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.array([pack_block(ids, parts, width)], pa.binary())],
                names=BLOCKS.names,
            )

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in in_slices(texts):
                for d, e in zip(doc_ids[a:b], enc.encode(texts[a:b]), strict=True):
                    ids.append(d)
                    parts.append(e + end)
                    size += len(e) // 4 + 1
                    if size >= block_ids:
                        yield block()
                        seq, start, size, ids, parts = seq + 1, start + size, 0, [], []
        if ids:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    ordered = rows.repartitionByRange(2 * partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return keep(ordered.mapInArrow(run, BLOCKS), tag)


def block_starts(blocks: DataFrame) -> DataFrame:
    """Each part's first global offset. One row per part: as many as write tasks, not documents."""
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
])


def read_documents(blocks: DataFrame, group: int = 16 * SAMPLE) -> DataFrame:
    """One row per document of a written table: doc_id, global start, n_tokens, ids_crc32.

    Boundaries and doc_ids are selected from the Elias-Fano sequences, ``group`` documents at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = Block(payload)
                for at in range(0, b.n_docs, group):
                    end = min(at + group, b.n_docs)
                    edges = np.concatenate([[b.ends.select(at - 1) if at else 0], b.ends.select_range(at, end)])
                    crc = [zlib.crc32(b.ids[s:e].astype("<u4").tobytes()) for s, e in itertools.pairwise(edges)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(b.docs.select_range(at, end) + b.first), pa.array(edges[:-1] + first), pa.array(np.diff(edges)), pa.array(crc, pa.int64())], names=DOCUMENTS.names
                    )

    placed = blocks.join(F.broadcast(block_starts(blocks)), "part")
    return placed.select((F.col("part_start") + F.col("start_in_part")).alias("first"), "payload").mapInArrow(run, DOCUMENTS)
