"""Exact repeats of 50 words and more, by fixed-block anchors.

Of every document the non-overlapping blocks of 25 words are indexed. Any window of 50 words holds
a whole block, so a repeated window shows up as a probe: some rolling window of 25 words whose hash
is in the index and which more than one document has. Only around such hits are windows of 50 words
hashed (96 bits); a window is a repeat if a document with a smaller doc_id has it, and the words
covered by repeats, merged into maximal spans, go.

How rows travel: documents are dealt once by a hash of doc_id into chunks. A chunk sends each hash
shard one packed row: its distinct hashes in order, delta-coded, a few bytes each. The shard answers
with one bit per hash it was sent. The chunk computes the same list again and reads the bits beside
it, so no text and no pair of documents is ever shuffled on a window's key; a passage that a third
of all documents share is one hash per chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import give_back, mix64, partitions

U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so invertible modulo 2^64
PROBE_BITS = 46
#: A chunk is meant for so many bytes of text at most; its words and hashes take a multiple of that in memory.
CHUNK_BYTES = 8 << 20


class Rolling:
    """Polynomial hashes of all windows of a chunk's words; powers are kept between calls."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([[U(1)], np.cumprod(np.full(n, self.base, U))])
                self.down = np.concatenate([[U(1)], np.cumprod(np.full(n, self.inverse, U))])

    def windows(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Hash of hashes[i : i + size] for each i; equal content gives equal hashes anywhere."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.empty(0, U)
        self.powers(len(hashes))
        sums = np.concatenate([[U(0)], np.cumsum(hashes * self.down[: len(hashes)], dtype=U)])
        return mix64((sums[size:] - sums[:-size]) * self.up[:n])


class Chunk:
    """The words of some documents, end to end, in ascending doc_id order."""

    def __init__(self, doc_ids: list[int], texts: list[str | None]):
        import xxhash

        order = sorted(range(len(doc_ids)), key=lambda i: (doc_ids[i], texts[i] or ""))
        self.order = order
        self.doc_ids = np.array([doc_ids[i] for i in order], np.int64)
        self.words = [(texts[i] or "").encode("utf-8", "surrogatepass").split() for i in order]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        memo: dict[bytes, int] = {}
        digest, flat = xxhash.xxh3_64_intdigest, []
        for w in self.words:
            for x in set(w).difference(memo):
                memo[x] = digest(x)
            flat.append(np.fromiter(map(memo.__getitem__, w), U, len(w)))
        self.hashes = np.concatenate(flat) if flat else np.empty(0, U)
        self.owner = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)

    def inside(self, size: int) -> np.ndarray:
        """Starts of the windows that do not run over their document's end."""
        at = np.arange(max(0, len(self.hashes) - size + 1))
        return at[self.owner[at] == self.owner[at + size - 1]] if len(at) else at


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shard of ascending hashes, ascending too."""
    return ((h >> U(32)) * U(shards) >> U(32)).astype(np.int64)


def pack_ascending(values: np.ndarray) -> bytes:
    """Ascending integers as differences, in as few byte planes as the largest needs."""
    gaps = np.diff(values, prepend=U(0)).astype("<u8")
    planes = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([planes]) + np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()


def unpack_ascending(data: bytes) -> np.ndarray:
    planes = data[0]
    cells = np.frombuffer(data, np.uint8, offset=1).reshape(planes, -1)
    wide = np.zeros((cells.shape[1], 8), np.uint8)
    wide[:, :planes] = cells.T
    return np.cumsum(wide.view("<u8").ravel(), dtype=U)


def planes_of(values: np.ndarray) -> bytes:
    """Fixed-width integers, byte plane by byte plane, so that equal high bytes lie together."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def probes(chunk: Chunk, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct probe hashes in order, whether several documents here have each, whether it is
    a block here, and the hash of each window start of ``chunk.inside(block)``."""
    at = chunk.inside(block)
    h = (Rolling(BASES[0]).windows(chunk.hashes, block)[at] >> U(64 - PROBE_BITS)) << U(64 - PROBE_BITS)
    order = np.argsort(h, kind="stable")
    ordered, owner = h[order], chunk.owner[at][order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(h) else np.empty(0, np.int64)
    low, high = (np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)) if len(h) else (owner, owner)
    fixed = ((at - chunk.starts[chunk.owner[at]]) % block == 0)[order]
    return ordered[first], low != high, np.logical_or.reduceat(fixed, first) if len(h) else fixed, h


def hit_starts(chunk: Chunk, block: int, hits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Window starts whose probe hash is in ``hits`` (ascending)."""
    at = chunk.inside(block)
    if not len(hits):
        return at[:0]
    spot = np.minimum(np.searchsorted(hits, h), len(hits) - 1)
    return at[hits[spot] == h]


def candidates(chunk: Chunk, window: int, block: int, hits: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``window`` words that hold a hit: distinct hashes in order (64 and 32 bits), the
    first document of each here, and for every candidate start its place among the distinct ones."""
    n = len(chunk.hashes)
    cover = np.zeros(n + 1, np.int64)
    starts = hit_starts(chunk, block, hits, h)
    np.add.at(cover, np.maximum(starts - (window - block), 0), 1)
    np.add.at(cover, starts + 1, -1)
    at = chunk.inside(window)
    at = at[np.cumsum(cover)[at] > 0]
    one = Rolling(BASES[0]).windows(chunk.hashes, window)[at]
    two = (Rolling(BASES[1]).windows(chunk.hashes, window)[at] >> U(32)).astype(np.uint32)
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, bool)
    first = np.flatnonzero(new)
    owner = np.minimum.reduceat(chunk.owner[at][order], first) if len(first) else np.empty(0, np.int32)
    place = np.empty(len(at), np.int64)
    place[order] = np.cumsum(new) - 1
    return a[first], b[first], owner, at, place


PROBES = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("chunk", T.IntegerType()),
    T.StructField("hashes", T.BinaryType()), T.StructField("flags", T.BinaryType()),
])
BITS = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("bits", T.BinaryType())])
WINDOWS = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("chunk", T.IntegerType()),
    T.StructField("hashes", T.BinaryType()), T.StructField("more", T.BinaryType()), T.StructField("docs", T.BinaryType()),
])


def arrow(schema: T.StructType, rows: list[tuple]) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    give_back()
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(schema), strict=True)], schema=to_arrow_schema(schema))


def chunk_of(rows: pa.Table) -> Chunk:
    return Chunk(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist())


def answered(bits: pa.Table, n: int) -> np.ndarray:
    """The shards' answers side by side, as one flag per hash that the chunk sent."""
    rows = sorted(zip(bits.column("shard").to_pylist(), bits.column("n").to_pylist(), bits.column("bits").to_pylist(), strict=True))
    flags = [np.unpackbits(np.frombuffer(b, np.uint8), count=k).astype(bool) for _, k, b in rows]
    out = np.concatenate(flags) if flags else np.zeros(0, bool)
    if len(out) != n:
        raise RuntimeError(f"{len(out)} answers to {n} hashes")
    return out


def repeats(docs: DataFrame, window: int = 50, with_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, and with ``with_text`` kept_text (the
    kept words joined by one space; the text itself where nothing was removed) and spans (removed
    word ranges). The columns in ``carry`` come along in a struct named ``carried``.

    A word goes if it lies in a window of ``window`` words that also starts in a document with a
    smaller doc_id, judged on the input. Null, empty and blank texts have no words. Rows without
    doc_id take no part. Rows that share a doc_id are judged one by one and never against each other.
    """
    block, n = window // 2, partitions(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    chunks = max(2 * n, -(-size // CHUNK_BYTES))  # so a task holds as much at every size
    shards = max(n, chunks // 2)
    chunk = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(chunks)).cast("int").alias("chunk")
    carried = [F.struct(*carry).alias("carried")] if carry else []
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried).where("doc_id is not null").select("*", chunk)

    def slices(h: np.ndarray) -> Iterator[tuple[int, slice]]:
        edges = np.searchsorted(shard_of(h, shards), np.arange(shards + 1))
        for s in range(shards):
            if edges[s + 1] > edges[s]:
                yield s, slice(edges[s], edges[s + 1])

    def send_probes(key: tuple, rows: pa.Table) -> pa.Table:
        h, several, fixed, _ = probes(chunk_of(rows), block)
        c, down = key[0].as_py(), U(64 - PROBE_BITS)
        flags = np.stack([several, fixed], axis=1) if len(h) else np.empty((0, 2), bool)
        return arrow(PROBES, [(s, c, pack_ascending(h[x] >> down), np.packbits(flags[x].ravel()).tobytes()) for s, x in slices(h)])

    def match_probes(key: tuple, rows: pa.Table) -> pa.Table:
        sent = [unpack_ascending(b) for b in rows.column("hashes").to_pylist()]
        flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=2 * len(h)).reshape(-1, 2).astype(bool) for f, h in zip(rows.column("flags").to_pylist(), sent, strict=True)]
        all_h, all_f = np.concatenate(sent), np.concatenate(flags)
        values, where, count = np.unique(all_h, return_inverse=True, return_counts=True)
        several, fixed = np.zeros(len(values), bool), np.zeros(len(values), bool)
        several[where[all_f[:, 0]]] = True
        fixed[where[all_f[:, 1]]] = True
        good = (((count > 1) | several) & fixed)[where]
        edges = np.cumsum([0, *map(len, sent)])
        return arrow(BITS, [(c, key[0].as_py(), len(h), np.packbits(good[a : a + len(h)]).tobytes()) for c, h, a in zip(rows.column("chunk").to_pylist(), sent, edges[:-1], strict=True)])

    def own_candidates(rows: pa.Table, bits: pa.Table) -> tuple:
        chunk = chunk_of(rows)
        h, _, _, each = probes(chunk, block)
        return chunk, candidates(chunk, window, block, h[answered(bits, len(h))], each)

    def send_windows(key: tuple, rows: pa.Table, bits: pa.Table) -> pa.Table:
        chunk, (one, two, owner, _, _) = own_candidates(rows, bits)
        ids = chunk.doc_ids[owner]
        return arrow(WINDOWS, [(s, key[0].as_py(), pack_ascending(one[x]), planes_of(two[x]), planes_of(ids[x])) for s, x in slices(one)])

    def match_windows(key: tuple, rows: pa.Table) -> pa.Table:
        one = [unpack_ascending(b) for b in rows.column("hashes").to_pylist()]
        a = np.concatenate(one)
        b = np.concatenate([from_planes(x, "<u4") for x in rows.column("more").to_pylist()])
        d = np.concatenate([from_planes(x, "<i8") for x in rows.column("docs").to_pylist()])
        order = np.lexsort((d, b, a))
        new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
        first = d[order][np.flatnonzero(new)][np.cumsum(new) - 1]  # smallest doc_id of each window
        earlier = np.empty(len(a), bool)
        earlier[order] = first < d[order]
        edges = np.cumsum([0, *map(len, one)])
        return arrow(BITS, [(c, key[0].as_py(), len(h), np.packbits(earlier[s : s + len(h)]).tobytes()) for c, h, s in zip(rows.column("chunk").to_pylist(), one, edges[:-1], strict=True)])

    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    if with_text:
        span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
        fields += [T.StructField("kept_text", T.StringType()), T.StructField("spans", T.ArrayType(span))]
    result, passed = T.StructType(fields), [dealt.schema["carried"]] if carry else []

    def remove(_key: tuple, rows: pa.Table, both: pa.Table) -> pa.Table:
        step = both.column("step").to_numpy()
        chunk, (one, _, owner, at, place) = own_candidates(rows, both.filter(pa.array(step == 1)))
        elsewhere = answered(both.filter(pa.array(step == 2)), len(one))
        # a smaller document in another chunk, or in this one
        gone = elsewhere[place] | (chunk.doc_ids[owner[place]] < chunk.doc_ids[chunk.owner[at]]) if len(at) else np.empty(0, bool)
        cover = np.zeros(len(chunk.hashes) + 1, np.int64)
        np.add.at(cover, at[gone], 1)
        np.add.at(cover, at[gone] + window, -1)
        removed = np.cumsum(cover)[:-1] > 0
        out, texts = [], rows.column("text").to_pylist() if with_text else []
        for i, w in enumerate(chunk.words):
            r = removed[chunk.starts[i] : chunk.starts[i + 1]]
            count = int(r.sum())
            kept = b" ".join(x for x, y in zip(w, r.tolist(), strict=True) if not y) if count else b" ".join(w)
            row = (int(chunk.doc_ids[i]), len(w), count, hashlib.sha256(kept).hexdigest())
            if with_text:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], r.astype(np.int8), [0]])))
                row += (kept.decode("utf-8", "surrogatepass") if count else texts[chunk.order[i]], [{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
            out.append(row)
        found = arrow(result, out)
        return found.append_column("carried", rows.column("carried").take(pa.array(chunk.order))) if carry else found

    # one plan: the exchange of the texts, and that of the hits, are each made once and read again
    hits = dealt.groupBy("chunk").applyInArrow(send_probes, PROBES).groupBy("shard").applyInArrow(match_probes, BITS)
    seen = dealt.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(send_windows, WINDOWS)
    earlier = seen.groupBy("shard").applyInArrow(match_windows, BITS)
    both = hits.withColumn("step", F.lit(1)).unionByName(earlier.withColumn("step", F.lit(2)))
    return dealt.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(remove, T.StructType([*fields, *passed]))
