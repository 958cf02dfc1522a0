"""Repeated byte strings, by bucket-pointer refinement over sampled suffixes.

A text's window of ``length`` bytes is anchored at the smallest hash among its grams of GRAM bytes, so
equal windows have equal anchors. Anchors, some one in 170 bytes, and each text's ends are the sampled
suffixes. They are put into buckets by their gram; a bucket with one suffix is done, and so are the
windows anchored in it: they occur once. The other buckets are refined by sorting on the buckets of the
next two samples and a hash of what lies between, and the refined pointers are then used at later offsets, two samples
apart, to name the whole stretch between the samples around a run of windows. Where that stretch
occurs twice, so does every window in it. What is left are windows near the ends of repeats: they are
compared one by one, by 96 bits of hash, with each other and with one copy of each repeated stretch
that has such windows in its bucket.

Bucket pointers come from hash shards (``naming``): a chunk of texts sends its distinct keys and gets
pointers back, so a passage that a third of all texts share is one key per chunk. Texts are shuffled
once, for the last step. Keys are 64 bits: two of n distinct ones are confused with a probability of
n^2 / 2^65, where n is about a hundredth of the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import give_back, keep, mix64, partitions
from lexmill.llm.naming import B, U, answered, ask, bits, combine, distinct, flags, schema
from lexmill.llm.substring import BASES, Rolling, arrow, from_planes, pack_ascending, planes_of, shard_of, unpack_ascending

GRAM, BLOCK, LOCAL_BITS = 64, 1 << 18, 20
CHUNK_BYTES, SHARD_BYTES, WINDOW_SHARD_BYTES = 16 << 20, 256 << 20, 32 << 20
#: What is known of a run of windows: they occur once; have to be compared; occur again; occur again,
#: and are compared on behalf of all like them.
ONCE, OPEN, KNOWN, SPEAKS = range(4)
#: A random-looking value for each byte.
VALUES = mix64(np.arange(1, 257, dtype=U))

I, L = T.IntegerType(), T.LongType()
SAMPLES = schema(chunk=L, doc_id=L, tie=L, n=L, points=B, grams=B, between=B, runs=B, last=B)
STATE = schema(chunk=L, sizes=B, points=B, owner=B, pointer=B, between=B, run_point=B, last=B, repeated=B)
WINDOWS = schema(shard=I, chunk=L, hashes=B, more=B, several=B)
BITS = schema(chunk=L, shard=I, n=I, bits=B)


class Bytes:
    """Texts end to end, in the order given, as bytes."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        self.n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, count=self.n + 1, offset=8 * texts.offset)
        data = texts.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.empty(0, np.uint8)
        self.starts = offsets - offsets[0]
        self.sizes = np.diff(self.starts)

    def windows(self, length: int) -> Iterator[tuple[int, np.ndarray]]:
        """Blocks of positions: where each begins, and whether a window that starts there stays in its text."""
        for low in range(0, max(0, len(self.data) - length + 1), BLOCK):
            high = min(low + BLOCK, len(self.data) - length + 1)
            a, b = np.searchsorted(self.starts, low, "right") - 1, np.searchsorted(self.starts, high, "left")
            room = np.clip(self.starts[a + 1 : b + 1], low, high) - np.clip(self.starts[a:b], low, high)
            yield low, np.arange(low, high) <= np.repeat(self.starts[a + 1 : b + 1] - length, room)


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        v, size = np.minimum(v[:-size], v[size:]), 2 * size
    return np.minimum(v[: len(v) - (width - size)], v[width - size :]) if size < width else v


def anchor_runs(texts: Bytes, length: int, gram: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one anchor: the anchor, first and last window, the anchor's gram."""
    width, found = length - gram + 1, []
    low_bits = U((1 << LOCAL_BITS) - 1)
    for low, inside in texts.windows(length):
        if not inside.any():
            continue
        h = rolling.windows(VALUES[texts.data[low : low + len(inside) + length - 1]], gram)
        best = sliding_min((h & ~low_bits) | np.arange(len(h), dtype=U), width)
        at = np.flatnonzero(inside)
        anchor = (best[at] & low_bits).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]))
        end = np.concatenate([new[1:], [len(at)]]) - 1
        found.append((anchor[new] + low, at[new] + low, at[end] + low, h[anchor[new]]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U)
    anchor, first, last, h = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (first[1:] != last[:-1] + 1)]))  # a run may cross blocks
    return anchor[new], first[new], last[np.concatenate([new[1:], [len(anchor)]]) - 1], h[new]


def gram_at(data: np.ndarray, at: np.ndarray, gram: int, rolling: Rolling) -> np.ndarray:
    rolling.powers(gram)
    with np.errstate(over="ignore"):
        return mix64((VALUES[data[at[:, None] + np.arange(gram)]] * rolling.down[:gram]).sum(axis=1, dtype=U))


def between(data: np.ndarray, points: np.ndarray, rolling: Rolling) -> np.ndarray:
    """Hash of the bytes from each point to the next; 0 for the last point and for far ones, which lie in
    different texts."""
    out, a = np.zeros(len(points), U), 0
    while a + 1 < len(points):
        c = np.searchsorted(points, points[a] + BLOCK, "right") - 1
        if c > a:
            rolling.powers(BLOCK + 1)
            x = points[a : c + 1] - points[a]
            with np.errstate(over="ignore"):
                sums = np.concatenate([[U(0)], np.cumsum(VALUES[data[points[a] : points[c]]] * rolling.down[: x[-1]], dtype=U)])
                out[a:c] = mix64((sums[x[1:]] - sums[x[:-1]]) * rolling.up[x[:-1]])
        a = max(c, a + 1)
    return out


def sample(length: int, gram: int):
    """Per text of ``length`` bytes and more: a row of SAMPLES, positions counted from its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(BASES[0])
        for batch in batches:
            texts = Bytes(batch.column("text"))
            anchor, _, last, h = anchor_runs(texts, length, gram, rolling)
            long = np.flatnonzero(texts.sizes >= length)
            ends = np.stack([texts.starts[:-1][long], texts.starts[1:][long] - gram], 1).ravel()
            points, place = np.unique(np.concatenate([anchor, ends]), return_index=True)
            hashes = np.concatenate([h, gram_at(texts.data, ends, gram, rolling)])[place]
            segments, run_point = between(texts.data, points, rolling), np.searchsorted(points, anchor)
            ids, ties, homes = (batch.column(c).to_pylist() for c in ("doc_id", "tie", "chunk"))
            out = []
            for i in long.tolist():
                start, end = texts.starts[i], texts.starts[i + 1]
                x, y = slice(*np.searchsorted(points, [start, end])), slice(*np.searchsorted(anchor, [start, end]))
                cells = ((points[x] - start).astype("<u4"), hashes[x].astype("<u8"), segments[x].astype("<u8"), (run_point[y] - x.start).astype("<u4"), (last[y] - start).astype("<u4"))
                out.append((homes[i], ids[i], ties[i], int(texts.sizes[i]), *(c.tobytes() for c in cells)))
            yield from arrow(SAMPLES, out).to_batches()

    return run


def gather(key: tuple, rows: pa.Table) -> pa.Table:
    """The samples of a chunk's texts as one row of STATE; pointers are still the grams' hashes."""
    rows = rows.sort_by([("doc_id", "ascending"), ("tie", "ascending")])
    sizes = rows.column("n").to_numpy()
    parts, start, count = [], 0, 0
    for i, (n, *cells) in enumerate(zip(sizes.tolist(), *(rows.column(c).to_pylist() for c in ("points", "grams", "between", "runs", "last")), strict=True)):
        points, grams, segments, runs, last = (np.frombuffer(c, k) for c, k in zip(cells, ("<u4", "<u8", "<u8", "<u4", "<u4"), strict=True))
        parts.append((points + np.int64(start), np.full(len(points), i, "<u4"), grams, segments, runs + np.int64(count), last + np.int64(start)))
        start, count = start + n, count + len(points)
    whole = [np.concatenate(x).astype(k).tobytes() for x, k in zip(zip(*parts, strict=True), ("<i8", "<u4", "<u8", "<u8", "<i8", "<i8"), strict=True)]
    return arrow(STATE, [(key[0].as_py(), sizes.astype("<i8").tobytes(), *whole, b"")])


class Marks:
    """A row of STATE as arrays."""

    def __init__(self, row: dict, length: int, gram: int):
        self.row, self.length, self.gram = row, length, gram
        kinds = {"sizes": "<i8", "points": "<i8", "owner": "<u4", "pointer": "<u8", "between": "<u8", "run_point": "<i8", "last": "<i8"}
        self.sizes, self.points, self.owner, self.pointer, self.between, self.run_point, self.last = (np.frombuffer(row[c], k) for c, k in kinds.items())
        starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        own = self.owner[self.run_point]
        new = np.concatenate([[True], own[1:] != own[:-1]])
        self.first = np.where(new, starts[own], np.concatenate([[0], self.last[:-1] + 1]))

    def refined(self) -> tuple[np.ndarray, np.ndarray]:
        """Samples with two more behind them, all in shared buckets, and the keys of their refined buckets."""
        p, x, way = self.pointer, self.points, self.between
        at = np.flatnonzero((self.owner[:-2] == self.owner[2:]) & (p[:-2] > 0) & (p[1:-1] > 0) & (p[2:] > 0)) if len(p) > 2 else np.empty(0, np.int64)
        return at, combine(p[at], x[at + 1] - x[at], way[at], p[at + 1], x[at + 2] - x[at + 1], way[at + 1], p[at + 2])

    def stretches(self, finer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of windows whose surrounding samples are all in shared buckets, and the keys of the stretches."""
        a = np.searchsorted(self.points, self.first, "right") - 1
        b = np.searchsorted(self.points, self.last + self.length - self.gram, "left")
        key = combine(self.pointer[a], self.points[b] - self.points[a], self.between[a], self.pointer[b], self.first - self.points[a], self.last - self.first)
        ok = (self.pointer[a] > 0) & (self.pointer[b] > 0) & (self.pointer[self.run_point] > 0)
        ok &= (b - a == 1) | (finer[a] > 0)
        left = np.flatnonzero(ok & (b - a > 1))
        at = a[left]
        while len(left):
            key[left] = combine(key[left], finer[at], self.points[at] - self.points[a[left]])
            ok[left] &= finer[at] > 0
            # on by two samples; the last step may overlap the one before
            more = at + 2 < b[left]
            left, at = left[more], np.minimum(at[more] + 2, b[left[more]] - 2)
            more = ok[left]
            left, at = left[more], at[more]
        runs = np.flatnonzero(ok)
        return runs, key[runs]

    def after(self, **changed: np.ndarray) -> pa.Table:
        return arrow(STATE, [tuple(changed.get(c, self.row[c]) for c in STATE.fieldNames())])


def repeats(docs: DataFrame, length: int = 400, with_kept: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_kept`` the kept
    bytes and the removed ranges of bytes as ``spans``.

    A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else, in another
    document or in the same one, judged on the input; matches never cross documents. Null and empty
    texts have no bytes. Rows without doc_id take no part; rows that share a doc_id, and repeated rows,
    are documents of their own. Other columns are ignored; an empty table gives no rows. A text must fit
    in a task, of any length below 2 GB.
    """
    spark = docs.sparkSession
    gram, n = max(1, min(GRAM, length // 4)), partitions(spark)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    chunks = max(2 * n, -(-size // CHUNK_BYTES))
    shards, window_shards = max(n, -(-size // SHARD_BYTES)), max(n, -(-size // WINDOW_SHARD_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(chunks)).cast("long"))

    state = keep(rows.mapInArrow(sample(length, gram), SAMPLES).groupBy("chunk").applyInArrow(gather, STATE), "repeats", "zstd")

    def marks(row: dict) -> Marks:
        return Marks(row, length, gram)

    def row_of(rows: pa.Table) -> dict:
        return {c: rows.column(c)[0].as_py() for c in rows.column_names}

    def refine(state: DataFrame, keys_of, apply, least: int = 2) -> DataFrame:
        """``keys_of`` gives places and their keys, and weights if a place is not to count as one; ``apply``
        takes the places, their names (0: none) and whether each is the one that speaks for its key."""

        def sent(m: Marks) -> tuple:
            at, keys, *weights = keys_of(m)
            values, counts, place = distinct(keys)
            return at, values, np.bincount(place, weights[0], len(values)).astype(U) if weights else counts, place

        answers = ask(state, lambda row: sent(marks(row))[1:3], shards, least)

        def receive(_key: tuple, rows: pa.Table, replies: pa.Table) -> pa.Table:
            m = marks(row_of(rows))
            at, values, _, place = sent(m)
            names, tell, _ = answered(replies, len(values))
            first = np.zeros(len(place), bool)
            first[np.unique(place, return_index=True)[1]] = True
            return apply(m, at, names[place], tell[place] & first)

        return keep(state.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(receive, STATE), "repeats", "zstd")

    def by_gram(m: Marks) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(len(m.pointer)), m.pointer

    def set_pointer(m: Marks, at: np.ndarray, names: np.ndarray, _speaks: np.ndarray) -> pa.Table:
        return m.after(pointer=names.astype("<u8").tobytes())

    def set_finer(m: Marks, at: np.ndarray, names: np.ndarray, _speaks: np.ndarray) -> pa.Table:
        finer = np.zeros(len(m.pointer), "<u8")
        finer[at] = names
        return m.after(repeated=finer.tobytes())

    def by_stretch(m: Marks) -> tuple[np.ndarray, np.ndarray]:
        return m.stretches(np.frombuffer(m.row["repeated"], "<u8"))

    def set_repeated(m: Marks, at: np.ndarray, names: np.ndarray, speaks: np.ndarray) -> pa.Table:
        """From here on runs alone, and what is known of each."""
        kind = np.where(m.pointer[m.run_point] > 0, OPEN, ONCE).astype(np.uint8)
        kind[at[names > 0]] = KNOWN
        kind[at[(names > 0) & speaks]] = SPEAKS
        runs = {"pointer": m.pointer[m.run_point], "points": m.points[m.run_point], "owner": m.owner[m.run_point], "run_point": np.arange(len(kind), dtype="<i8"), "between": kind[:0], "repeated": kind}
        return m.after(**{c: x.tobytes() for c, x in runs.items()})

    def by_bucket(m: Marks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of windows to compare and of those that speak; the former count."""
        kind = np.frombuffer(m.row["repeated"], np.uint8)
        at = np.flatnonzero((kind == OPEN) | (kind == SPEAKS))
        return at, m.pointer[at], kind[at] == OPEN

    def set_heard(m: Marks, at: np.ndarray, names: np.ndarray, _speaks: np.ndarray) -> pa.Table:
        """Nobody asks in buckets without open windows."""
        kind = np.frombuffer(m.row["repeated"], np.uint8).copy()
        quiet = at[names == 0]
        kind[quiet[kind[quiet] == SPEAKS]] = KNOWN
        return m.after(repeated=kind.tobytes(), pointer=b"", between=b"")

    state = refine(state, by_gram, set_pointer)
    state = refine(state, Marks.refined, set_finer)
    state = refine(state, by_stretch, set_repeated)
    state = refine(state, by_bucket, set_heard, least=1)
    dealt = rows.select("chunk", "doc_id", "tie", "text")

    def long_texts(rows: pa.Table) -> tuple[pa.Table, Bytes, np.ndarray]:
        rows = rows.sort_by([("doc_id", "ascending"), ("tie", "ascending")]).combine_chunks()
        texts = Bytes(rows.column("text").combine_chunks())
        return rows, texts, np.flatnonzero(texts.sizes >= length)

    def open_windows(texts: Bytes, long: np.ndarray, state: pa.Table) -> tuple:
        """Distinct hashes (64 and 32 bits) of the windows to compare, how often each occurs here; where the
        windows are, and each one's place among the distinct ones; and the windows known to be repeats."""
        none = np.empty(0, np.int64)
        if not state.num_rows:
            return np.empty(0, U), np.empty(0, np.uint32), none, none, none, np.empty((0, 2), np.int64)
        m = marks(row_of(state))
        kind = np.frombuffer(m.row["repeated"], np.uint8)
        # the marks count the bytes of long texts alone
        starts = np.concatenate([[0], np.cumsum(m.sizes)])[:-1]
        shift = (texts.starts[:-1][long] - starts)[m.owner]
        first, last = m.first + shift, m.last + shift
        known = np.stack([first, last + 1], 1)[kind >= KNOWN]
        compared = (kind == OPEN) | (kind == SPEAKS)
        first, last = first[compared], last[compared]
        rolling, rolling2, at, one, two = Rolling(BASES[0]), Rolling(BASES[1]), [], [], []
        edge = np.searchsorted(first, np.arange(0, len(texts.data) + BLOCK, BLOCK))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            while a < b:
                low = int(first[a])
                c = a + max(1, np.searchsorted(last[a:b], low + BLOCK))  # runs are shorter than a window
                values = VALUES[texts.data[low : int(last[c - 1]) + length]]
                p = np.repeat(first[a:c], last[a:c] - first[a:c] + 1)
                p += np.arange(len(p)) - np.repeat(np.cumsum(last[a:c] - first[a:c] + 1) - (last[a:c] - first[a:c] + 1), last[a:c] - first[a:c] + 1)
                at.append(p)
                one.append(rolling.windows(values, length)[p - low])
                two.append((rolling2.windows(values, length)[p - low] >> U(32)).astype(np.uint32))
                a = c
        if not at:
            return np.empty(0, U), np.empty(0, np.uint32), none, none, none, known
        at, one, two = np.concatenate(at), np.concatenate(one), np.concatenate(two)
        order = np.lexsort((two, one))
        x, y = one[order], two[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        place = np.empty(len(at), np.int64)
        place[order] = np.cumsum(new) - 1
        return x[new], y[new], np.diff(np.append(np.flatnonzero(new), len(at))), at, place, known

    def send_windows(key: tuple, rows: pa.Table, state: pa.Table) -> pa.Table:
        _, texts, long = long_texts(rows)
        one, two, count, *_ = open_windows(texts, long, state)
        owner = shard_of(one, window_shards)
        edges = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]])) if len(one) else np.zeros(1, int)
        return arrow(WINDOWS, [(int(owner[a]), key[0].as_py(), pack_ascending(one[a:b]), planes_of(two[a:b]), bits(count[a:b] > 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)])

    def match_windows(key: tuple, rows: pa.Table) -> pa.Table:
        sent = [unpack_ascending(b) for b in rows.column("hashes").to_pylist()]
        one, two = np.concatenate(sent), np.concatenate([from_planes(b, "<u4") for b in rows.column("more").to_pylist()])
        several = np.concatenate([flags(b, len(h)) for b, h in zip(rows.column("several").to_pylist(), sent, strict=True)])
        order = np.lexsort((two, one))
        new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
        heads = np.flatnonzero(new)
        often = (np.diff(np.append(heads, len(one))) > 1) | np.logical_or.reduceat(several[order], heads)
        good = np.empty(len(one), bool)
        good[order] = often[np.cumsum(new) - 1]
        edges = np.cumsum([0, *map(len, sent)])
        return arrow(BITS, [(c, key[0].as_py(), len(h), bits(good[a : a + len(h)])) for c, h, a in zip(rows.column("chunk").to_pylist(), sent, edges[:-1], strict=True)])

    fields = {"doc_id": L, "n_bytes": L, "n_removed": L, "n_spans": L, "kept_sha256": T.StringType()}
    if with_kept:
        fields |= {"kept": B, "spans": T.ArrayType(schema(start=L, end=L))}
    result = schema(**fields)

    def remove(_key: tuple, rows: pa.Table, both: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        rows, texts, long = long_texts(rows)
        is_state = both.column("sizes").is_valid()
        _, _, count, at, place, known = open_windows(texts, long, both.filter(is_state).select(STATE.fieldNames()))
        replies = sorted(both.filter(pc.invert(is_state)).select(["shard", "n", "bits"]).to_pylist(), key=lambda r: r["shard"])
        good = np.concatenate([flags(r["bits"], r["n"]) for r in replies]) if replies else np.zeros(0, bool)
        if len(good) != len(count):
            raise RuntimeError(f"{len(good)} answers to {len(count)} windows")
        hits = at[good[place]]
        cover = np.zeros(len(texts.data) + 1, np.int32)
        np.add.at(cover, hits, 1)
        np.add.at(cover, hits + length, -1)
        np.add.at(cover, known[:, 0], 1)
        np.add.at(cover, known[:, 1] + length - 1, -1)
        gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
        out, ids = [], rows.column("doc_id").to_pylist()
        for i in range(texts.n):
            a, b = texts.starts[i], texts.starts[i + 1]
            r = gone[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], r.view(np.int8), [0]])))
            kept = texts.data[a:b][~r].tobytes() if len(edge) else texts.data[a:b].tobytes()
            row = (ids[i], int(b - a), int(r.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest())
            if with_kept:
                row += (kept, [{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
            out.append(row)
        give_back()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), to_arrow_schema(result), strict=True)], schema=to_arrow_schema(result))

    seen = dealt.groupBy("chunk").cogroup(state.groupBy("chunk")).applyInArrow(send_windows, WINDOWS)
    both = state.unionByName(seen.groupBy("shard").applyInArrow(match_windows, BITS), allowMissingColumns=True)
    return dealt.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(remove, result)
