"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are cut into m segments that stand in a ring. If two differ in at most t bits, some
segment starts a chain whose every prefix of l segments differs in at most l * t / m bits (the
pigeonring principle). Fingerprints meet in groups of (start, value of that segment), as the first
link allows no difference for t < m; in a group, candidates are looked up by the second segment
within its budget, the chain's later prefixes prune them, and the full Hamming check decides.

Equal fingerprints are one vertex, so copies are never paired. A group larger than ``block`` is keyed
by two segments: its members ask for every second segment within their budget, so that 32 bits and not
16 decide who meets. What is still larger is split into blocks that meet
pairwise. A task handles many groups at once and reports only a spanning forest of the links it found,
so what is written grows with the fingerprints, not with their pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import give_back, keep, mix64, partitions
from lexmill.llm.components import components

SEED = 42
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words, repeats included; a shorter text is one shingle."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest, last = xxhash.xxh64_intdigest, min(width, len(words)) - 1
    return np.fromiter((digest(joined[starts[i] : ends[i + last] - 1], SEED) for i in range(n)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if over half the hashes have it; no hashes give zero."""
    n = len(hashes)
    if not n:
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8)
        votes += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int((np.packbits(2 * votes > n, bitorder="little")).view("<u8")[0])


PRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp is the 64-bit fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t, width)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=PRINTS.names)
        give_back()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    return rows.mapInArrow(run, PRINTS)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


Side = tuple[np.ndarray, np.ndarray, np.ndarray]


def segment(side: Side, k: int, segments: int) -> np.ndarray:
    """The ``k``-th segment behind each fingerprint's own start on the ring."""
    fp, _, start = side
    width = 64 // segments
    return fp >> ((start + k) % segments * width).astype(np.uint64) & np.uint64((1 << width) - 1)


def flips(width: int, most: int) -> list[int]:
    """All masks of at most ``most`` of ``width`` bits."""
    return [sum(1 << b for b in bits) for k in range(most + 1) for bits in itertools.combinations(range(width), k)]


def close_pairs(left: Side, right: Side, segments: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints of one unit within ``radius`` whose chain keeps its budgets. A side
    is (fingerprints, units, starts of their chains); many units are met at once."""
    mix = lambda side, second: mix64(mix64(side[1]) + second)
    key = mix(right, segment(right, 1, segments))
    order = np.argsort(key, kind="stable")
    key, second = key[order], segment(left, 1, segments)
    found_l, found_r = [], []
    for flip in flips(64 // segments, 2 * radius // segments):  # differences that the first two segments may have
        wanted = mix(left, second ^ np.uint64(flip))
        low, high = np.searchsorted(key, wanted, "left"), np.searchsorted(key, wanted, "right")
        many = high - low
        for a, b in _runs(many, 4_000_000):
            count = many[a:b]
            total = int(count.sum())
            if not total:
                continue
            i = np.repeat(np.arange(a, b), count)
            j = order[np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[a:b], count)]
            apart = (left[0][i] ^ right[0][j], left[1][i], left[2][i])
            good, so_far = apart[0] != 0, np.zeros(total, np.int64)
            for k in range(segments):
                so_far += popcount(segment(apart, k, segments))
                good &= so_far * segments <= (k + 1) * radius
            found_l.append(i[good])
            found_r.append(j[good])
    if not found_l:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_l), np.concatenate(found_r)


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring ranges whose sizes add up to about ``most``."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield start, end
        start = end


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the given links, of those with the fewest differing bits."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    order, out = np.argsort(popcount((a ^ b).view(np.uint64)), kind="stable"), []
    for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


UNITS = ["fp", "start", "unit", "left", "right"]


def links(prints: DataFrame, radius: int = 3, segments: int = 4, block: int = 512, task_rows: int = 50_000) -> DataFrame:
    """Links (a, b) between the distinct ``fp`` of ``prints`` that keep every component of the
    graph "at most ``radius`` bits differ" together. Needs radius < segments, 64 % segments == 0."""
    if radius >= segments or 64 % segments:
        raise ValueError("the first link of a chain must allow no difference")
    width, spark = 64 // segments, prints.sparkSession

    def part(k: int):
        return F.shiftrightunsigned("fp", k % segments * width).bitwiseAND((1 << width) - 1)

    starts = F.explode(F.array(*[F.struct(F.lit(k).alias("start"), part(k).alias("value"), part(k + 1).alias("second")) for k in range(segments)])).alias("s")
    members = prints.select("fp", starts).select("fp", "s.*")
    one, two = ["start", "value"], ["start", "value", "at"]
    large = members.groupBy(*one).agg(F.count("*").alias("n")).where(F.col("n") > block).select(*one, F.lit(True).alias("large"))
    marked = members.join(large, one, "left")
    both = [F.lit(True).alias("left"), F.lit(True).alias("right")]
    small = marked.where("large is null").select("fp", "start", F.xxhash64(*one).alias("unit"), *both)
    # members of a large group ask for the second segments within their budget
    near = F.explode(F.array(*[F.col("second").bitwiseXOR(F.lit(f)) for f in flips(width, 2 * radius // segments)])).alias("at")
    asks = marked.where("large").select("fp", *one, "second", near).withColumn("stored", F.col("at") == F.col("second"))
    sizes = asks.groupBy(*two).agg(F.count_if("stored").alias("stores"), F.count("*").alias("all")).where("stores > 0")
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    placed = asks.join(sizes.select(*two, blocks("stores").alias("ps"), blocks("all").alias("qs")), two)
    p, q = F.pmod(F.xxhash64("fp"), F.col("ps")).cast("int"), F.pmod(F.xxhash64("fp"), F.col("qs")).cast("int")
    unit = F.xxhash64(*two, "p", "q").alias("unit")
    stores = placed.where("stored").withColumn("p", p).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    seekers = placed.withColumn("q", q).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("ps") - 1)))
    split = stores.select("fp", "start", unit, F.lit(False).alias("left"), F.lit(True).alias("right")).unionByName(seekers.select("fp", "start", unit, F.lit(True).alias("left"), F.lit(False).alias("right")))
    tasks = max(partitions(spark), -(-segments * prints.count() // task_rows))
    dealt = small.unionByName(split).withColumn("task", F.pmod(F.xxhash64("unit"), F.lit(tasks)))

    def run(_key: tuple, rows: pa.Table) -> pa.Table:
        fp, start, unit, left, right = (rows.column(c).to_numpy() for c in UNITS)
        fps = fp.view(np.uint64)
        i, j = close_pairs(*((fps[x], unit[x].view(np.uint64), start[x].astype(np.int64)) for x in (left, right)), segments, radius)
        tree = forest(fp[left][i], fp[right][j]) if len(i) else []
        return pa.table({"a": pa.array([x for x, _ in tree], pa.int64()), "b": pa.array([y for _, y in tree], pa.int64())})

    return dealt.groupBy("task").applyInArrow(run, LINKS)


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, segments: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row with a doc_id.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Rows that
    share a doc_id stay separate rows. component_id is the smallest doc_id that is reachable over
    links of at most ``radius`` bits.
    """
    prints = keep(fingerprints(docs, width), "prints")
    vertices = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "vertices")
    found = links(vertices.select("fp"), radius, segments)
    tree = components(found, "simhash")
    rooted = keep(vertices.join(tree.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "first"), "rooted")
    classes = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    lone = vertices.join(classes, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    found = prints.join(keep(lone, "classes"), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
