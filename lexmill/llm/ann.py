"""Approximate nearest neighbours by cross-polytope hashing.

A hash turns every unit vector by a pseudo-rotation (three rounds of random signs and a fast Hadamard
transform) and takes the nearest signed axis. A table files a vector under several hashes together,
the last of which has only so many axes that the buckets are a fixed share of the vectors in number, whatever
that is. A query visits, per table, those combinations of axes that are nearest to it in sum, a number
that grows with a power (about 0.47 at 128 axes) of that of the buckets.

Only ids are filed and looked up. The pairs that meet are dealt by candidate into slices, each slice
gets the vectors of its candidates and of the queries that ask for them, and reports its best few per
query by exact cosine. Equal vectors are one entry that carries its smallest ids, as many as an answer
can use, so copies never fill a bucket. Queries for which the tables hold fewer entries than asked for
are compared with all entries.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexmill.llm.common import keep


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


@functools.lru_cache(maxsize=1024)
def signs_of(width: int, table: int) -> np.ndarray:
    return np.random.default_rng(1_000_003 * width + table).choice([-1.0, 1.0], (3, width))


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-rotation number ``table``, zero-padded to a power of two."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    for s in signs_of(width, table):
        y = hadamard(y * s)
    return y


def signed(y: np.ndarray) -> np.ndarray:
    """Each row's coordinate on every signed axis: 2 * axis + (1 if negative)."""
    return np.stack([y, -y], axis=2).reshape(len(y), -1)


#: Of each hash only so many axes are combined with others.
NEAR_AXES = 48


#: A table has a bucket for so many vectors.
BUCKET = 3


def grid(entries: int, axes: int, probes: int) -> tuple[list[int], int]:
    """The numbers of signed axes of a table's hashes, and how many buckets a query visits: ``probes`` of the ``axes``
    of one hash, and with more buckets the same power of their number. Both grow with the entries
    without a jump, which a whole further hash would be."""
    sizes, left = [axes], entries / BUCKET / axes
    while (size := int(min(left, axes)) // 2 * 2) >= 2:
        sizes.append(size)
        left /= size
    return sizes, min(math.prod(sizes), round(probes ** (math.log(math.prod(sizes)) / math.log(axes))))


def nearest_axis(x: np.ndarray, number: int, size: int) -> np.ndarray:
    return signed(rotate(x, number)[:, : size // 2]).argmax(axis=1)


def probed(x: np.ndarray, numbers: range, sizes: list[int], many: int) -> np.ndarray:
    """For each row the ``many`` combinations of one signed axis per hash that lie nearest, as codes."""
    total, codes = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for number, size in zip(numbers, sizes, strict=True):
        all_axes = signed(rotate(x, number)[:, : size // 2])
        axis = np.argsort(-all_axes, axis=1, kind="stable")[:, :NEAR_AXES]
        near = np.take_along_axis(all_axes, axis, axis=1)
        lost = (near[:, :1] - near) ** 2
        total = (total[:, :, None] + lost[:, None, :]).reshape(len(x), -1)
        codes = (codes[:, :, None] * size + axis[:, None, :]).reshape(len(x), -1)
        if total.shape[1] > many:
            best = np.argpartition(total, many - 1, axis=1)[:, :many]
            total, codes = np.take_along_axis(total, best, axis=1), np.take_along_axis(codes, best, axis=1)
    return codes


FILED = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("slot", T.IntegerType()), T.StructField("code", T.LongType()), T.StructField("rep", T.LongType())])


def filed(vectors: DataFrame, tables: int, sizes: list[int], probes: int | None) -> DataFrame:
    """Each (rep, vector) under its bucket of every table, or under the ``probes`` buckets it visits."""

    def run(batches):
        for whole in batches:
            step = 100 if probes else 2000  # many combinations of axes a query, one a vector
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                reps, lists = batch.column("rep").to_numpy(), batch.column("vector").to_pylist()
                for dim, x, which in by_width(lists):
                    for slot in range(tables):
                        numbers = range(slot * len(sizes), (slot + 1) * len(sizes))
                        if probes is None:
                            code = np.zeros((len(x), 1), np.int64)
                            for number, size in zip(numbers, sizes, strict=True):
                                code = code * size + nearest_axis(x, number, size)[:, None]
                        else:
                            code = probed(x, numbers, sizes, probes)
                        n = code.size
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, slot, np.int32)), pa.array(code.ravel()), pa.array(np.repeat(reps[which], code.shape[1]))],
                            names=FILED.names,
                        )

    return vectors.select("rep", "vector").mapInArrow(run, FILED)


def padded(dim: int) -> int:
    return 1 << max(0, (dim - 1).bit_length())


def by_width(lists: list) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(width, unit vectors, their places) for each width among ``lists``."""
    places: dict[int, list[int]] = {}
    for i, v in enumerate(lists):
        places.setdefault(len(v), []).append(i)
    out = []
    for dim, at in places.items():
        x = np.array([lists[i] for i in at], np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)  # the scale does not matter, over- and underflow would
        out.append((dim, x / np.linalg.norm(x, axis=1, keepdims=True), np.array(at)))
    return out


FOUND = T.StructType([T.StructField("query", T.LongType()), T.StructField("rep", T.LongType()), T.StructField("score", T.DoubleType())])


#: Kinds of rows of a slice: candidates, queries with stated candidates, pairs, queries that meet all.
CANDIDATE, QUERY, PAIR, ANY = range(4)


def best_of(slices: DataFrame, best: int) -> DataFrame:
    """FOUND: each query's ``best`` candidates of every slice (slice, kind, query, rep, vector)."""

    def run(_key: tuple, rows: pa.Table) -> pa.Table:
        kind = rows.column("kind").to_numpy()
        of = {k: rows.take(pa.array(np.flatnonzero(kind == k))) for k in range(4)}
        pairs = {c: of[PAIR].column(c).to_numpy() for c in ("query", "rep")}
        sides = []
        for name, kinds in (("rep", (CANDIDATE,)), ("query", (QUERY, ANY))):
            t = pa.concat_tables([of[k] for k in kinds])
            sides.append((t.column(name).to_numpy(), t.column("vector").to_pylist(), t.column("kind").to_numpy()))
        found: list[tuple[np.ndarray, ...]] = []

        def report(query: np.ndarray, rep: np.ndarray, score: np.ndarray) -> None:
            order = np.lexsort((rep, -score, query))
            query, rep, score = query[order], rep[order], score[order]
            first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.empty(0, int)
            rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
            found.append((query[rank < best], rep[rank < best], score[rank < best]))

        units = {d: (x, sides[0][0][at]) for d, x, at in by_width(sides[0][1])}
        for dim, q, at in by_width(sides[1][1]):
            if dim not in units:
                continue
            c, reps = units[dim]
            names, asks = sides[1][0][at], sides[1][2][at]
            order, q_order = np.argsort(reps), np.argsort(names)
            i = np.searchsorted(names[q_order], pairs["query"]).clip(max=len(names) - 1)
            j = np.searchsorted(reps[order], pairs["rep"]).clip(max=len(reps) - 1)
            i, j = q_order[i], order[j]
            here = np.flatnonzero((names[i] == pairs["query"]) & (reps[j] == pairs["rep"]) & (asks[i] == QUERY))
            got = [np.empty(0)]
            for s in range(0, len(here), 1 << 15):
                part = here[s : s + (1 << 15)]
                got.append(np.einsum("ij,ij->i", q[i[part]], c[j[part]]))
            report(names[i[here]], reps[j[here]], np.concatenate(got))
            for one in np.flatnonzero(asks == ANY):
                report(np.full(len(reps), names[one]), reps, np.einsum("ij,j->i", c, q[one]))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [[], [], []]
        return pa.table({n: pa.array(x, t) for n, x, t in zip(FOUND.names, columns, [pa.int64(), pa.int64(), pa.float64()], strict=True)})

    return slices.groupBy("slice").applyInArrow(run, FOUND)


def nearest(vectors: DataFrame, is_query, k: int = 5, tables: int = 16, probes: int = 10, slice_pairs: int = 100_000, slice_entries: int = 20_000) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each row of ``vectors`` (vec_id,
    embedding) for which the Column ``is_query`` holds; never the row itself.

    Cosine in double precision, nearest first, ties to the smaller vec_id. Null and empty vectors,
    zero vectors, vectors with null or non-finite components and rows without vec_id take no part;
    vectors of different lengths are no candidates of each other. Rows that repeat a vec_id are one.
    A query visits ``probes`` buckets of a table of one hash; ``grid`` says how many of more.
    """
    sound = (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), is_query.alias("asks"))
    # + 0.0 makes -0.0 equal to 0.0
    clean = clean.where("vec_id is not null").where(F.coalesce(sound, F.lit(False))).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    alike = Window.partitionBy("vector").orderBy("vec_id")
    firsts = clean.select("vec_id", "vector").withColumn("r", F.dense_rank().over(alike)).where(F.col("r") <= k + 1)
    entries = keep(firsts.groupBy("vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "vector"), "entries")
    asking = keep(clean.where("asks").join(entries.select("rep", "vector"), "vector").select("vec_id", "rep").distinct(), "asking")
    query_reps = entries.join(asking.select("rep").distinct(), "rep", "left_semi")
    shape = entries.agg(F.count("*"), F.max(F.size("vector"))).first()
    sizes, visited = grid(shape[0], 2 * padded(shape[1] or 1), probes)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")

    def ranked(found: DataFrame) -> DataFrame:
        pairs = found.groupBy("query", "rep").agg(F.max("score").alias("score"))
        few = pairs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
        with_ids = few.join(entries.select("rep", "ids"), "rep")
        hit = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("vec_id")))
        lists = with_ids.groupBy("query").agg(F.sort_array(F.flatten(F.collect_list(hit))).alias("hits"))  # at most (k + 1)^2 entries
        return lists.withColumn("hits", F.slice("hits", 1, k + 1))

    bucket = ["dim", "slot", "code"]
    visits = filed(query_reps, tables, sizes, visited).withColumnRenamed("rep", "query")
    pairs = keep(visits.join(filed(entries, tables, sizes, None), bucket).select("query", "rep").distinct(), "pairs")
    n_slices = max(1, -(-pairs.count() // slice_pairs), -(-shape[0] // slice_entries))
    put, nothing = F.pmod(F.xxhash64("rep"), F.lit(n_slices)).cast("int").alias("slice"), F.lit(None).cast("array<double>").alias("vector")

    def of(kind: int, df: DataFrame, *columns) -> DataFrame:
        return df.select(columns[0], F.lit(kind).alias("kind"), *columns[1:])

    none = F.lit(None).cast("long")
    candidates = of(CANDIDATE, entries, put, none.alias("query"), F.col("rep"), F.col("vector"))
    asked = pairs.select("query", put).distinct().join(query_reps.select(F.col("rep").alias("query"), "vector"), "query")
    queries = of(QUERY, asked, F.col("slice"), F.col("query"), none.alias("rep"), F.col("vector"))
    met = of(PAIR, pairs, put, F.col("query"), F.col("rep"), nothing)
    first = keep(ranked(best_of(candidates.unionByName(queries).unionByName(met), k + 1)), "found")
    short = keep(query_reps.join(first.where(F.size("hits") == k + 1).select(F.col("query").alias("rep")), "rep", "left_anti"), "short")
    if short.limit(1).count():
        every = F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))).alias("slice")
        seekers = of(ANY, short.select("rep", "vector", every), F.col("slice"), F.col("rep").alias("query"), none.alias("rep"), F.col("vector"))
        rest = ranked(best_of(candidates.unionByName(seekers), k + 1))
        first = first.join(short.select(F.col("rep").alias("query")), "query", "left_anti").unionByName(rest)
    answers = asking.join(first.withColumnRenamed("query", "rep"), "rep").select(F.col("vec_id").alias("query_id"), "hits")
    others = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    rows = answers.select("query_id", F.posexplode(others).alias("at", "hit"))
    return rows.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score"))
