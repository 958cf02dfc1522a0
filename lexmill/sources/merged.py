"""Merge-on-read tables: a bucketed base, small deltas beside it, and compaction bucket by bucket.

Layout: ``delta/n=N`` is one batch as it came; ``base/bucket=B/v=V`` is one version of a bucket; ``state/N`` is a
small JSON file that names the version of each bucket and the last delta that all bases hold. A batch costs what
it holds: nothing old is read or written by ``upsert``. A reader takes the newest state, the bases it names and
the deltas behind it. Folders count once Spark has put ``_SUCCESS`` into them, states once they are renamed into
place, so what a lost job leaves half-written is never seen; its number is used again by nobody.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 64


class Store:
    """Files of one table by the session's own file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.jvm = spark, path.rstrip("/"), spark._jvm
        self.fs = self.at().getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: object):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *map(str, parts)]))

    def names(self, *parts: object) -> list[str]:
        where = self.at(*parts)
        return [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def deltas(self) -> list[int]:
        """Numbers of the complete deltas."""
        found = [n for n in self.names("delta") if n.startswith("n=")]
        return sorted(int(n[2:]) for n in found if self.fs.exists(self.at("delta", n, "_SUCCESS")))

    def state(self) -> tuple[int, dict]:
        """Number and content of the newest state."""
        found = sorted(int(n) for n in self.names("state") if n.isdigit())
        if not found:
            return 0, {"through": 0, "buckets": {}}
        text = self.spark.read.text(f"{self.path}/state/{found[-1]}", wholetext=True).first()[0]
        return found[-1], json.loads(text)

    def publish(self, n: int, content: dict) -> None:
        aside = self.at("state", f"_{uuid.uuid4().hex}")
        out = self.fs.create(aside)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if not self.fs.rename(aside, self.at("state", n)):
            raise RuntimeError(f"another job has published state {n} of {self.path}")


def bucket_of(keys: list[str], buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def upsert(new: DataFrame, path: str, keys: list[str], order: str) -> int:
    """Add a batch; of rows that share their keys the newest by ``order`` counts. Returns the delta's number."""
    store = Store(new.sparkSession, path)
    n = max([store.state()[1]["through"], *(int(x[2:]) for x in store.names("delta") if x.startswith("n="))]) + 1
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    rows = new.withColumn("_r", rank).where("_r = 1").drop("_r").withColumn("bucket", bucket_of(keys))
    rows.write.partitionBy("bucket").parquet(f"{store.path}/delta/n={n}")
    return n


def _deltas(store: Store, numbers: list[int], wanted: list[int] | None = None) -> DataFrame | None:
    parts = []
    for n in numbers:
        part = store.spark.read.option("basePath", f"{store.path}/delta/n={n}").parquet(f"{store.path}/delta/n={n}").withColumn("_n", F.lit(n))
        parts.append(part if wanted is None else part.where(F.col("bucket").isin(wanted)))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def _newest(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Of several batches the last one with a key counts."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n")))
    return deltas.withColumn("_r", rank).where("_r = 1").drop("_r", "_n")


def _base(store: Store, buckets: dict, wanted: list[int] | None = None) -> DataFrame | None:
    paths = [f"{store.path}/base/bucket={b}/v={v}" for b, v in buckets.items() if wanted is None or int(b) in wanted]
    return store.spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None


def read(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """The table as it is: bases without the rows that deltas replace, and the newest rows of the deltas."""
    store = Store(spark, path)
    _, state = store.state()
    old = _base(store, state["buckets"])
    deltas = _deltas(store, [n for n in store.deltas() if n > state["through"]])
    if deltas is None:
        return old
    fresh = _newest(deltas, keys).drop("bucket")
    return fresh if old is None else old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def compact(spark: SparkSession, path: str, keys: list[str], keep_states: int = 2) -> list[int]:
    """Take the deltas so far into the base. Only buckets that a delta touches are written, each as a new version;
    the others keep theirs. Returns those buckets. Files that the last ``keep_states`` states do not name go."""
    store = Store(spark, path)
    number, state = store.state()
    done = [n for n in store.deltas() if n > state["through"]]
    if not done:
        return []
    touched = sorted(r[0] for r in _deltas(store, done).select("bucket").distinct().collect())  # at most as many as buckets
    fresh = _newest(_deltas(store, done), keys)
    old = _base(store, state["buckets"], touched)
    rows = fresh
    if old is not None:
        kept = old.join(fresh.select(*keys), keys, "left_anti").withColumn("bucket", bucket_of(keys))
        rows = kept.unionByName(fresh, allowMissingColumns=True)
    version = number + 1
    aside = f"{store.path}/base/_v={version}-{uuid.uuid4().hex}"
    rows.repartition("bucket").write.partitionBy("bucket").parquet(aside)
    for b in touched:  # renames of folders, no data moves
        store.fs.mkdirs(store.at("base", f"bucket={b}"))
        source = spark._jvm.org.apache.hadoop.fs.Path(f"{aside}/bucket={b}")
        if not store.fs.rename(source, store.at("base", f"bucket={b}", f"v={version}")):
            raise RuntimeError(f"version {version} of bucket {b} exists already")
    store.publish(version, {"through": done[-1], "buckets": state["buckets"] | {str(b): version for b in touched}})
    store.fs.delete(spark._jvm.org.apache.hadoop.fs.Path(aside), True)
    _forget(store, keep_states)
    return touched


def _forget(store: Store, keep_states: int) -> None:
    """Remove what only states before the last ``keep_states`` name."""
    numbers = sorted(int(n) for n in store.names("state") if n.isdigit())
    alive = []
    for n in numbers[-keep_states:]:
        alive.append(json.loads(store.spark.read.text(f"{store.path}/state/{n}", wholetext=True).first()[0]))
    for n in numbers[:-keep_states]:
        store.fs.delete(store.at("state", n), False)
    through = min(s["through"] for s in alive)
    for n in store.deltas():
        if n <= through:
            store.fs.delete(store.at("delta", f"n={n}"), True)
    for b in {b for s in alive for b in s["buckets"]}:
        named = {s["buckets"].get(b) for s in alive}
        for v in store.names("base", f"bucket={b}"):
            if int(v[2:]) not in named:
                store.fs.delete(store.at("base", f"bucket={b}", v), True)


# -- keys seen before ------------------------------------------------------------------------------

#: Bits of a filter per key, and keys that share a word of 64 bits on average.
WORD_KEYS = 4
PROBES = 5


def _word(key, slots):
    return F.pmod(F.xxhash64(key, F.lit(1)), slots)


def _mask(key):
    """PROBES bits of one 64-bit word, by slices of one hash."""
    h, mask = F.xxhash64(key, F.lit(2)), F.lit(0).cast("long")
    for p in range(PROBES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * p).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def add_keys(keys: DataFrame, path: str, column: str = "key") -> None:
    """File a batch of keys: the keys by bucket, and a blocked Bloom filter of them, 16 bits a key."""
    rows = keys.select(F.col(column).alias("key")).where("key is not null").distinct()
    n = uuid.uuid4().hex
    spark = keys.sparkSession
    rows.withColumn("bucket", bucket_of(["key"])).write.partitionBy("bucket").parquet(f"{path}/keys/batch={n}")
    stored = spark.read.parquet(f"{path}/keys/batch={n}")
    slots = max(1, -(-stored.count() // WORD_KEYS))
    stored.groupBy(_word(F.col("key"), F.lit(slots)).alias("word")).agg(F.bit_or(_mask(F.col("key"))).alias("bits")).withColumn("slots", F.lit(slots).cast("long")).write.parquet(f"{path}/filters/batch={n}")


def unseen(new: DataFrame, path: str, column: str = "key") -> DataFrame:
    """Rows of ``new`` whose key is in no filed batch.

    A key is looked up in the batches' filters first; only keys that some filter may hold are checked against
    the filed keys, and only in the buckets of those keys. Where no filter answers, no filed key is read.
    """
    from lexmill.sources.tables import scratch

    spark = new.sparkSession
    store = Store(spark, path)
    batches = [b for b in store.names("filters") if store.fs.exists(store.at("filters", b, "_SUCCESS"))]
    if not batches:
        return new
    filters = spark.read.option("basePath", f"{path}/filters").parquet(*[f"{path}/filters/{b}" for b in batches])
    sizes = [r[0] for r in filters.select("slots").distinct().collect()]  # one value a batch at most
    asked = new.select(F.col(column).alias("key")).distinct()
    probes = asked.select("key", _mask(F.col("key")).alias("mask"), F.explode(F.array(*[F.struct(F.lit(s).cast("long").alias("slots"), _word(F.col("key"), F.lit(s)).alias("word")) for s in sizes])).alias("x"))
    maybe = probes.select("key", "mask", "x.slots", "x.word").join(filters.select("slots", "word", "bits"), ["slots", "word"])
    aside = scratch(spark, "maybe")
    maybe.where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("key").distinct().withColumn("bucket", bucket_of(["key"])).write.parquet(aside)
    possible = spark.read.parquet(aside)
    buckets = sorted(r[0] for r in possible.select("bucket").distinct().collect())  # at most BUCKETS
    if not buckets:
        return new
    filed = spark.read.option("basePath", f"{path}/keys").parquet(*[f"{path}/keys/{b}" for b in batches]).where(F.col("bucket").isin(buckets))
    held = possible.join(filed.select("key", "bucket"), ["key", "bucket"], "left_semi").select(F.col("key").alias(column))
    return new.join(held, column, "left_anti")
