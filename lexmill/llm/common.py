"""What the training-data operators share: scratch tables, word rules, chunk counts."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the ASCII controls TAB..CR. ``bytes.split()`` cuts alike.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def keep(df: DataFrame, tag: str, compression: str = "snappy", row_group: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors. Rows of megabytes
    need ``row_group``, the most of them that a task holds as it writes or reads: by itself Parquet looks at
    their size after a hundred rows only, and a file is read in batches of 4096."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexmill-{tag}-{uuid.uuid4().hex}"
    out = df.write.option("compression", compression)
    if row_group:
        out = out.option("parquet.block.row.count.limit", row_group)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_by(df: DataFrame, column: str, tag: str) -> DataFrame:
    """As ``keep``, in buckets of ``column``: what groups by it reads the table without a shuffle."""
    spark, name = df.sparkSession, f"lexmill_{tag}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(partitions(spark), column).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"drop table {name}")  # the files stay, as the path is outside the warehouse
    return found


def drop(df: DataFrame) -> None:
    """Delete the files of a kept table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if "/lexmill" in folder:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def salted(id_column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_column)), F.lit(n)).cast("int")


def give_back() -> None:
    """Return what Arrow and the C heap hold but no longer use, as Python workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and odd multipliers)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
