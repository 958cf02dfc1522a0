"""Sinks: run partitions, upserts, replacements, exports and reports."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share; in local mode it may be a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/lexmill-{tag}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)


def newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row per key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_r", rank).where("_r = 1").drop("_r")


def merged(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old rows without a newer one, and the newest of the new; columns of either side stay."""
    fresh = newest(new, keys, order)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    done = [s.getPath() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("v=")) for p in done if p.getName().startswith("v="))


def read_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The last complete version of a table, or None."""
    found = _versions(spark, path)
    return spark.read.parquet(f"{path}/v={found[-1]}") if found else None


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: str, keep_versions: int = 2) -> int:
    """Write a new version with ``new`` merged in; readers see it once it is complete. Versions before
    the last ``keep_versions`` are removed, so that readers of the one before may finish. Returns its number."""
    done = _versions(spark, path)
    old, n = spark.read.parquet(f"{path}/v={done[-1]}") if done else None, (done or [0])[-1] + 1
    rows = merged(old, new, keys, order) if old is not None else newest(new, keys, order)
    rows.write.mode("overwrite").parquet(f"{path}/v={n}")
    for v in done[: max(0, len(done) + 1 - keep_versions)]:
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return n


def write_run(rows: DataFrame, path: str, kind: str = "json") -> None:
    """One folder per run_id; earlier runs stay."""
    rows.write.mode("append").partitionBy("run_id").format(kind).save(path)


def replace_rows(rows: DataFrame, path: str, key: str = "doc_id", buckets: int = 64) -> None:
    """Replace the rows of the keys at hand, leave all others. The table has ``buckets`` partitions
    by a hash of the key; only those that hold one of the keys are written again."""
    spark, bucket = rows.sparkSession, F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")
    new = rows.withColumn("bucket", bucket)
    if exists(spark, path):
        touched = new.select("bucket").distinct()
        old = spark.read.parquet(path).join(touched, "bucket", "left_semi").join(rows.select(key).distinct(), key, "left_anti")
        # what is read here is replaced below, so it is written aside first
        aside = scratch(spark, "replaced")
        old.unionByName(new, allowMissingColumns=True).write.parquet(aside)
        new = spark.read.parquet(aside)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def export_rules(rules: DataFrame, path: str, category: str | None = None) -> None:
    (rules.where(F.col("category") == category) if category else rules).write.mode("overwrite").json(path)


def render_report(summary: DataFrame, findings: DataFrame) -> DataFrame:
    """A text report per document: a head line, then one line per finding in rank order."""
    lines = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.format_string("- [%s] %s: %s", "severity", "rule_id", "action").alias("line")))).alias("ls"))
    both = summary.join(lines, "doc_id", "left")
    head = F.format_string("# Document %d\nScore: %d", F.col("doc_id"), F.floor(F.col("score") * 100 + 1e-9))
    body = F.array_join(F.transform(F.coalesce("ls", F.array().cast("array<struct<rank:int,line:string>>")), lambda x: x["line"]), "\n")
    return both.select("doc_id", F.concat_ws("\n", head, F.nullif(body, F.lit(""))).alias("report"))


def state_counters(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))
