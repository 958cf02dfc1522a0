"""Analytics of runs, jobs and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def node_timing(events: DataFrame) -> DataFrame:
    """run_id, node, ts -> per run: slowest and fastest node, mean and total seconds. A node ends when the next event comes."""
    after = F.lead("ts").over(Window.partitionBy("run_id").orderBy("ts", "seq"))
    rows = events.withColumn("seconds", F.unix_micros(after.cast("timestamp")) / 1e6 - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).where("seconds is not null")
    per = rows.groupBy("run_id", "node").agg(F.sum("seconds").alias("seconds"))
    return per.groupBy("run_id").agg(
        F.max_by("node", F.struct(F.round("seconds", 3), "node")).alias("slowest"), F.min_by("node", F.struct(F.round("seconds", 3), "node")).alias("fastest"), F.round(F.avg("seconds"), 3).alias("mean"), F.round(F.sum("seconds"), 3).alias("total"))


def execution_edges(events: DataFrame) -> DataFrame:
    """run_id, seq, from_node, to_node of consecutive events."""
    after = F.lead("node").over(Window.partitionBy("run_id").orderBy("ts", "seq"))
    return events.select("run_id", "seq", F.col("node").alias("from_node"), after.alias("to_node")).where("to_node is not null")


def state_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, change between two snapshots (key, value)."""
    a, b = before.select("key", F.col("value").alias("old"), F.lit(1).alias("a")), after.select("key", F.col("value").alias("new"), F.lit(1).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("modified")
    return a.join(b, "key", "full_outer").select("key", change.alias("change"))


def run_compare(runs: DataFrame, first, second) -> DataFrame:
    """run_id, seconds, path of two runs: difference, per cent, same path."""
    a = runs.where(F.col("run_id") == first).select(F.lit(1).alias("k"), F.col("seconds").alias("s1"), F.col("path").alias("p1"))
    b = runs.where(F.col("run_id") == second).select(F.lit(1).alias("k"), F.col("seconds").alias("s2"), F.col("path").alias("p2"))
    return a.join(b, "k").select((F.col("s2") - F.col("s1")).alias("difference"), ((F.col("s2") - F.col("s1")) / F.col("s1") * 100).alias("per_cent"), (F.col("p1") == F.col("p2")).alias("same_path"))


def job_progress(events: DataFrame) -> DataFrame:
    """job_id, seq, progress: 0.1 + 0.8 x done / total."""
    jobs = Window.partitionBy("job_id")
    done = F.row_number().over(jobs.orderBy("ts", "seq"))
    return events.select("job_id", "seq", (0.1 + 0.8 * done / F.count("*").over(jobs)).alias("progress"))


def error_category(node: Column, message: Column, kind: Column) -> Column:
    """The first category that fits."""
    low = F.lower(message)
    return (
        F.when(F.lower(node).contains("pdf") | low.contains("pdf"), "pdf_processing").when(low.rlike("api|request|connection|timeout|rate limit"), "llm_api")
        .when(kind.isin("FileNotFoundError", "PermissionError", "IOError"), "file_io").when(kind.isin("ConnectionError", "TimeoutError", "URLError"), "network")
        .when(kind.isin("ValueError", "KeyError", "IndexError", "EmptyDataError"), "data_validation").when(kind.isin("AttributeError", "ImportError", "ModuleNotFoundError"), "configuration")
        .otherwise("data_validation")
    )


def error_severity(category: Column, message: Column, kind: Column) -> Column:
    low = F.lower(message)
    critical = low.contains("missing required configuration") | (low.contains("authorization") & low.contains("failed")) | (kind.isin("ImportError", "ModuleNotFoundError") & low.contains("critical"))
    again = category.isin("pdf_processing", "llm_api", "network") | low.rlike("timeout|connection|rate limit")
    return F.when(critical, "critical").when(again, "recoverable").when(category == "data_validation", "warning").otherwise("recoverable")


def error_summary(errors: DataFrame) -> DataFrame:
    """Counts by severity, by category and by node in one pass."""
    sets = errors.groupingSets([["severity"], ["category"], ["node"]], "severity", "category", "node").agg(F.count("*").alias("n"))
    return sets.select("severity", "category", "node", "n")


def rollout_bucket(name: str, identifier: Column) -> Column:
    """md5(name:identifier) as a number modulo 100, digit by digit."""
    digits = F.transform(F.split(F.md5(F.concat(F.lit(name + ":"), identifier)), ""), lambda d: F.conv(d, 16, 10).cast("int"))
    return F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0), lambda a, d: (a * 16 + d) % 100)


def enabled_for(name: str, identifier: Column, percentage: int, allow: list[str] = (), deny: list[str] = ()) -> Column:
    return F.when(identifier.isin(list(deny)), False).when(identifier.isin(list(allow)), True).otherwise(rollout_bucket(name, identifier) < percentage)


def latest_progress(events: DataFrame) -> DataFrame:
    """job_id and its last event."""
    return events.groupBy("job_id").agg(F.max_by(F.struct("node", "seq"), F.struct("ts", "seq")).alias("last")).select("job_id", "last.node", "last.seq")


def status_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts per window and node; the same code serves batch and stream."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), "node").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "node", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy("job_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("job_id", F.col("w.start").alias("start"), "n")
