"""Progress of jobs as keyed state: the last rows of each job, forgotten some time after its last event."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HISTORY = T.StructType([T.StructField("at", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("node", T.StringType())])
PROGRESS = T.StructType([T.StructField("job_id", T.LongType()), T.StructField("node", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("history", T.ArrayType(HISTORY))])


class LastRows(StatefulProcessor):
    """Keeps the ``most`` newest rows of a key, newest first, and tells them after each batch that has any.

    A timer of event time forgets a key ``forget_ms`` after its newest row, so jobs that have ended cost nothing."""

    def __init__(self, most: int, forget_ms: int):
        self.most, self.forget_ms = most, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.rows = handle, handle.getListState("rows", HISTORY)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        for r in rows:  # never more than the newest are held
            kept = sorted({*kept, (r["at"], r["seq"], r["node"])}, key=lambda x: (x[0], x[1]), reverse=True)[: self.most]
        self.rows.put(kept)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(kept[0][0] // 1000 + self.forget_ms)
        yield Row(job_id=key[0], node=kept[0][2], seq=kept[0][1], history=[Row(at=a, seq=b, node=c) for a, b, c in kept])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.rows.clear()
        return iter([])

    def close(self) -> None:
        pass


def last_rows(stream: DataFrame, most: int = 10, forget_days: int = 3650) -> DataFrame:
    """A stream (job_id, ts, seq, node) -> per batch one row for every job with new events: its newest event
    and ``history``, its ``most`` newest events. Events older than ``forget_days`` before the newest event of the
    stream are late and dropped, and what is known of such jobs is forgotten. Needs the RocksDB state store."""
    rows = stream.select(F.col("job_id").cast("long").alias("job_id"), "ts", F.unix_micros("ts").alias("at"), F.col("seq").cast("long").alias("seq"), "node")
    late = rows.withWatermark("ts", f"{forget_days} days")
    found = late.groupBy("job_id").transformWithState(LastRows(most, forget_days * 24 * 3600 * 1000), PROGRESS, "Update", "EventTime")
    history = F.transform("history", lambda x: F.struct(F.timestamp_micros(x["at"]).alias("ts"), x["seq"].alias("seq"), x["node"].alias("node")))
    return found.select("job_id", "node", "seq", history.alias("history"))


def last_rows_batch(events: DataFrame, most: int = 10) -> DataFrame:
    """The same over a table."""
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("seq")))
    newest = events.select("job_id", "ts", "seq", "node", rank.alias("k")).where(F.col("k") <= most)
    rows = newest.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("k", "ts", "seq", "node"))).alias("h"))
    return rows.select("job_id", F.col("h")[0]["node"].alias("node"), F.col("h")[0]["seq"].alias("seq"), F.transform("h", lambda x: F.struct(x["ts"].alias("ts"), x["seq"].alias("seq"), x["node"].alias("node"))).alias("history"))
