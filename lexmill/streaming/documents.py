"""Incremental runs: each document once, progress and status windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from lexmill.operators.runs import latest_progress, status_windows
from lexmill.sources import merged
from lexmill.sources.tables import scratch, upsert


def new_documents(stream: DataFrame, late: str = "1 day", text: str = "text", ts: str = "ts") -> DataFrame:
    """A stream (doc_id, text, ts) without texts that came before within the watermark.

    State is bounded by the watermark; a copy that is later than that passes again, so sinks must
    take a document twice, as ``upsert_documents`` does.
    """
    return stream.withColumn("doc_hash", F.sha2(text, 256)).withWatermark(ts, late).dropDuplicatesWithinWatermark(["doc_hash"])


def upsert_documents(stream: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Process each micro-batch and merge it into a versioned table by doc_id."""

    def merge(batch: DataFrame, _epoch: int) -> None:
        upsert(batch.sparkSession, path, work(batch), ["doc_id"], "ts")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def process_once(stream: DataFrame, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda df: df, text: str = "text", ts: str = "ts") -> StreamingQuery:
    """Each text once, however late its copy comes, as a merge-on-read table of documents by doc_id in
    ``path``/documents.

    Hashes of processed texts are filed in ``path``/seen with a filter each batch, so state does not grow in
    the stream and a new text reads no old hash. Of copies within a batch the smallest doc_id counts. Results
    are written before their hashes: a batch that is lost in between runs again and writes the same rows.
    """

    def once(batch: DataFrame, epoch: int) -> None:
        hashed = batch.withColumn("doc_hash", F.sha2(text, 256))
        first = hashed.withColumn("_r", F.row_number().over(Window.partitionBy("doc_hash").orderBy("doc_id"))).where("_r = 1").drop("_r")
        aside = scratch(batch.sparkSession, "once")
        merged.unseen(first, f"{path}/seen", "doc_hash").write.parquet(aside)
        fresh = batch.sparkSession.read.parquet(aside)
        merged.upsert(work(fresh), f"{path}/documents", ["doc_id"], ts)
        merged.add_keys(fresh, f"{path}/seen", "doc_hash")

    return stream.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_stream(stream: DataFrame) -> DataFrame:
    return latest_progress(stream)


def window_stream(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Status counts per window; rows later than the watermark are dropped."""
    return status_windows(stream.withWatermark("ts", late), width)


def read_folder(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
