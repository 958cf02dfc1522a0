"""Merge-on-read tables, filters of seen keys, keyed state, and quotes near a hint."""

import os
import random

from pyspark.sql import functions as F

from lexmill.operators import citations, labels
from lexmill.sources import merged
from lexmill.streaming import documents as D
from lexmill.streaming import progress


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


def rows_of(spark, path):
    return {r.k: (r.v, r.run) for r in merged.read(spark, path, ["k"]).collect()}


def test_table_equals_a_dictionary(spark, tmp_path):
    rng, path, want = random.Random(1), str(tmp_path / "t"), {}
    assert merged.read(spark, path, ["k"]) is None and merged.compact(spark, path, ["k"]) == []
    for run in range(5):
        batch = [(rng.randrange(40), f"v{run}-{i}", run * 100 + i) for i in range(15)]
        merged.upsert(spark.createDataFrame(batch, "k long, v string, run int"), path, ["k"], "run")
        want |= {k: (v, r) for k, v, r in sorted(batch, key=lambda x: x[2])}
        assert rows_of(spark, path) == want
        if run in (1, 3):
            touched = merged.compact(spark, path, ["k"])
            assert touched and rows_of(spark, path) == want and merged.compact(spark, path, ["k"]) == []


def test_a_batch_costs_what_it_holds_and_lost_writes_stay_unseen(spark, tmp_path):
    path = str(tmp_path / "t")
    merged.upsert(spark.range(50_000).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit(1).alias("run")), path, ["k"], "run")
    merged.compact(spark, path, ["k"])
    before = size_of(path)
    merged.upsert(spark.range(3).select(F.col("id").alias("k"), F.lit("new").alias("v"), F.lit(2).alias("run")), path, ["k"], "run")
    assert size_of(path) - before < before / 20
    lost = spark.range(9).select(F.col("id").alias("k"), F.lit("lost").alias("v"), F.lit(3).alias("run"), merged.bucket_of(["id"]).alias("bucket"))
    lost.write.partitionBy("bucket").parquet(f"{path}/delta/n=9")
    os.remove(f"{path}/delta/n=9/_SUCCESS")  # as a job leaves it that dies before its end
    got = rows_of(spark, path)
    assert len(got) == 50_000 and {k for k, v in got.items() if v[0] == "new"} == {0, 1, 2} and not [v for v in got.values() if v[0] == "lost"]
    touched = merged.compact(spark, path, ["k"])
    assert 1 <= len(touched) <= 3 and rows_of(spark, path) == got
    fresh = merged.upsert(spark.createDataFrame([(1, "x", 4, True)], "k long, v string, run int, more boolean"), path, ["k"], "run")
    assert fresh == 10 and rows_of(spark, path)[1] == ("x", 4) and "more" in merged.read(spark, path, ["k"]).columns


def test_seen_keys(spark, tmp_path):
    path = str(tmp_path / "seen")
    keys = lambda a, b: spark.range(a, b).select(F.md5(F.col("id").cast("string")).alias("key"), "id")
    assert merged.unseen(keys(0, 5), path).count() == 5
    merged.add_keys(keys(0, 3000), path)
    merged.add_keys(keys(5000, 5200), path)
    assert sorted(r.id for r in merged.unseen(keys(2990, 5010), path).collect()) == list(range(3000, 5000))
    filters = spark.read.parquet(*[f"{path}/filters/{b}" for b in os.listdir(f"{path}/filters")])
    assert size_of(f"{path}/filters") < size_of(f"{path}/keys")
    probe = keys(10_000, 20_000).select("key", merged._mask(F.col("key")).alias("mask"), F.lit(750).cast("long").alias("slots"), merged._word(F.col("key"), F.lit(750)).alias("word"))
    false_hits = probe.join(filters, ["slots", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).count()
    assert false_hits < 400  # under 4 % of new keys are checked exactly
    few = spark.createDataFrame([("a new key",)], "key string")
    plan = merged.unseen(few, path)._jdf.queryExecution().executedPlan().toString()
    assert "/keys/" not in plan  # no filed key is read for a key that no filter knows


def test_sentences_scored_before_are_skipped(spark, tmp_path):
    s = spark.createDataFrame([(d, i, f"text {(d + i) % 7}") for d in range(5) for i in range(4)], "doc_id long, sent_id int, text string")
    scored = s.where("doc_id < 2").select(labels.cache_key(F.col("text"), "v1").alias("key"))
    merged.add_keys(scored, str(tmp_path / "scored"))
    got = sorted(map(tuple, labels.skip_filed(s, str(tmp_path / "scored"), "v1").collect()))
    assert got == sorted(map(tuple, labels.skip_scored(s, scored, "v1").collect())) and got


def test_documents_pass_once_however_late(spark, tmp_path):
    kind = "doc_id long, text string, ts timestamp"
    day = lambda n: F.timestamp_seconds(F.lit(n * 86400))
    for n, rows in enumerate([[(1, "a"), (2, "b"), (3, "a")], [(4, "a"), (5, "c")], [(6, "b"), (7, "d")]]):
        spark.createDataFrame(rows, "doc_id long, text string").withColumn("ts", day(400 * n)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = D.read_folder(spark, f"{tmp_path}/in", kind)
        for _ in range(2):  # a restart from the checkpoint changes nothing
            D.process_once(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert {r.doc_id: r.text for r in merged.read(spark, f"{tmp_path}/out/documents", ["doc_id"]).collect()} == {1: "a", 2: "b", 5: "c", 7: "d"}


def test_last_rows_over_restarts(spark, tmp_path):
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(2)
    rows = [(rng.randrange(3), rng.randrange(10**6), s, f"n{s % 4}") for s in range(60)]
    df = spark.createDataFrame(rows, "job_id long, at long, seq long, node string").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    for half in (df.where("seq < 30"), df.where("seq >= 30")):
        half.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = D.read_folder(spark, f"{tmp_path}/in", "job_id long, seq long, node string, ts timestamp")
        told = progress.last_rows(stream, 10).writeStream.outputMode("update").foreachBatch(lambda b, e: b.write.mode("overwrite").parquet(f"{tmp_path}/out/epoch={e}"))
        told.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(120)
    spark.conf.set(store, before)
    last = spark.read.parquet(f"{tmp_path}/out").groupBy("job_id").agg(F.max_by(F.struct("node", "seq", "history"), "epoch").alias("x")).select("job_id", "x.*")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, progress.last_rows_batch(df).select(last.columns).collect()))


def test_a_hint_decides(spark):
    text = "The fee is due. " + "x" * 2000 + " the fee is due. " + "y" * 3000 + " The fee is due. The end"
    docs = spark.createDataFrame([(1, text), (2, text), (3, "THE FEE IS DUE."), (4, text)], "doc_id long, text string")
    quotes = spark.createDataFrame([(9, "The fee is due.")], "item_id long, text string")
    second = text.rindex("The fee")
    hints = spark.createDataFrame([(1, 9, second + 500), (2, 9, 2500), (4, 9, 3)], "doc_id long, item_id long, hint long")
    got = {r.doc_id: (r.pos, r.end - r.pos, r.how) for r in citations.locate_near(docs, quotes, hints).collect()}
    assert got == {1: (second, 15, "near"), 2: (0, 15, "exact"), 3: (0, 15, "folded"), 4: (0, 15, "near")}
