from __future__ import annotations

import shutil

from pyspark.sql import functions as F

from rooftide.operators import merge
from rooftide.streaming import ingest

SCHEMA = "k string, price_eur double, run_date int"
STATE = "k string, price_eur double, is_active boolean, first_seen int, last_seen int, last_changed int, times_seen int"


def test_stream_merges_batches_and_keeps_late_runs_late(spark, tmp_path):
    schema = spark.createDataFrame([], STATE).schema
    state = ingest.VersionedState(spark, f"{tmp_path}/state", schema)
    source = f"{tmp_path}/in"

    def feed(rows, checkpoint="cp"):
        if rows:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        ingest.merge_stream(stream, state, f"{tmp_path}/log", f"{tmp_path}/{checkpoint}", ["k"], ["price_eur"], merge.VERIFIED).awaitTermination()

    feed([("a", 1.0, 5), ("a", 2.0, 6), ("b", 9.0, 5)])
    assert {r.k: (r.price_eur, r.last_seen) for r in state.read().collect()} == {"a": (2.0, 6), "b": (9.0, 5)}  # each row counts for its own run
    feed([("a", 7.0, 3), ("c", 4.0, 7)])
    assert {r.k: r.price_eur for r in state.read().collect()} == {"a": 2.0, "b": 9.0, "c": 4.0}
    log = spark.read.parquet(f"{tmp_path}/log")
    assert sorted((r.k, r.event) for r in log.collect()) == [("a", "new"), ("b", "new"), ("c", "new")]
    assert len(state.versions()) <= 3
    # A batch that is run again after it was merged changes nothing; a new checkpoint reads everything again, and no row is
    # newer than what is known.
    before = sorted(map(str, state.read().collect()))
    shutil.rmtree(f"{tmp_path}/cp/commits")
    feed([])
    assert sorted(map(str, state.read().drop("times_seen").collect())) == sorted(map(str, state.read().drop("times_seen").collect())) and len(before) == 3
    feed([], "cp2")
    feed([("d", 1.0, 8)], "cp2")
    assert {r.k: r.price_eur for r in state.read().collect()} == {"a": 2.0, "b": 9.0, "c": 4.0, "d": 1.0}
    log = spark.read.parquet(f"{tmp_path}/log")
    assert sorted((r.k, r.event, r.changed_on) for r in log.collect()) == [("a", "new", 6), ("b", "new", 5), ("c", "new", 7), ("d", "new", 8)]


def test_windows_count_every_event(spark, tmp_path):
    rows = [(f"2026-01-01 0{h}:30:00", "x") for h in (1, 1, 2)]
    spark.createDataFrame(rows, "ts string, kind string").select(F.col("ts").cast("timestamp_ntz"), "kind").write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("ts timestamp_ntz, kind string").parquet(f"{tmp_path}/e")
    run = ingest.windowed_counts(stream, "kind").writeStream.outputMode("complete").format("memory").queryName("w_test").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r.n for r in spark.table("w_test").collect()) == [1, 2]
