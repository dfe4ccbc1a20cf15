"""Incremental ingestion with Structured Streaming: snapshots merged per micro-batch, late runs kept late.

The market's own cycle is a daily batch; `availableNow` runs it as one. State lives in a table that each micro-batch
replaces as a whole under a new version, so a failed batch leaves the last version in place. It fits streams of few large
batches: a batch costs as much as the state is large.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import Policy, history, merge


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need instants; times without a zone are read in the session's."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def windowed_counts(events: DataFrame, by: str, width: str = "1 hour", late: str = "10 minutes", column: str = "ts") -> DataFrame:
    timed = event_time(events, column).withWatermark(column, late)
    counts = timed.groupBy(F.window(column, width), by).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), by, "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 day", column: str = "ts") -> DataFrame:
    """Known addresses are skipped while the watermark holds them."""
    return event_time(events, column).withWatermark(column, late).dropDuplicatesWithinWatermark(keys)


def with_places(offers: DataFrame, geo: DataFrame) -> DataFrame:
    """A stream of listings against the table of resolved places."""
    return offers.join(geo, "id", "left")


class VersionedState:
    """A table with whole versions in folders named version.batch; the last complete one counts. Older versions than the
    previous are removed."""

    def __init__(self, spark: SparkSession, path: str, schema) -> None:
        self.spark, self.path, self.schema = spark, path, schema
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        self.root = hadoop

    def versions(self) -> list[tuple[int, str]]:
        """(version, the batch that made it), oldest first."""
        if not self.fs.exists(self.root):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName().split(".", 1) for s in self.fs.listStatus(self.root)]
        return sorted((int(n[0]), n[1]) for n in names if len(n) == 2 and n[0].isdigit() and self.fs.exists(path(f"{self.path}/{n[0]}.{n[1]}/_SUCCESS")))

    def read(self) -> DataFrame:
        have = self.versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{have[-1][0]}.{have[-1][1]}") if have else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, version: int, batch: str) -> None:
        df.select(*[f.name for f in self.schema.fields]).write.mode("overwrite").parquet(f"{self.path}/{version}.{batch}")
        for old, name in self.versions()[:-2]:
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{old}.{name}"), True)


def merge_stream(snapshots: DataFrame, state: VersionedState, log_path: str, checkpoint: str, keys: list[str], tracked: list[str], policy: Policy, run_date: str = "run_date") -> StreamingQuery:
    """Merges each micro-batch of a stream of snapshot rows into the state and writes its history. Of a key's rows in a batch
    the last run counts; rows of runs older than what the state has seen of the key stay out; every row counts for its own run.

    A batch is known by its stream and number, so one that is run again after it was merged changes nothing, and a new
    checkpoint starts new batches. History is written under the version that it leads to, so a batch that failed between the
    two writes replaces its own."""
    spark = snapshots.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        have = state.versions()
        if have and have[-1][1] == f"{stream}-{number}":
            return
        version = have[-1][0] + 1 if have else 0
        old = state.read()
        rest = [c for c in batch.columns if c not in keys]
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(run_date)).alias("r")).select(*keys, "r.*")
        seen = old.select(*keys, F.col("last_seen").alias("__seen"))
        fresh = last.join(seen, keys, "left").where(F.col("__seen").isNull() | (F.col(run_date) >= F.col("__seen"))).drop("__seen")
        day = fresh.agg(F.max(run_date)).first()[0]
        if day is None:
            state.write(old, version, f"{stream}-{number}")
            return
        merged = merge(old, fresh, keys, tracked, F.lit(day), policy, run=run_date).persist()
        own_day = F.when(F.col("outcome") == "gone", F.lit(day)).otherwise(F.col("last_seen"))
        history(merged, keys, own_day, policy).write.mode("overwrite").parquet(f"{log_path}/version={version}")
        state.write(merged, version, f"{stream}-{number}")
        merged.unpersist()

    return snapshots.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_run_stream(probes: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Append-only evidence, handed on batch by batch; latest_probe() over the whole store keeps late runs late."""
    return probes.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
