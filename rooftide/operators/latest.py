"""Latest state of append-only evidence. A run that starts later wins, whenever its rows land."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_probe(probes: DataFrame, key: str = "agency_slug", started: str = "run_started", probed: str = "probed_at", tie: str | None = None) -> DataFrame:
    """Each key's row of the latest run, then the latest time, then the largest tie. A run without a start wins, as a
    null sorts first in falling order here. One aggregate with a partial step; no key is sorted in one task."""
    rest = [c for c in probes.columns if c != key]
    rank = F.struct(F.col(started).isNull(), F.col(started), F.col(probed), *([F.col(tie)] if tie else []))
    return probes.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("r")).select(key, "r.*")


def current_run(probes: DataFrame, started: str = "run_started") -> DataFrame:
    """Rows of the run that started last."""
    run = probes.select("run_id", started).distinct().orderBy(F.desc_nulls_first(started), F.desc("run_id")).limit(1)
    return probes.join(run.select("run_id"), "run_id", "left_semi")


def carried_down(rows: DataFrame, table: str, position: str, heading: str) -> DataFrame:
    """rows with the last heading at or above each row."""
    w = Window.partitionBy(table).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("carried", F.last(heading, ignorenulls=True).over(w))


def interleaved_sample(rows: DataFrame, by: str, n: int, seed: int, key: str = "url") -> DataFrame:
    """n rows that alternate between the values of `by`, in an order fixed by the seed."""
    w = Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), key), key)
    return rows.withColumn("turn", F.row_number().over(w)).orderBy("turn", by).limit(n)
