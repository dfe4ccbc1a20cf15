"""Cutting the lineage of what a loop builds, so that round n does not repeat the rounds before; settling columns; and dealing
out rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; without the setting a temporary one, in local mode only."""
    if folder := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rooftide-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, rows: int = 2500, *keys: str) -> DataFrame:
    """df dealt out, by keys if any, to tasks of about so many rows, where each row is much work: a small file would be one task, however many
    rows it holds. Rows that grow should grow after it."""
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once, however often later columns and filters name them. They come from a generator
    of one row, which the optimiser neither merges into what follows nor pushes filters through."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
