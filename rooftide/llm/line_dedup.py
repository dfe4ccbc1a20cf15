"""Line dedup: range-partitioned line hashes, streamed first occurrences, run-length coded keep bitmaps. Native only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import NO_ID, SPACES, ascii_lower, materialize

#: A hash is hot from so many lines on, or from this share of all lines if that is less (but never below HOT_LEAST).
HOT_LINES, HOT_SHARE, HOT_LEAST = 1_000_000, 1 / 2000, 64
#: Up to so many hot hashes are broadcast; beyond, Spark joins their table.
BROADCAST_HOT = 100_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """One row per distinct (id, text) with at least one dropped line: id_key, text_hash, dropped (sorted positions),
    dropped_runs (the keep bitmap, run-length coded: inclusive ranges of dropped positions; all else is kept).

    A line's key is the line without ASCII white space at both ends, A-Z lowered. A line of a key with min_chars code
    points or more is dropped if a smaller id holds the key. Keys are compared by 128 bits of hash. Hot keys are
    counted exactly, resolved by a pre-aggregated minimum and never dealt by key; all others are range
    partitioned by hash and sorted by id and position, so that one pass meets each key's first document first.
    A null id counts as the largest id, a null text as one empty line; repeated rows are the same document; an empty
    table gives no rows. Other columns are not read."""
    base = docs.select(
        F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("id_key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    keys = F.transform(_lines(ascii_lower(F.col("text"))), lambda x: F.btrim(x, F.lit(SPACES)))
    hashed = F.transform(keys, lambda x: F.when(F.length(x) >= min_chars, F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"))))
    lines = (
        base.select("id_key", F.xxhash64("text").alias("text_hash"), F.posexplode(hashed).alias("pos", "h"))
        .where("h IS NOT NULL")
        .select("id_key", "text_hash", "pos", "h.h1", "h.h2")
    )
    lines = materialize(lines, "lines")  # hashes only; the passes below need not split the texts again
    n = lines.count()
    bound = max(HOT_LEAST, min(HOT_LINES, n * HOT_SHARE))
    firsts = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id_key").alias("first")).where(F.col("n") >= bound)
    firsts = materialize(firsts.select("h1", "h2", "first"), "hot")  # n / bound rows at most
    n_hot = firsts.count()
    known = F.broadcast(firsts) if n_hot <= BROADCAST_HOT else firsts
    by_key = Window.partitionBy("h1", "h2").orderBy("id_key", "pos")
    cold = lines.join(known, ["h1", "h2"], "left_anti") if n_hot else lines
    dropped = (
        cold.repartitionByRange("h1", "h2")
        .withColumn("first", F.first("id_key").over(by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .where("id_key > first")
        .select("id_key", "text_hash", "pos")
    )
    if n_hot:
        dropped = dropped.unionByName(lines.join(known, ["h1", "h2"]).where("id_key > first").select("id_key", "text_hash", "pos"))
    marks = dropped.groupBy("id_key", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    at = F.col("dropped")
    starts = F.filter(at, lambda x, i: (i == 0) | (F.get(at, i - 1) != x - 1))
    ends = F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) != x + 1))
    return marks.withColumn("dropped_runs", F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), b.alias("last"))))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """docs with three more columns, kept_text, n_lines and n_dropped (a clashing column of docs is replaced).

    Lines and edge cases as in line_keep_bitmaps(); the kept lines are joined by line feeds, and none left is ''."""
    marks = line_keep_bitmaps(docs, id_col, text_col, min_chars).select(
        F.col("id_key").alias("__id"), F.col("text_hash").alias("__hash"), F.col("dropped").alias("__dropped")
    )
    marks = materialize(marks, "marks")  # a table, so that Spark may split a row that is repeated everywhere
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({"__id": F.coalesce(F.col(id_col), F.lit(NO_ID)), "__hash": F.xxhash64(text)})
    lines = _lines(text)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__dropped"))
    joined = keyed.join(marks, ["__id", "__hash"], "left")
    return joined.withColumns(
        {
            "kept_text": F.when(F.col("__dropped").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")),
            "n_lines": F.size(lines).cast("long"),
            "n_dropped": F.coalesce(F.size("__dropped"), F.lit(0)).cast("long"),
        }
    ).drop("__id", "__hash", "__dropped")
