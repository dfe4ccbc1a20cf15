"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, materialize

#: Rows are ranked in tasks of about this many, in no more than so many ranges.
RANK_ROWS, RANGES = 1_000_000, 20_000


def ranked(df: DataFrame, n: int, order: Sequence[Column], by: Sequence[str] = (), sums: Sequence[str] = ()) -> DataFrame:
    """df with rank (from 1, by `order`, within each value of `by`) and, for each of `sums`, upto_<name>: its sum over the
    rows up to and with this one. df has n rows; `order` should tell rows apart.

    Rows are cut into ranges at quantiles of the order, by and all, so neither a hot value of `by` nor outliers fill one
    task; ranges are ranked each, and what ranges before hold is added. The ranges' table fixes the cut."""
    cut = df.repartitionByRange(min(RANGES, -(-n // RANK_ROWS) + 1), *map(F.col, by), *order) if n > RANK_ROWS else df.repartitionByRange(*map(F.col, by), *order)
    table = materialize(cut.withColumn("__range", F.spark_partition_id()), "ranges")
    cells = table.groupBy("__range", *by).agg(F.count("*").alias("__n"), *(F.sum(c).alias(f"__{c}") for c in sums))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most for each value
    cells = cells.select("__range", *by, *(F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in ("n", *sums)))
    own = Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = table.withColumns({"rank": F.row_number().over(own), **{f"upto_{c}": F.sum(c).over(own) for c in sums}})
    out = inside.join(cells, ["__range", *by]).withColumn("rank", F.col("rank") + F.col("__n"))
    return out.withColumns({f"upto_{c}": F.col(f"upto_{c}") + F.col(f"__{c}") for c in sums}).drop("__range", "__n", *(f"__{c}" for c in sums))


def source_targets(sized: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """(src, source_size, target) from (src, size): weights go round the sources by code point, null ('') last. The
    targets share `share` of all sizes by weight; one stops at `most` times its source's size and the excess is
    shared again. Sorted by size over weight, the sources that stop are a prefix, so one pass settles it."""
    sources = materialize(sized.groupBy("src").agg(F.sum("size").alias("source_size")), "sources")
    n, total = sources.agg(F.count("*"), F.sum("source_size")).first()
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    weighed = ranked(sources, n, [F.col("src") == "", F.col("src")]).withColumn("weight", weight).drop("rank")
    placed = materialize(ranked(weighed, n, [F.col("source_size") / F.col("weight"), F.col("src")], sums=["source_size", "weight"]), "placed")
    all_weight = placed.agg(F.sum("weight")).first()[0]
    before, onward = F.col("upto_source_size") - F.col("source_size"), F.lit(all_weight) - F.col("upto_weight") + F.col("weight")
    level = (F.lit(total) * share - before * most) / onward
    settled = placed.select(level.alias("level"), "weight", "source_size").where(F.col("level") * F.col("weight") <= F.col("source_size") * most).agg(F.max("level")).first()[0]
    target = F.least(F.col("source_size") * F.lit(most), F.lit(settled or 0.0) * F.col("weight"))
    return placed.select("src", "source_size", target.cast("double").alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of docs: the id, src ('=' and the source; '' for null), size (words), source_size, target and
    copies, and the columns to carry (none of these names).

    Within a source all documents expect target / source_size copies. Ranked by size and id, the prefix sum after
    rank r is r times that; one offset for each source, from its name and the seed, moves it, and each whole number
    it passes emits the document once. So copies are at most ceil(most), sizes are sampled evenly, and reruns agree.
    Ranks come from ranges cut at quantiles, so no task ranks a whole source. A null text has size 0; a null id comes
    first; rows of one size and id follow each other by their texts' hashes, and equal rows in any order, which gives
    the same rows. Empty: no rows."""
    sized = docs.select(
        *carry,
        F.xxhash64(text_col).alias("tie"),
        F.col(id_col).alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("src"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    # The row's own number parts equal rows, so that many of them may lie in several ranges.
    sized = materialize(sized.withColumn("row", F.monotonically_increasing_id()), "sized")
    places = ranked(sized, sized.count(), [F.col("size"), F.col("id"), F.col("tie"), F.col("row")], ["src"])
    targets = source_targets(sized.select("src", "size"), weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("src")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    after, before = (F.floor(r * rate + start) for r in (F.col("rank"), F.col("rank") - 1))
    # A table of sources, however many; Spark splits a hot source's rows in the join.
    return materialize(places.select(*carry, "id", "src", "size", "rank"), "places").join(targets, "src").select(
        *carry, F.col("id").alias(id_col), "src", "size", "source_size", "target", F.least(after - before, F.lit(-int(-most // 1))).cast("long").alias("copies")
    )
