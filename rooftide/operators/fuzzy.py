"""Trigram similarity joins without an index: prefix-filtered inverted lists, then an exact check.

A pair at similarity s shares at least ceil(s * size) of the trigrams of either side. So if each side is listed under
its rarest size - ceil(s * size) + 1 trigrams only, every such pair still meets, while common trigrams, which would
make hot keys, are hardly ever listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import similarity, trigrams

THRESHOLD, AREA_TOLERANCE, PRICE_TOLERANCE, PER_REFERENCE = 0.55, 3.0, 3.0, 5
VOTE_FLOOR, DOMINANCE, STRONG, LEAST_EVIDENCE = 0.60, 0.80, 0.95, 2


def _prefixes(texts: DataFrame, ranks: DataFrame, threshold: float, keys: list[str]) -> DataFrame:
    """(keys, text, size, gram) for each distinct text's prefix grams."""
    grams = texts.select(*keys, "text", F.size("grams").alias("size"), F.explode("grams").alias("gram")).join(ranks, "gram")
    sized = grams.groupBy(*keys, "text", "size").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("ranked"))
    keep = F.col("size") - F.ceil(F.col("size") * threshold) + 1
    return sized.select(*keys, "text", "size", F.explode(F.slice("ranked", F.lit(1), keep.cast("int"))).alias("x")).select(*keys, "text", "size", "x.gram")


def similar_texts(left: DataFrame, right: DataFrame, threshold: float, keys: list[str] | None = None) -> DataFrame:
    """Distinct (keys, a, b, sim) with similarity >= threshold; left and right: (keys, text). Each distinct text is
    compared once, however many rows share it."""
    keys = keys or []
    a, b = (df.select(*keys, "text").where("text <> ''").distinct().withColumn("grams", trigrams(F.col("text"))).where(F.size("grams") > 0) for df in (left, right))
    counted = a.select("grams").unionByName(b.select("grams")).select(F.explode("grams").alias("gram"))
    ranks = counted.groupBy("gram").agg(F.count("*").alias("n"))
    mine = _prefixes(a, ranks, threshold, keys).withColumnsRenamed({"text": "a", "size": "size_a"})
    theirs = _prefixes(b, ranks, threshold, keys).withColumnsRenamed({"text": "b", "size": "size_b"})
    fits = (F.col("size_a") >= F.col("size_b") * threshold) & (F.col("size_b") >= F.col("size_a") * threshold)
    met = mine.join(theirs, [*keys, "gram"]).where(fits).select(*keys, "a", "b").distinct()
    return met.withColumn("sim", similarity(trigrams(F.col("a")), trigrams(F.col("b")))).where(F.col("sim") >= threshold)


def close(a: Column, b: Column, tolerance: Column | float) -> Column:
    return a.isNull() | b.isNull() | (F.abs(a - b) <= tolerance)


def possible_duplicates(references: DataFrame, offers: DataFrame, limit: int = PER_REFERENCE) -> DataFrame:
    """(id, other_id, sim, place): for each reference the most similar active listings of other agencies in the same city,
    location and deal, with bedrooms equal, area within 3 and price within 3 % of the reference's, or unknown.

    Both: id, agency_id, city, location, deal, bedrooms, area, price, title_norm; offers also is_active."""
    keys = ["city", "location", "deal"]
    named = lambda df: df.where("title_norm <> '' AND location <> ''")
    refs, pool = named(references), named(offers.where("is_active"))
    texts = similar_texts(refs.select(*keys, F.col("title_norm").alias("text")), pool.select(*keys, F.col("title_norm").alias("text")), THRESHOLD, keys)
    other = pool.select(*keys, F.col("title_norm").alias("b"), *(F.col(c).alias(f"other_{c}") for c in ("id", "agency_id", "bedrooms", "area", "price")))
    pairs = refs.withColumnRenamed("title_norm", "a").join(texts, [*keys, "a"]).join(other, [*keys, "b"])
    fits = (
        (F.col("id") != F.col("other_id"))
        & (F.col("agency_id") != F.col("other_agency_id"))
        & close(F.col("bedrooms"), F.col("other_bedrooms"), 0)
        & close(F.col("area"), F.col("other_area"), AREA_TOLERANCE)
        & close(F.col("price"), F.col("other_price"), F.col("price") * PRICE_TOLERANCE / 100)
    )
    best = Window.partitionBy("id").orderBy(F.desc("sim"), F.asc_nulls_last("other_price"), "other_id")
    ranked = pairs.where(fits).withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit)
    return ranked.select("id", "other_id", "sim", "place", (F.col("other_price") - F.col("price")).alias("price_delta"))


def also_at(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("similarity", F.bround("sim", 3)).drop("sim")


def corpus_votes(unlocated: DataFrame, located: DataFrame) -> DataFrame:
    """(id, location, votes, best): where similar located titles agree. unlocated: (id, text); located: (text, location).

    A location wins with 80 % of the votes, from two titles at least or one at 0.95. Votes are counted by distinct
    title before they are joined, so popular titles do not multiply rows."""
    by_text = located.where("location <> ''").groupBy("text", "location").agg(F.count("*").alias("n"))
    texts = similar_texts(unlocated, by_text.select("text").distinct(), VOTE_FLOOR)
    votes = texts.join(by_text.withColumnRenamed("text", "b"), "b").groupBy("a", "location").agg(F.sum("n").alias("votes"), F.max("sim").alias("best"))
    every = Window.partitionBy("a")
    first = every.orderBy(F.desc("votes"), F.desc("best"), "location")
    won = votes.withColumns({"share": F.col("votes") / F.sum("votes").over(every), "place": F.row_number().over(first)}).where(
        (F.col("place") == 1) & (F.col("share") >= DOMINANCE) & ((F.col("votes") >= LEAST_EVIDENCE) | (F.col("best") >= STRONG))
    )
    return unlocated.join(won.select(F.col("a").alias("text"), "location", "votes", "best"), "text").select("id", "location", "votes", "best")
