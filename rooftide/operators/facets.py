"""Facets and statistics: every count of a scope in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import taxonomy


def facet_counts(scoped: DataFrame, deal: str = "sale", groups: dict | None = None) -> DataFrame:
    """One row: total, kind_<group>, build_new, build_resale of the deal, and deal_sale, deal_rent of the whole scope.
    Groups overlap; other filters are left out on purpose."""
    groups = groups or taxonomy.KIND_GROUPS
    own = F.col("deal") == deal
    new = taxonomy.new_build_clause(F.col("title"), F.col("notes"))
    kinds = [F.count_if(own & taxonomy.kind_clause(g, F.col("kind"), F.col("title"), groups)).alias(f"kind_{g}") for g in groups]
    deals = [F.count_if(F.col("deal") == d).alias(f"deal_{d}") for d in ("sale", "rent")]
    return scoped.agg(F.count_if(own).alias("total"), *kinds, F.count_if(own & new).alias("build_new"), F.count_if(own & ~new).alias("build_resale"), *deals)


def facet_agencies(scoped: DataFrame, agencies: DataFrame, deal: str = "sale") -> DataFrame:
    """(slug, name, n) by falling n. Counted by id first, so that names join after the aggregation."""
    counts = scoped.where(F.col("deal") == deal).groupBy("agency_id").agg(F.count("*").alias("n"))
    return counts.join(agencies.select("agency_id", "slug", "name"), "agency_id").select("slug", "name", "n").orderBy(F.desc("n"), "slug")


def agency_directory(scoped: DataFrame, agencies: DataFrame) -> DataFrame:
    """Agencies with live listings, by falling number."""
    counts = scoped.groupBy("agency_id").agg(F.count("*").alias("live"))
    return agencies.join(counts, "agency_id").orderBy(F.desc("live"), "slug")


def market_stats(active: DataFrame, images: DataFrame) -> DataFrame:
    """One row: offers, agencies, with_photo, sale, rent."""
    photos = images.select(F.col("offer_id").alias("id")).distinct().withColumn("photo", F.lit(True))
    return active.join(photos, "id", "left").agg(
        F.count("*").alias("offers"),
        F.countDistinct("agency_id").alias("agencies"),
        F.count_if(F.col("photo")).alias("with_photo"),
        F.count_if(F.col("deal") == "sale").alias("sale"),
        F.count_if(F.col("deal") == "rent").alias("rent"),
    )
