"""Listings, places and pages derived from the driver's tables; the expressions are valid in Spark SQL and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LISTING = {
    "id": "p_partkey",
    "title": "p_name",
    "kind": "p_type",
    "notes": "CASE WHEN p_partkey % 5 = 0 THEN 'new construction' WHEN p_partkey % 5 = 1 THEN 'преди акт 16' WHEN p_partkey % 5 = 2 THEN 'no lift, garden' WHEN p_partkey % 5 = 3 THEN 'pool and lift' ELSE '' END",
    "price": "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END",
    "area": "CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size * CAST(3.5 AS DOUBLE) END",
    "bedrooms": "CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size % 7 AS INT) END",
    "floor": "CASE WHEN p_size % 9 = 0 THEN NULL ELSE CAST(p_size % 9 AS INT) END",
    "location": "CASE WHEN p_partkey % 17 = 0 THEN '' ELSE p_brand END",
    "deal": "CASE WHEN p_partkey % 3 = 0 THEN 'rent' ELSE 'sale' END",
    "is_active": "p_partkey % 11 <> 0",
    "url": "CASE WHEN p_partkey % 13 = 0 THEN '' ELSE concat('https://homes.example/', p_partkey) END",
    "agency_id": "p_partkey % 10",
    "first_seen": "CAST(p_partkey % 400 AS INT)",
}
GEO = {
    "id": "p_partkey",
    "city": "n_name",
    "city_active": "n_nationkey % 6 <> 0",
    "neighbourhood": "CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END",
}
#: Stand-ins for the groups of kinds, as the tables' types are not those of homes.
GROUPS = {"apartment": ("standard", "economy"), "house": ("large", "widget"), "land": ("promo",)}


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


LISTINGS_SQL = f"listings AS (SELECT {_select(LISTING)} FROM part)"
GEO_SQL = f"geo AS (SELECT {_select(GEO)} FROM part JOIN supplier ON s_suppkey = p_partkey % 10 JOIN nation ON n_nationkey = s_nationkey)"
IMAGES_SQL = "images AS (SELECT l_partkey AS offer_id, l_linenumber AS position, l_orderkey AS image_id, concat('img/', l_orderkey, '-', l_linenumber, '.jpg') AS local_path FROM lineitem WHERE l_quantity >= 48)"
AGENCIES_SQL = "agencies AS (SELECT s_suppkey AS agency_id, s_name AS slug, concat('Agency ', s_nationkey) AS name FROM supplier)"
LIVE_SQL = f"{LISTINGS_SQL}, live AS (SELECT * FROM listings WHERE is_active AND url <> '')"


def any_of(column: str, tokens) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{t}')" for t in tokens) + ")"


def kind_sql(group: str) -> str:
    return f"({any_of('kind', GROUPS[group])} OR {any_of('title', GROUPS[group])})"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _exprs(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in columns.items()]


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(*_exprs(LISTING))


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    places = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
    part = read(spark, sf_dir, "part")
    return part.join(places, part.p_partkey % 10 == places.s_suppkey).selectExpr(*_exprs(GEO))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").where("l_quantity >= 48")
    return rows.selectExpr("l_partkey AS offer_id", "l_linenumber AS position", "l_orderkey AS image_id", "concat('img/', l_orderkey, '-', l_linenumber, '.jpg') AS local_path")


def agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS agency_id", "s_name AS slug", "concat('Agency ', s_nationkey) AS name")
