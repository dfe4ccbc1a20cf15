"""Verified sources: pages as those sites write them, made from the driver's tables, read back and compared with the tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import spread
from ..sources import sites, tree
from ._tables import read

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# A listing's facts, in SQL that both engines read.
_OFFER = {
    "ref": "p_partkey",
    "wrong": "p_partkey % 23 = 0",
    "asked": "CASE WHEN p_partkey % 3 = 0 AND p_partkey % 29 <> 0 THEN 'rent' ELSE 'sale' END",
    "named": "CASE WHEN p_partkey % 3 = 0 THEN 'rent' ELSE 'sale' END",
    "gone": "p_partkey % 11 = 0",
    "town": "CASE WHEN p_size % 7 = 0 THEN 'Пловдив, ' ELSE 'София (град), ' END",
    "place": "p_brand",
    "name": "p_name",
    "type": "CASE p_size % 4 WHEN 0 THEN 'Едностаен апартамент' WHEN 1 THEN 'Магазин' WHEN 2 THEN '3-стаен' ELSE p_type END",
    "price": "CASE WHEN p_size % 9 = 0 THEN '90 000 - 120 000 €' WHEN p_partkey % 13 = 0 THEN 'по договаряне' ELSE concat(CAST(floor(p_retailprice) AS BIGINT), ' €') END",
    "euros": "CASE WHEN p_partkey % 13 <> 0 THEN CAST(floor(p_retailprice) AS DOUBLE) END",
    "many": "p_size % 9 = 0",
    "area": "CASE WHEN p_size % 5 = 0 THEN '0 кв.м' ELSE concat(p_size, '.5 кв.м') END",
    "metres": "CASE WHEN p_size % 5 <> 0 THEN p_size + CAST(0.5 AS DOUBLE) END",
    "floor": "CASE WHEN p_size % 6 = 0 THEN 'Партер' ELSE concat(p_size, '') END",
    "level": "CASE WHEN p_size % 6 = 0 THEN 0 ELSE p_size END",
    "rooms": "p_size % 40",
}
_OFFERS = f"offers AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _OFFER.items())} FROM part)"
_HEADING = "concat(CASE WHEN named = 'rent' THEN 'Отдава под наем, ' ELSE 'Продава, ' END, type, ', ', name, CASE WHEN gone THEN ' ПРОДАДЕН' ELSE '' END)"
_LISTING = f"""concat('<title>Оферта №', CASE WHEN wrong THEN ref + 1 ELSE ref END, '</title><link rel="canonical" href="https://www.arcoreal.bg/оферти/imot-', ref,
'"><nav><a class="label" href="/">Площ</a></nav><div class="offer"><div class="info"><h1>', {_HEADING}, '</h1><span itemprop="address">', town, place, '</span><div itemprop="price"><strong>', price,
'</strong> <strong>1 лв.</strong></div><div class="details"><div class="row"><span class="label">Площ</span><span class="value">', area, '</span></div><div class="row"><span class="label">Етаж</span><span class="value">', floor,
'</span></div><div class="row"><span class="label">Спални</span><span class="value">', rooms, '</span></div></div></div></div>')"""


@query(
    f"""WITH {_OFFERS}, told AS (SELECT *, CASE WHEN wrong THEN 'rejected' WHEN town <> 'София (град), ' THEN 'outside_city' WHEN gone THEN 'unavailable' WHEN named <> asked THEN 'rejected' WHEN many THEN 'project' ELSE 'offer' END AS outcome FROM offers)
SELECT concat('https://www.arcoreal.bg/оферти/imot-', ref) AS url, outcome, CASE WHEN outcome = 'rejected' THEN CASE WHEN wrong THEN 'the listing''s number is missing' ELSE 'the title names another deal' END END AS reason,
CASE WHEN outcome = 'offer' THEN {_HEADING} END AS title, CASE WHEN outcome = 'offer' THEN concat('София, ', place) END AS location, CASE WHEN outcome = 'offer' THEN named END AS deal,
CASE WHEN outcome = 'offer' THEN CASE type WHEN '3-стаен' THEN 'Тристаен апартамент' ELSE type END END AS kind, CASE WHEN outcome = 'offer' THEN euros END AS price, CASE WHEN outcome = 'offer' THEN metres END AS area,
CASE WHEN outcome = 'offer' AND rooms <= 30 THEN rooms END::INT AS bedrooms, CASE WHEN outcome = 'offer' THEN level END::INT AS floor, CASE WHEN outcome = 'offer' THEN metres IS NULL END AS area_placeholder FROM told"""
)
def site_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = read(spark, sf_dir, "part").selectExpr(*(f"{e} AS {n}" for n, e in _OFFER.items()))
    pages = offers.selectExpr("concat('https://www.arcoreal.bg/оферти/imot-', ref) AS url", f"{_LISTING} AS html", "asked AS deal")
    found = sites.read_listings(pages, sites.SITES["arco-real-estate"])
    r = F.col("record")
    return found.select(
        "url", "outcome", "reason", r["title"].alias("title"), r["location"].alias("location"), r["deal_type"].alias("deal"), r["property_kind"].alias("kind"), r["price_eur"].cast("double").alias("price"),
        r["area_m2"].cast("double").alias("area"), r["bedrooms"].alias("bedrooms"), r["floor"].alias("floor"), F.when(F.col("outcome") == "offer", F.map_contains_key("fields", "area_placeholder")).alias("area_placeholder"),
    )


_UNIT = {
    "listing": "l_orderkey",
    "unit": "l_partkey * 8 + l_linenumber",
    "sold": "l_returnflag = 'R'",
    "beds": "l_linenumber % 4",
    "area": "CAST(l_quantity AS BIGINT)",
    "size": "CAST(l_quantity AS BIGINT) + CASE WHEN l_partkey % 31 = 0 THEN 1 ELSE 0 END",
    "price": "CAST(l_extendedprice AS DECIMAL(12, 2))",
    "shown": "CAST(floor(CAST(l_extendedprice AS DECIMAL(12, 2)) + 0.5) AS BIGINT) + CASE WHEN l_suppkey % 37 = 0 THEN 1 ELSE 0 END",
    "hidden": "l_partkey % 17 = 0",
    "heading": "CASE l_linenumber % 5 WHEN 0 THEN 'Ground floor' WHEN 1 THEN 'First floor' WHEN 2 THEN 'Minus second floor' WHEN 3 THEN '17th floor' ELSE 'Roof' END",
}
_UNITS = f"units AS (SELECT {', '.join(f'{e} AS {n}' for n, e in _UNIT.items())} FROM lineitem)"
_ROW = """concat('<h3 class="sub-title">', heading, '</h3><table><tr data-id="', unit, '" data-size="', size, '" data-price="', price, '"><td>#', unit, '</td><td class="apr_type">', CASE WHEN beds = 0 THEN 'Studio' ELSE concat(beds, '-bed') END,
'</td><td class="apr_area">', area, '</td><td class="apr_price">', CASE WHEN hidden THEN '' ELSE concat('€ ', shown) END, '</td><td class="stat">', CASE WHEN sold THEN 'Sold' ELSE 'Available' END, '</td></tr></table>')"""
_DEVELOPMENT = """concat('<link rel="canonical" href="', url, '"><div class="component-single-property-general-information"><h1>Project ', listing, '</h1><span class="location">', CASE WHEN listing % 10 = 0 THEN 'Varna' ELSE 'Sofia, Center' END, '</span><span class="labels">For sale</span></div>')"""


@query(
    f"""WITH {_UNITS}, lists AS (SELECT listing, listing % 10 = 0 AS away, count(*) <> count(DISTINCT unit) AS twice FROM units GROUP BY 1),
one AS (SELECT *, CASE WHEN sold THEN 'unavailable' WHEN area <> size OR (NOT hidden AND shown <> floor(price + 0.5)) THEN 'rejected' ELSE 'offer' END AS outcome FROM units JOIN lists USING (listing) WHERE NOT away AND NOT twice)
SELECT listing, concat(listing, 'PL', unit) AS ref, outcome, CASE WHEN outcome = 'rejected' THEN 'what is shown and what is stated disagree' END AS reason, CASE WHEN outcome = 'offer' AND NOT hidden THEN price END::DOUBLE AS price,
CASE WHEN outcome = 'offer' THEN area END::DOUBLE AS area, CASE WHEN outcome = 'offer' THEN beds END::INT AS bedrooms, CASE WHEN outcome = 'offer' THEN CASE heading WHEN 'Ground floor' THEN 0 WHEN 'First floor' THEN 1 WHEN 'Minus second floor' THEN -2 WHEN '17th floor' THEN 17 END END::INT AS floor FROM one
UNION ALL SELECT listing, NULL, 'rejected', CASE WHEN away THEN 'the development is outside the city' ELSE 'a unit without a number of its own' END, NULL, NULL, NULL, NULL FROM lists WHERE away OR twice"""
)
def development_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A development has at most a few units, so its list is put together in one row. Units are dealt out by development before
    they become markup: the lists then need no exchange of their own, and no few tasks read them all."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    units = spread(lines, 20_000, "l_orderkey").selectExpr(*(f"{e} AS {n}" for n, e in _UNIT.items()))
    lists = units.groupBy("listing").agg(F.array_join(F.array_sort(F.collect_list(F.expr(_ROW))), "").alias("rows"))
    pages = lists.withColumn("url", F.expr("concat('https://www.bulgarianproperties.com/p/AD', listing, 'BG_project.html')"))
    pages = pages.selectExpr("listing", "url", f"{_DEVELOPMENT} AS project_html", "concat('<div id=\"price-list\">', rows, '</div>') AS html")
    r = F.col("record")
    return sites.read_units(pages).select("listing", "ref", "outcome", "reason", r["price_eur"].cast("double").alias("price"), r["area_m2"].cast("double").alias("area"), r["bedrooms"].alias("bedrooms"), r["floor"].alias("floor"))


@query(
    """WITH o AS (SELECT o_custkey AS page, o_orderkey AS ref, o_orderkey % 4 = 0 AS project, o_orderkey % 3 = 0 AS inactive, o_custkey % 9 = 0 AS broken FROM orders)
SELECT page, CASE WHEN broken THEN 'a card without its own link or of the other deal' END AS reason, CASE WHEN NOT broken THEN count(*) * 30 END AS total, CASE WHEN NOT broken THEN count(*) END::INT AS cards, CASE WHEN NOT broken THEN count(*) FILTER (project) END::INT AS projects,
CASE WHEN NOT broken THEN count(*) FILTER (inactive) END::INT AS inactive, CASE WHEN NOT broken THEN min(concat('https://www.yavlena.com/bg/', ref)) END AS first_url, CASE WHEN NOT broken AND count(*) > 3 THEN 'https://www.yavlena.com/bg/sales/sofia-sofia/d23l4396?page=2' END AS next_url FROM o GROUP BY page, broken"""
)
def site_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue page for each customer, with the cards of a rendered component; cards without links are refused."""
    cards = read(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS page", "concat('<a href=\"/bg/', o_orderkey, '\">x</a>') AS link",
        "named_struct('propertyInnerNumber', o_orderkey, 'isRent', false, 'isProject', o_orderkey % 4 = 0, 'isSoldOrRented', o_orderkey % 3 = 0, 'cityName', 'София') AS card",
    )
    found = cards.groupBy("page").agg(F.collect_list("card").alias("cards"), F.array_join(F.collect_list("link"), "").alias("links"))
    data = F.struct(F.struct(F.lit(True).alias("succeeded"), F.struct((F.size("cards") * 30).alias("propertyServicesCount"), "cards").alias("data")).alias("ssrResult"))
    record = F.concat(F.lit('1:["$","x",null,'), F.to_json(data), F.lit("]\n"))
    pushed = F.concat(F.lit("<script>self.__next_f.push("), F.regexp_replace(F.to_json(F.array(F.lit("1"), record)), r'^\["1"', "[1"), F.lit(")</script>"))
    html = F.concat(F.when(F.col("page") % 9 == 0, F.lit("")).otherwise(F.col("links")), pushed)
    site = sites.SITES["yavlena"]
    pages = found.select("page", F.lit(site.starts["sale"] + "?page=1").alias("url"), html.alias("html"), F.lit("sale").alias("deal"))
    c = F.col("catalogue")
    count = lambda fit: F.when(c["cards"].isNotNull(), F.size(F.filter(c["cards"], fit)))
    return sites.catalogue_cards(pages, site).select(
        "page", c["reason"].alias("reason"), c["total"].alias("total"), count(lambda x: F.lit(True)).alias("cards"), count(lambda x: x["project"]).alias("projects"), count(lambda x: x["inactive"]).alias("inactive"),
        F.array_min(c["cards"]["url"]).alias("first_url"), c["next_url"].alias("next_url"),
    )


@query(
    """SELECT page_id, len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a '))::INT AS n_nav, replace(regexp_extract(html, '<nav><ul><li><a href="([^"]*)"', 1), '&amp;', '&') AS first_link,
len(regexp_extract_all(html, '<article>'))::INT AS n_articles, len(regexp_extract_all(html, '<p[ >]'))::INT AS n_paragraphs, len(regexp_extract_all(html, 'class="ad"'))::INT AS n_ads, 'p{margin:0}' AS style FROM pages"""
)
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    def look(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for html in pages:
            page = tree.tree(html)
            count = lambda path: sum(1 for _ in page.every(path))  # noqa: B023, E731
            rows.append((count("nav a"), page.one("nav ul a[href]").get("href"), count("article"), count("p"), count(".ad"), page.one("style").source()))
        return pd.DataFrame(rows, columns=["n_nav", "first_link", "n_articles", "n_paragraphs", "n_ads", "style"])

    seen = F.pandas_udf(look, "struct<n_nav:int,first_link:string,n_articles:int,n_paragraphs:int,n_ads:int,style:string>")
    return read(spark, sf_dir, "pages").select("page_id", seen("html").alias("s")).select("page_id", "s.*")
