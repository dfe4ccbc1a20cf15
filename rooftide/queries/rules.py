"""Rules of filters, repairs, readers and streams over rows made of the driver's tables, each with its result spelled out in SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features, identity, prices, taxonomy, text
from ..operators import geo, latest, merge, recon, search
from ..operators.lineage import shared_folder, spread
from ..plans import jobs
from ..sources import catalogue, feeds, flight, html
from ..streaming import ingest
from ._tables import AGENCIES_SQL, LIVE_SQL, agencies, listings, read

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _cases(values: list[str | None], key: str = "p_partkey") -> str:
    """SQL, for both engines, of a text by key modulo the number of values."""
    rows = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {rows} END"


def _numbers(values: list[int | None], key: str = "p_partkey") -> str:
    rows = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else str(v)) for i, v in enumerate(values))
    return f"CAST(CASE {key} % {len(values)} {rows} END AS INT)"


def _parts(spark: SparkSession, sf_dir: str, heavy: bool = False, **columns: str) -> DataFrame:
    """heavy: what becomes of a row is much work, so rows are dealt out first."""
    part = read(spark, sf_dir, "part")
    return (spread(part.select("p_partkey", "p_size")) if heavy else part).selectExpr("p_partkey AS id", *(f"{e} AS {c}" for c, e in columns.items()))


# --- filters ----------------------------------------------------------------------------------------------------------


@query(f"WITH {LIVE_SQL}, {AGENCIES_SQL} SELECT id, slug AS agency_slug FROM live JOIN agencies USING (agency_id) WHERE deal = 'sale' AND slug = 'Supplier#000000003'")
def agency_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = search.live(listings(spark, sf_dir)).join(agencies(spark, sf_dir).select("agency_id", F.col("slug").alias("agency_slug")), "agency_id")
    return search.filtered(offers, {"agency": "Supplier#000000003"}).select("id", "agency_slug")


@query(f"WITH {LIVE_SQL} SELECT id, price FROM live WHERE price IS NOT NULL")
def legacy_price_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.legacy_price_sort(search.live(listings(spark, sf_dir)), "price_asc").select("id", "price")


_SECTIONS = ["offer", "offer/archive", "en/offer", "blog", "Offer"]


@query("SELECT p_partkey AS id, p_partkey % 5 IN (0, 2) AS listing FROM part")
def listing_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, url=f"concat('https://www.s', p_partkey % 7, '.example/', {_cases(_SECTIONS)}, '/', p_partkey)")
    return rows.select("id", recon.is_listing(F.col("url"), F.array(F.lit("re:/offer/[0-9]+$")), F.array(F.lit("/offer/archive"))).alias("listing"))


@query("SELECT c_custkey AS id, c_custkey % 3 = 0 AND c_custkey % 4 <> 0 AS crawlable FROM customer")
def crawlable_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 3 = 0 THEN 'ok' ELSE 'blocked' END AS status", "CASE WHEN c_custkey % 8 = 0 THEN '' WHEN c_custkey % 4 = 0 THEN NULL ELSE '/x/*' END AS pattern")
    return rows.select("id", recon.crawlable(F.col("status"), F.col("pattern")).alias("crawlable"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0")
def needs_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 3 = 0 THEN 'web' ELSE 'sheet' END AS source", "CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate END AS verified_at")
    return rows.where(merge.needs_verification(F.col("source"), F.col("verified_at"))).select("id")


_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '')"


@query(f"SELECT page_id FROM pages WHERE NOT contains({_HOST}, '.com') AND NOT contains({_HOST}, '.net')")
def own_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.without_domains(read(spark, sf_dir, "pages"), [".com", ".net"]).select("page_id")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 5 IN (0, 2)")
def own_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = catalogue.Adapter("own", ref="x", own="софия|sofia", other="варна")
    places = ["обява в СОФИЯ център", "София и Варна", "Sofia flat", "Бургас", None]
    return _parts(spark, sf_dir, t=_cases(places)).where(catalogue.in_city(F.col("t"), rule)).select("id")


@query(
    """WITH s AS (SELECT p_brand AS site, p_type AS shape, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n DESC, shape) AS place FROM s)
SELECT site, arg_min(shape, place) AS shape, arg_min(n, place) AS n FROM r WHERE place <= 5 AND first % 3 <> 0 GROUP BY site"""
)
def verified_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    shapes = part.groupBy(F.col("p_brand").alias("site"), F.col("p_type").alias("shape")).agg(F.count("*").alias("n"), F.array(F.min("p_partkey").cast("string")).alias("samples"))
    kinds = part.selectExpr("CAST(p_partkey AS STRING) AS url", "CASE WHEN p_partkey % 3 <> 0 THEN 'detail' ELSE 'catalogue' END AS kind")
    return recon.verified_pattern(shapes, kinds)


# --- texts ------------------------------------------------------------------------------------------------------------


@query(f"SELECT p_partkey AS id, {_cases(['kashta v ruse', 'shtit i yula', 'chasha', 'plain text', ''])} AS latin FROM part")
def romanised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, t=_cases(["къща в русе", "щит и юла", "чаша", "plain text", ""])).select("id", text.romanise(F.col("t")).alias("latin"))


@query(f"SELECT p_partkey AS id, concat({_cases(['Sozopol', 'Созопол', 'Center море'])}, ' ', p_name) AS t FROM part")
def lookalikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, t=f"concat({_cases(['Sоzоpоl', 'Созопол', 'Cеntеr море'])}, ' ', p_name)")
    return rows.select("id", text.undo_lookalikes(F.col("t")).alias("t"))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 4 IN (0, 2)")
def distinctive_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, t=_cases(["Apartament Kamelot", "kashta studio", "ПАРК Ривиера", "a bc 12"]))
    return rows.where(text.is_distinctive(F.col("t"), jobs.GENERIC)).select("id")


@query(r"SELECT p_partkey AS id, regexp_replace(lower(concat(p_name, '--', p_brand)), '[^a-z0-9]+', '-', 'g') AS slug FROM part")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, t="concat(' ', p_name, '--', p_brand, '!')").select("id", text.slugify(F.col("t")).alias("slug"))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 1 THEN concat('one line', chr(10), 'floor: ', p_size) WHEN 2 THEN concat('a', chr(10), 'floor: ', p_size, chr(10), 'b') ELSE concat('floor: ', p_size) END AS notes FROM part")
def merged_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, notes=r"CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'one line' WHEN 2 THEN 'a\nfloor: 9\nb' END", size="p_size")
    return rows.select("id", catalogue.merge_note(F.col("notes"), "floor", F.col("size").cast("string")).alias("notes"))


@query(
    """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN p_size WHEN 3 THEN -1 END::INT AS value, CASE p_partkey % 4 WHEN 1 THEN p_size WHEN 2 THEN 1000 + p_size WHEN 3 THEN -1 END::DOUBLE AS strict,
CASE p_partkey % 4 WHEN 1 THEN p_size WHEN 2 THEN 1000 + p_size WHEN 3 THEN 1 END::DOUBLE AS first FROM part"""
)
def whole_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, t="CASE p_partkey % 4 WHEN 0 THEN 'Ground' WHEN 1 THEN CAST(p_size AS STRING) WHEN 2 THEN concat('1’', lpad(CAST(p_size AS STRING), 3, '0')) ELSE '-1' END")
    t = F.col("t")
    return rows.select("id", prices.single_integer(t).alias("value"), prices.strict_number(t).cast("double").alias("strict"), prices.first_number(t).cast("double").alias("first"))


@query(f"SELECT p_partkey AS id, {_numbers([0, 3, -2, 7, 20, None, None])} AS floor FROM part")
def floor_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = ["ground floor", "Third floor", "minus second floor", "7th floor", "twentieth floor", "on the third floor", "101 floor"]
    return _parts(spark, sf_dir, t=_cases(said)).select("id", taxonomy.floor_number(F.col("t")).alias("floor"))


@query(f"SELECT p_partkey AS id, {_cases(['Тристаен апартамент', 'Многостаен апартамент', 'Студио', 'Къща', 'loft'])} AS kind, {_numbers([3, 6, 1, None, None])} AS rooms, {_cases(['', 'Без домашни любимци', '', 'домашни любимци са позволени', ''])} AS pets FROM part")
def kinds_and_pets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["Продава тристаен", "6-стаен дом", "Студио", "къща с двор", "loft"]
    rows = _parts(spark, sf_dir, t=_cases(kinds), notes=_cases(["тихо", "Без домашни любимци.", "куче", "ок, домашни любимци са позволени", ""]))
    return rows.select("id", taxonomy.kind_and_rooms(F.col("t")).alias("k"), taxonomy.pet_fact(F.col("notes")).alias("pets")).select("id", "k.*", "pets")


@query(f"SELECT p_partkey AS id, {_cases(['no', 'yes', None, 'no'])} AS pets FROM part")
def pets_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, title="p_name", notes=_cases(["Без животни", "Pet-friendly home", "quiet", "no pets, pets allowed"]))
    said = features.pets_allowed(F.col("title"), F.col("notes"))
    return rows.select("id", F.when(said, "yes").when(~said, "no").alias("pets"))


# --- places -----------------------------------------------------------------------------------------------------------


@query(
    f"""SELECT p_partkey AS id, {_cases(['sofia', 'varna', None, 'sofia', None, None, 'varna'])} AS city, {_cases(['Дружба 2', 'Чайка', None, None, None, None, 'Чайка'])} AS neighbourhood,
{_cases(['0.95', '0.95', '0.00', '0.40', '0.00', '0.00', '0.95'])} AS confidence, {_cases(['alias', 'alias', 'unresolved', 'source_city', 'unresolved', 'unresolved', 'alias'])} AS matched_by FROM part"""
)
def places_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    cities = spark.createDataFrame([("sofia", "София", "Sofia"), ("varna", "Варна", "Varna")], "slug string, name_bg string, name_en string")
    aliases = spark.createDataFrame([("sofia", "druzhba 2", "Дружба 2"), ("sofia", "druzhba", "Дружба"), ("varna", "chayka", "Чайка")], "city string, alias string, place string")
    where = ["София, Дружба 2", "Varna Chayka", "Каварна", "", "София или Варна", "никъде", "кв. Чайка"]
    source = [None, None, "varna", "sofia", "varna", None, "varna"]
    offers = _parts(spark, sf_dir, location=_cases(where), location_raw="''", source_city=_cases(source))
    return geo.resolve(offers, cities, aliases).select("id", "city", "neighbourhood", "confidence", "matched_by")


_NAMED = "WHEN contains(p_name, 'old widget') THEN 'Old widget' WHEN contains(p_name, 'ring') THEN 'Ring' WHEN contains(p_name, 'bolt') THEN 'Bolt' WHEN contains(p_name, 'red') THEN 'Red'"


@query(f"SELECT p_partkey AS id, CASE {_NAMED} END AS strict, CASE {_NAMED} WHEN list_contains(string_split(p_name, ' '), 'widget') THEN 'Old widget' END AS loose FROM part")
def longest_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = [("ring", "Ring"), ("bolt", "Bolt"), ("red", "Red"), ("old widget", "Old widget")]
    rows, name = _parts(spark, sf_dir, t="p_name"), F.col("t")
    return rows.select("id", geo.first_longest_alias(name, vocabulary).alias("strict"), geo.first_longest_alias_or_word(name, vocabulary).alias("loose"))


# --- repairs ----------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, round_even(p_retailprice * p_size, 2) AS price, p_retailprice AS price_per_m2, concat('n', chr(10), 'price: rate per m2, total derived') AS notes FROM part WHERE p_partkey % 3 = 0")
def fixed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, price="p_retailprice", area="CAST(p_size AS DOUBLE)", price_per_m2="CASE WHEN p_partkey % 2 = 0 THEN CAST(1 AS DOUBLE) END", notes="'n'", price_raw="CASE WHEN p_partkey % 3 = 0 THEN '900 EUR / m2' ELSE '900 EUR' END")
    return jobs.fix_prices(rows)


@query("SELECT p_partkey AS id, ((100 + p_size) * 1000)::DOUBLE AS price FROM part WHERE p_partkey % 2 = 0")
def fixed_split_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, price="CAST(7000000 + (100 + p_size) * 1000 AS DOUBLE)", price_raw=r"CASE WHEN p_partkey % 2 = 0 THEN concat('Complex 7\n', 100 + p_size, ' 000 EUR') ELSE concat('7 ', 100 + p_size, ' 000 EUR') END")
    return jobs.fix_split_prices(rows)


@query(
    """SELECT s_suppkey AS agency_id, sum(CASE WHEN p_partkey % 11 <> 0 AND s_suppkey % 4 <> 0 THEN 1 ELSE 0 END)::BIGINT AS active, sum(CASE WHEN p_partkey % 11 <> 0 AND s_suppkey % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS withdrawn
FROM part JOIN supplier ON s_suppkey = p_partkey % 10 GROUP BY ALL"""
)
def retired_agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = listings(spark, sf_dir).withColumn("last_changed", F.lit(1))
    after, log = merge.retire_agency(state, agencies(spark, sf_dir).where("agency_id % 4 = 0"), F.lit(9))
    counts = after.groupBy("agency_id").agg(F.count_if("is_active").alias("active"))
    return counts.join(log.groupBy("agency_id").agg(F.count("*").alias("withdrawn")), "agency_id", "left").select("agency_id", "active", F.coalesce("withdrawn", F.lit(0).cast("long")).alias("withdrawn"))


@query(
    """SELECT concat('web', left(sha1(concat('https://h/', o_orderkey)), 13)) AS fingerprint,
CASE WHEN o_orderkey % 10 = 0 THEN 'sold' WHEN o_orderkey % 6 = 0 THEN 'new' ELSE 'active' END AS status, o_orderkey % 10 <> 0 AS is_active,
CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS last_changed FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 10 = 0 OR o_orderkey % 6 = 0"""
)
def sold_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "concat('https://h/', o_orderkey) AS url", "o_totalprice AS price_eur").where("k % 2 = 1 OR k % 10 = 0 OR k % 6 = 0")
    stored = {"fingerprint": identity.web_fingerprint(F.col("url")), "status": F.lit("active"), "is_active": F.lit(True), **{c: F.lit(1) for c in ("first_seen", "last_seen", "last_changed", "times_seen")}}
    records = orders.where("k % 2 = 0").selectExpr("url", "price_eur", "CASE WHEN k % 10 = 0 THEN 'sold' ELSE 'new' END AS status")
    return jobs.store_web(orders.withColumns(stored).drop("k", "url"), records, F.lit(2))[0].select("fingerprint", "status", "is_active", "last_changed")


@query(
    """WITH r AS (SELECT o_orderkey AS offer_id, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice ELSE o_totalprice + 10 END AS price_eur, [7, 9, 11, 13][(o_orderkey // 2 % 4 + 1)::INT] AS area_m2, o_orderkey % 4 <> 0 AS moved FROM orders WHERE o_orderkey % 2 = 0)
SELECT offer_id, price_eur, round_even(price_eur / area_m2, 2) AS price_per_m2, moved FROM r"""
)
def verified_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored under 'code 12', found again as 12, with some values missing."""
    rows = read(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").selectExpr("CAST(o_orderkey AS STRING) AS ref", "concat('https://h/', o_orderkey) AS listing_url", "o_totalprice AS price_eur", "CAST(element_at(array(7, 9, 11, 13), CAST(o_orderkey DIV 2 % 4 + 1 AS INT)) AS DOUBLE) AS area_m2")
    state = rows.selectExpr("ref AS offer_id", "concat('code ', ref) AS ref", "'' AS listing_url", "price_eur", "area_m2", "true AS is_active", "1 AS first_seen", "1 AS last_seen", "1 AS last_changed", "1 AS times_seen")
    records = rows.selectExpr("ref", "listing_url", "CASE WHEN CAST(ref AS BIGINT) % 4 <> 0 THEN price_eur + 10 END AS price_eur", "CASE WHEN CAST(ref AS BIGINT) % 3 <> 0 THEN area_m2 END AS area_m2")
    merged, _, _ = jobs.store_verified(state, records, F.lit(2))
    return merged.select(F.col("offer_id").cast("long").alias("offer_id"), "price_eur", "price_per_m2", F.exists("changes", lambda x: x["field"] == "price_eur").alias("moved"))


@query(
    """WITH r AS (SELECT o_orderkey AS id, concat('r', o_orderkey // 2) AS ref, CASE WHEN o_orderkey % 2 = 0 THEN 'sale' ELSE 'rent' END AS deal, concat('https://h/', o_orderkey // 2, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '/rent' END) AS url,
concat('https://h/', o_orderkey // 2, CASE WHEN o_orderkey % 2 = 0 THEN '/rent' ELSE '' END) AS opposite FROM orders),
s AS (SELECT id AS offer_id, ref AS s_ref, url AS s_url, CASE WHEN id % 10 = 1 THEN 'sale' ELSE deal END AS s_deal FROM r)
SELECT ref, deal, min(offer_id) AS offer_id, count(*) > 1 AS ambiguous FROM r JOIN s ON (url = s_url OR ref = s_ref AND deal = s_deal) AND s_url <> opposite GROUP BY ref, deal"""
)
def two_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reference for a sale and a rental; every tenth row is stored under the wrong deal."""
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS offer_id", "concat('r', o_orderkey DIV 2) AS ref", "CASE WHEN o_orderkey % 2 = 0 THEN 'sale' ELSE 'rent' END AS deal", "concat('https://h/', o_orderkey DIV 2, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '/rent' END) AS url")
    stored = rows.withColumn("deal", F.when(F.col("offer_id") % 10 == 1, "sale").otherwise(F.col("deal")))
    return merge.service_matches(rows.drop("offer_id"), stored)


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 <> 0 THEN concat('st', s_suppkey % 3) END AS status, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 9 END AS listing_count FROM supplier")
def seeded_agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    newest = s.where("s_suppkey % 4 <> 0").selectExpr("s_name AS agency_slug", "concat('st', s_suppkey % 3) AS status", "'/x/*' AS listing_pattern", "s_suppkey % 9 AS listing_count", "2 AS run_started", "1 AS probed_at")
    older = newest.withColumns({"status": F.lit("old"), "run_started": F.lit(1), "probed_at": F.lit(5)})
    return jobs.seed_agencies(s.selectExpr("s_suppkey AS id", "s_name AS slug"), newest.unionByName(older)).select("id", "status", "listing_count")


@query("SELECT event_id FROM events WHERE event_id % 20 = (SELECT max(event_id % 20) FROM events)")
def current_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.current_run(read(spark, sf_dir, "events").selectExpr("event_id", "event_id % 20 AS run_id", "event_id % 20 AS run_started")).select("event_id")


@query("SELECT 8::BIGINT AS n, 4::BIGINT AS red")
def interleaved_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, url="concat(p_name, p_partkey)", side="CASE WHEN p_partkey % 5 = 0 THEN 'red' ELSE 'blue' END")
    return latest.interleaved_sample(rows, "side", 8, 1).agg(F.count("*").alias("n"), F.count_if(F.col("side") == "red").alias("red"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'x' END AS name, c_custkey % 4 = 0 AS rental, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS price FROM customer")
def conformed_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = "CASE WHEN c_custkey % 5 = 0 THEN 'ask' ELSE CAST(c_acctbal AS STRING) END AS price_eur"
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'X' END AS title", "'' AS location", asked, "'' AS area_m2", "'2' AS bedrooms", "'?' AS floor", "CASE WHEN c_custkey % 4 = 0 THEN 'rent' ELSE '' END AS deal_type")
    out = jobs.conform_sheet(rows).where("bedrooms = 2 AND floor IS NULL AND area_m2 IS NULL")
    return out.select("id", F.col("title_norm").alias("name"), (F.col("deal_type") == "rent").alias("rental"), F.col("price_eur").cast("double").alias("price"))


# --- feeds ------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, concat('/a', p_size, ',/b') AS disallow, 'https://h/s.xml' AS sitemaps FROM part")
def robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, t=r"concat('User-agent: *\r\nDISALLOW: /b\nDisallow: /a', p_size, '\nDisallow:\nDisallow: /b\nSitemap: https://h/s.xml')")
    said = rows.select("id", feeds.robots(F.col("t")).alias("r"))
    return said.select("id", F.array_join("r.disallow", ",").alias("disallow"), F.array_join("r.sitemaps", ",").alias("sitemaps"))


@query("SELECT concat('https://h/', p_partkey) AS loc, concat('2026-01-', lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0')) AS lastmod FROM part WHERE p_partkey % 20 <> 7")
def sitemap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of twenty maps, one of which was not fetched."""
    entry = "concat('<url><loc>https://h/', p_partkey, '</loc><lastmod>2026-01-', lpad(CAST(p_partkey % 28 + 1 AS STRING), 2, '0'), '</lastmod></url>')"
    maps = read(spark, sf_dir, "part").groupBy(F.expr("p_partkey % 20").alias("m")).agg(F.array_join(F.collect_list(F.expr(entry)), "").alias("b"))
    files = maps.where("m <> 7").select(F.concat(F.lit("https://h/map"), "m").alias("url"), F.concat(F.lit("<urlset>"), "b", F.lit("</urlset>")).alias("xml"))
    named = maps.agg(F.array_join(F.collect_list(F.concat(F.lit("<loc>https://h/map"), "m", F.lit("</loc>"))), "").alias("b"))
    return feeds.sitemap_entries(files.unionByName(named.select(F.lit("https://h/index").alias("url"), F.concat(F.lit("<sitemapindex>"), "b", F.lit("</sitemapindex>")).alias("xml"))))


@query("SELECT concat('l', p_partkey % 500) AS link, arg_min(p_name, p_partkey) AS title FROM part GROUP BY 1")
def rss_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = "concat('<rss><item><title><![CDATA[', p_name, ']]></title><link>l', p_partkey % 500, '</link></item></rss>')"
    return feeds.rss_items(read(spark, sf_dir, "part").selectExpr("p_partkey AS page", f"{item} AS xml"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 <> 4 THEN s_name END AS slug FROM supplier")
def agencies_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    known = s.selectExpr("s_name AS slug", "concat('https://www.a', s_suppkey, '.example/home') AS website")
    found = s.selectExpr("s_suppkey AS id", "'nobody' AS name", "CASE s_suppkey % 5 WHEN 4 THEN concat('https://b', s_suppkey, '.example') WHEN 1 THEN concat('http://shop.a', s_suppkey, '.example') ELSE concat('http://a', s_suppkey, '.example/x') END AS website")
    return feeds.match_by_host(found, known).select("id", "slug")


@query("SELECT p_partkey % 300 AS offer_id, count(*) FILTER (p_partkey % 4 < 2) AS images, count(*) FILTER (p_partkey % 4 >= 2) AS broken FROM part GROUP BY 1")
def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good files, too short ones and pages in place of images."""
    body = "repeat(concat(p_partkey, 'x'), 2000)"
    content = f"CASE p_partkey % 4 WHEN 0 THEN concat(unhex('FFD8FF'), CAST({body} AS BINARY)) WHEN 1 THEN concat(unhex('52494646AAAAAAAA57454250'), CAST({body} AS BINARY)) WHEN 2 THEN unhex('FFD8') ELSE CAST(concat('<html>', {body}) AS BINARY) END"
    files = read(spark, sf_dir, "part").selectExpr("p_partkey % 300 AS offer_id", "p_partkey AS position", f"{content} AS content", "CAST(p_partkey AS STRING) AS path")
    kept = feeds.import_images(files, each=None).groupBy("offer_id").agg(F.count("*").alias("images"))
    broken = feeds.broken_images(files.select("path"), files).groupBy((F.col("path").cast("long") % 300).alias("offer_id")).agg(F.count("*").alias("broken"))
    every = files.select("offer_id").distinct().join(kept, "offer_id", "left").join(broken, "offer_id", "left")
    return every.select("offer_id", F.coalesce("images", F.lit(0).cast("long")).alias("images"), F.coalesce("broken", F.lit(0).cast("long")).alias("broken"))


@query("SELECT p_partkey AS id, concat('Цена ', p_size) AS t FROM part")
def decoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same words in Windows-1251, declared by the header or by the page, and in UTF-8."""
    word = "unhex('D6E5EDE020')"
    body = f"CASE p_partkey % 3 WHEN 0 THEN concat({word}, CAST(CAST(p_size AS STRING) AS BINARY)) WHEN 1 THEN concat(CAST('<meta charset=\"windows-1251\">' AS BINARY), {word}, CAST(CAST(p_size AS STRING) AS BINARY)) ELSE CAST(concat('Цена ', p_size) AS BINARY) END"
    rows = _parts(spark, sf_dir, content=body, header="CASE WHEN p_partkey % 3 = 0 THEN 'Windows-1251' ELSE '' END")
    return rows.select("id", F.regexp_replace(feeds.decode(F.col("content"), F.col("header")), "^<.*>", "").alias("t"))


# --- pages ------------------------------------------------------------------------------------------------------------


@query(f"SELECT p_partkey AS id, {_cases(['unreachable', 'blocked', 'blocked', 'http_error', 'ok'])} AS outcome FROM part")
def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, status=_numbers([None, 403, 200, 404, 200]), body=_cases(["", "", "Just a Moment...", "", "flat"]))
    return rows.select("id", recon.response_class(F.col("status"), F.col("body")).alias("outcome"))


@query("SELECT s_suppkey AS id, concat('https://s', s_suppkey, '.example/en/offer/') AS first, 're:/en/offer/[^/]+' AS include, '/en/offer/page/,/ru/,/de/' AS drops FROM supplier")
def derived_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "concat('https://s', s_suppkey, '.example/home?x') AS probe")
    spec = recon.derived_spec(F.col("probe"), F.lit("/en/offer/*"), F.lit(None).cast("array<string>"))
    return rows.select("id", spec.alias("s")).select("id", F.get("s.catalog", F.lit(0)).alias("first"), F.array_join("s.include", ",").alias("include"), F.array_join("s.drop", ",").alias("drops"))


_LINKS = """CASE p_partkey % 3 WHEN 0 THEN concat('<base href="/', p_size, '/"><a href="x#top">1</a>') WHEN 1 THEN concat('<a class="z" href="../../', p_size, '/./x">1</a><a href="mailto:x">m</a>')
ELSE concat('<a href="https://other.example/">1</a><A HREF="/', p_size, '/y/../x">2</a><a href="/z.css">3</a>') END"""


@query("SELECT p_partkey AS id, concat('https://www.h/', p_size, '/x') AS link FROM part")
def links_with_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recon.links_on(_parts(spark, sf_dir, url="'https://www.h/a/b/c.html'", html=_LINKS), ["id"])


_HOME = """concat('<html><head><title>Site | all</title></head><body class="header-top"><div class="top menu">Цена: 77 000 EUR</div><button>Цена 66 000 EUR</button><h1>Апартамент Изгрев ', p_partkey, '</h1><div class="research">',
'<p>Цена: ', 50 + p_size, ' 000 EUR</p><p>Площ: ', 40 + p_size, ' кв.м</p><p>Спални: ', 1 + p_size % 4, '</p><p>Етаж: ', CASE WHEN p_partkey % 5 = 0 THEN 'партер' ELSE CAST(1 + p_size % 9 AS STRING) END, '</p><p>Обзаведен: да</p>',
CASE WHEN p_partkey % 7 = 0 THEN '<p>Статус: продаден</p>' ELSE '' END, '</div><div id="similar-offers">Площ: 999 кв.м</div><h1>Друга обява</h1><p>', repeat('Светъл апартамент до парка. ', 8), '</p></body></html>')"""


@query(
    """SELECT p_partkey AS id, concat('Апартамент Изгрев ', p_partkey) AS title, ((50 + p_size) * 1000)::DOUBLE AS price, concat(50 + p_size, ' 000 EUR') AS price_raw, (40 + p_size)::DOUBLE AS area, (1 + p_size % 4)::INT AS bedrooms,
CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 + p_size % 9 END::INT AS floor, CASE WHEN p_partkey % 7 = 0 THEN 'sold' ELSE 'active' END AS status, true AS furnished, 'Изгрев' AS location FROM part"""
)
def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(_parts(spark, sf_dir, heavy=True, url="concat('https://h/', p_partkey)", html=_HOME), vocabulary=[("изгрев", "Изгрев"), ("парк", "Парк")])
    return found.select("id", "title", "price", "price_raw", "area", "bedrooms", "floor", "status", "furnished", "location")


_DATA = """concat('<script type="application/ld+json">{"@graph":[{"@type":"Apartment","name":"Flat ', p_partkey, ' by the park","numberOfRooms":', 2 + p_size % 4, ',"floorSize":{"value":', 40 + p_size, '},"address":{"streetAddress":"Main ', p_size, '","addressLocality":"Sofia"},',
'"offers":{"@type":"Offer","price":"', 90000 + p_partkey, '","priceCurrency":"', CASE WHEN p_partkey % 2 = 0 THEN 'BGN' ELSE 'EUR' END, '"}},{"@type":"PropertyValue","name":"Floor","value":"', 1 + p_size % 9, '"}]}</script><p>', repeat('bright rooms and a quiet street near the park ', 8), '</p>')"""


@query(
    """SELECT p_partkey AS id, concat('Flat ', p_partkey, ' by the park') AS title, CASE WHEN p_partkey % 2 = 0 THEN round_even((90000 + p_partkey) / 1.95583::DOUBLE, 2) ELSE (90000 + p_partkey)::DOUBLE END AS price, (40 + p_size)::DOUBLE AS area,
(1 + p_size % 4)::INT AS bedrooms, (1 + p_size % 9)::INT AS floor, concat('Main ', p_size, ' Sofia') AS location_raw FROM part"""
)
def structured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(_parts(spark, sf_dir, heavy=True, url="concat('https://h/', p_partkey)", html=_DATA))
    return found.select("id", "title", "price", "area", "bedrooms", "floor", "location_raw")


_PUSHED = r"""CASE WHEN p_partkey % 3 = 2 THEN '<p>none</p>' ELSE concat('<script>self.__next_f.push([1,"1:T6,2:[1,{3:[\\"$\\",\\"x\\",null,{\\"price\\":', 50000 + p_partkey, ',\\"area\\":', 30 + p_size, '}]\\n"])</script>') END"""


@query("SELECT p_partkey AS id, 50000 + p_partkey AS price, (30 + p_size)::BIGINT AS area FROM part WHERE p_partkey % 3 <> 2")
def component_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records behind a text record that begins like one."""
    found = flight.with_records(_parts(spark, sf_dir, html=_PUSHED))
    records = found.select("id", F.explode("records").alias("r")).select("id", F.from_json("r", "price long, area long").alias("x"))
    return records.select("id", "x.price", "x.area")


# --- streams ----------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = f"{sf_dir}/{name}.parquet"
    schema = read(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(source if os.path.isdir(source) else f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def _drained(rows: DataFrame, name: str) -> DataFrame:
    """The rows of a stream that ran to its end, as a table in the shared folder."""
    spark, base = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/{name}-{os.urandom(4).hex()}"
    rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event of each user while the watermark holds them, then the first of the batch's."""
    seen = ingest.first_seen(_stream(spark, sf_dir, "events"), ["user_id"], late="3650 days")
    users = _drained(seen.select("user_id"), "first").distinct()
    return users.join(read(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id")), "user_id")


@query("SELECT o_orderkey AS id, c_mktsegment AS place FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0")
def stream_with_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = _stream(spark, sf_dir, "orders").selectExpr("o_orderkey AS offer", "o_custkey AS id")
    places = read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey AS id", "c_mktsegment AS place")
    return _drained(ingest.with_places(offers, places).selectExpr("offer AS id", "place"), "places")


@query("SELECT o_custkey AS key, arg_max(o_totalprice, o_orderkey) AS price_eur, max(o_orderkey) AS last_seen, true AS is_active FROM orders GROUP BY o_custkey")
def stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as price reports of customers, each a run of its own; the last run of each counts, with its own date."""
    base = f"{shared_folder(spark)}/merge-{os.urandom(4).hex()}"
    schema = spark.createDataFrame([], "key long, price_eur double, is_active boolean, first_seen long, last_seen long, last_changed long, times_seen int").schema
    state = ingest.VersionedState(spark, f"{base}/state", schema)
    reports = _stream(spark, sf_dir, "orders").selectExpr("o_custkey AS key", "o_totalprice AS price_eur", "o_orderkey AS run_date")
    ingest.merge_stream(reports, state, f"{base}/log", f"{base}/checkpoint", ["key"], ["price_eur"], merge.VERIFIED).awaitTermination()
    return state.read().select("key", "price_eur", "last_seen", "is_active")
