"""Search, facets, statistics, identity, matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features, identity, prices, taxonomy, text
from ..operators import facets, fuzzy, geo, match, search
from ._tables import AGENCIES_SQL, GEO_SQL, GROUPS, IMAGES_SQL, LISTINGS_SQL, LIVE_SQL, agencies, any_of, geography, images, kind_sql, listings, read

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


CARD = ["id", "title", "deal", "price", "area", "double(bedrooms) AS bedrooms"]


@query(f"WITH {LIVE_SQL} SELECT id, title, deal, price, area, bedrooms::DOUBLE AS bedrooms FROM live WHERE deal = 'sale' AND (price <= 980 OR price IS NULL) AND (bedrooms >= 2 OR bedrooms IS NULL) ORDER BY price ASC NULLS LAST, id DESC LIMIT 24 OFFSET 24")
def live_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.filtered(search.live(listings(spark, sf_dir)), {"deal": "sale", "price_max": "980", "beds": "2"}, groups=GROUPS)
    return search.page_of(found, "price_asc", 2).selectExpr(*CARD)


@query(f"WITH {LIVE_SQL} SELECT id, title, deal, price, area, bedrooms::DOUBLE AS bedrooms FROM live WHERE deal = 'sale' AND (contains(lower(title), 'ring') OR contains(lower(location), 'ring')) AND {kind_sql('house')} AND (area >= 50 OR area IS NULL) ORDER BY area DESC NULLS LAST, id DESC LIMIT 24")
def search_text_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.filtered(search.live(listings(spark, sf_dir)), {"q": " Ring ", "kind": "house", "area_min": "50", "price_min": "cheap"}, groups=GROUPS)
    return search.page_of(found, "area_desc").selectExpr(*CARD)


@query(f"WITH {LIVE_SQL}, {IMAGES_SQL} SELECT id, title, deal, price, area, bedrooms::DOUBLE AS bedrooms FROM live WHERE deal = 'rent' AND id IN (SELECT offer_id FROM images)")
def with_photo_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.filtered(search.live(listings(spark, sf_dir)), {"deal": "rent", "with_photo": "1"}, images(spark, sf_dir), GROUPS).selectExpr(*CARD)


_NEW = f"({any_of('title', ['new construction'])} OR {any_of('notes', taxonomy.NEW_BUILD_TOKENS)})"


@query(f"WITH {LIVE_SQL} SELECT id, title FROM live WHERE deal = 'sale' AND NOT {_NEW}")
def resale_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.filtered(search.live(listings(spark, sf_dir)), {"build": "resale"}, groups=GROUPS).select("id", "title")


_SCOPED = f"WITH {LIVE_SQL}, {GEO_SQL}, scoped AS (SELECT l.*, city, city_active, neighbourhood FROM live l LEFT JOIN geo USING (id))"


@query(f"{_SCOPED} SELECT id, city, neighbourhood FROM scoped WHERE city = (SELECT min(city) FROM geo WHERE city_active) AND city_active AND (neighbourhood = 'Brand#7' OR neighbourhood IS NULL)")
def neighbourhood_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = geography(spark, sf_dir)
    city = places.where("city_active").agg(F.min("city")).first()[0]
    known = places.where("neighbourhood IS NOT NULL").select("city", F.col("neighbourhood").alias("slug"), F.lit(True).alias("active")).distinct()
    offers = search.city_scope(search.with_geography(search.live(listings(spark, sf_dir)), places), city)
    return search.neighbourhood_scope(offers, city, "Brand#7", known).select("id", "city", "neighbourhood")


@query(
    f"WITH {LIVE_SQL} SELECT count(*) FILTER (deal = 'sale') AS total, "
    + ", ".join(f"count(*) FILTER (deal = 'sale' AND {kind_sql(g)}) AS kind_{g}" for g in GROUPS)
    + f", count(*) FILTER (deal = 'sale' AND {_NEW}) AS build_new, count(*) FILTER (deal = 'sale' AND NOT {_NEW}) AS build_resale, count(*) FILTER (deal = 'sale') AS deal_sale, count(*) FILTER (deal = 'rent') AS deal_rent FROM live"
)
def facets_single_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.facet_counts(search.live(listings(spark, sf_dir)), "sale", GROUPS)


@query(f"WITH {LIVE_SQL}, {AGENCIES_SQL} SELECT slug, name, count(*) AS n FROM live JOIN agencies USING (agency_id) WHERE deal = 'sale' GROUP BY slug, name")
def facet_agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.facet_agencies(search.live(listings(spark, sf_dir)), agencies(spark, sf_dir))


@query(f"WITH {LISTINGS_SQL}, {AGENCIES_SQL} SELECT agency_id, slug, name, count(*) AS live FROM listings JOIN agencies USING (agency_id) WHERE is_active GROUP BY ALL")
def agency_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.agency_directory(listings(spark, sf_dir).where("is_active"), agencies(spark, sf_dir)).select("agency_id", "slug", "name", "live")


@query(f"WITH {LISTINGS_SQL}, {IMAGES_SQL} SELECT count(*) AS offers, count(DISTINCT agency_id) AS agencies, count(*) FILTER (id IN (SELECT offer_id FROM images)) AS with_photo, count(*) FILTER (deal = 'sale') AS sale, count(*) FILTER (deal = 'rent') AS rent FROM listings WHERE is_active")
def market_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.market_stats(listings(spark, sf_dir).where("is_active"), images(spark, sf_dir))


@query(
    f"WITH {LIVE_SQL}, {IMAGES_SQL}, first AS (SELECT offer_id AS id, arg_min(local_path, (position, image_id)) AS image FROM images GROUP BY offer_id) "
    "SELECT id, round_even(((price IS NOT NULL)::INT + (area IS NOT NULL)::INT + (bedrooms IS NOT NULL)::INT + (floor IS NOT NULL)::INT + (location <> '')::INT) / 5.0::DOUBLE, 2) AS confidence, "
    "concat_ws(',', CASE WHEN price IS NULL THEN 'price_eur' END, CASE WHEN area IS NULL THEN 'area_m2' END, CASE WHEN bedrooms IS NULL THEN 'bedrooms' END, CASE WHEN floor IS NULL THEN 'floor' END) AS missing, "
    "CASE (price IS NULL)::INT + (area IS NULL)::INT + (bedrooms IS NULL)::INT + (floor IS NULL)::INT WHEN 0 THEN 'full' WHEN 1 THEN 'partial' WHEN 2 THEN 'partial' ELSE 'thin' END AS completeness, "
    "notes IN ('new construction', 'преди акт 16') AS new_build, CASE WHEN notes = 'преди акт 16' THEN 'Пред Акт 16' END AS stage, image FROM live LEFT JOIN first USING (id)"
)
def serialise_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = search.serialise(search.live(listings(spark, sf_dir)))
    cards = cards.join(search.first_image(images(spark, sf_dir)), "id", "left")
    return cards.select("id", "confidence", F.array_join("missing", ",").alias("missing"), taxonomy.completeness(F.col("missing")).alias("completeness"), "new_build", "stage", "image")


_RAW = "CASE WHEN p_partkey % 4 = 0 THEN concat('EUR ', p_size, ' per m2') WHEN p_partkey % 4 = 1 THEN concat('EUR ', p_size, '/ sq m') ELSE concat('EUR ', p_size) END"


@query(
    f"WITH t AS (SELECT p_partkey AS id, p_retailprice AS price, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size * 3.5::DOUBLE END AS area, {_RAW} AS raw FROM part) "
    "SELECT id, CASE WHEN id % 4 < 2 THEN round_even(price * area, 2) ELSE price END AS total, CASE WHEN id % 4 < 2 THEN price ELSE round_even(price / area, 2) END AS per_m2 FROM t"
)
def price_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_retailprice AS price", "CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size * CAST(3.5 AS DOUBLE) END AS area", f"{_RAW} AS raw")
    return rows.select("id", prices.normalise(F.col("price"), F.col("area"), F.col("raw")).alias("x")).select("id", "x.*")


@query(
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 < 2 THEN concat(100 + p_size, ' 000 EUR') END AS line, CASE WHEN p_partkey % 3 < 2 THEN (100 + p_size) * 1000.0::DOUBLE END AS value FROM part"
)
def price_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = "CASE p_partkey % 3 WHEN 0 THEN concat('Complex ', p_size, '\\n', 100 + p_size, ' 000 EUR') WHEN 1 THEN concat(' ', 100 + p_size, ' 000 EUR \\n\\nCall us') ELSE concat('1 EUR\\n', p_size, ' EUR') END"
    rows = read(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{block} AS raw")
    line = prices.price_line(F.col("raw"))
    return rows.select("id", line.alias("line"), prices.value_of(line).alias("value"))


@query(
    "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN floor(o_totalprice) + 0.5 WHEN 1 THEN floor(o_totalprice) WHEN 2 THEN floor(o_totalprice) ELSE floor(o_totalprice) + 0.25 END AS value FROM orders"
)
def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.floor("o_totalprice")
    digits = whole.cast("string")
    head, tail = F.substring(digits, F.lit(1), F.length(digits) - 3), F.right(digits, F.lit(3))
    texts = F.when(F.col("id") % 4 == 0, F.concat(F.lit("price "), head, F.lit("."), tail, F.lit(",50 EUR"))).when(F.col("id") % 4 == 1, F.concat(head, F.lit(","), tail)).when(
        F.col("id") % 4 == 2, F.concat(head, F.lit("."), tail, F.lit(" EUR"))
    ).otherwise(F.concat(head, F.lit(" "), tail, F.lit(",25")))
    rows = read(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    return rows.select("id", prices.number(texts).alias("value"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN round_even(floor(o_totalprice) / 1.95583::DOUBLE, 2) ELSE floor(o_totalprice) END AS eur FROM orders")
def bgn_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat(F.floor("o_totalprice").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(" BGN")).otherwise(F.lit(" EUR")))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), prices.money(quoted).alias("eur"))


_TITLE = "array_to_string(list_filter(string_split(trim(regexp_replace(lower({}), '[^a-z0-9_ ]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ('studio', 'flat', 'complex', 'apartment', 'residence') AND NOT regexp_full_match(w, '[0-9]+')), ' ')"


_STUDIO = "concat(p_name, '-', p_brand, ' Studio ', p_size)"


@query(f"SELECT p_partkey AS id, {_TITLE.format(_STUDIO)} AS title_norm FROM part")
def title_norm_latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.title_norm(F.expr(_STUDIO)).alias("title_norm"))


_KEYED = (
    "keyed AS (SELECT *, CASE WHEN (location <> '')::INT + (title <> '')::INT + (bedrooms IS NOT NULL)::INT + (area IS NOT NULL)::INT + (floor IS NOT NULL)::INT < 3 THEN '' ELSE "
    "left(sha1(concat_ws('|', lower(replace(location, '#', ' ')), left(lower(title), 24), coalesce(bedrooms::VARCHAR, ''), coalesce((round_even(area / 5, 0) * 5)::BIGINT::VARCHAR, ''), coalesce(floor::VARCHAR, ''))), 16) END AS dedup_key FROM listings)"
)


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).withColumn("dedup_key", identity.dedup_key(*(F.col(c) for c in ("location", "title", "bedrooms", "area", "floor"))))


@query(f"WITH {LISTINGS_SQL}, {_KEYED} SELECT id, dedup_key FROM keyed")
def dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir).select("id", "dedup_key")


@query(f"WITH {LISTINGS_SQL}, {_KEYED}, {GEO_SQL} SELECT id, CASE WHEN city IS NULL OR dedup_key = '' THEN '' ELSE concat(city, ':', deal, ':', dedup_key) END AS cluster_key FROM keyed LEFT JOIN geo USING (id)")
def cluster_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.with_geography(_keyed(spark, sf_dir), geography(spark, sf_dir))
    return rows.select("id", identity.cluster_key(F.col("city"), F.col("deal"), F.col("dedup_key")).alias("cluster_key"))


@query(
    f"WITH {LISTINGS_SQL}, {GEO_SQL}, k AS (SELECT listings.*, city, left(sha1(concat_ws('|', lower(kind), 'home', bedrooms::VARCHAR, '', '')), 16) AS dedup_key FROM listings JOIN geo USING (id) WHERE bedrooms IS NOT NULL), "
    "pairs AS (SELECT a.id, b.id AS sibling_id, row_number() OVER (PARTITION BY a.id ORDER BY b.first_seen DESC NULLS LAST, b.price ASC NULLS LAST, b.id) AS place FROM k a JOIN k b USING (dedup_key, city, deal) WHERE a.id <> b.id) SELECT id, sibling_id, place::INT AS place FROM pairs WHERE place <= 24"
)
def exact_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = F.lit(None).cast("int")
    key = identity.dedup_key(F.col("kind"), F.lit("Home"), F.col("bedrooms"), nothing, nothing)
    rows = listings(spark, sf_dir).withColumns({"dedup_key": key, "last_seen": F.col("first_seen")})
    return search.siblings(search.with_geography(rows, geography(spark, sf_dir)))


@query(f"WITH {LISTINGS_SQL}, {GEO_SQL} SELECT city, deal, kind, CASE WHEN count(price) > 1 THEN max(price) - min(price) END AS spread, count(*) AS members FROM listings JOIN geo USING (id) GROUP BY city, deal, kind")
def sibling_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.price_spread(listings(spark, sf_dir).join(geography(spark, sf_dir), "id"), ["city", "deal", "kind"])


_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, (length(w) + 2)::BIGINT), lambda i: substring(concat('  ', w, ' '), i, 3)))))"
_SIM = "len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1})))::DOUBLE"


@query(f"WITH n AS (SELECT name, {_GRAMS.format('name')} AS g FROM (SELECT DISTINCT p_name AS name FROM part)) SELECT a.name AS a, b.name AS b, round({_SIM.format('a.g', 'b.g')}, 6) AS sim FROM n a JOIN n b ON a.name < b.name WHERE {_SIM.format('a.g', 'b.g')} >= 0.5")
def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "part").select(F.col("p_name").alias("text")).distinct()
    return fuzzy.similar_texts(names, names, 0.5).where("a < b").select("a", "b", F.round("sim", 6).alias("sim"))


_FUZZY = f"""WITH {LISTINGS_SQL}, o AS (SELECT id, agency_id, id % 3 AS city, kind AS location, deal, bedrooms, area, price, is_active, lower(title) AS t FROM listings WHERE title <> '' AND kind <> ''),
n AS (SELECT t, {_GRAMS.format('t')} AS g FROM (SELECT DISTINCT t FROM o)), s AS (SELECT a.t AS ta, b.t AS tb, {_SIM.format('a.g', 'b.g')} AS sim FROM n a, n b WHERE {_SIM.format('a.g', 'b.g')} >= 0.55),
p AS (SELECT a.id, b.id AS other_id, sim, b.price - a.price AS delta, row_number() OVER (PARTITION BY a.id ORDER BY sim DESC, b.price ASC NULLS LAST, b.id) AS place
FROM o a JOIN o b USING (city, location, deal) JOIN s ON ta = a.t AND tb = b.t
WHERE a.id <> b.id AND a.agency_id <> b.agency_id AND b.is_active AND (a.bedrooms IS NULL OR b.bedrooms IS NULL OR a.bedrooms = b.bedrooms)
AND (a.area IS NULL OR b.area IS NULL OR abs(a.area - b.area) <= 3) AND (a.price IS NULL OR b.price IS NULL OR abs(a.price - b.price) <= a.price * 3.0 / 100))
SELECT id, other_id, place::INT AS place, round_even(sim, 3) AS similarity, delta AS price_delta FROM p WHERE place <= 5"""


@query(_FUZZY)
def fuzzy_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).withColumns({"title_norm": F.lower("title"), "city": F.col("id") % 3, "location": F.col("kind")})
    return fuzzy.also_at(fuzzy.possible_duplicates(rows, rows)).select("id", "other_id", "place", "similarity", "price_delta")


@query(
    f"""WITH {LISTINGS_SQL}, loc AS (SELECT lower(title) AS t, deal AS location, count(*) AS n FROM listings WHERE id % 4 <> 0 GROUP BY ALL), u AS (SELECT id, lower(title) AS t FROM listings WHERE id % 4 = 0),
g AS (SELECT t, {_GRAMS.format('t')} AS g FROM (SELECT t FROM loc UNION SELECT t FROM u)), s AS (SELECT a.t AS ta, b.t AS tb, {_SIM.format('a.g', 'b.g')} AS sim FROM g a, g b WHERE {_SIM.format('a.g', 'b.g')} >= 0.6),
v AS (SELECT ta, location, sum(n)::BIGINT AS votes, max(sim) AS best FROM s JOIN loc ON tb = loc.t GROUP BY ALL),
w AS (SELECT *, votes / sum(votes) OVER (PARTITION BY ta) AS share, row_number() OVER (PARTITION BY ta ORDER BY votes DESC, best DESC, location) AS place FROM v)
SELECT id, location, votes, best FROM u JOIN w ON ta = t WHERE place = 1 AND share >= 0.8 AND (votes >= 2 OR best >= 0.95)"""
)
def corpus_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).withColumn("text", F.lower("title"))
    return fuzzy.corpus_votes(rows.where("id % 4 = 0").select("id", "text"), rows.where("id % 4 <> 0").select("text", F.col("deal").alias("location")))


@query(
    f"""WITH {LIVE_SQL}, {GEO_SQL}, c AS (SELECT l.*, city, neighbourhood FROM live l JOIN geo USING (id) WHERE city_active AND city = (SELECT max(city) FROM geo WHERE city_active) AND deal = 'sale'),
k AS (SELECT *, {any_of('kind', GROUPS['apartment'])} AS apt, ({any_of('kind', GROUPS['apartment'])} OR {any_of('kind', GROUPS['house'])} OR {any_of('kind', GROUPS['land'])}) AS known FROM c),
s AS (SELECT id, first_seen, CASE WHEN known THEN apt END AS a_kind, bedrooms + 1 = 3 AS a_rooms, price <= 990 AND price >= 0 AS a_budget, area >= 20 AS a_area, neighbourhood IN ('Brand#3', 'Brand#9', 'Brand#20') AS a_nb,
CASE WHEN notes = 'no lift, garden' THEN false WHEN notes = 'pool and lift' THEN true END AS a_lift FROM k),
f AS (SELECT * FROM s WHERE coalesce(a_kind, true) AND coalesce(a_rooms, true) AND coalesce(a_budget, true) AND coalesce(a_area, true) AND coalesce(a_nb, true) AND coalesce(a_lift, true)),
r AS (SELECT id, first_seen, 5 + 2 * (a_kind IS NOT NULL)::INT + 3 * (a_rooms IS NOT NULL)::INT + 3 * (a_budget IS NOT NULL)::INT + 2 * (a_area IS NOT NULL)::INT + 3 * (a_nb IS NOT NULL)::INT + (a_lift IS NOT NULL)::INT AS w FROM f)
SELECT id, round_even(w * 100 / 19::DOUBLE, 0)::INT AS confidence, CASE WHEN w = 19 THEN 'verified' ELSE 'unverified' END AS band FROM r ORDER BY confidence DESC, first_seen DESC NULLS LAST, id DESC LIMIT 24"""
)
def buyer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = geography(spark, sf_dir)
    city = places.where("city_active").agg(F.max("city")).first()[0]
    names = {"Brand#3", "Brand#9", "Brand#20"}
    profile = match.validate_profile({"city": city, "rooms": 3, "price_max": 990, "area_min": "20", "neighbourhoods": sorted(names), "features": ["lift"]}, {city}, {city: names})
    offers = search.with_geography(listings(spark, sf_dir), places)
    return match.matches(offers, profile, groups=GROUPS).select("id", "confidence", "band")


@query(f"WITH {LIVE_SQL}, asked(place, id) AS (VALUES (0, 5), (1, 3), (2, 22), (3, 999999999), (4, 13)) SELECT place, id::BIGINT AS id, id IN (SELECT id FROM live) AS available FROM asked")
def wishlist_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.wishlist(listings(spark, sf_dir), [5, 3, 5, 22, 999999999, 13])


@query(
    f"WITH {LISTINGS_SQL} SELECT id, CASE notes WHEN 'no lift, garden' THEN 'garden=true;lift=true' WHEN 'pool and lift' THEN 'lift=true;pool=true;pool_view=true' WHEN 'преди акт 16' THEN 'act16=true' ELSE '' END AS features, CASE notes WHEN 'no lift, garden' THEN false WHEN 'pool and lift' THEN true END::VARCHAR AS wants_lift, CASE WHEN notes = 'преди акт 16' THEN false END::VARCHAR AS wants_act16 FROM listings"
)
def feature_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"title": F.col("title"), "notes": F.col("notes")}
    rows = listings(spark, sf_dir)
    decided = F.array_sort(F.transform(F.map_entries(features.resolve(columns)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return rows.select("id", F.array_join(decided, ";").alias("features"), *(features.requirement(x, columns).cast("string").alias(f"wants_{x}") for x in ("lift", "act16")))


@query("SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'pre_act16' WHEN 1 THEN 'act16' WHEN 2 THEN 'act15' WHEN 3 THEN 'act14' WHEN 4 THEN 'pre_act14' END AS stage, p_partkey % 6 <> 5 OR p_size % 2 = 0 AS new_build FROM part")
def stage_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = "CASE p_partkey % 6 WHEN 0 THEN 'Пред Акт 16' WHEN 1 THEN 'АКТ-16 готов' WHEN 2 THEN 'има акт 15' WHEN 3 THEN 'Акт14' WHEN 4 THEN 'пред акт 14 и акт 15' ELSE CASE WHEN p_size % 2 = 0 THEN 'Off-plan' ELSE 'панелен' END END"
    rows = read(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{note} AS t")
    return rows.select("id", taxonomy.stage_of(F.col("t")).alias("stage"), taxonomy.is_new_build(F.col("t")).alias("new_build"))


# Two words of each benchmark text are the aliases; documents are whole, in all their languages.
@query(
    """WITH alias AS (SELECT item_id AS place, trim(lower(array_to_string(list_slice(string_split(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), ' '), 1, 2), ' '))) AS alias FROM benchmark),
d AS (SELECT doc_id AS id, ' ' || trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), '([a-z])([0-9])|([0-9])([a-z])', '\\1\\3 \\2\\4', 'g')) || ' ' AS t FROM documents),
c AS (SELECT DISTINCT id, alias, place FROM d JOIN alias ON contains(t, ' ' || alias || ' ') WHERE alias <> '')
SELECT id, alias, place FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.id = c.id AND o.alias <> c.alias AND contains(' ' || o.alias || ' ', ' ' || c.alias || ' '))"""
)
def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.array_join(F.slice(F.split(F.regexp_replace("text", "[^A-Za-z]+", " "), " "), 1, 2), " ")
    aliases = read(spark, sf_dir, "benchmark").select(F.trim(F.lower(head)).alias("alias"), F.col("item_id").alias("place")).where("alias <> ''")
    docs = read(spark, sf_dir, "documents")
    return geo.alias_matches(docs.select(F.col("doc_id").alias("id"), text.geo_norm(F.col("text")).alias("text")), aliases, 2)


@query("WITH chosen AS (SELECT n_name FROM nation WHERE n_nationkey IN (3, 11)) SELECT n_name AS place FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation WHERE n_name IN (SELECT n_name FROM chosen)) AND n_name NOT IN (SELECT n_name FROM chosen)")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    chosen = nation.where("n_nationkey IN (3, 11)").select(F.col("n_name").alias("place"))
    return geo.adjacent_to(chosen, nation.select(F.col("n_regionkey").alias("cluster"), F.col("n_name").alias("place")))


@query("SELECT p_partkey AS id, concat('web', left(sha1(concat('https://homes.example/', p_partkey)), 13)) AS fingerprint FROM part")
def web_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), identity.web_fingerprint(F.expr("concat('https://homes.example/', p_partkey)")).alias("fingerprint"))


@query(f"WITH {LIVE_SQL}, {GEO_SQL} SELECT count(*) AS n, sum(round(price / area))::BIGINT AS rates FROM live JOIN geo USING (id) WHERE city_active")
def city_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.with_geography(search.live(listings(spark, sf_dir)), geography(spark, sf_dir)).where("city_active")
    rate = search.shown_rate(F.col("price"), F.col("area"), F.lit(None).cast("double"))
    return rows.agg(F.count("*").alias("n"), F.sum(rate).alias("rates"))
