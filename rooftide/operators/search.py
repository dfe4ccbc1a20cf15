"""Faceted search over listings. A missing value never removes a listing; it lowers its confidence.

Listings carry: id, agency_id, title, notes, kind, price, price_per_m2, area, bedrooms, floor, location, deal, is_active,
url, first_seen, dedup_key and, joined from geography, city, city_active, neighbourhood. Whatever a frame lacks is simply
not filtered or served. All of it is lazy: counts, pages and facets share one plan until an action.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import taxonomy
from ..functions.identity import cluster_key

PER_PAGE = 24
#: name -> (column, descending); nulls are last either way, ties go to the larger id.
SORTS = {
    "newest": ("first_seen", True),
    "price_asc": ("price", False),
    "price_desc": ("price", True),
    "area_desc": ("area", True),
    "sqm_asc": ("price_per_m2", False),
}


def live(offers: DataFrame) -> DataFrame:
    return offers.where(F.col("is_active") & (F.col("url") != ""))


def with_geography(offers: DataFrame, geo: DataFrame) -> DataFrame:
    """geo: one row per listing id with city, city_active, neighbourhood; listings without one stay."""
    return offers.join(geo, "id", "left")


def city_scope(offers: DataFrame, city: str | None) -> DataFrame:
    """Only an active city counts; an unknown one gives nothing."""
    return offers if not city else offers.where((F.col("city") == city) & F.col("city_active"))


def neighbourhood_scope(offers: DataFrame, city: str | None, neighbourhood: str | None, known: DataFrame | None = None) -> DataFrame:
    """The neighbourhood's listings and those of the city without one. It needs a city and, where known (city, slug, active)
    is given, an active entry there; else nothing."""
    if not neighbourhood:
        return offers
    if not city:
        return offers.where(F.lit(False))
    out = offers.where((F.col("neighbourhood") == neighbourhood) | F.col("neighbourhood").isNull())
    if known is None:
        return out
    entry = known.where((F.col("city") == city) & (F.col("slug") == neighbourhood) & F.col("active")).select(F.col("city").alias("city"))
    return out.join(entry.distinct(), "city", "left_semi")


def at_least(column: str, low) -> Column:
    return (F.col(column) >= low) | F.col(column).isNull()


def at_most(column: str, high) -> Column:
    return (F.col(column) <= high) | F.col(column).isNull()


def text_filter(query: str) -> Column:
    """Literal, case-insensitive substring of title or location."""
    low = F.lower(F.lit(query))
    return F.contains(F.lower("title"), low) | F.contains(F.lower("location"), low)


def whole_number(value) -> int | None:
    """Bounds that are no plain digits are ignored."""
    return int(value) if value is not None and str(value).isdigit() else None


def filtered(offers: DataFrame, params: dict, images: DataFrame | None = None, groups: dict | None = None) -> DataFrame:
    """All filters but scope. params: deal, q, kind, price_min, price_max, area_min, area_max, beds, agency, with_photo,
    build."""
    groups = groups or taxonomy.KIND_GROUPS
    rules = [F.col("deal") == (params.get("deal") or "sale")]
    if query := (params.get("q") or "").strip():
        rules.append(text_filter(query))
    if params.get("kind") in groups:
        rules.append(taxonomy.kind_clause(params["kind"], F.col("kind"), F.col("title"), groups))
    for column in ("price", "area"):
        low, high = whole_number(params.get(f"{column}_min")), whole_number(params.get(f"{column}_max"))
        rules += [at_least(column, low)] if low is not None else []
        rules += [at_most(column, high)] if high is not None else []
    if (beds := whole_number(params.get("beds"))) is not None:
        rules.append(at_least("bedrooms", beds))
    if params.get("agency"):
        rules.append(F.col("agency_slug") == params["agency"])
    if params.get("build") in ("new", "resale"):
        new = taxonomy.new_build_clause(F.col("title"), F.col("notes"))
        rules.append(new if params["build"] == "new" else ~new)
    out = offers.where(reduce(lambda a, b: a & b, rules))
    if params.get("with_photo") in ("1", "true", True) and images is not None:
        out = out.join(images.select(F.col("offer_id").alias("id")), "id", "left_semi")
    return out


def order_by(sort: str | None) -> list[Column]:
    column, down = SORTS.get(sort or "newest", SORTS["newest"])
    return [F.desc_nulls_last(column) if down else F.asc_nulls_last(column), F.desc("id")]


def legacy_price_sort(offers: DataFrame, sort: str) -> DataFrame:
    """The older listing view: ascending sorts leave out what has no value."""
    return offers.where(F.col(SORTS[sort][0]).isNotNull()) if sort in ("price_asc", "sqm_asc") else offers


def clamp_page(page, total: int, per_page: int = PER_PAGE) -> int:
    try:
        wanted = max(1, int(page or 1))
    except ValueError:
        wanted = 1
    return min(wanted, max(1, -(-total // per_page)))


def page_of(offers: DataFrame, sort: str | None = None, page: int = 1, per_page: int = PER_PAGE) -> DataFrame:
    """A top-k plan: only the page's rows leave the sort."""
    return offers.orderBy(*order_by(sort)).offset((page - 1) * per_page).limit(per_page)


def search(offers: DataFrame, params: dict, images: DataFrame | None = None, neighbourhoods: DataFrame | None = None) -> dict:
    """results (a DataFrame of the page), total, page, per_page, sort, deal. One count, then the page."""
    scoped = neighbourhood_scope(city_scope(live(offers), params.get("city")), params.get("city"), params.get("neighbourhood"), neighbourhoods)
    found = filtered(scoped, params, images)
    total = found.count()
    page = clamp_page(params.get("page"), total)
    sort = params.get("sort") if params.get("sort") in SORTS else "newest"
    return {"results": serialise(page_of(found, sort, page)), "total": total, "page": page, "per_page": PER_PAGE, "sort": sort, "deal": params.get("deal") or "sale"}


def first_image(images: DataFrame) -> DataFrame:
    """(id, image): each listing's image of least (position, id), pre-aggregated before the shuffle."""
    return images.groupBy(F.col("offer_id").alias("id")).agg(F.min_by("local_path", F.struct("position", "image_id")).alias("image"))


KNOWN = ("price", "area", "bedrooms", "floor", "location")


def known_share() -> Column:
    present = [F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in KNOWN]
    return F.bround(sum(p.cast("int") for p in present) / len(KNOWN), 2)


def missing() -> Column:
    """Names of the first four facts that are null."""
    names = {"price": "price_eur", "area": "area_m2", "bedrooms": "bedrooms", "floor": "floor"}
    return F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(n)) for c, n in names.items())))


def serialise(offers: DataFrame) -> DataFrame:
    """The listing card: derived columns are added only to the rows that are asked for."""
    text = F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in ("title", "notes", "location") if c in offers.columns))
    add = {"confidence": known_share(), "missing": missing(), "new_build": taxonomy.is_new_build(text), "stage": taxonomy.stage_label(text)}
    if {"city", "dedup_key"} <= set(offers.columns):
        add["cluster_key"] = cluster_key(F.col("city"), F.col("deal"), F.col("dedup_key"))
    out = offers.withColumns(add)
    return out.withColumns({c: F.when(F.col(c) != 0, F.col(c)) for c in ("price", "price_per_m2", "area") if c in offers.columns})


def price_spread(members: DataFrame, keys: list[str], price: str = "price") -> DataFrame:
    """Range of known prices in each group; null with fewer than two."""
    known = F.when(F.col(price) != 0, F.col(price))
    return members.groupBy(*keys).agg(F.when(F.count(known) > 1, F.max(known) - F.min(known)).alias("spread"), F.count("*").alias("members"))


def siblings(offers: DataFrame, limit: int = PER_PAGE) -> DataFrame:
    """Pairs (id, sibling_id, place): other listings of the same cluster, newest first, then cheapest; at most limit each
    (the page of a detail view). Clusters are small by nature; a listing without key or city has none."""
    keyed = offers.where((F.coalesce("dedup_key", F.lit("")) != "") & F.col("city").isNotNull())
    keys = ["dedup_key", "city", "deal"]
    ranked = Window.partitionBy(keys).orderBy(F.desc_nulls_last("last_seen"), F.asc_nulls_last("price"), "id")
    other = keyed.select(*keys, F.col("id").alias("sibling_id"), F.row_number().over(ranked).alias("place")).where(F.col("place") <= limit + 1)
    pairs = keyed.select(*keys, "id").join(other, keys).where("id <> sibling_id")
    again = Window.partitionBy("id").orderBy("place")
    return pairs.withColumn("place", F.row_number().over(again)).where(F.col("place") <= limit).select("id", "sibling_id", "place")


def shown_rate(price: Column, area: Column, stored: Column) -> Column:
    """The rate on a card: the stored one, else price by area, in whole euros."""
    return F.round(F.coalesce(F.when(stored != 0, stored), F.try_divide(price, F.when(area != 0, area)))).cast("long")
