"""The read API as functions: one per endpoint, each lazy until its page. No server is included.

`Market` bundles the frames that every endpoint reads; arguments are those of the endpoints, by name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import facets, match, search


class NotFound(LookupError):
    """Outside the scope that was asked for, or not there."""


class BadRequest(ValueError):
    """A parameter that must be given was not."""


@dataclass
class Market:
    """offers (with geography joined: city, city_active, neighbourhood), images, agencies, places (city, slug, name_bg, name_en,
    active) and city_names (slug, name_bg, name_en, active)."""

    offers: DataFrame
    images: DataFrame
    agencies: DataFrame
    places: DataFrame
    city_names: DataFrame

    def scoped(self, offers: DataFrame, city: str | None = None, neighbourhood: str | None = None) -> DataFrame:
        return search.neighbourhood_scope(search.city_scope(offers, city), city, neighbourhood, self.places.select("city", "slug", "active"))


def cities(market: Market) -> DataFrame:
    return market.city_names.where("active").select("slug", "name_bg", "name_en")


def neighbourhoods(market: Market, city: str | None = None) -> DataFrame:
    if not city:
        raise BadRequest("city")
    active = market.city_names.where("active").select(F.col("slug").alias("city"))
    return market.places.where((F.col("city") == city) & F.col("active")).join(active, "city", "left_semi").select("slug", "name_bg", "name_en")


def offers(market: Market, **params) -> dict:
    return search.search(market.offers, params, market.images, market.places.select("city", "slug", "active"))


def offer_detail(market: Market, pk: int, city: str | None = None, neighbourhood: str | None = None) -> dict:
    """offer (one row), siblings (up to a page), spread, images (in order)."""
    live = search.live(market.offers)
    row = market.scoped(live, city, neighbourhood).where(F.col("id") == pk)
    found = row.head(1)
    if not found:
        raise NotFound(pk)
    key = found[0]["dedup_key"] if "dedup_key" in row.columns else None
    same = F.lit(bool(key)) & (F.col("dedup_key") == (key or "")) & (F.col("city") == found[0]["city"]) & (F.col("deal") == found[0]["deal"]) & (F.col("id") != pk)
    others = live.where(same).orderBy(F.desc_nulls_last("last_seen"), F.asc_nulls_last("price"), "id").limit(search.PER_PAGE)
    members = row.select("price").unionByName(others.select("price"))
    known = F.when(F.col("price") != 0, F.col("price"))
    spread = members.agg(F.when(F.count(known) > 1, F.max(known) - F.min(known))).first()[0]
    pictures = market.images.where(F.col("offer_id") == pk).orderBy("position", "image_id")
    return {"offer": search.serialise(row), "siblings": search.serialise(others), "spread": spread, "images": [r["local_path"] for r in pictures.collect()]}


def facet_summary(market: Market, deal: str = "sale", city: str | None = None, neighbourhood: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(counts, agencies) of the scope; the search's other filters are left out."""
    scoped = market.scoped(search.live(market.offers), city, neighbourhood)
    return facets.facet_counts(scoped, deal), facets.facet_agencies(scoped, market.agencies, deal)


def agencies(market: Market, city: str | None = None, neighbourhood: str | None = None) -> DataFrame:
    return facets.agency_directory(market.scoped(market.offers.where("is_active"), city, neighbourhood), market.agencies)


def stats(market: Market, city: str | None = None, neighbourhood: str | None = None) -> DataFrame:
    return facets.market_stats(market.scoped(market.offers.where("is_active"), city, neighbourhood), market.images)


def buyer_options() -> list[dict]:
    return [{"key": k, "label": v} for k, v in match.LABELS.items()]


def buyer_matches(market: Market, profile: dict, page: int = 1) -> dict:
    """results (a page of cards with confidence, band, reasons, unknown), total, page, per_page, city."""
    if isinstance(page, bool) or not isinstance(page, int) or page < 1:
        raise BadRequest("page")
    active = {r[0] for r in cities(market).select("slug").collect()}
    city = profile.get("city") if isinstance(profile, dict) else None
    known = {city: {r[0] for r in market.places.where((F.col("city") == city) & F.col("active")).select("slug").collect()}} if city in active else {}
    checked = match.validate_profile(profile, active, known)
    scope = search.live(market.offers).where((F.col("city") == checked["city"]) & F.col("city_active") & (F.col("deal") == checked["deal"]))
    total = match.score(scope, checked).count()
    return {"results": search.serialise(match.matches(market.offers, checked, page)), "total": total, "page": page, "per_page": search.PER_PAGE, "city": checked["city"]}


def buyer_wishlist(market: Market, ids: list[int]) -> dict:
    """results (cards in the order asked for) and unavailable (ids)."""
    asked = match.wishlist(market.offers, ids)
    cards = search.serialise(search.live(market.offers)).join(asked.where("available"), "id").orderBy("place")
    return {"results": cards, "unavailable": [r["id"] for r in asked.where("NOT available").orderBy("place").collect()]}
