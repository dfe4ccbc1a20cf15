"""Matching listings to a buyer's profile: weighted three-valued checks, explained."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features, taxonomy
from .search import PER_PAGE, live

# Labels of features that a profile may ask for.
LABELS = {"lift": "Асансьор", "parking": "Паркомясто", "garden": "Двор / градина", "furnished": "Обзаведен", "act16": "Готов за живеене (Акт 16)"}
WEIGHTS = {"city": 3, "deal": 2, "kind": 2, "rooms": 3, "budget": 3, "area": 2, "neighbourhood": 3, "feature": 1, "pets": 2}
NOT_HOMES = r"(?iu)гараж|паркомясто|склад|garage|parking|warehouse"
MANY_ROOMS = r"(?iu)четиристаен|петстаен|\d[- ]?стаен"
BOUNDS = (("rooms", 10), ("price_min", 100_000_000), ("price_max", 100_000_000), ("area_min", 100_000))


class ProfileError(ValueError):
    """A profile that must not be widened into a search."""


def validate_profile(value: dict, cities: set[str], neighbourhoods: dict[str, set[str]]) -> dict:
    """The checked profile, or ProfileError. Runs on the driver; a profile is a few values."""
    if not isinstance(value, dict) or value.get("city") not in cities:
        raise ProfileError("city")
    out = {"city": value["city"], "deal": value.get("deal", "sale"), "kind": value.get("kind", "apartment"), "pets": value.get("pets", "none")}
    if out["deal"] not in ("sale", "rent") or out["kind"] not in ("apartment", "house") or out["pets"] not in ("none", "cat", "dog", "other"):
        raise ProfileError("choice")
    for key, most in BOUNDS:
        given = value.get(key)
        if given in (None, ""):
            out[key] = None
            continue
        if isinstance(given, bool) or not re.fullmatch(r"\d{1,9}", str(given)) or int(given) > most or (key == "rooms" and int(given) < 1):
            raise ProfileError(key)
        out[key] = int(given)
    if None not in (out["price_min"], out["price_max"]) and out["price_min"] > out["price_max"]:
        raise ProfileError("price")
    for key, allowed in (("neighbourhoods", neighbourhoods.get(value["city"], set())), ("features", set(LABELS))):
        items = value.get(key, [])
        if not isinstance(items, list) or len(items) > 100 or any(not isinstance(x, str) or x not in allowed for x in items):
            raise ProfileError(key)
        out[key] = list(dict.fromkeys(items))
    return out


def checks(profile: dict, has: set[str], groups: dict | None = None) -> list[tuple[str, Column, int]]:
    """(label, answer, weight) of a profile; an answer is true, false or null. has: the listing's columns."""
    groups = groups or taxonomy.KIND_GROUPS
    kind = F.lower(F.coalesce("kind", F.lit("")))
    in_group = {g: taxonomy.any_token(kind, tokens) for g, tokens in groups.items()}
    in_group["apartment"] = in_group.get("apartment", F.lit(False)) | kind.rlike(MANY_ROOMS)
    some = reduce(lambda a, b: a | b, in_group.values())
    out = [("city", F.lit(True), WEIGHTS["city"]), ("deal", F.lit(True), WEIGHTS["deal"])]
    out.append(("kind", F.when(some, in_group[profile["kind"]]), WEIGHTS["kind"]))
    if profile.get("rooms") is not None:
        out.append((f"rooms {profile['rooms']}", taxonomy.rooms_of(F.col("kind"), F.col("bedrooms")) == profile["rooms"], WEIGHTS["rooms"]))
    low, high = profile.get("price_min"), profile.get("price_max")
    if low is not None or high is not None:
        out.append(("budget", (F.col("price") >= (low if low is not None else 0)) & (F.col("price") <= (high if high is not None else 1e18)), WEIGHTS["budget"]))
    if profile.get("area_min") is not None:
        out.append(("area", F.col("area") >= profile["area_min"], WEIGHTS["area"]))
    if profile.get("neighbourhoods"):
        out.append(("neighbourhood", F.col("neighbourhood").isin(profile["neighbourhoods"]), WEIGHTS["neighbourhood"]))
    columns = {c: F.col(c) for c in ("title", "notes", "documents", "status", "ready_date", "furnished") if c in has}
    for token in profile.get("features", ()):
        out.append((LABELS[token], features.requirement(token, columns), WEIGHTS["feature"]))
    if profile.get("pets", "none") != "none" and profile["deal"] == "rent":
        out.append(("pets", features.pets_allowed(F.col("title"), F.col("notes") if "notes" in has else F.lit("")), WEIGHTS["pets"]))
    return out


def score(offers: DataFrame, profile: dict, groups: dict | None = None) -> DataFrame:
    """Listings that contradict nothing, with confidence (percent of weight that is known), band, reasons and unknown. Kinds
    that are no homes do not pass as unknown ones. One projection over the scanned rows; nothing is collected."""
    rows = checks(profile, set(offers.columns), groups)
    kind = F.lower(F.coalesce("kind", F.lit("")))
    known_kind = reduce(lambda a, b: a | b, (taxonomy.any_token(kind, t) for t in (groups or taxonomy.KIND_GROUPS).values())) | kind.rlike(MANY_ROOMS)
    every = F.array(*(F.struct(F.lit(n).alias("label"), a.cast("boolean").alias("answer"), F.lit(w).alias("weight")) for n, a, w in rows))
    total = sum(w for _, _, w in rows)
    labels = lambda keep: F.transform(F.filter("checks", keep), lambda c: c["label"])
    weight = F.aggregate(F.filter("checks", lambda c: c["answer"].isNotNull()), F.lit(0), lambda n, c: n + c["weight"])
    return (
        offers.where(~(~known_kind & kind.rlike(NOT_HOMES)))
        .withColumn("checks", every)
        .where(~F.exists("checks", lambda c: F.coalesce(~c["answer"], F.lit(False))))
        .withColumns(
            {
                "confidence": F.bround(weight * 100 / total, 0).cast("int"),
                "band": F.when(weight == total, "verified").otherwise("unverified"),
                "reasons": labels(lambda c: F.coalesce(c["answer"], F.lit(False))),
                "unknown": labels(lambda c: c["answer"].isNull()),
            }
        )
        .drop("checks")
    )


def matches(offers: DataFrame, profile: dict, page: int = 1, per_page: int = PER_PAGE, groups: dict | None = None) -> DataFrame:
    """A page of scored listings in the profile's city and deal: by confidence, then newest. Pages past the end are empty."""
    scope = live(offers).where((F.col("city") == profile["city"]) & F.col("city_active") & (F.col("deal") == profile["deal"]))
    order = [F.desc("confidence"), F.desc_nulls_last("first_seen"), F.desc("id")]
    return score(scope, profile, groups).orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def wishlist(offers: DataFrame, ids: list[int]) -> DataFrame:
    """(place, id, available) of the distinct ids in the order asked for; available ones are live."""
    if len(ids) > 200 or any(isinstance(i, bool) or not isinstance(i, int) or not 1 <= i < 2**63 for i in ids):
        raise ProfileError("ids")
    wanted = offers.sparkSession.range(1).select(F.posexplode(F.array(*(F.lit(i).cast("long") for i in dict.fromkeys(ids)))).alias("place", "id"))
    found = live(offers).select("id", F.lit(True).alias("available"))
    return wanted.join(found, "id", "left").select("place", "id", F.coalesce("available", F.lit(False)).alias("available"))
