"""Batch jobs as plain functions over DataFrames: each returns what it would change, and the caller writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity, prices
from ..functions.text import fold, is_distinctive, title_norm, undo_lookalikes
from ..operators import fuzzy, geo, latest, merge, recon, report
from ..operators.lineage import cut
from ..sources import html

# Words of titles that do not name a place.
GENERIC = ("apartament", "studio", "kompleks", "rezidens", "apartment", "complex", "residence", "kashta", "parcel", "taunkhaus", "pentkhaus")
NOTE_LIMIT = 4000


def conform_sheet(rows: DataFrame) -> DataFrame:
    """Sheet rows as listings: typed, with title_norm and dedup_key; values that cannot be read are null."""
    money = {c: F.col(c).cast("string").try_cast("decimal(20,6)") for c in ("price_eur", "area_m2", "commission_value", "maintenance_eur") if c in rows.columns}
    half_even = {c: F.bround(x, 2).cast("decimal(12,2)") for c, x in money.items()}
    whole = {c: F.col(c).cast("string").try_cast("int") for c in ("bedrooms", "floor") if c in rows.columns}
    out = rows.withColumns(half_even | whole)
    deal = F.when(F.coalesce("deal_type", F.lit("")) == "", "sale").otherwise(F.col("deal_type"))
    key = identity.dedup_key(F.col("location"), F.col("title"), F.col("bedrooms"), F.col("area_m2"), F.col("floor"))
    return out.withColumns({"title_norm": F.left(title_norm(F.col("title")), F.lit(400)), "dedup_key": key, "deal_type": deal})


def sync_sheets(state: DataFrame, rows: DataFrame, run_date: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, history, counts) after the sheets of the agencies that rows has; other agencies' rows stay out of it."""
    keys = ["agency_id", "fingerprint"]
    incoming = merge.first_rows(rows, keys, "source_row")
    read = incoming.select("agency_id").distinct()
    own = state.join(read, "agency_id", "left_semi")
    claimed = merge.rekeyed(own, incoming, ["agency_id"], "fingerprint", "weak_core")
    moved = claimed.where("old_key IS NOT NULL").select("agency_id", F.col("old_key").alias("fingerprint"), F.col("fingerprint").alias("new_key"))
    own = own.join(moved, keys, "left").withColumn("fingerprint", F.coalesce("new_key", "fingerprint")).drop("new_key")
    tracked = [c for c in merge.SHEET_TRACKED if c in rows.columns and c in state.columns]
    merged = merge.merge(own, claimed.drop("old_key"), keys, tracked, run_date, merge.SHEET, "price_eur" if "price_eur" in tracked else None)
    counts = merge.sync_counts(merged, ["agency_id"]).unionByName(moved.groupBy("agency_id").agg(F.lit("rekeyed").alias("outcome"), F.count("*").alias("n")))
    return merged, merge.history(merged, keys, run_date), counts


def store_web(state: DataFrame, records: DataFrame, run_date: Column) -> tuple[DataFrame, DataFrame]:
    """(state, history) after crawled records (url is the identity). Sold pages deactivate what is stored, which is then sold
    as of this run, and enter no history."""
    live, sold = merge.drop_sold(records.withColumn("fingerprint", identity.web_fingerprint(F.col("url"))))
    tracked = [c for c in merge.WEB_TRACKED if c in records.columns and c in state.columns]
    merged = merge.merge(state, live, ["fingerprint"], tracked, run_date, merge.WEB, "price_eur" if "price_eur" in tracked else None)
    marks = merged.join(sold.select("fingerprint", F.lit(True).alias("__sold")).distinct(), "fingerprint", "left")
    gone = F.col("__sold").isNotNull() & F.col("is_active")
    new = {"last_changed": F.when(gone, run_date).otherwise(F.col("last_changed")), "is_active": F.col("is_active") & ~gone}
    if "status" in merged.columns:
        new["status"] = F.when(gone, F.lit("sold")).otherwise(F.col("status"))
    return marks.withColumns(new).drop("__sold"), merge.history(merged, ["fingerprint"], run_date, merge.WEB)


def store_verified(state: DataFrame, records: DataFrame, run_date: Column, path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, history, ambiguous) after records of a verified source (offer_id of a new row is its fingerprint). A record
    replaces the one stored row that its reference or address fits; one that fits several changes nothing and comes back
    in ambiguous. Missing values keep what is stored, and rates and keys follow from the values that are kept."""
    fits = merge.single_matches(records.select("ref", F.col("listing_url").alias("url")), state.select("offer_id", "ref", F.col("listing_url").alias("url")), path)
    named = records.join(fits, "ref", "left")
    ambiguous = named.where("ambiguous").drop("offer_id", "ambiguous")
    fresh = named.where("NOT coalesce(ambiguous, false)").withColumn("offer_id", F.coalesce("offer_id", identity.web_fingerprint(F.col("listing_url")))).drop("ambiguous")
    tracked = [c for c in records.columns if c in state.columns and c != "offer_id"]
    merged = merge.merge(state, fresh.select("offer_id", *tracked), ["offer_id"], tracked, run_date, merge.VERIFIED, "price_eur")
    derived = {}
    if {"price_eur", "area_m2"} <= set(tracked):
        derived["price_per_m2"] = F.bround(F.try_divide(F.col("price_eur").cast("double"), F.when(F.col("area_m2") != 0, F.col("area_m2")).cast("double")), 2)
    if {"location", "title", "bedrooms", "area_m2", "floor"} <= set(tracked):
        derived["dedup_key"] = identity.dedup_key(*(F.col(c) for c in ("location", "title", "bedrooms", "area_m2", "floor")))
    return merged.withColumns(derived) if derived else merged, merge.history(merged, ["offer_id"], run_date, merge.VERIFIED), ambiguous


def reextract(snapshots: DataFrame) -> DataFrame:
    """Records from stored pages (url, html), without the network."""
    return html.extract(snapshots)


def verify(offers: DataFrame, statuses: DataFrame, today: Column) -> DataFrame:
    """(url, verdict, is_active, last_seen) from page statuses; only 404 and 410 withdraw."""
    seen = offers.join(statuses, "url", "left").withColumn("verdict", recon.liveness(F.col("status")))
    active = F.when(F.col("verdict") == "withdrawn", F.lit(False)).otherwise(F.col("is_active"))
    return seen.select("url", "verdict", active.alias("is_active"), F.when(F.col("verdict") == "alive", today).otherwise(F.col("last_seen")).alias("last_seen"))


def fix_prices(offers: DataFrame) -> DataFrame:
    """(id, price, price_per_m2, notes) of listings whose quoted text is a rate that is stored as a total."""
    new = prices.normalise(F.col("price"), F.col("area"), F.col("price_raw"))
    note = F.left(F.trim(F.concat(F.coalesce("notes", F.lit("")), F.lit("\n"), F.lit("price: rate per m2, total derived"))), F.lit(NOTE_LIMIT))
    wrong = prices.is_per_m2(F.col("price_raw")) & F.col("price").isNotNull() & (F.col("price_per_m2").isNull() | (F.col("price_per_m2") != F.col("price")))
    return offers.where(wrong).select("id", new["total"].alias("price"), new["per_m2"].alias("price_per_m2"), note.alias("notes"))


def fix_split_prices(offers: DataFrame) -> DataFrame:
    """(id, price) where the one priced line of a block says less than what is stored."""
    value = prices.value_of(prices.price_line(F.col("price_raw")))
    return offers.select("id", "price", value.alias("new")).where(F.col("new") < F.col("price")).select("id", F.col("new").alias("price"))


def salvage_locations(offers: DataFrame, vocabulary: list[tuple[str, str]]) -> DataFrame:
    """(id, location, source): corpus vote, then look-alikes undone, then the sheet's tab; one pass over stored rows.
    vocabulary: (folded alias, name)."""
    missing = offers.where(F.coalesce("location", F.lit("")) == "")
    fit = missing.where(is_distinctive(F.col("title"), GENERIC))
    voted = fuzzy.corpus_votes(fit.select("id", F.col("title_norm").alias("text")), offers.where("location <> ''").select(F.col("title_norm").alias("text"), "location"))
    reread = geo.first_longest_alias(fold(undo_lookalikes(F.concat_ws(" ", "location_raw", "title", "notes"))), vocabulary)
    tab = geo.first_longest_alias(fold(F.col("source_tab")), vocabulary)
    joined = missing.join(voted.select("id", F.col("location").alias("voted")), "id", "left")
    found = joined.select("id", F.coalesce("voted", reread, tab).alias("location"), F.when(F.col("voted").isNotNull(), "corpus").when(reread.isNotNull(), "reread").otherwise("tab").alias("source"))
    return found.where("location IS NOT NULL")


def salvage_to_fixpoint(offers: DataFrame, vocabulary: list[tuple[str, str]], rounds: int = 5) -> DataFrame:
    """offers with locations filled in, recovered rows serving as evidence for the next round."""
    for _ in range(rounds):
        found = cut(salvage_locations(offers, vocabulary).select("id", F.col("location").alias("__found")))
        if not found.head(1):
            break
        offers = offers.join(found, "id", "left").withColumn("location", F.coalesce(F.nullif("location", F.lit("")), "__found", F.lit(""))).drop("__found")
    return offers


def seed_agencies(registry: DataFrame, probes: DataFrame) -> DataFrame:
    """Registry rows with their latest probe."""
    last = latest.latest_probe(probes).select(F.col("agency_slug").alias("slug"), "status", "listing_pattern", "listing_count")
    return registry.join(last, "slug", "left")


def crawl_reports(offers: DataFrame, trace: DataFrame, fields: list[str], outcomes: list[str]) -> dict[str, DataFrame]:
    """The reports of a run."""
    return {"report": report.crawl_report(trace, fields, outcomes), "totals": report.run_totals(trace), "quality": report.fill_rates(offers, ["price", "area", "location"])}


Step = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]
#: The order of a run: who is on the market, their sheets, their sites, then what is only known afterwards.
STEPS = ("registry", "sheets", "sites", "locations", "rematch")


def crawl_all(tables: dict[str, DataFrame], steps: dict[str, Step], skip: tuple[str, ...] = ()) -> tuple[dict[str, DataFrame], list[str]]:
    """(tables, names of the steps that ran): each step gets all tables as the steps before it left them, and returns those that
    it replaces. Steps run in the order of STEPS; ones that are not given or to be skipped are left out; an unknown name is
    an error, and so is one that a step raises: what follows would rest on half a run."""
    if unknown := set(steps) - set(STEPS):
        raise ValueError(f"unknown steps {sorted(unknown)}; known ones are {STEPS}")
    ran = []
    for name in STEPS:
        if name in steps and name not in skip:
            tables = {**tables, **steps[name](tables)}
            ran.append(name)
    return tables, ran


def vendor_check(recorded: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest against files (path, content)."""
    return merge.manifest_compare(recorded, files.select("path", F.left(F.sha2("content", 256), F.lit(16)).alias("digest")))
