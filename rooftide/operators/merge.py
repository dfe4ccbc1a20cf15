"""Reconciling a snapshot with the stored state: one full outer join, typed comparison, long history.

`merge` covers the three ways of keeping a source: price sheets (overwrite, new and removed rows enter the history, weak
rekeying), crawled pages (overwrite, new rows do not), and verified sources (a missing value keeps the last good
one, returns are recorded). Classification uses null-safe equality only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a price sheet tracks.
SHEET_TRACKED = (
    "price_eur", "status", "commission_value", "commission_raw", "maintenance_eur", "area_m2", "floor", "bedrooms", "title",
    "location", "view", "furnished", "documents", "notes", "photos_url",
)
WEB_TRACKED = ("price_eur", "bedrooms", "area_m2", "floor", "title", "location", "property_kind", "deal_type", "status")
LEAST_SHARE = 0.5


@dataclass(frozen=True)
class Policy:
    retain_last_good: bool = False
    emit_new: bool = True
    emit_returned: bool = False
    retire_missing: bool = True


SHEET, WEB, VERIFIED = Policy(), Policy(emit_new=False, retire_missing=False), Policy(True, True, True, False)


def differs(a: Column, b: Column, kind: str) -> Column:
    """Null-safe; floating numbers within 1e-9 are equal."""
    if kind in ("double", "float"):
        return F.coalesce(F.abs(a - b) > 1e-9, ~a.eqNullSafe(b))
    return ~a.eqNullSafe(b)


def rendered(value: Column, kind: str) -> Column:
    """A value as history shows it: flags as 1 and 0, whole numbers without a fraction, null as ''."""
    if kind == "boolean":
        text = value.cast("int").cast("string")
    elif kind in ("double", "float") or kind.startswith("decimal"):
        plain = F.regexp_replace(value.cast("decimal(38,9)").cast("string"), r"(\.\d*?)0+$", "$1")
        text = F.regexp_replace(plain, r"\.$", "")
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


def first_rows(incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A key listed twice counts once, where it stands first; rows without a key do not count. min_by combines before
    the shuffle, so a key repeated without end costs a row for each task."""
    rest = [c for c in incoming.columns if c not in keys]
    kept = incoming.where(F.col(keys[-1]).isNotNull() & (F.col(keys[-1]).cast("string") != ""))
    return kept.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")


def rekeyed(state: DataFrame, incoming: DataFrame, scope: list[str], key: str, weak: str) -> DataFrame:
    """incoming with one more column, old_key: for a new row, the one active stored row of the same weak core that no
    incoming row claims; several candidates, or several claims on one, are ambiguous and give none."""
    known = state.select(*scope, key)
    unclaimed = state.where(F.col("is_active") & (F.coalesce(weak, F.lit("")) != "")).join(incoming.select(*scope, key), [*scope, key], "left_anti")
    single = unclaimed.groupBy(*scope, weak).agg(F.count("*").alias("n"), F.min(key).alias("old_key")).where("n = 1").drop("n")
    new = incoming.where(F.coalesce(weak, F.lit("")) != "").join(known, [*scope, key], "left_anti")
    claims = new.groupBy(*scope, weak).agg(F.min(key).alias(key), F.count("*").alias("n")).where("n = 1").drop("n")
    return incoming.join(claims.join(single, [*scope, weak]).select(*scope, key, "old_key"), [*scope, key], "left")


def merge(state: DataFrame, incoming: DataFrame, keys: list[str], tracked: list[str], run_date: Column, policy: Policy = SHEET, price: str | None = None, run: str | None = None) -> DataFrame:
    """One row per key of either side: keys, tracked (new values), outcome (new, changed, unchanged, gone, returned,
    absent), is_active, first_seen, last_seen, last_changed, times_seen, prev_price (with price) and changes (array of field,
    old_value, new_value).

    state: keys, tracked, is_active, first_seen, last_seen, last_changed, times_seen. Both sides have unique keys. Rows that
    the incoming side lacks are retired only under a policy that says so; partial reads use one that does not. run: the
    incoming column with each row's own run date; run_date then counts for rows that are missing."""
    types = dict(state.select(*tracked).dtypes)
    old = state.select(*keys, F.struct(*[c for c in state.columns if c not in keys]).alias("o"))
    fresh = incoming.select(*keys, F.struct(*(F.col(c).cast(types[c]).alias(c) for c in tracked), *([F.col(run).alias("__run")] if run else [])).alias("i"))
    both = old.join(fresh, keys, "full_outer")
    run_date = F.coalesce("i.__run", run_date) if run else run_date
    here, there = F.col("o").isNotNull(), F.col("i").isNotNull()

    def value(c: str) -> Column:
        new = F.col(f"i.{c}")
        if policy.retain_last_good:
            new = F.coalesce(F.nullif(new, F.lit("")) if types[c] == "string" else new, F.col(f"o.{c}"))
        return new

    moved = F.array_compact(
        F.array(*(F.when(here & there & differs(F.col(f"o.{c}"), value(c), types[c]), F.struct(F.lit(c).alias("field"), rendered(F.col(f"o.{c}"), types[c]).alias("old_value"), rendered(value(c), types[c]).alias("new_value"))) for c in tracked))
    )
    both = both.withColumn("changes", moved)
    changed = F.size("changes") > 0
    active = F.coalesce(F.col("o.is_active"), F.lit(False))
    outcome = (
        F.when(~here, "new")
        .when(there & ~active & F.lit(policy.emit_returned), "returned")
        .when(there & changed, "changed")
        .when(there, "unchanged")
        .when(active & F.lit(policy.retire_missing), "gone")
        .otherwise("absent")
    )
    touched = (there & (changed | ~here)) | outcome.isin("gone", "returned")
    out = both.select(
        *keys,
        *(F.when(there, value(c)).otherwise(F.col(f"o.{c}")).alias(c) for c in tracked),
        outcome.alias("outcome"),
        F.when(there, F.lit(True)).when(outcome == "gone", F.lit(False)).otherwise(active).alias("is_active"),
        F.coalesce("o.first_seen", run_date).alias("first_seen"),
        F.when(there, run_date).otherwise(F.col("o.last_seen")).alias("last_seen"),
        F.when(touched, run_date).otherwise(F.col("o.last_changed")).alias("last_changed"),
        (F.coalesce("o.times_seen", F.lit(0)) + there.cast("int")).alias("times_seen"),
        "changes",
        *([F.when(F.exists("changes", lambda x: x["field"] == price), F.col(f"o.{price}")).alias("prev_price")] if price else []),
    )
    return out


def history(merged: DataFrame, keys: list[str], run_date: Column, policy: Policy = SHEET) -> DataFrame:
    """The long change log: keys, event, field, old_value, new_value, changed_on."""
    line = lambda event, field="", old="", new="": F.struct(F.lit(event).alias("event"), F.lit(field).alias("field"), F.lit(old).alias("old_value"), F.lit(new).alias("new_value"))
    moved = F.transform("changes", lambda x: F.struct(F.lit("changed").alias("event"), x["field"].alias("field"), x["old_value"].alias("old_value"), x["new_value"].alias("new_value")))
    own = (
        F.when((F.col("outcome") == "new") & F.lit(policy.emit_new), F.array(line("new")))
        .when(F.col("outcome") == "gone", F.array(line("removed", "is_active", "1", "0")))
        .when(F.col("outcome") == "returned", F.concat(F.array(line("returned", "is_active", "0", "1")), moved))
        .when(F.col("outcome") == "changed", moved)
    )
    return merged.select(*keys, run_date.alias("changed_on"), F.explode(own).alias("x")).select(*keys, "x.*", "changed_on")


def sync_counts(merged: DataFrame, by: list[str] | None = None) -> DataFrame:
    return merged.groupBy(*(by or []), "outcome").agg(F.count("*").alias("n"))


def drop_sold(incoming: DataFrame, status: str = "status") -> tuple[DataFrame, DataFrame]:
    """(live, sold): sold pages are never stored as live; they deactivate what is stored, without history."""
    sold = F.coalesce(F.col(status) == "sold", F.lit(False))
    return incoming.where(~sold), incoming.where(sold)


def retire_missing(state: DataFrame, seen: DataFrame, agency: str = "agency_id", url: str = "url") -> DataFrame:
    """Active stored rows that were not seen, for agencies of which at least half of what is held was found."""
    held = state.where("is_active").groupBy(agency).agg(F.count("*").alias("held"))
    found = seen.select(agency, url).distinct()
    share = found.groupBy(agency).agg(F.count("*").alias("found"))
    trusted = held.join(share, agency).where(F.col("found") >= F.col("held") * LEAST_SHARE).select(agency)
    return state.where("is_active").join(trusted, agency, "left_semi").join(found, [agency, url], "left_anti")


def known_urls(discovered: DataFrame, stored: DataFrame, url: str = "url") -> DataFrame:
    """What is discovered and not stored yet."""
    return discovered.join(stored.where(F.col(url) != "").select(url), url, "left_anti")


def single_matches(refs: DataFrame, stored: DataFrame, path: str | None = None) -> DataFrame:
    """(ref, offer_id, ambiguous): stored rows by reference or by address, each as a join of its own. refs: ref, url;
    stored: offer_id, ref, url. Two rows for one reference are ambiguous, and nothing may be changed then.

    A stored reference also fits if it ends in the wanted digits and no digit stands before them, as in 'code 123'. path: a
    pattern whose first group is the reference in a stored address; such addresses fit by it."""
    wanted = refs.where("ref <> ''")
    tail = F.regexp_extract("ref", r"([0-9]+)$", 1)
    by_ref = wanted.join(stored.select("offer_id", "ref"), "ref").select("ref", "offer_id")
    by_tail = wanted.join(stored.select("offer_id", tail.alias("ref")).where("ref <> ''"), "ref").select("ref", "offer_id")
    by_url = refs.where("url <> ''").join(stored.select("offer_id", "url"), "url").select("ref", "offer_id")
    every = by_ref.unionByName(by_tail).unionByName(by_url)
    if path:
        inside = stored.select("offer_id", F.regexp_extract("url", path, 1).alias("ref")).where("ref <> ''")
        every = every.unionByName(wanted.join(inside, "ref").select("ref", "offer_id"))
    found = every.distinct()
    return found.groupBy("ref").agg(F.min("offer_id").alias("offer_id"), (F.count("*") > 1).alias("ambiguous"))


def service_matches(refs: DataFrame, stored: DataFrame, suffix: str = "/rent") -> DataFrame:
    """As single_matches for sources that list one property for sale and for rent under one reference, the rental's address
    ending in `suffix`: rows match by address, or by reference and deal, but never the row whose address is that of the
    opposite deal. refs: ref, url, deal; stored: offer_id, ref, url, deal."""
    bare = F.regexp_replace("url", f"{suffix}$", "")
    wanted = refs.withColumn("opposite", F.when(F.col("deal") == "sale", F.concat(bare, F.lit(suffix))).otherwise(bare))
    have = stored.select("offer_id", "ref", "deal", F.col("url").alias("own"))
    by_url = wanted.join(have.drop("ref", "deal"), F.col("url") == F.col("own")).select("ref", "deal", "offer_id", "own", "opposite")
    by_ref = wanted.join(have, ["ref", "deal"]).select("ref", "deal", "offer_id", "own", "opposite")
    found = by_url.unionByName(by_ref).where("own <> opposite").select("ref", "deal", "offer_id").distinct()
    return found.groupBy("ref", "deal").agg(F.min("offer_id").alias("offer_id"), (F.count("*") > 1).alias("ambiguous"))


def retire_agency(state: DataFrame, agencies: DataFrame, run_date: Column, agency: str = "agency_id") -> tuple[DataFrame, DataFrame]:
    """(state, history) after all rows of merged agencies are withdrawn."""
    mark = state.join(agencies.select(agency, F.lit(True).alias("__gone")).distinct(), agency, "left")
    gone = F.coalesce("__gone", F.lit(False)) & F.col("is_active")
    log = mark.where(gone).select(*[c for c in ("id",) if c in state.columns], agency, F.lit("merged").alias("event"), F.lit("is_active").alias("field"), F.lit("1").alias("old_value"), F.lit("0").alias("new_value"), run_date.alias("changed_on"))
    return mark.withColumns({"last_changed": F.when(gone, run_date).otherwise(F.col("last_changed")), "is_active": F.col("is_active") & ~gone}).drop("__gone"), log


def unchanged_sources(fetched: DataFrame, last: DataFrame, source: str = "agency_id") -> DataFrame:
    """fetched (source, content_hash) with `changed`: equal content only moves last_seen."""
    latest = last.groupBy(source).agg(F.max_by("content_hash", "run_id").alias("old_hash"))
    return fetched.join(latest, source, "left").select(source, "content_hash", (~F.col("content_hash").eqNullSafe(F.col("old_hash"))).alias("changed"))


def upsert(state: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace stored ones of the same keys."""
    return state.join(incoming, keys, "left_anti").unionByName(incoming, allowMissingColumns=True)


def keep_manual(values: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Curated rows are never resolved again."""
    return values.join(stored.where("matched_by = 'manual'").select(key), key, "left_anti")


def previous_price(log: DataFrame, key: str = "id") -> DataFrame:
    """The price before the latest change of it."""
    prices = log.where((F.col("event") == "changed") & (F.col("field") == "price_eur"))
    last = prices.groupBy(key).agg(F.max_by("old_value", F.struct("changed_on", "seq")).alias("old_value"))
    return last.select(key, F.col("old_value").try_cast("decimal(12,2)").alias("prev_price"))


def manifest_compare(recorded: DataFrame, current: DataFrame, key: str = "path", digest: str = "digest") -> DataFrame:
    """(key, status): same, drifted, missing or unrecorded."""
    a, b = recorded.select(key, F.col(digest).alias("a")), current.select(key, F.col(digest).alias("b"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unrecorded").when(F.col("a") == F.col("b"), "same").otherwise("drifted")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def row_checksum(df: DataFrame) -> DataFrame:
    """One row that changes with any row: count and the sum of the rows' hashes. For proving that nothing was touched."""
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("checksum"))


def price_dropped(price: Column, previous: Column) -> Column:
    return F.coalesce(previous > price, F.lit(False))


def needs_verification(source: Column, verified_at: Column) -> Column:
    """A web find is hearsay until somebody confirms it."""
    return (source == "web") & verified_at.isNull()


def repair_deals(matched: DataFrame) -> DataFrame:
    """matched (id, old_deal, deal, price, prev_price): rows that an earlier import moved to the other deal get their deal back,
    and no previous price, as prices of two deals do not compare. Adds repaired and the history line of it."""
    wrong = ~F.col("old_deal").eqNullSafe(F.col("deal"))
    line = F.struct(F.lit("changed").alias("event"), F.lit("identity_repair").alias("field"), F.col("old_deal").alias("old_value"), F.col("deal").alias("new_value"))
    return matched.withColumns({"repaired": wrong, "prev_price": F.when(~wrong, F.col("prev_price")), "history": F.when(wrong, line)})


def deactivate_with_evidence(state: DataFrame, evidence: DataFrame) -> DataFrame:
    """(offer_id) of active rows that their own page says are gone. evidence: ref, url, outcome, in_scope; state: offer_id, ref, url,
    is_active. Evidence that fits several rows is ambiguous and withdraws none; absence is no evidence."""
    gone = evidence.where((F.col("outcome") == "unavailable") & F.col("in_scope")).select("ref", "url")
    found = single_matches(gone, state.where("is_active"))
    return found.where("NOT ambiguous").select("offer_id").distinct()
