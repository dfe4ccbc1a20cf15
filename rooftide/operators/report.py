"""Crawl quality: fill rates, outcomes, medians, domains, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import registrable, url_path

CONFIDENT = 20


def fill_rate(present: Column) -> Column:
    """Percent of rows with a value, to one place; null without rows."""
    return F.when(F.count("*") > 0, F.bround(100 * F.count_if(present) / F.count("*"), 1))


def fill_rates(offers: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    filled = [fill_rate(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(f"{c}_pct") for c in columns]
    return offers.groupBy(*(by or [])).agg(F.count("*").alias("n"), *filled)


def upper_median(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """The value at place n // 2, from 0, in sorted order. Values are counted first; no group's rows are collected."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    upto = F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumns({"upto": upto, "middle": F.floor(F.sum("n").over(w) / 2)})
    return ranked.where("upto > middle").groupBy(*by).agg(F.min(value).alias(name))


def crawl_report(trace: DataFrame, fields: list[str], outcomes: list[str]) -> DataFrame:
    """By agency: pages, counts by outcome, bytes, upper median of ms, and how often each field was found. trace: agency, outcome,
    bytes, ms, fields_found (array)."""
    main = trace.groupBy("agency").agg(
        F.count("*").alias("pages"),
        *(F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in outcomes),
        F.sum("bytes").alias("bytes"),
        *(fill_rate(F.array_contains("fields_found", f)).alias(f"{f}_pct") for f in fields),
    )
    return main.join(upper_median(trace, ["agency"], "ms", "median_ms"), "agency", "left")


def run_totals(trace: DataFrame) -> DataFrame:
    return trace.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def status_rollup(probes: DataFrame) -> DataFrame:
    """(status, n, slugs): slugs sorted; a roll-up of a dimension."""
    return probes.groupBy("status").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("agency_slug")), ",").alias("slugs"))


def crawl_map(probes: DataFrame) -> DataFrame:
    ok = (F.col("status") == "ok") & (F.coalesce("listing_pattern", F.lit("")) != "")
    return probes.agg(
        F.count_if(ok & (F.col("listing_count") >= CONFIDENT)).alias("crawlable"),
        F.count_if(ok & (F.coalesce("listing_count", F.lit(0)) < CONFIDENT)).alias("thin"),
        F.coalesce(F.sum(F.when(ok, F.col("listing_count"))), F.lit(0)).alias("listings"),
    )


def domain_mode(urls: DataFrame, by: list[str], url: str = "url") -> DataFrame:
    """(by, domain, n): the commonest registrable domain, ties by name."""
    counts = urls.groupBy(*by, registrable(F.col(url)).alias("domain")).agg(F.count("*").alias("n")).where("domain <> ''")
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("m"), "domain")).alias("x")).select(*by, "x.domain", (-F.col("x.m")).alias("n"))


def path_heads(urls: DataFrame, by: list[str], url: str = "url", limit: int = 3, least: int = 2) -> DataFrame:
    """(by, head, n): first path segments that come at least twice, the three commonest."""
    head = F.get(F.filter(F.split(url_path(F.col(url)), "/"), lambda s: s != ""), F.lit(0))
    counts = urls.groupBy(*by, head.alias("head")).agg(F.count("*").alias("n")).where(F.col("head").isNotNull() & (F.col("n") >= least))
    rank = Window.partitionBy(*by).orderBy(F.desc("n"), "head")
    return counts.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= limit).drop("place")


def catalogue_coverage(pages: DataFrame) -> DataFrame:
    """By catalogue: pages, rows, distinct addresses, repeats, how far the announced total moved, and whether all was seen.
    pages: catalogue, page, total, urls (array)."""
    flat = pages.select("catalogue", F.explode("urls").alias("url")).groupBy("catalogue").agg(F.count("*").alias("rows"), F.countDistinct("url").alias("urls"))
    seen = pages.groupBy("catalogue").agg(F.countDistinct("page").alias("pages"), F.max("total").alias("total"), (F.max("total") - F.min("total")).alias("drift"))
    out = seen.join(flat, "catalogue", "left")
    return out.withColumns({"repeats": F.col("rows") - F.col("urls"), "complete": F.coalesce(F.col("urls") >= F.col("total"), F.lit(False))})


def content_groups(df: DataFrame, key: str, content: str, owner: str | None = None) -> DataFrame:
    """(digest, n, owners, first): content that several rows share, by hash."""
    by = df.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("digest"))
    extra = [F.countDistinct(owner).alias("owners")] if owner else []
    return by.agg(F.count("*").alias("n"), *extra, F.min(key).alias("first")).where("n > 1")


def retry_worklist(failed: DataFrame, without_image: DataFrame, incomplete: DataFrame, url: str = "url") -> DataFrame:
    """(url, reasons): each address once, with why it is tried again."""
    parts = [df.select(url, F.lit(why).alias("why")) for df, why in ((failed, "failed"), (without_image, "image"), (incomplete, "incomplete"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy(url).agg(F.array_join(F.array_sort(F.collect_set("why")), ",").alias("reasons"))


def both_deals(refs: DataFrame) -> DataFrame:
    """References that stand for sale and for rent."""
    return refs.groupBy("ref").agg(F.count_if(F.col("deal") == "sale").alias("sale"), F.count_if(F.col("deal") == "rent").alias("rent")).where("sale > 0 AND rent > 0").select("ref")


def to_markdown(rows: DataFrame, limit: int = 500) -> str:
    """A small aggregate as a table. A table of more rows than `limit` says so in its last line."""
    names = rows.columns
    found = rows.limit(limit + 1).collect()
    body = [" | ".join("" if x is None else str(x) for x in r) for r in found[:limit]]
    lines = [f"| {line} |" for line in (" | ".join(names), " | ".join("---" for _ in names), *body)]
    return "\n".join([*lines, f"({rows.count() - limit} more rows)"] if len(found) > limit else lines)
