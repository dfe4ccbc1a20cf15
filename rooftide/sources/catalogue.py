"""Walking stored catalogue pages: adapters for sites, and a breadth-first walk as joins.

An adapter turns a page into an outcome: offer, project, unavailable or outside_city. Adapters are data; a site is added
by registering one. Pages were fetched before; the walk only decides which of them belong to a catalogue.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prices, taxonomy
from ..operators import recon
from ..operators.lineage import cut
from .html import extract

MOST_PAGES = 600
# Bounds of verified sources.
BOUNDS = {"price": (0, 9_999_999_999.99), "area": (0, 999_999.99), "bedrooms": (0, 30), "floor": (-3, 100)}


@dataclass(frozen=True)
class Adapter:
    """What a verified source's pages look like. own: the city's pattern; other: cities that rule a page out; gone: marks of
    what is no longer offered; project: marks of a development; ref: pattern of the reference in an address."""

    name: str
    ref: str
    own: str
    other: str = r"(?!)"
    gone: str = taxonomy.SOLD
    project: str = r"(?!)"
    include: tuple[str, ...] = ()
    drop: tuple[str, ...] = ()
    extra: dict[str, Callable[[Column], Column]] = field(default_factory=dict)


ADAPTERS: dict[str, Adapter] = {}


def register(adapter: Adapter) -> Adapter:
    ADAPTERS[adapter.name] = adapter
    return adapter


def in_city(text: Column, adapter: Adapter) -> Column:
    return ~text.rlike(f"(?iu){adapter.other}") & text.rlike(f"(?iu){adapter.own}")


def outcomes(pages: DataFrame, adapter: Adapter, url: str = "url", html: str = "html") -> DataFrame:
    """(url, ref, outcome, record): one struct for each page; record is null unless it is an offer."""
    found = extract(pages.select(url, html), html, url)
    record = F.struct(*(prices.within(F.col(c), *BOUNDS[c]).alias(c) if c in BOUNDS else F.col(c) for c in found.columns if c != url))
    by_url = found.select(url, record.alias("record"))
    low = F.lower(html)
    kind = (
        F.when(low.rlike(f"(?iu){adapter.project}"), "project")
        .when(low.rlike(adapter.gone), "unavailable")
        .when(~in_city(low, adapter), "outside_city")
        .otherwise("offer")
    )
    out = pages.select(url, F.nullif(F.regexp_extract(url, adapter.ref, 1), F.lit("")).alias("ref"), kind.alias("outcome"))
    out = out.join(by_url, url, "left")
    return out.select(url, "ref", F.when((F.col("outcome") == "offer") & F.col("record").isNull(), "rejected").otherwise(F.col("outcome")).alias("outcome"), F.when(F.col("outcome") == "offer", F.col("record")).alias("record"))


def catalogue_rows(pages: DataFrame, adapter: Adapter, url: str = "url", html: str = "html") -> DataFrame:
    """(url, link): listing links of catalogue pages by the adapter's include and drop lists."""
    links = recon.links_on(pages, [url], url, html)
    arrays = [F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in (adapter.include, adapter.drop)]
    return links.where(recon.is_listing(F.col("link"), *arrays))


def walk(pages: DataFrame, start: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """(url, depth): pages of a catalogue that links lead to from the start, breadth first, until a round finds no new page or
    so many pages are found. pages: url, html; start: url."""
    links = recon.links_on(pages, ["url"])
    reached = start.select("url", F.lit(0).alias("depth"))
    edge, depth = reached, 0
    while True:
        depth += 1
        base = F.col("url")
        edge = edge.select("url").join(links, "url").where(recon.is_page_of(F.col("link"), base)).select(F.col("link").alias("url")).distinct()
        edge = cut(edge.join(reached.select("url"), "url", "left_anti").select("url", F.lit(depth).alias("depth")))
        if not edge.head(1):
            break
        reached = cut(reached.unionByName(edge))
        if reached.count() >= most:
            break
    return reached.orderBy("depth", "url").limit(most)


def units(content: Column) -> Column:
    """array<struct<floor, number, area, price>> from the lines of a development's price list: a floor heading holds for the lines
    below it; a line counts with an area and a price, and where total and rate are both given they must agree when rounded."""
    lines = F.filter(F.split(content, "\n"), lambda x: x != "")
    heading = lambda x: F.when(x.rlike(r"(?i)^\s*(minus\s+)?[a-z]+\s+floor\s*$"), taxonomy.floor_number(x))
    area = lambda x: prices.number(F.nullif(F.regexp_extract(x, r"(?iuU)(\d[\d.,]*)\s*(?:m2|m²|кв)", 1), F.lit("")))
    price = lambda x: prices.number(F.nullif(F.regexp_extract(x, r"(?iuU)(?<![\w.,])(\d[\d\s.,]*)\s*(?:€|EUR)", 1), F.lit("")))
    rows = F.transform(lines, lambda x, i: F.struct(
        F.try_element_at(F.filter(F.transform(F.slice(lines, F.lit(1), i + 1), heading), lambda f: f.isNotNull()), F.lit(-1)).alias("floor"),
        F.nullif(F.regexp_extract(x, r"^\s*([A-Za-z]?-?\d+[A-Za-z]?)\b", 1), F.lit("")).alias("number"),
        area(x).alias("area"),
        price(x).alias("price"),
    ))
    return F.filter(rows, lambda r: r["area"].isNotNull() & r["price"].isNotNull())


def merge_note(notes: Column, label: str, value: Column, limit: int = 4000) -> Column:
    """notes with 'label: value', in place of an earlier one, cut to the stored length."""
    line = F.concat(F.lit(f"{label}: "), value)
    pattern = rf"(?m)^{label}: .*$"
    return F.left(F.when(notes.rlike(pattern), F.regexp_replace(notes, F.lit(pattern), line)).when(F.coalesce(notes, F.lit("")) == "", line).otherwise(F.concat(notes, F.lit("\n"), line)), F.lit(limit))
