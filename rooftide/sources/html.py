"""Listing pages: one Arrow UDF parses HTML into a typed struct, everything after that is native.

The parser drops chrome (navigation, scripts, menus) by subtree, which patterns cannot do; so it runs in Python workers
over Arrow batches, once per page.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features, identity, prices, taxonomy
from ..functions.text import fold, once, title_norm
from ..operators import geo
from ..operators.lineage import settle

PAGE = "struct<title:string,h1:string,og:map<string,string>,ld:array<map<string,string>>,content:string,links:array<string>>"
# What is furniture on a page: tags, words of classes and ids between borders, and tags that never are.
CHROME_TAGS = frozenset(("script", "style", "noscript", "nav", "header", "footer", "aside", "form", "select", "button", "iframe", "svg", "template", "dialog"))
CHROME_WORDS = (
    "nav", "navbar", "menu", "topbar", "sidebar", "side-?nav", "filter", "filters", "facet", "footer", "header", "masthead", "cookie",
    "consent", "modal", "popup", "overlay", "drawer", "offcanvas", "widget", "related", "similar", "recommend", "recently", "viewed",
    "carousel-nav", "newsletter", "subscribe", "social", "share", "breadcrumbs?", "pagination", "search-form", "compare", "favorites?",
    "izbrannoe", "toolbar", "banner",
)
NEVER_CHROME = frozenset(("html", "body", "main", "article"))
CHROME = re.compile(rf"(?i)(?:^|[-_ ])(?:{'|'.join(CHROME_WORDS)})(?:$|[-_ ])")
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
BREAKS = frozenset(("p", "br", "div", "li", "tr", "td", "th", "h1", "h2", "h3", "h4", "table", "ul", "ol", "section", "article", "dt", "dd"))
# An ampersand, and the name or number of a character up to its semicolon, if it is one.
REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)?")
LEAST_TEXT, LARGE_PAGE, ANCHOR, LEAST_HEADING, LEAST_WINDOW = 300, 5000, 40, 8, 120
TITLE_END = r"\s+[|–—]\s.*$"


class _Reader(HTMLParser):
    """Text outside chrome, in lines; the title, the first heading outside chrome and the first of all, meta properties,
    JSON-LD and links of the whole page. A chrome subtree ends with the tag that began it, however sloppily those inside
    are closed."""

    def __init__(self, strict: bool, kept: str = "") -> None:
        """kept: a character that stands for ampersands which are text."""
        super().__init__(convert_charrefs=True)
        self.strict, self.kept, self.open, self.skipping = strict, kept, [], 0
        self.text, self.title, self.og, self.ld, self.links = [], [], {}, [], []
        self.headings: list[tuple[bool, list[str]]] = []  # whether outside chrome, and the parts
        self.into: list | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v.replace(self.kept, "&") if v and self.kept else v for k, v in attrs}
        name = (a.get("property") or a.get("name") or "").lower()
        if tag == "meta" and ":" in name and a.get("content"):
            self.og.setdefault(name.removeprefix("og:"), a["content"])
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag in BREAKS:
            self.text.append("\n")
        if tag in VOID:
            return
        marks = f"{a.get('class') or ''} {a.get('id') or ''}"
        chrome = tag in CHROME_TAGS or (self.strict and tag not in NEVER_CHROME and bool(CHROME.search(marks)))
        self.open.append((tag, chrome))
        self.skipping += chrome
        if tag == "script" and "ld+json" in (a.get("type") or "").lower():
            self.into = self.ld
            self.ld.append("")
        elif tag == "title":
            self.into = self.title
        elif tag == "h1":
            self.headings.append((not self.skipping, []))
            self.into = self.headings[-1][1]

    def handle_endtag(self, tag: str) -> None:
        if tag in BREAKS:
            self.text.append("\n")
        if tag in ("script", "title", "h1"):
            self.into = None
        if any(t == tag for t, _ in self.open):
            while self.open:
                t, chrome = self.open.pop()
                self.skipping -= chrome
                if t == tag:
                    break

    def handle_data(self, data: str) -> None:
        data = data.replace(self.kept, "&") if self.kept else data
        if self.into is self.ld and self.ld:
            self.ld[-1] += data
            return
        if self.into is not None:
            self.into.append(data)
        if not self.skipping and self.into is not self.title:
            self.text.append(data)

    def heading(self) -> str:
        """The first heading outside chrome, else the first of all: a theme may bury it."""
        said = [(outside, _spaced(parts)) for outside, parts in self.headings if _spaced(parts)]
        return next((text for outside, text in said if outside), said[0][1] if said else "")


def _spaced(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def _flat(node, out: list[dict]) -> None:
    if isinstance(node, list):
        for x in node:
            _flat(x, out)
    elif isinstance(node, dict):
        out.append({str(k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in node.items() if v is not None})
        for v in node.values():
            if isinstance(v, (list, dict)):
                _flat(v, out)


def _lines(parts: list[str]) -> str:
    return "\n".join(x for x in (" ".join(line.split()) for line in "".join(parts).split("\n")) if x)


def _read(html: str, strict: bool, kept: str = "") -> _Reader:
    reader = _Reader(strict, kept)
    reader.feed(html)
    reader.close()
    return reader


def _keep_open(html: str) -> tuple[str, str]:
    """html with a character that it does not hold in place of each ampersand that begins no reference with a semicolon."""
    kept = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in html)
    own = lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else kept + (m[1] or "")
    return REFERENCE.sub(own, html), kept


def parse_page(html: str | None, closed: bool = False) -> dict:
    """The page as a dict of PAGE. closed: only references with their semicolon stand for characters, and what a cut left of
    one stays as it is; else names without it count where HTML lets them. The window starts at the heading where one is found in the text: the first h1, else what
    the page's data or its title calls the listing. If next to nothing is left outside chrome, the words misjudged the page,
    and it is read again without them where that gives more."""
    html, kept = _keep_open(html or "") if closed else (html or "", "")
    reader = _read(html, True, kept)
    content = _lines(reader.text)
    if len(content) < LEAST_TEXT and len(html) > LARGE_PAGE:
        loose = _read(html, False, kept)
        if len(_lines(loose.text)) > len(content):
            reader, content = loose, _lines(loose.text)
    ld: list[dict] = []
    for raw in reader.ld:
        try:
            _flat(json.loads(raw), ld)
        except ValueError:
            continue
    h1, title = reader.heading(), _spaced(reader.title)
    named = next((n["name"] for n in ld if n.get("name") and re.search("|".join(LD_KINDS), n.get("@type", ""))), "")
    heading = h1 or re.sub(TITLE_END, "", named or reader.og.get("title", "") or title)
    if len(heading) > LEAST_HEADING and (at := content.find(heading[:ANCHOR])) >= 0:
        content = content[at:]
    return {"title": title, "h1": h1, "og": reader.og, "ld": ld, "content": content, "links": reader.links}


# Kinds of JSON-LD nodes that describe a listing.
LD_KINDS = ("RealEstateListing", "Residence", "Apartment", "House", "Product", "SingleFamilyResidence", "Offer", "Accommodation")


def with_page(pages: DataFrame, html: str = "html", name: str = "page", closed: bool = False) -> DataFrame:
    """pages with what parse_page finds."""

    def parsed(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in pages:
            yield pd.DataFrame([parse_page(x, closed) for x in part], columns=["title", "h1", "og", "ld", "content", "links"])

    # Made here, as a UDF's type can only be read once there is a session.
    read = F.pandas_udf(parsed, PAGE)
    return pages.withColumn(name, read(F.col(html)))


# --- labelled facts ---------------------------------------------------------------------------------------------------

# Labels of facts, in the order in which a label is tried.
LABELS = (
    ("price_per_m2", r"(?iu)(цена|price|стоимост).{0,12}(за\s*)?(м2|м²|кв\.?\s*м|m2|sq)"),
    ("price", r"(?iu)^(цена|price|стоимост|цена на имота|asking)"),
    ("area", r"(?iu)^(площ|площадь|area|размер|квадратура|size|living area)"),
    ("floor", r"(?iu)^(етаж|этаж|floor|на етаж)"),
    ("floors_total", r"(?iu)(общо етаж|всего этаж|total floors|етажност)"),
    ("rooms", r"(?iu)^(комнат|стаи|броя стаи|rooms|номер стаи)"),
    ("bedrooms", r"(?iu)^(спалн|bedroom|schlafzimmer|кол.{0,4}спал)"),
    ("deal", r"(?iu)(вид сделка|тип сделки|deal type|операция)"),
    ("status", r"(?iu)^(статус|състояние|состояние|status)"),
    ("location", r"(?iu)^(град|город|район|курорт|location|населено място|city|region)"),
    ("view", r"(?iu)(гледка|вид на море|вид из окна|view)"),
    ("furnished", r"(?iu)(мебел|обзавежд|обзаведен|furnish)"),
    ("kind", r"(?iu)^(вид имот|тип имота|тип недвижимости|property type|вид)"),
    ("ref", r"(?iu)^(код|реф|référ|ref|id|номер|артикул)"),
    ("maintenance", r"(?iu)(поддръжка|поддержка|такса|maintenance|service charge)"),
    ("sea_distance", r"(?iu)(до море|до морето|разстояние до мор|distance to)"),
)
# A label and its value, and words for yes, no and the ground floor.
PAIR = r"([A-Za-zА-Яа-яЁёЂ-ќ][^:\n]{1,34}?)[^\S\n]*:[^\S\n]*([^\n:]{1,70})"
YES, NO, GROUND = r"(?iu)^(да|има|есть|yes|true|\+)", r"(?iu)^(не|няма|нет|no|false|-)", r"(?iu)(партер|цокол|ground|first floor|приземн)"


def label_pairs(content: Column) -> Column:
    """map field -> value from 'label: value' lines; each pair goes to the first field its label fits, and the first pair of a
    field wins."""
    # No pair goes over the end of a line, so only lines with a colon are searched.
    lines = F.array_join(F.filter(F.split(content, "\n"), lambda x: x.contains(":")), "\n")
    names, values = (F.regexp_extract_all(lines, F.lit(PAIR), i) for i in (1, 2))
    pairs = F.zip_with(names, values, lambda a, b: F.struct(taxonomy.first_match(F.trim(a), LABELS).alias("key"), F.trim(b).alias("value")))
    good = F.filter(pairs, lambda p: p["key"].isNotNull() & (p["value"] != ""))

    def first_of_each(good: Column) -> Column:
        keys = F.array_distinct(F.transform(good, lambda p: p["key"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(good, lambda p: p["key"] == k)[0]["value"]))

    return once(good, first_of_each)


def yes_no(text: Column) -> Column:
    return F.when(F.trim(text).rlike(YES), F.lit(True)).when(F.trim(text).rlike(NO), F.lit(False))


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull() & (v != "")), F.lit(0))


def ld_value(ld: Column, *names: str) -> Column:
    """The first value of a property among JSON-LD nodes of listing kinds; 'floorSize.value' is one inside another."""
    kinds = F.filter(ld, lambda n: n["@type"].rlike("|".join(LD_KINDS)))

    def of(name: str) -> Column:
        outer, _, inner = name.partition(".")
        return _first(F.transform(kinds, lambda n: F.get_json_object(n[outer], f"$.{inner}") if inner else n[outer]))

    return F.coalesce(*map(of, names))


def ld_property(ld: Column, pattern: str, unless: str = "(?!)") -> Column:
    """The first value of a PropertyValue node whose name fits."""
    name = lambda n: F.lower(F.coalesce(n["name"], F.lit("")))
    fit = F.filter(ld, lambda n: F.coalesce(n["@type"].rlike("PropertyValue"), F.lit(False)) & name(n).rlike(pattern) & ~name(n).rlike(unless))
    return _first(F.transform(fit, lambda n: n["value"]))


def ld_address(ld: Column) -> Column:
    """Street, town and region of a listing's structured address; null without one."""
    parts = [ld_value(ld, f"address.{x}") for x in ("streetAddress", "addressLocality", "addressRegion")]
    return F.nullif(F.concat_ws(" ", *parts), F.lit(""))


# Names of structured properties, amounts of money, areas and floors in text.
LD_AREA, LD_BEDROOMS, LD_ROOMS, LD_FLOOR = "площ|area|size|кв", "спал|bedroom", "комнат|стаи|rooms", "етаж|этаж|floor"
LD_PRICE, LD_NO_PRICE = "цена|price|стоимост", "м2|кв"
MONEY = r"(?iuU)([\d][\d\s .,]{2,12}\s*(?:€|EUR|евро|лв\.?|BGN))"
MONEY_LABELLED = r"(?iuU)(?:цена|price|стоимост)\D{0,24}?([\d][\d\s .,]{2,12}\s*(?:€|EUR|евро|лв\.?|BGN))"
AREA = r"(?iuU)([\d]+(?:[.,]\d+)?)\s*(?:кв\.?\s*м|м\s?2|м²|m\s?2|m²|sq\.?\s?m)"
FLOOR = r"(?iuU)(?:етаж|этаж|floor)\D{0,8}(\d{1,2})|(\d{1,2})\s*[-\s]?(?:ти|ри|й|ый)?\s*(?:етаж|этаж|floor)"
ALL_FLOORS = r"(?iu)(етажност|общо етаж|всего этаж|total floors?)\D{0,12}\d+"
LEAST_PRICE, MOST_PRICE = 1000, 5_000_000
RAW_CHARS, NOTES_CHARS, WINDOW_NOTES, FEATURE_WINDOW, PLACE_WINDOW = 120, 4000, 1500, 3000, 400


def asking_price(spec: Column, ld: Column, content: Column, html: Column | None = None, hints: tuple[str, ...] = (), least: float = LEAST_PRICE, most: float = MOST_PRICE) -> Column:
    """struct(value, derived, raw): labelled, structured, by a site's own patterns (hints; the amount is group 1), labelled in
    text, any amount in text, rate times area; the first within bounds, with the text it was read from."""
    amount = lambda value, raw, derived=False: F.struct(value.cast("double").alias("value"), F.lit(derived).alias("derived"), F.left(raw, F.lit(RAW_CHARS)).alias("raw"))
    in_text = lambda pattern: F.zip_with(F.regexp_extract_all(content, F.lit(pattern), 1), F.regexp_extract_all(content, F.lit(pattern), 0), lambda x, whole: amount(prices.money(x), whole))
    own, currency = F.coalesce(ld_value(ld, "price"), ld_property(ld, LD_PRICE, LD_NO_PRICE)), F.coalesce(ld_value(ld, "priceCurrency"), F.lit("EUR"))
    structured = prices.number(own) / F.when(F.upper(currency) == "BGN", F.lit(prices.BGN_PER_EUR)).otherwise(F.lit(1.0))
    by_site = [amount(prices.number(F.regexp_extract(html, f"(?i){h}", 1)), F.regexp_extract(html, f"(?i){h}", 0)) for h in hints if html is not None]
    rate = amount(F.bround(prices.money(spec["price_per_m2"]) * prices.number(spec["area"]), 2), F.concat(spec["price_per_m2"], F.lit(" × "), spec["area"]), True)
    first = F.array(amount(prices.money(spec["price"]), spec["price"]), amount(F.bround(structured, 2), F.concat_ws(" ", own, currency)), *by_site)
    every = F.concat(first, in_text(MONEY_LABELLED), in_text(MONEY), F.array(rate))
    nothing = F.struct(F.lit(None).cast("double").alias("value"), F.lit(False).alias("derived"), F.lit("").alias("raw"))
    return F.coalesce(F.get(F.filter(every, lambda x: x["value"].between(least, most)), F.lit(0)), nothing)


def page_location(spec: Column, ld: Column, title: Column, url: Column, window: Column, vocabulary: list[tuple[str, str]]) -> Column:
    """The place that a page states about its listing: by label, address, title or web address; else one that the first lines
    name, if only by the word that no other place has. vocabulary: (folded alias, name)."""
    slug = F.regexp_replace(F.regexp_replace(url, "^[a-zA-Z]+://", ""), "[-_/]+", " ")
    stated = geo.first_longest_alias(fold(F.concat_ws(" ", spec["location"], ld_address(ld), title, slug)), vocabulary)
    return F.coalesce(stated, geo.first_longest_alias_or_word(fold(F.left(window, F.lit(PLACE_WINDOW))), vocabulary))


def extract(pages: DataFrame, html: str = "html", url: str = "url", vocabulary: list[tuple[str, str]] | None = None, hints: tuple[str, ...] = ()) -> DataFrame:
    """Listing records of the pages that are listings: a title, a window of text, and two of price, area and bedrooms.
    vocabulary: places (folded alias, name) to resolve locations by; hints: a site's own patterns of prices."""
    ld, body, spec, title = (F.col(f"__{x}") for x in ("ld", "body", "spec", "title"))
    read = with_page(pages, html, "__page")
    read = settle(read, __body=F.col("__page.content"), __ld=F.col("__page.ld"), __og=F.col("__page.og"))
    heading = F.coalesce(F.nullif(F.col("__page.h1"), F.lit("")), ld_value(ld, "name"), F.col("__og")["title"], F.col("__page.title"))
    read = settle(read, __spec=label_pairs(body), __title=F.left(F.trim(F.regexp_replace(heading, f"(?U){TITLE_END}", "")), F.lit(400)))
    read = read.where((F.length(title) >= 3) & (F.length(body) >= LEAST_WINDOW))

    status_text = lambda key: F.concat_ws(" ", spec[key], title, F.left(body, F.lit(300)))
    texts = {
        "area": F.coalesce(spec["area"], ld_value(ld, "floorSize.value"), ld_property(ld, LD_AREA)),
        "area_said": F.nullif(F.regexp_extract(body, AREA, 1), F.lit("")),
        "beds": F.coalesce(spec["bedrooms"], F.when(spec["rooms"].isNull(), F.coalesce(ld_value(ld, "numberOfBedrooms"), ld_property(ld, LD_BEDROOMS)))),
        "rooms": F.coalesce(spec["rooms"], ld_value(ld, "numberOfRooms"), ld_property(ld, LD_ROOMS)),
        "floor": F.coalesce(spec["floor"], ld_value(ld, "floor"), ld_property(ld, LD_FLOOR)),
        "floor_said": F.regexp_extract(F.regexp_replace(body, ALL_FLOORS, ""), FLOOR, 0),
        "address": ld_address(ld),
        "notes": F.coalesce(F.nullif(F.left(F.coalesce(ld_value(ld, "description"), F.col("__og")["description"]), F.lit(NOTES_CHARS)), F.lit("")), F.left(body, F.lit(WINDOW_NOTES))),
        "status": status_text("status"),
        "deal": status_text("deal"),
        "price": asking_price(spec, ld, body, F.col(html), hints),
    }
    read = settle(read, **{f"__{k}": v for k, v in texts.items()})
    said = lambda k: F.col(f"__{k}")
    floor = F.coalesce(F.when(said("floor").rlike(GROUND), F.lit(0.0)), prices.number(said("floor")), prices.number(said("floor_said")))
    area = F.coalesce(prices.number(said("area")), prices.number(said("area_said")))
    beds = F.coalesce(prices.number(said("beds")).cast("int"), taxonomy.at_least_none(prices.number(said("rooms")).cast("int") - 1), taxonomy.bedrooms_of(title, body))
    place = page_location(spec, ld, title, F.col(url), body, vocabulary) if vocabulary else F.lit(None).cast("string")
    read = settle(read, __floors=floor, __areas=area, __bedrooms=beds, __place=place)
    found = settle(
        read,
        price=F.col("__price.value"),
        price_derived=F.col("__price.derived"),
        price_raw=F.col("__price.raw"),
        area=prices.within(said("areas"), 10, 1000),
        bedrooms=prices.within(said("bedrooms"), 0, 6),
        floor=prices.within(said("floors"), -1, 30).cast("int"),
        title=title,
        title_norm=title_norm(title),
        location=F.coalesce(said("place"), F.lit("")),
        location_salvaged=said("place").isNotNull() & (F.coalesce(spec["location"], F.lit("")) == ""),
        location_raw=F.left(F.coalesce(spec["location"], said("address"), title), F.lit(300)),
        kind=taxonomy.kind_of(F.concat_ws(" ", spec["kind"], title)),
        deal=taxonomy.deal_of(said("deal")),
        status=F.when(taxonomy.is_sold(said("status")), "sold").otherwise("active"),
        view=F.left(F.coalesce(spec["view"], F.lit("")), F.lit(300)),
        furnished=yes_no(spec["furnished"]),
        maintenance_raw=F.left(F.coalesce(spec["maintenance"], F.lit("")), F.lit(200)),
        notes=said("notes"),
        ref=F.left(F.coalesce(spec["ref"], F.lit("")), F.lit(80)),
    )
    known = sum(F.col(c).isNotNull().cast("int") for c in ("price", "area", "bedrooms"))
    found = found.where(known >= 2)
    columns = {"title": F.col("title"), "notes": F.concat_ws(" ", "notes", F.left(body, F.lit(FEATURE_WINDOW))), "view": F.concat_ws(" ", "view", spec["sea_distance"]), "status": F.col("status"), "furnished": F.col("furnished")}
    sets = {fields: f"__text{i}" for i, fields in enumerate(features.field_sets())}
    read_in = {f for fields in sets for f in fields if f in columns}
    found = settle(found, **{f"__part_{f}": c for f, c in features.folded_parts({f: columns[f] for f in sorted(read_in)}).items()})
    found = settle(found, **{name: features.joined({f: F.col(f"__part_{f}") for f in read_in}, fields) for fields, name in sets.items()})
    key_place = F.coalesce(F.nullif("location", F.lit("")), "location_raw")
    out = found.withColumns(
        {
            "price_per_m2": F.bround(F.try_divide(F.col("price"), F.col("area")), 2),
            "features": features.resolve(columns, texts={fields: F.col(name) for fields, name in sets.items()}),
            "dedup_key": identity.dedup_key(key_place, F.col("title"), F.col("bedrooms"), F.col("area"), F.col("floor")),
            "fingerprint": identity.web_fingerprint(F.col(url)),
        }
    )
    return out.drop(html, *(c for c in out.columns if c.startswith("__")))


def meta_images(page: Column) -> Column:
    """Image addresses of a page's metadata and structured data, junk left out, in order."""
    listed = F.array_compact(F.array(page["og"]["image"], page["og"]["twitter:image"], ld_value(page["ld"], "image")))
    return F.filter(F.array_distinct(listed), lambda u: u.rlike(r"^https?://") & ~u.rlike(r"(?i)(logo|icon|avatar|placeholder|sprite|blank)"))
