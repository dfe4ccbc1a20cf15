"""Looking at sites: address shapes, kinds of pages, platforms, candidate patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import host, shape_of, url_path

SHAPES, SAMPLES, SIBLINGS, MANY = 12, 3, 9, 10
# What marks prices, areas, rooms and news on a page.
PRICE = r"(?iuU)(?:€|EUR|лв\.?|BGN)\s*[\d\s.,]{3,}|[\d\s.,]{3,}\s*(?:€|EUR|лв\.?|BGN)"
AREA = r"(?iuU)\d[\d\s.,]*\s*(?:m2|m²|кв\.?\s*м|sq\.?\s*m|кв\.м)"
ROOMS = r"(?iu)(едностаен|двустаен|тристаен|многостаен|мезонет|bedroom|спалн|студио|studio)"
NEWS = r"(?i)\"@type\"\s*:\s*\"(NewsArticle|BlogPosting|Article)\""
# Marks of platforms in page text, endings of assets, answers that mean a block.
PLATFORMS = {
    "WordPress": (r"/wp-content/", r"/wp-includes/", r'name="generator"[^>]*WordPress'),
    "Houzez": (r"houzez",),
    "Realhomes": (r"realhomes",),
    "Wix": (r"wix\.com", r"_wixCssImports"),
    "Joomla": (r"/media/jui/", r'name="generator"[^>]*Joomla'),
    "Drupal": (r"/sites/default/files/", r'name="generator"[^>]*Drupal'),
    "Shopify": (r"cdn\.shopify\.com",),
    "Next.js": (r"/_next/static/",),
    "Nuxt": (r"/_nuxt/",),
}
SKIPPED = (".css", ".js", ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".pdf", ".zip", ".ico", ".woff", ".woff2", ".mp4", ".xml")
BLOCKED_STATUS = (401, 403, 429, 503)


def url_shapes(urls: DataFrame, url: str = "url", order: str | None = None, by: list[str] | None = None, limit: int = SHAPES) -> DataFrame:
    """(by, shape, n, samples): the commonest path shapes with their first three addresses. Samples are kept by a bounded
    aggregate per task, so that a shape that most addresses share stays small."""
    by, order = by or [], order or url
    shaped = urls.select(*by, F.col(url).alias("u"), F.col(order).alias("o"), shape_of(F.col(url)).alias("shape"))
    counts = shaped.groupBy(*by, "shape").agg(F.count("*").alias("n"))
    top = Window.partitionBy(*by).orderBy(F.desc("n"), "shape")
    counts = counts.withColumn("place", F.row_number().over(top)).where(F.col("place") <= limit).drop("place")
    # Earliest first: the three least of (order, url), one after the other.
    least = shaped.join(counts.select(*by, "shape"), [*by, "shape"], "left_semi")
    samples = None
    for i in range(SAMPLES):
        first = least.groupBy(*by, "shape").agg(F.min(F.struct("o", "u")).alias(f"s{i}"))
        samples = first if samples is None else samples.join(first, [*by, "shape"], "left")
        least = least.join(first, [*by, "shape"]).where(F.struct("o", "u") > F.col(f"s{i}")).drop(f"s{i}") if i < SAMPLES - 1 else least
    picked = F.array_compact(F.array(*(F.col(f"s{i}.u") for i in range(SAMPLES)))).alias("samples")
    return counts.join(samples, [*by, "shape"]).select(*by, "shape", "n", picked)


def page_kind(body: Column, siblings: Column | None = None) -> Column:
    """detail, catalogue or other. Prices and areas both, or one of them and rooms; news never; nine links of the page's own
    shape make a catalogue, and without that count ten prices and areas do."""
    prices, areas = F.regexp_count(body, F.lit(PRICE)), F.regexp_count(body, F.lit(AREA))
    likely = ((prices > 0) & (areas > 0)) | ((prices + areas > 0) & body.rlike(ROOMS))
    many = (prices >= MANY) & (areas >= MANY)
    many = many if siblings is None else F.when(siblings.isNotNull(), siblings >= SIBLINGS).otherwise(many)
    return F.when(body.rlike(NEWS) | ~likely, "other").when(many, "catalogue").otherwise("detail")


def platforms(body: Column) -> Column:
    """Names of the platforms whose marks the page has; a theme hides what it is built on."""
    found = F.array_compact(F.array(*(F.when(sum(body.rlike(f"(?i){p}").cast("int") for p in ps) > 0, F.lit(n)) for n, ps in PLATFORMS.items())))
    themed = F.array_contains(found, "Houzez") | F.array_contains(found, "Realhomes")
    return F.when(themed, F.array_remove(found, "WordPress")).otherwise(found)


def charset(body: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(body, r"(?i)<meta[^>]+charset=[\"']?\s*([\w-]+)", 1)), F.lit(""))


def page_title(body: Column) -> Column:
    return F.trim(F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)</title>", 1))


# What links are no addresses.
NO_ADDRESS = "^(mailto:|tel:|javascript:|data:)"


def hrefs(body: Column) -> Column:
    """Targets of links, as written, up to a fragment."""
    found = F.regexp_extract_all(body, F.lit(r"(?i)<a\b[^>]*?href=[\"']([^\"'#]+)"), 1)
    return F.filter(F.transform(found, lambda h: F.trim(h)), lambda h: (h != "") & ~h.rlike(NO_ADDRESS))


def without_dots(path: Column) -> Column:
    """An absolute path with '.' and '..' resolved; one that ends in either ends in a slash."""
    parts = F.split(F.regexp_replace(path, r"/\.\.?$", "$0/"), "/")
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", up(done)).when(x == ".", done).otherwise(F.concat(done, F.array(x))))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.array_join(kept, "/")).otherwise(path)


def absolute(href: Column, base: Column) -> Column:
    """href against base for the forms that pages use: absolute, //host, /path, ?query and plain names, with dots resolved."""
    scheme, root = F.regexp_extract(base, r"^([a-zA-Z]+):", 1), F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]*)", 1)
    folder = F.regexp_replace(url_path(base), r"[^/]*$", "")
    path, rest = F.regexp_extract(href, r"^[^?#]*", 0), F.regexp_extract(href, r"[?#].*$", 0)
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, without_dots(path), rest))
        .when(href.startswith("?"), F.concat(root, url_path(base), href))
        .otherwise(F.concat(root, without_dots(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path)), rest))
    )


def base_of(body: Column, url: Column) -> Column:
    """What relative links of a page start from: its own <base>, else its address."""
    own = F.nullif(F.trim(F.regexp_extract(body, r"(?i)<base\b[^>]*?href=[\"']([^\"'#]+)", 1)), F.lit(""))
    return F.when(own.isNotNull(), absolute(own, url)).otherwise(url)


def links_on(pages: DataFrame, keys: list[str], url: str = "url", body: str = "html") -> DataFrame:
    """(keys, link): distinct addresses of the same host that are no assets, without fragments."""
    links = pages.select(*keys, F.col(url).alias("own"), base_of(F.col(body), F.col(url)).alias("base"), F.explode(hrefs(F.col(body))).alias("href"))
    links = links.select(*keys, "own", F.substring_index(absolute(F.col("href"), F.col("base")), "#", 1).alias("link"))
    low = F.lower(url_path(F.col("link")))
    asset = sum(low.endswith(x).cast("int") for x in SKIPPED) > 0
    return links.where((host(F.col("link")) == host(F.col("own"))) & ~asset).select(*keys, "link").distinct()


def sibling_counts(links: DataFrame, pages: DataFrame, key: str, url: str = "url") -> DataFrame:
    """(key, siblings): links of each page that have the page's own shape."""
    own = pages.select(key, shape_of(F.col(url)).alias("own"))
    same = links.join(own, key).where(shape_of(F.col("link")) == F.col("own")).groupBy(key).agg(F.count("*").alias("siblings"))
    return own.select(key).join(same, key, "left").select(key, F.coalesce("siblings", F.lit(0)).alias("siblings"))


def response_class(status: Column, body: Column, challenge: str = r"(?i)captcha|cf-challenge|just a moment|access denied") -> Column:
    return (
        F.when(status.isNull(), "unreachable")
        .when(status.isin(*BLOCKED_STATUS) | F.coalesce(body.rlike(challenge), F.lit(False)), "blocked")
        .when(status >= 400, "http_error")
        .otherwise("ok")
    )


def liveness(status: Column) -> Column:
    """Only positive evidence withdraws a listing."""
    return F.when(status.isin(404, 410), "withdrawn").when(status == 200, "alive").otherwise("unknown")


def verified_pattern(shapes: DataFrame, kinds: DataFrame, candidates: int = 5, samples: int = 3) -> DataFrame:
    """(site, shape, n): each site's first shape, by falling count, with a sample that is a detail page. shapes: site, shape, n,
    samples; kinds: url, kind."""
    rank = Window.partitionBy("site").orderBy(F.desc("n"), "shape")
    tried = shapes.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= candidates)
    tested = tried.select("site", "shape", "n", "place", F.explode(F.slice("samples", 1, samples)).alias("url")).join(kinds.where("kind = 'detail'"), "url")
    return tested.groupBy("site").agg(F.min_by(F.struct("shape", "n"), "place").alias("x")).select("site", "x.*")


def is_listing(url: Column, include: Column, drop: Column) -> Column:
    """Path prefixes to drop come first; then any include, a substring or re:pattern; none includes all."""
    path = url_path(url)
    hit = F.exists(include, lambda p: F.when(p.startswith("re:"), F.regexp_like(url, F.substring(p, F.lit(4), F.length(p)))).otherwise(F.contains(url, p)))
    return ~F.exists(drop, lambda p: F.startswith(path, p)) & ((F.size(include) == 0) | hit)


def is_page_of(url: Column, base: Column) -> Column:
    """Another page of the same catalogue: same host, path below, and a page number."""
    return (host(url) == host(base)) & F.startswith(url_path(url), F.regexp_replace(url_path(base), "/$", "")) & url.rlike(r"(?i)([?&](page|p|paged|pg)=\d+|/page[/-]?\d+)")


LANGUAGES = ("/en/", "/ru/", "/de/")


def derived_spec(probe: Column, pattern: Column, catalogues: Column) -> Column:
    """struct(catalog, include, drop) of a site from its probe: the final address, the listing shape and shapes of catalogues.
    Other languages' copies are dropped, but never the prefix that the listings themselves have."""
    root = F.regexp_extract(probe, r"^([a-zA-Z]+://[^/?#]*)", 1)
    bare = lambda c: F.regexp_replace(c, r"[/*]+$", "")
    shape = bare(pattern)
    tries = F.concat(F.array(F.concat(root, shape, F.lit("/"))), F.transform(F.coalesce(catalogues, F.array().cast("array<string>")), lambda c: F.concat(root, bare(c), F.lit("/"))), F.array(probe))
    other = F.filter(F.array(*map(F.lit, LANGUAGES)), lambda x: ~F.startswith(shape, F.regexp_replace(x, "/$", "")))
    quoted = F.regexp_replace(shape, r"([.\\+*?\[\](){}^$|])", r"\\$1")
    return F.struct(tries.alias("catalog"), F.array(F.concat(F.lit("re:"), quoted, F.lit("/[^/]+"))).alias("include"), F.concat(F.array(F.concat(shape, F.lit("/page/"))), other).alias("drop"))


def crawlable(status: Column, pattern: Column) -> Column:
    return (status == "ok") & (F.coalesce(pattern, F.lit("")) != "")
