"""Feeds and text files as DataFrames: JSON, RSS, sitemaps, robots, directories, sheets' links, snapshots, images, traces.

Fetching stays outside the engine. What was fetched is read with Spark's readers, whole files or rows at a time.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_url, host, limited, slugify
from ..operators.lineage import cut

IMAGES_EACH, LEAST_IMAGE = 8, 3000
# First bytes of image files.
MAGIC = (("jpg", "FFD8FF"), ("png", "89504E470D0A1A0A"), ("gif", "47494638"), ("webp", "52494646"))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of binary files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def json_feed(rows: DataFrame, city_field: str, city: str, mapping: dict[str, str]) -> DataFrame:
    """Records of one city with renamed keys; keys that a feed lacks are null."""
    have = set(rows.columns)
    return rows.where(F.col(city_field) == city).select(*((F.col(k) if k in have else F.lit(None).cast("string")).alias(v) for k, v in mapping.items()))


def robots(text: Column) -> Column:
    """struct(disallow, sitemaps), both sorted and distinct; empty values do not count."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))
    values = lambda key: F.array_sort(F.array_distinct(F.filter(F.transform(F.filter(lines, lambda x: F.startswith(F.lower(x), F.lit(f"{key}:"))), lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", ""))), lambda v: v != "")))
    return F.struct(values("disallow").alias("disallow"), values("sitemap").alias("sitemaps"))


def sitemap_locs(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), 1)


def is_sitemap_index(xml: Column) -> Column:
    return F.contains(F.lower(xml), F.lit("<sitemapindex"))


def sitemap_entries(files: DataFrame, url: str = "url", xml: str = "xml") -> DataFrame:
    """(loc, lastmod): entries of page sitemaps that an index leads to, or that no index leads to. files: url, xml as fetched.

    Indexes are followed by joining what they name, until a round finds nothing new."""
    index = files.where(is_sitemap_index(F.col(xml))).select(F.col(url).alias("from"), F.explode(sitemap_locs(F.col(xml))).alias(url))
    roots = files.select(url).join(index.select(url), url, "left_anti")
    reached, edge = roots, roots
    while True:
        edge = cut(edge.withColumnRenamed(url, "from").join(index, "from").select(url).distinct().join(reached, url, "left_anti"))
        if not edge.head(1):
            break
        reached = cut(reached.unionByName(edge))
    pages = files.join(reached, url, "left_semi").where(~is_sitemap_index(F.col(xml)))
    blocks = pages.select(F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<url>(.*?)</url>"), 1)).alias("b"))
    loc = F.get(sitemap_locs(F.col("b")), F.lit(0))
    lastmod = F.nullif(F.regexp_extract("b", r"(?i)<lastmod>\s*([^<\s]+)", 1), F.lit(""))
    return blocks.select(clean_url(loc).alias("loc"), lastmod.alias("lastmod")).where("loc IS NOT NULL").groupBy("loc").agg(F.max("lastmod").alias("lastmod"))


def rss_items(files: DataFrame, page: str = "page", xml: str = "xml") -> DataFrame:
    """(link, title): members of a paged feed; the earliest page's title wins."""
    items = files.select(page, F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), 1)).alias("pos", "item"))
    tag = lambda name: F.trim(F.regexp_replace(F.regexp_extract("item", rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1), r"(?s)^<!\[CDATA\[(.*)\]\]>$", "$1"))
    rows = items.select(page, "pos", tag("link").alias("link"), tag("title").alias("title")).where("link <> ''")
    return rows.groupBy("link").agg(F.min_by("title", F.struct(page, "pos")).alias("title"))


def directory(pages: DataFrame, block: str, fields: dict[str, str], html: str = "html") -> DataFrame:
    """One row per block of a directory page: fields by pattern, one row a name (the largest count), most listings first.
    fields has patterns for name, count, website and phone."""
    blocks = pages.select(F.explode(F.regexp_extract_all(F.col(html), F.lit(block), 1)).alias("b"))
    rows = blocks.select(*(F.trim(F.regexp_extract("b", p, 1)).alias(k) for k, p in fields.items())).where("name <> ''")
    rows = rows.withColumns({"count": F.coalesce(F.col("count").try_cast("int"), F.lit(0)), "slug": slugify(F.col("name"))})
    rest = [c for c in rows.columns if c != "name"]
    return rows.groupBy("name").agg(F.max_by(F.struct(*rest), F.struct("count", "slug")).alias("r")).select("name", "r.*").orderBy(F.desc("count"), "name")


def first_own_domain(links: DataFrame, denied: list[str]) -> DataFrame:
    """(page, website): the first link of each page that leads to another host, no denied one. links: page, position, link."""
    name = host(F.col("link"))
    own = links.where((name != "") & (name != host(F.col("page"))) & ~F.exists(F.array(*map(F.lit, denied)), lambda d: F.contains(name, d)))
    return own.groupBy("page").agg(F.min_by("link", "position").alias("website"))


def rows_of_city(rows: DataFrame, column: str, own: str, others: str) -> DataFrame:
    """Rows of a directory whose text does not name another city, unless it names the own one too; patterns."""
    text = F.coalesce(F.col(column), F.lit(""))
    return rows.where(~text.rlike(f"(?iu){others}") | text.rlike(f"(?iu){own}"))


def sheet_urls(links: DataFrame, cells: DataFrame, offers: DataFrame, agencies: DataFrame) -> DataFrame:
    """(agency, url) from sheets' links, addresses in cells, offers, websites and mailboxes' domains."""
    in_cells = cells.select("agency", F.explode(F.regexp_extract_all("cell", F.lit(r"(https?://[^\s\"'<>]+)"), 1)).alias("url"))
    mail = agencies.select("agency", F.concat(F.lit("https://"), F.regexp_extract("email", r"@([\w.-]+)$", 1)).alias("url")).where("url <> 'https://'")
    every = [links.select("agency", "url"), in_cells, offers.select("agency", "url"), agencies.select("agency", F.col("website").alias("url")), mail]
    out = every[0]
    for x in every[1:]:
        out = out.unionByName(x)
    return out.where("url <> ''").distinct()


def without_domains(urls: DataFrame, denied: list[str], url: str = "url") -> DataFrame:
    name = host(F.col(url))
    return urls.where(~F.exists(F.array(*map(F.lit, denied)), lambda d: F.contains(name, d)))


def registry_upsert(agencies: DataFrame, rows: DataFrame) -> DataFrame:
    """Agencies by slug with the rows' values; an alias then points to the agency that carries its canonical slug."""
    merged = agencies.join(rows, "slug", "left_anti").unionByName(rows, allowMissingColumns=True)
    target = merged.select(F.col("slug").alias("alias_of"), F.col("name").alias("duplicate_of"))
    return merged.drop("duplicate_of").join(target, "alias_of", "left")


def _domains(name: Column) -> Column:
    """A host and all domains that it lies in, longest first, down to two labels."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def match_by_host(found: DataFrame, agencies: DataFrame) -> DataFrame:
    """found (name, website) with the agency's slug: by host, where one's may lie in the other's domain (the closest counts),
    else by the name's slug. Hosts meet by equal domains, not by containment."""
    own = agencies.where(host(F.col("website")) != "").select(F.col("slug").alias("s1"), host(F.col("website")).alias("h1"))
    keyed = found.withColumns({"h": host(F.col("website")), "s": slugify(F.col("name")), "n": F.monotonically_increasing_id()})
    hosts = keyed.where("h <> ''").select("h").distinct()
    below = hosts.select("h", F.posexplode(_domains(F.col("h"))).alias("far", "h1")).join(own, "h1").select("h", "s1", "far")
    above = own.select("s1", F.posexplode(_domains(F.col("h1"))).alias("far", "h")).join(hosts, "h").select("h", "s1", "far")
    closest = below.unionByName(above).groupBy("h").agg(F.min(F.struct("far", "s1")).alias("m")).select("h", F.col("m.s1").alias("s1"))
    by_slug = agencies.select(F.col("slug").alias("s2"))
    joined = keyed.join(closest, "h", "left").join(by_slug, F.col("s") == F.col("s2"), "left")
    return joined.select(*found.columns, F.coalesce("s1", "s2").alias("slug"))


#: Sets of one byte a letter that pages declare, by the codec that knows them. Browsers read Latin-1 as Windows-1252.
SINGLE_BYTE = {
    "cp1252": ("iso-8859-1", "latin-1", "latin1", "windows-1252", "cp1252", "us-ascii", "ascii"),
    "cp1251": ("windows-1251", "cp1251", "win-1251", "x-cp1251"),
    "koi8_r": ("koi8-r", "koi8"), "koi8_u": ("koi8-u",), "iso8859_5": ("iso-8859-5", "cyrillic"), "cp866": ("ibm866", "cp866"),
    "mac_cyrillic": ("x-mac-cyrillic", "maccyrillic"), "cp1250": ("windows-1250", "cp1250"), "iso8859_2": ("iso-8859-2", "latin2"),
    "cp1253": ("windows-1253", "cp1253"), "iso8859_7": ("iso-8859-7", "greek"), "cp1254": ("windows-1254", "iso-8859-9", "latin5"),
    "iso8859_15": ("iso-8859-15", "latin9"),
}
HEAD_BYTES = 8192


def decode(content: Column, header_charset: Column) -> Column:
    """Text of fetched bytes: the header's character set, then the page's own, else UTF-8, as for sets that are not known.

    Spark decodes a few sets only; one of a byte a letter is Latin-1 with its upper half mapped."""
    latin = F.decode(content, "ISO-8859-1")
    own = F.regexp_extract(F.left(latin, F.lit(HEAD_BYTES)), r"(?i)charset\s*=\s*[\"']?([\w-]+)", 1)
    declared = F.lower(F.coalesce(F.nullif(header_charset, F.lit("")), F.nullif(own, F.lit("")), F.lit("utf-8")))
    upper = "".join(map(chr, range(0x80, 0x100)))
    out = F.decode(content, "UTF-8")
    for codec, names in SINGLE_BYTE.items():
        out = F.when(declared.isin(*names), F.translate(latin, upper, bytes(range(0x80, 0x100)).decode(codec, "replace"))).otherwise(out)
    return F.when(declared.isin("utf-16", "utf-16le", "utf-16be"), F.decode(content, "UTF-16")).otherwise(out)


def _unpack(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(blob: bytes | None) -> bytes | None:
        if blob is None or not blob.startswith(GZIP):
            return blob
        try:
            return gzip.decompress(blob)
        except (OSError, EOFError, zlib.error):
            return None

    for part in parts:
        yield part.map(one, na_action="ignore")


GZIP = bytes.fromhex("1f8b")


def unpacked(files: DataFrame, content: str = "content") -> DataFrame:
    """files with gzip contents unpacked, in Python workers over Arrow batches; a broken archive becomes null."""
    return files.withColumn(content, F.pandas_udf(_unpack, "binary")(F.col(content)))


def snapshot_rows(pages: DataFrame, url: str = "url") -> DataFrame:
    """Pages under a name by content address, for a store that is read again without the network."""
    return pages.withColumns({"name": F.sha1(url), "sha256": F.sha2(F.col("html").cast("binary"), 256)})


def gunzip_needed(content: Column) -> Column:
    return F.startswith(content, F.lit(GZIP))


def image_kind(content: Column) -> Column:
    start = F.hex(F.substring(content, 1, 12))
    out = F.lit(None).cast("string")
    for name, magic in reversed(MAGIC):
        mark = F.startswith(start, F.lit(magic))
        if name == "webp":
            mark = mark & F.endswith(start, F.lit("57454250"))
        out = F.when(mark, F.lit(name)).otherwise(out)
    return out


def import_images(files: DataFrame, each: int | None = IMAGES_EACH) -> DataFrame:
    """(offer_id, sha256, position, kind): distinct images of a listing, the first each of them, or all if that is None. files:
    offer_id, position, content."""
    good = files.where((F.length("content") >= LEAST_IMAGE) & image_kind(F.col("content")).isNotNull())
    hashed = good.select("offer_id", "position", F.sha2("content", 256).alias("sha256"), image_kind(F.col("content")).alias("kind"))
    once = hashed.groupBy("offer_id", "sha256").agg(F.min("position").alias("position"), F.first("kind").alias("kind"))
    if each is None:
        return once
    w = Window.partitionBy("offer_id").orderBy("position", "sha256")
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= each).drop("place")


def image_counts(offers: DataFrame, images: DataFrame) -> DataFrame:
    """offers with image_count as the stored images say."""
    counts = images.groupBy("offer_id").agg(F.count("*").cast("int").alias("image_count")).withColumnRenamed("offer_id", "id")
    return offers.drop("image_count").join(counts, "id", "left").withColumn("image_count", F.coalesce("image_count", F.lit(0)))


def broken_images(stored: DataFrame, files: DataFrame) -> DataFrame:
    """Stored images whose file is missing or no image: (path, reason)."""
    have = files.select("path", image_kind(F.col("content")).alias("kind"), F.lit(True).alias("there"))
    reason = F.when(F.col("there").isNull(), "missing").when(F.col("kind").isNull(), "corrupt")
    return stored.select("path").join(have, "path", "left").select("path", reason.alias("reason")).where("reason IS NOT NULL")


def write_trace(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_report(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("append").parquet(path)


def wordpress_rows(pages: DataFrame, body: str = "body") -> DataFrame:
    """(id, link, title, modified) of stored REST pages, newest first within equal ids; pages: body (a JSON array)."""
    item = "array<struct<id:bigint,link:string,modified:string,title:struct<rendered:string>>>"
    rows = pages.select(F.explode(F.from_json(F.col(body), item)).alias("x")).select("x.id", "x.link", F.col("x.title.rendered").alias("title"), "x.modified")
    return rows.groupBy("id").agg(F.max_by(F.struct("link", "title", "modified"), "modified").alias("r")).select("id", "r.*")


def sheet_text(row: DataFrame, columns: dict[str, int]) -> DataFrame:
    """Text columns trimmed and cut to their stored lengths; null becomes ''."""
    return row.withColumns({c: limited(F.col(c), n) for c, n in columns.items()})
