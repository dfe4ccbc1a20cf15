from __future__ import annotations

from pyspark.sql import functions as F
from test_operators import PAGE

from rooftide.operators import recon, report
from rooftide.sources import catalogue, feeds

SITE = catalogue.register(
    catalogue.Adapter("demo", ref=r"/offer/(\d+)", own="софия|sofia", other="варна", project="new development", include=("/offer/",), drop=("/offer/archive",))
)


def test_outcomes(spark):
    good = PAGE.replace("Обзаведен: да", "Град: София")
    rows = [
        ("http://x/offer/1", good), ("http://x/offer/2", good.replace("<h1>", "<h1>New development ")), ("http://x/offer/3", good.replace("</p>", " ПРОДАДЕН</p>", 1)),
        ("http://x/offer/4", good.replace("София", "Варна")), ("http://x/offer/5", "<h1>София</h1><p>nothing to sell here</p>"),
    ]
    got = {r.ref: (r.outcome, r.record is not None) for r in catalogue.outcomes(spark.createDataFrame(rows, "url string, html string"), SITE).collect()}
    assert got == {"1": ("offer", True), "2": ("project", False), "3": ("unavailable", False), "4": ("outside_city", False), "5": ("rejected", False)}


def test_walk_and_rows(spark):
    link = lambda *urls: "".join(f'<a href="{u}">x</a>' for u in urls)
    pages = [
        ("http://x/sale", link("/sale?page=2", "/offer/1", "/rent?page=2", "/offer/archive/9")), ("http://x/sale?page=2", link("/sale?page=3", "/sale?page=2", "/offer/2")),
        ("http://x/sale?page=3", link("/offer/3")), ("http://x/rent?page=2", link("/sale?page=9")),
    ]
    df = spark.createDataFrame(pages, "url string, html string")
    start = spark.createDataFrame([("http://x/sale",)], "url string")
    assert [(r.url, r.depth) for r in catalogue.walk(df, start).collect()] == [("http://x/sale", 0), ("http://x/sale?page=2", 1), ("http://x/sale?page=3", 2)]
    found = catalogue.catalogue_rows(df, SITE)
    assert sorted(r.link for r in found.collect()) == ["http://x/offer/1", "http://x/offer/2", "http://x/offer/3"]
    assert catalogue.walk(df, start, most=2).count() == 2


def test_verified_pattern(spark):
    shapes = spark.createDataFrame([("s", "/blog/*", 90, ["b1"]), ("s", "/offer/*", 50, ["o1", "o2"]), ("t", "/x/*", 5, ["x1"])], "site string, shape string, n long, samples array<string>")
    kinds = spark.createDataFrame([("b1", "other"), ("o1", "other"), ("o2", "detail"), ("x1", "catalogue")], "url string, kind string")
    assert [(r.site, r.shape, r.n) for r in recon.verified_pattern(shapes, kinds).collect()] == [("s", "/offer/*", 50)]


def test_feeds_and_registry(spark):
    pages = spark.createDataFrame([('[{"id":1,"link":"l","modified":"2026-01-02","title":{"rendered":"New"}},{"id":1,"link":"l","modified":"2026-01-01","title":{"rendered":"Old"}}]',)], "body string")
    assert [(r.id, r.title) for r in feeds.wordpress_rows(pages).collect()] == [(1, "New")]
    agencies = spark.createDataFrame([("a", "A", "https://www.a.bg", None), ("b", "B", "", None)], "slug string, name string, website string, alias_of string")
    rows = spark.createDataFrame([("b", "B2", "", "a")], "slug string, name string, website string, alias_of string")
    assert {r.slug: (r.name, r.duplicate_of) for r in feeds.registry_upsert(agencies, rows).collect()} == {"a": ("A", None), "b": ("B2", "A")}
    found = spark.createDataFrame([("x", "http://a.bg/contact"), ("B", ""), ("new", "")], "name string, website string")
    assert {r.name: r.slug for r in feeds.match_by_host(found, agencies).collect()} == {"x": "a", "B": "b", "new": None}
    urls = spark.createDataFrame([("http://fb.com/x",), ("http://a.bg",)], "url string")
    assert [r.url for r in feeds.without_domains(urls, ["fb.com"]).collect()] == ["http://a.bg"]
    sheet = feeds.sheet_urls(
        spark.createDataFrame([("g", "http://l")], "agency string, url string"), spark.createDataFrame([("g", "see http://c/1 and https://d")], "agency string, cell string"),
        spark.createDataFrame([("g", "http://l")], "agency string, url string"), spark.createDataFrame([("g", "", "me@mail.bg")], "agency string, website string, email string"),
    )
    assert sorted(r.url for r in sheet.collect()) == ["http://c/1", "http://l", "https://d", "https://mail.bg"]


def test_broken_images_and_json_sink(spark, tmp_path):
    stored = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    files = spark.createDataFrame([("a", bytearray(b"\xff\xd8\xff1")), ("b", bytearray(b"<html>"))], "path string, content binary")
    assert {r.path: r.reason for r in feeds.broken_images(stored, files).collect()} == {"b": "corrupt", "c": "missing"}
    feeds.write_trace(stored, f"{tmp_path}/t")
    feeds.write_trace(stored, f"{tmp_path}/t")
    assert spark.read.json(f"{tmp_path}/t").count() == 6
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.html").write_bytes(b"hello")
    assert bytes(feeds.read_files(spark, f"{tmp_path}/f").first().content) == b"hello"
    assert feeds.snapshot_rows(spark.createDataFrame([("u", "h")], "url string, html string")).first().name == "51e69892ab49df85c6230ccc57f8e1d1606caccc"


def test_coverage_and_retries(spark):
    pages = spark.createDataFrame([("c", 1, 3, ["a", "b"]), ("c", 2, 3, ["b", "d"]), ("e", 1, 9, ["a"])], "catalogue string, page int, total int, urls array<string>")
    got = {r.catalogue: (r.urls, r.repeats, r.complete) for r in report.catalogue_coverage(pages).collect()}
    assert got == {"c": (3, 1, True), "e": (1, 0, False)}
    kept = catalogue.in_city(F.col("catalogue"), catalogue.Adapter("z", "x", own="c"))
    assert pages.where(kept).count() == 2
