from __future__ import annotations

import datetime
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rooftide.functions import features
from rooftide.operators import fuzzy, geo, latest, match, merge, recon, report, search
from rooftide.plans import jobs
from rooftide.sources import feeds, html

OFFER = "id long, agency_id long, agency_slug string, title string, notes string, kind string, price double, price_per_m2 double, area double, bedrooms int, floor int, location string, deal string, is_active boolean, url string, first_seen int, last_seen int, dedup_key string, city string, city_active boolean, neighbourhood string"


def offers(spark, rows):
    base = {"agency_id": 1, "agency_slug": "a", "title": "Flat", "notes": "", "kind": "apartment", "deal": "sale", "is_active": True, "url": "u", "first_seen": 1, "last_seen": 1, "dedup_key": "", "city": "sofia", "city_active": True, "location": "x"}
    names = [x.split()[0] for x in OFFER.split(", ")]
    return spark.createDataFrame([tuple((base | {"id": i} | r).get(n) for n in names) for i, r in enumerate(rows, 1)], OFFER)


def ids(df):
    return [r.id for r in df.collect()]


def test_missing_values_pass_filters(spark):
    df = offers(spark, [{"price": 5.0}, {"price": None}, {"price": 50.0, "area": 10.0}, {"bedrooms": 1}, {"is_active": False}, {"url": ""}])
    assert sorted(ids(search.filtered(search.live(df), {"price_max": "10"}))) == [1, 2, 4]
    assert sorted(ids(search.filtered(search.live(df), {"beds": "2", "price_min": "x"}))) == [1, 2, 3]


def test_sorts_and_pages(spark):
    df = offers(spark, [{"price": 5.0}, {"price": None}, {"price": 5.0}, {"price": 1.0}])
    assert ids(search.page_of(df, "price_asc")) == [4, 3, 1, 2] and ids(search.page_of(df, "price_desc")) == [3, 1, 4, 2]
    assert ids(search.page_of(df, "price_asc", 2, 3)) == [2]
    assert search.clamp_page("9", 26) == 2 and search.clamp_page("x", 26) == 1 and search.clamp_page(None, 0) == 1 and search.clamp_page(-3, 9) == 1


def test_scope_fails_closed(spark):
    df = offers(spark, [{"neighbourhood": "n"}, {"neighbourhood": None}, {"neighbourhood": "m"}, {"city": "varna", "neighbourhood": "n"}, {"city_active": False}])
    known = spark.createDataFrame([("sofia", "n", True), ("sofia", "m", False)], "city string, slug string, active boolean")
    scope = lambda c, n: sorted(ids(search.neighbourhood_scope(search.city_scope(df, c), c, n, known)))
    assert scope("sofia", "n") == [1, 2] and scope(None, "n") == [] and scope("sofia", "m") == [] and scope("sofia", None) == [1, 2, 3]


def test_search_serialises(spark):
    df = offers(spark, [{"title": "50% Off", "price": 0.0, "dedup_key": "k"}, {"title": "500 Off"}])
    out = search.search(df, {"q": "50%", "page": "7"})
    (row,) = out["results"].collect()
    assert (out["total"], out["page"], row.price, row.cluster_key) == (1, 1, None, "sofia:sale:k") and row.missing == ["area_m2", "bedrooms", "floor"]
    assert row.confidence == pytest.approx(0.4)


def test_siblings_stay_in_city_and_deal(spark):
    df = offers(spark, [{"dedup_key": "k"}, {"dedup_key": "k"}, {"dedup_key": "k", "city": "varna"}, {"dedup_key": "k", "deal": "rent"}, {"dedup_key": ""}, {"dedup_key": "k", "city": None}])
    assert sorted((r.id, r.sibling_id) for r in search.siblings(df).collect()) == [(1, 2), (2, 1)]


def test_photo_filter_and_first_image(spark):
    df = offers(spark, [{}, {}])
    images = spark.createDataFrame([(1, 2, 1, "b"), (1, 1, 9, "a"), (1, 1, 10, "c")], "offer_id long, position int, image_id int, local_path string")
    assert ids(search.filtered(df, {"with_photo": "1"}, images)) == [1]
    assert [tuple(r) for r in search.first_image(images).collect()] == [(1, "a")]


def test_legacy_sort_drops_nulls(spark):
    assert ids(search.legacy_price_sort(offers(spark, [{"price": 1.0}, {}]), "price_asc")) == [1]


# --- merges ------------------------------------------------------------------------------------------------------------

STATE = "k string, price_eur double, title string, flag boolean, is_active boolean, first_seen int, last_seen int, last_changed int, times_seen int"


def run_merge(spark, old, new, policy=merge.SHEET):
    state = spark.createDataFrame(old, STATE)
    incoming = spark.createDataFrame(new, "k string, price_eur double, title string, flag boolean")
    merged = merge.merge(state, incoming, ["k"], ["price_eur", "title", "flag"], F.lit(9), policy, "price_eur")
    return {r.k: r for r in merged.collect()}, Counter((r.k, r.event, r.field, r.old_value, r.new_value) for r in merge.history(merged, ["k"], F.lit(9), policy).collect())


def test_merge_sheet(spark):
    old = [("a", 120000.0, "t", None, True, 1, 2, 1, 3), ("b", None, "t", True, True, 1, 2, 1, 3), ("c", 5.0, "t", None, True, 1, 2, 1, 3), ("d", 5.0, "t", None, False, 1, 2, 1, 3)]
    got, log = run_merge(spark, old, [("a", 110000.0, "t", None), ("b", None, "t", False), ("e", 1.0, "n", None), ("d", 5.0, "t", None)])
    assert {k: r.outcome for k, r in got.items()} == {"a": "changed", "b": "changed", "c": "gone", "d": "unchanged", "e": "new"}
    assert got["a"].prev_price == 120000.0 and got["a"].times_seen == 4 and got["d"].is_active and not got["c"].is_active and got["c"].last_changed == 9
    assert log == Counter({("a", "changed", "price_eur", "120000", "110000"): 1, ("b", "changed", "flag", "1", "0"): 1, ("c", "removed", "is_active", "1", "0"): 1, ("e", "new", "", "", ""): 1})


def test_merge_policies(spark):
    old = [("a", 1.0, "t", None, False, 1, 2, 1, 3), ("b", 2.0, "t", None, True, 1, 2, 1, 3)]
    got, log = run_merge(spark, old, [("a", None, "", None), ("n", 1.0, "t", None)], merge.VERIFIED)
    assert (got["a"].price_eur, got["a"].title, got["a"].outcome) == (1.0, "t", "returned") and got["b"].outcome == "absent" and got["b"].is_active
    assert ("a", "returned", "is_active", "0", "1") in log
    got, log = run_merge(spark, old, [("b", None, "t", None), ("n", 1.0, "t", None)], merge.WEB)
    assert got["b"].price_eur is None and got["b"].prev_price == 2.0 and log == Counter({("b", "changed", "price_eur", "2", ""): 1})


values = st.tuples(st.sampled_from("abcdef"), st.one_of(st.none(), st.floats(0, 9, allow_nan=False)), st.sampled_from([None, "", "x"]), st.one_of(st.none(), st.booleans()))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(values, unique_by=lambda v: v[0]))
def test_merging_a_snapshot_twice_changes_nothing(spark, rows):
    state = spark.createDataFrame([], STATE)
    incoming = spark.createDataFrame(rows, "k string, price_eur double, title string, flag boolean")
    args = (["k"], ["price_eur", "title", "flag"])
    once = merge.merge(state, incoming, *args, F.lit(1))
    columns = [x.split()[0] for x in STATE.split(", ")]
    again = merge.merge(spark.createDataFrame(once.select(columns).collect(), STATE), incoming, *args, F.lit(2))
    assert {r.outcome for r in again.collect()} <= {"unchanged"} and merge.history(again, ["k"], F.lit(2)).count() == 0


def test_weak_rekey(spark):
    state = spark.createDataFrame([("g", "old1", "w", True), ("g", "old2", "v", True), ("g", "old3", "v", True), ("g", "gone", "u", False)], "a string, fp string, weak string, is_active boolean")
    new = spark.createDataFrame([("g", "n1", "w"), ("g", "n2", "v"), ("g", "n3", "u"), ("h", "n4", "w")], "a string, fp string, weak string")
    assert {r.fp: r.old_key for r in merge.rekeyed(state, new, ["a"], "fp", "weak").collect()} == {"n1": "old1", "n2": None, "n3": None, "n4": None}


def test_sync_sheets(spark):
    schema = "agency_id string, fingerprint string, weak_core string, price_eur double, title string"
    state = spark.createDataFrame([("g", "f1", "w", 10.0, "t", True, 1, 1, 1, 1), ("h", "f9", "", 1.0, "t", True, 1, 1, 1, 1)], f"{schema}, is_active boolean, first_seen int, last_seen int, last_changed int, times_seen int")
    rows = spark.createDataFrame([("g", "f2", "w", 12.0, "t", 1), ("g", "f2", "w", 13.0, "t", 2), ("g", "", "", 1.0, "t", 3)], f"{schema}, source_row int")
    merged, log, counts = jobs.sync_sheets(state, rows, F.lit(2))
    assert [(r.fingerprint, r.price_eur, r.outcome, r.prev_price) for r in merged.collect()] == [("f2", 12.0, "changed", 10.0)]
    assert Counter((r.outcome, r.n) for r in counts.collect()) == Counter({("changed", 1): 1, ("rekeyed", 1): 1}) and log.count() == 1


def test_retire_guard_and_sold(spark):
    state = spark.createDataFrame([("a", "1", True), ("a", "2", True), ("b", "3", True), ("b", "4", True), ("b", "5", True)], "agency_id string, url string, is_active boolean")
    seen = spark.createDataFrame([("a", "1"), ("b", "3")], "agency_id string, url string")
    assert [tuple(r) for r in merge.retire_missing(state, seen).select("agency_id", "url").collect()] == [("a", "2")]
    web = spark.createDataFrame([("web1", 1.0, True, 1, 1, 1, 1)], "fingerprint string, price_eur double, is_active boolean, first_seen int, last_seen int, last_changed int, times_seen int")
    out, log = jobs.store_web(web, spark.createDataFrame([("http://x", 2.0, "sold"), ("http://y", 3.0, "active")], "url string, price_eur double, status string"), F.lit(2))
    assert out.count() == 2 and log.count() == 0


def test_retire_agency_and_previous_price(spark):
    state = spark.createDataFrame([(1, "a", True, 1), (2, "b", True, 1), (3, "a", False, 1)], "id long, agency_id string, is_active boolean, last_changed int")
    out, log = merge.retire_agency(state, spark.createDataFrame([("a",)], "agency_id string"), F.lit(5))
    assert {r.id: r.is_active for r in out.collect()} == {1: False, 2: True, 3: False} and [r.id for r in log.collect()] == [1]
    moves = spark.createDataFrame([(1, 1, 1, "changed", "price_eur", "10.00"), (1, 2, 2, "changed", "price_eur", "12.50"), (1, 3, 3, "changed", "title", "x")], "id long, seq int, changed_on int, event string, field string, old_value string")
    assert [(r.id, float(r.prev_price)) for r in merge.previous_price(moves).collect()] == [(1, 12.5)]


def test_latest_probe_ignores_late_rows(spark):
    t = datetime.datetime
    rows = [("a", 2, t(2026, 1, 2), t(2026, 1, 3), "new"), ("a", 1, t(2026, 1, 1), t(2026, 1, 9), "late"), ("b", 1, t(2026, 1, 1), t(2026, 1, 1), "only"), ("c", 3, None, t(2025, 1, 1), "null")]
    df = spark.createDataFrame(rows, "agency_slug string, run_id int, run_started timestamp, probed_at timestamp, status string")
    assert {r.agency_slug: r.status for r in latest.latest_probe(df).collect()} == {"a": "new", "b": "only", "c": "null"}
    assert [r.status for r in latest.current_run(df.where("run_started IS NOT NULL")).collect()] == ["new"]
    sample = latest.interleaved_sample(spark.createDataFrame([(f"u{i}", "sale" if i < 8 else "rent") for i in range(10)], "url string, deal string"), "deal", 4, 1)
    assert Counter(r.deal for r in sample.collect()) == Counter(sale=2, rent=2)


# --- fuzzy ---------------------------------------------------------------------------------------------------------------


def test_similar_texts_match_brute_force(spark):
    import itertools
    import random

    from rooftide.functions.text import similarity, trigrams

    rng = random.Random(1)
    names = sorted({" ".join(rng.choice(["grand", "grant", "kamelia", "kameliya", "park", "parks", "beach", "sun"]) for _ in range(rng.randrange(1, 4))) for _ in range(60)})
    df = spark.createDataFrame([(n,) for n in names], "text string")
    for threshold in (0.3, 0.55, 0.8, 1.0):
        got = {(r.a, r.b) for r in fuzzy.similar_texts(df, df, threshold).collect()}
        pairs = spark.createDataFrame(list(itertools.product(names, names)), "a string, b string")
        want = {(r.a, r.b) for r in pairs.where(similarity(trigrams(F.col("a")), trigrams(F.col("b"))) >= threshold).collect()}
        assert got == want


def test_possible_duplicates(spark):
    schema = "id long, agency_id long, city string, location string, deal string, bedrooms int, area double, price double, title_norm string, is_active boolean"
    rows = [(1, 1, "c", "l", "sale", 2, 60.0, 100.0, "grand kameliya", True), (2, 2, "c", "l", "sale", None, 62.0, 103.0, "grand kamelia", True), (3, 2, "c", "l", "sale", 2, 60.0, 104.0, "grand kamelia", True),
            (4, 2, "d", "l", "sale", 2, 60.0, 100.0, "grand kameliya", True), (5, 1, "c", "l", "sale", 2, 60.0, 100.0, "grand kameliya", True), (6, 3, "c", "l", "sale", 2, 60.0, 100.0, "grand kameliya", False)]
    df = spark.createDataFrame(rows, schema)
    assert [(r.id, r.other_id, r.place) for r in fuzzy.possible_duplicates(df.where("id = 1"), df).collect()] == [(1, 2, 1)]


def test_corpus_votes(spark):
    located = spark.createDataFrame([("sun park one", "A"), ("sun park one", "A"), ("sun park two", "A"), ("moon hill", "B"), ("moon hill", "C")], "text string, location string")
    asked = spark.createDataFrame([(1, "sun park one"), (2, "moon hill"), (3, "other")], "id long, text string")
    assert [(r.id, r.location) for r in fuzzy.corpus_votes(asked, located).collect()] == [(1, "A")]


# --- places --------------------------------------------------------------------------------------------------------------


def test_geo_resolution(spark):
    cities = spark.createDataFrame([("sofia", "София", "Sofia"), ("varna", "Варна", "Varna")], "slug string, name_bg string, name_en string")
    aliases = spark.createDataFrame([("sofia", "mladost 1", "mladost-1"), ("sofia", "mladost 1 a", "mladost-1a"), ("sofia", "lyulin 10", "lyulin-10"), ("sofia", "lyulin 1", "lyulin-1"), ("sofia", "bulgaria", "bulgaria"), ("varna", "chayka", "chayka"), ("sofia", "iztok", "iztok")], "city string, alias string, place string")
    rows = [
        (1, "София, Mladost 1A", "", None), (2, "", "гр. София Люлин-10", None), (3, "София или Варна, Чайка", "", "sofia"), (4, "Каварна", "област Варна", "varna"), (5, "кв. Чайка", "", "varna"),
        (6, "Sofia Bulgaria", "", None), (7, "Sofia, kv Bulgaria", "", None), (8, "", "", None), (9, "София Изток Люлин 10", "", None),
    ]
    df = spark.createDataFrame(rows, "id long, location string, location_raw string, source_city string")
    got = {r.id: (r.city, r.neighbourhood, r.confidence, r.matched_by) for r in geo.resolve(df, cities, aliases).collect()}
    assert got[1] == ("sofia", "mladost-1a", "0.95", "alias") and got[2][:2] == ("sofia", "lyulin-10")
    assert got[3] == (None, None, "0.00", "unresolved") and got[4][0] is None and got[5] == ("varna", "chayka", "0.95", "alias")
    assert got[6] == ("sofia", None, "0.40", "city_text") and got[7][1] == "bulgaria" and got[8][3] == "unresolved" and got[9][1] is None


def test_adjacency(spark):
    clusters = spark.createDataFrame([(i, p) for i, c in enumerate(geo.CLUSTERS) for p in c], "cluster int, place string")
    near = geo.adjacent_to(spark.createDataFrame([("Албена",), ("Балчик",)], "place string"), clusters)
    assert {r.place for r in near.collect()} == {"Каварна", "Златни пясъци"}


# --- buyers --------------------------------------------------------------------------------------------------------------


def test_profiles():
    good = match.validate_profile({"city": "sofia", "rooms": "2", "neighbourhoods": ["n", "n"], "features": ["lift"]}, {"sofia"}, {"sofia": {"n"}})
    assert good["rooms"] == 2 and good["neighbourhoods"] == ["n"] and good["deal"] == "sale"
    for bad in ({}, {"city": "x"}, {"city": "sofia", "rooms": 0}, {"city": "sofia", "rooms": True}, {"city": "sofia", "price_min": 5, "price_max": 4}, {"city": "sofia", "pets": "cow"}, {"city": "sofia", "features": ["x"]}, {"city": "sofia", "price_max": "-1"}):
        with pytest.raises(match.ProfileError):
            match.validate_profile(bad, {"sofia"}, {})


def test_matching(spark):
    profile = match.validate_profile({"city": "sofia", "rooms": 2, "price_max": 100, "features": ["garden"]}, {"sofia"}, {})
    df = offers(spark, [{"kind": "двустаен", "price": 90.0, "notes": "двор"}, {"kind": "", "price": None}, {"kind": "двустаен", "price": 200.0}, {"kind": "apartment", "bedrooms": 3}, {"kind": "гараж"}, {"kind": "двустаен", "notes": "Без двор"}])
    got = match.matches(df, profile).collect()
    assert [(r.id, r.confidence, r.band) for r in got] == [(1, 100, "verified"), (2, 36, "unverified")]
    assert "rooms 2" in got[1].unknown and "kind" in got[0].reasons
    assert match.matches(df, profile, 2).count() == 0


def test_match_pages(spark):
    df = offers(spark, [{"first_seen": i} for i in range(26)])
    profile = match.validate_profile({"city": "sofia"}, {"sofia"}, {})
    one, two = (ids(match.matches(df, profile, p)) for p in (1, 2))
    assert len(one) == 24 and len(two) == 2 and not set(one) & set(two) and one[0] == 26


def test_wishlist(spark):
    df = offers(spark, [{}, {"is_active": False}])
    assert [(r.id, r.available) for r in match.wishlist(df, [2, 1, 2, 9]).orderBy("place").collect()] == [(2, False), (1, True), (9, False)]
    with pytest.raises(match.ProfileError):
        match.wishlist(df, [0])


# --- pages, feeds, reports ---------------------------------------------------------------------------------------------

PAGE = """<html><head><title>Flat | Site</title><meta property="og:image" content="http://x/a.jpg"><script type="application/ld+json">
{"@graph": [{"@type": "Apartment", "name": "Two-room flat by the park", "offers": {"price": "97 000", "priceCurrency": "EUR"}}]}</script></head>
<body><nav>Studios up to 55 000€</nav><div class="site-menu">Rent 400 €</div><h1>Two-room flat by the park</h1>
<p>Цена: 185 000 €</p><p>Площ: 65,5 кв.м</p><p>Спални: 2</p><p>Етаж: 3</p><p>Обзаведен: да</p><p>Етажност: 26</p>
<p>Просторен апартамент с гледка към парка, близо до училище и метро, с асансьор и паркомясто в гаража.</p><a href="/next">n</a></body></html>"""


def test_page_extraction(spark):
    bare = "<html><body><h1>About our company</h1>" + "<p>We are an agency with many years of experience in the market.</p>" * 4 + "</body></html>"
    df = spark.createDataFrame([("http://x/1", PAGE), ("http://x/2", bare), ("http://x/3", None)], "url string, html string")
    (row,) = html.extract(df).collect()
    assert (row.url, row.title, row.price, row.area, row.bedrooms, row.floor, row.deal, row.status, row.furnished) == ("http://x/1", "Two-room flat by the park", 185000.0, 65.5, 2, 3, "sale", "active", True)
    assert row.features["lift"] is True and row.price_per_m2 == pytest.approx(2824.43) and row.fingerprint.startswith("web") and not row.price_derived
    page = html.with_page(df).first().page
    assert "55 000" not in page.content and "400" not in page.content and page.links == ["/next"] and page.og["image"] == "http://x/a.jpg"


def test_rate_times_area_is_marked(spark):
    df = spark.createDataFrame([({"price_per_m2": "1 150 €", "area": "40 кв. м."},)], "spec map<string,string>")
    empty_ld = F.array().cast("array<map<string,string>>")
    row = df.select(html.asking_price(F.col("spec"), empty_ld, F.lit("")).alias("p")).first().p
    assert (row.value, row.derived) == (46000.0, True)


def test_links_and_siblings(spark):
    body = "".join(f'<a href="/offer/{1000 + i}#x">o</a>' for i in range(10)) + '<a href="mailto:a@b">m</a><a href="/a.css">c</a><a href="http://other/offer/1000">o</a>'
    df = spark.createDataFrame([(1, "http://h/offer/999", body)], "page_id long, url string, html string")
    links = recon.links_on(df, ["page_id"])
    assert links.count() == 10
    assert recon.sibling_counts(links, df, "page_id").first().siblings == 10
    assert df.select(recon.page_kind(F.lit("100 000 € 60 m2"), F.lit(10))).first()[0] == "catalogue"


def test_sitemaps(spark):
    rows = [("i", "<sitemapindex><loc>a</loc><loc>b</loc></sitemapindex>"), ("a", "<url><loc>http://x/1</loc><lastmod>2026-01-01</lastmod></url><url><loc>http://x/2#f</loc></url>"), ("b", "<url><loc>http://x/1</loc><lastmod>2026-02-01</lastmod></url>")]
    got = feeds.sitemap_entries(spark.createDataFrame(rows, "url string, xml string")).collect()
    assert {r.loc: r.lastmod for r in got} == {"http://x/1": "2026-02-01", "http://x/2": None}


def test_rss_directory_images(spark):
    rss = spark.createDataFrame([(1, "<item><title><![CDATA[One]]></title><link>l1</link></item>"), (2, "<item><link>l1</link><title>Late</title></item><item><link>l2</link><title>Two</title></item>")], "page int, xml string")
    assert {r.link: r.title for r in feeds.rss_items(rss).collect()} == {"l1": "One", "l2": "Two"}
    page = spark.createDataFrame([("<li><b>Имот</b> 12 <a>w.bg</a></li><li><b>Имот</b> 3</li><li><b>Дом</b></li>",)], "html string")
    rows = feeds.directory(page, r"<li>(.*?)</li>", {"name": "<b>(.*?)</b>", "count": r"(\d+)", "website": "<a>(.*?)</a>", "phone": r"tel:(\d+)"}).collect()
    assert [(r.name, r["count"], r.slug) for r in rows] == [("Имот", 12, "imot"), ("Дом", 0, "dom")]
    jpg = bytearray(b"\xff\xd8\xff" + b"0" * 4000)
    files = spark.createDataFrame([(1, i, bytearray(jpg + bytes([i % 10]))) for i in range(20)] + [(1, 99, bytearray(b"x" * 5000)), (2, 1, jpg[:100])], "offer_id long, position int, content binary")
    assert feeds.import_images(files).count() == 8


def test_reports(spark):
    trace = spark.createDataFrame([("a", "offer", 10, i, ["price"]) for i in (5, 1, 9, 7)] + [("b", "error", 1, None, [])], "agency string, outcome string, bytes long, ms long, fields_found array<string>")
    got = {r.agency: r for r in report.crawl_report(trace, ["price"], ["offer", "error"]).collect()}
    assert got["a"].median_ms == 7 and got["a"].price_pct == 100.0 and got["b"].n_error == 1 and got["b"].median_ms is None
    assert report.to_markdown(report.run_totals(trace).orderBy("outcome")).splitlines()[2] == "| error | 1 | 1 |"


def test_price_repairs_and_salvage(spark):
    df = spark.createDataFrame([(1, 1019.0, 108.0, None, "1 019 €/m2", ""), (2, 7215000.0, 60.0, None, "Изток 7\n215 000 €", ""), (3, 5.0, 1.0, None, "5 €", "")], "id long, price double, area double, price_per_m2 double, price_raw string, notes string")
    assert [(r.id, r.price) for r in jobs.fix_prices(df).collect()] == [(1, 110052.0)]
    assert [(r.id, r.price) for r in jobs.fix_split_prices(df).collect()] == [(2, 215000.0)]
    rows = [(1, "Sunny Dreams", "sunny dreams", "Бяла", "", "", ""), (2, "Sunny Dreams", "sunny dreams", "Бяла", "", "", ""), (3, "Sunny Dreams", "sunny dreams", "", "", "", ""), (4, "Other", "other", "", "Burgаs", "", ""), (5, "Other2", "other2", "", "", "", "Обзор"), (6, "x", "x", "", "", "", "")]
    offers_df = spark.createDataFrame(rows, "id long, title string, title_norm string, location string, location_raw string, notes string, source_tab string")
    vocabulary = [("burgas", "Бургас"), ("обзор", "Обзор")]
    assert {r.id: (r.location, r.source) for r in jobs.salvage_locations(offers_df, vocabulary).collect()} == {3: ("Бяла", "corpus"), 4: ("Бургас", "reread"), 5: ("Обзор", "tab")}
    assert jobs.salvage_to_fixpoint(offers_df, vocabulary).where("location = ''").count() == 1


def test_verify_and_checksums(spark):
    df = spark.createDataFrame([("u1", True, 1), ("u2", True, 1), ("u3", True, 1)], "url string, is_active boolean, last_seen int")
    seen = spark.createDataFrame([("u1", 404), ("u2", 200)], "url string, status int")
    assert {r.url: (r.verdict, r.is_active, r.last_seen) for r in jobs.verify(df, seen, F.lit(7)).collect()} == {"u1": ("withdrawn", False, 1), "u2": ("alive", True, 7), "u3": ("unknown", True, 1)}
    assert merge.row_checksum(df).first() == merge.row_checksum(df.repartition(2)).first() != merge.row_checksum(df.limit(2)).first()


def test_chrome_by_words_first_heading_and_structured_facts():
    from rooftide.sources import html

    page = html.parse_page(
        '<title>Site</title><div class="main-menu">77 000 EUR</div><div class="research">kept words</div><button>66 000 EUR</button><h1>First heading</h1><p>body</p><h1>Second</h1><div id="property-modal">gone</div>'
        '<script type="application/ld+json">{"@type":"House","address":{"addressLocality":"Sofia"}}</script>'
    )
    assert page["h1"] == "First heading" and page["content"].startswith("First heading") and "Second" in page["content"]
    assert not any(x in page["content"] for x in ("77 000", "66 000", "gone")) and len(page["ld"]) == 2
    buried = html.parse_page('<div class="page header"><h1>Buried heading</h1></div><p>text</p>')
    assert buried["h1"] == "Buried heading" and buried["content"] == "text"


def test_image_files_of_many_images(spark, tmp_path):
    from rooftide.queries import rules

    # 1,500 good files and 1,500 broken ones of one offer.
    spark.range(6000).selectExpr("id * 150 + id % 2 AS p_partkey").where("p_partkey % 300 = 0 OR p_partkey % 300 = 151").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.offer_id: (r.images, r.broken) for r in rules.image_files(spark, str(tmp_path)).collect()}
    want = {o: [0, 0] for o in (0, 151)}
    for i in range(6000):
        key = i * 150 + i % 2
        if key % 300 in want:
            want[key % 300][key % 4 >= 2] += 1
    assert got == {o: tuple(n) for o, n in want.items()} and max(map(max, want.values())) > 1000


@pytest.mark.parametrize("name", ["listing_pages", "structured_pages"])
def test_pages_of_a_small_file_are_dealt_out(spark, tmp_path, name):
    from rooftide.queries import rules

    spark.range(6000).selectExpr("id AS p_partkey", "CAST(id % 50 + 1 AS INT) AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert rules.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_texts_folded_in_parts(spark):
    rows = [("Море!", "?", None), (None, None, None), ("", "Straße, \u0301x", "sea! view"), ("!", "no", "ΟΔΟΣ"), (" a ", "-b-", "c.")]
    columns = {c: F.col(c) for c in ("title", "notes", "view")}
    parts, fields = features.folded_parts(columns), ("view", "title", "notes", "documents")
    got = spark.createDataFrame(rows, "title string, notes string, view string").select(features.folded(columns, fields).alias("a"), features.joined(parts, fields).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and got[1].b == "" and "sea  view" in got[2].b


def test_label_pairs_by_line(spark):
    text = "Гледка към: \n: 5\nno colon here Цена 5\nЦена: 5 € Площ: 60\nПлощ:70\nЦена: 9"
    got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(html.label_pairs(F.col("t")).alias("m")).collect()
    assert got[0].m == {"price": "5 € Площ", "area": "70"} and got[1].m == {} and got[2].m is None


def test_references_cut_off_stay_as_they_are(spark):
    text = '<h1>a&amp;&amp;&amp</h1><a href="/x?a=1&amp;b=2&copy">l</a><p>R&D &quot &ampere; &#65; &#x42; &#6</p><script type="application/ld+json">{"name": "A & B &amp"}</script>'
    page = html.parse_page(text, closed=True)
    assert (page["h1"], page["links"], page["ld"]) == ("a&&&amp", ["/x?a=1&b=2&copy"], [{"name": "A & B &amp"}])
    assert page["content"].endswith("R&D &quot &ampere; A B &#6")
    assert html.parse_page(text)["h1"] == "a&&&"
    row = html.with_page(spark.createDataFrame([(text,)], "html string"), closed=True).first().page
    assert row.h1 == "a&&&amp"


def test_long_reports_say_that_they_are_cut(spark):
    lines = report.to_markdown(spark.range(7), limit=5).splitlines()
    assert len(lines) == 8 and lines[-1] == "(2 more rows)" and len(report.to_markdown(spark.range(5), limit=5).splitlines()) == 7


def test_run_in_order(spark):
    one = spark.range(1)
    steps = {"sites": lambda t: {"sites": t["sheets"]}, "sheets": lambda t: {"sheets": one}, "rematch": lambda t: {"x": t["sites"]}}
    tables, ran = jobs.crawl_all({}, steps, skip=("rematch",))
    assert ran == ["sheets", "sites"] and set(tables) == {"sheets", "sites"}
    with pytest.raises(ValueError, match="unknown"):
        jobs.crawl_all({}, {"other": lambda t: t})
