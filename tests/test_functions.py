from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rooftide.functions import features, identity, prices, taxonomy, text
from rooftide.operators import geo, recon
from rooftide.sources import catalogue, feeds


def each(spark, build, values):
    """build applied to a text column, value by value."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(build(F.col("x"))).collect()]


def test_folding(spark):
    assert each(spark, text.fold, ["Café-Bar!", "  Йод и Ёлка ", "Straße", None, "a, b"]) == ["cafe bar", "иод и елка", "strasse", "", "a  b"]


def test_title_norm(spark):
    values = ["Синя Ракита", "Студио 12 Щит", "SINYA Rakita Residence", "", "Юла-Ясен"]
    assert each(spark, text.title_norm, values) == ["sinya rakita", "shtit", "sinya rakita", "", "yula yasen"]


def test_geo_norm_keeps_short_i(spark):
    assert each(spark, text.geo_norm, ["Дружба 2Б", "Druzhba-2B", "Чайка", "Надежда-3", None]) == ["druzhba 2 b", "druzhba 2 b", "chayka", "nadezhda 3", ""]


def test_trigram_similarity(spark):
    df = spark.createDataFrame([("word", "word"), ("word", "words"), ("", "x"), ("grand kameliya", "grand kamelia")], "a string, b string")
    got = [r[0] for r in df.select(text.similarity(text.trigrams(F.col("a")), text.trigrams(F.col("b")))).collect()]
    assert got[:3] == [1.0, pytest.approx(4 / 7), 0.0] and got[3] > 0.55


def test_lookalikes_slugs_hosts(spark):
    assert each(spark, text.undo_lookalikes, ["Sоzоpоl сеnter", "Созопол", "plain море", "Ноliday"]) == ["Sozopol center", "Созопол", "plain море", "Holiday"]
    assert each(spark, text.slugify, ["Имоти Варна & Ко.", "Ágency  1"]) == ["imoti-varna-ko", "agency-1"]
    urls = ["https://www.a.example.com/x/12?y#z", "http://B.org", "nothing"]
    assert each(spark, text.host, urls) == ["a.example.com", "b.org", ""]
    assert each(spark, text.registrable, urls) == ["example.com", "b.org", ""]
    assert each(spark, text.shape_of, ["https://a.b/property/12345", "https://a.b/sale/two-bedroom-flat/7/x", "https://a.b/"]) == ["/property/*", "/sale/*/*", "/"]
    assert each(spark, text.clean_url, ["https://a.b/https://a.b/c#d", "http://a.b/c"]) == ["https://a.b/c", "http://a.b/c"]


def test_per_m2(spark):
    df = spark.createDataFrame([(1019.0, 108.0, "€ 1 019 /m2"), (1019.0, None, "1019 на кв.м"), (100000.0, 50.0, "100000 €"), (None, 5.0, "x")], "p double, a double, r string")
    got = [tuple(r[0]) for r in df.select(prices.normalise(F.col("p"), F.col("a"), F.col("r"))).collect()]
    assert got == [(110052.0, 1019.0), (None, 1019.0), (100000.0, 2000.0), (None, None)]


def test_price_lines(spark):
    values = ["4\n185000 €", "1 €\n2 €", "single 5 €", "Complex 4\n185 000", "x\ny", "Beach 4\n12345\n12346"]
    assert each(spark, prices.price_line, values) == ["185000 €", None, None, "185 000", None, "12345"]


def test_value_of(spark):
    values = ["185.000 €", "1 019.50 €", "1 019 €/m2", "1,5", "1.234.567", "0", "no", None, "1 019 €"]
    assert each(spark, prices.value_of, values) == [185000.0, 1019.5, 1019.0, 1.5, 1234567.0, None, None, None, 1019.0]


def test_number(spark):
    values = ["33 кв. м.", "88 900,00 €", "88,900", "88.900", "1.234,56", "1,234.56", "-3", "none", None]
    assert each(spark, prices.number, values) == [33.0, 88900.0, 88900.0, 88900.0, 1234.56, 1234.56, -3.0, None, None]


def test_strict_number_and_money(spark):
    assert [None if x is None else float(x) for x in each(spark, prices.strict_number, ["1,234.50", "1.234,50", "12", "12 m", ""])] == [1234.5, 1234.5, 12.0, None, None]
    assert each(spark, prices.money, ["195583 лв.", "1000 EUR", "100 BGN"]) == [100000.0, 1000.0, 51.13]


def test_stages(spark):
    values = ["Пред Акт 16", "АКТ-16", "акт 15, преди акт 16", "Акт14", "nothing", None]
    assert each(spark, taxonomy.stage_of, values) == ["pre_act16", "act16", "pre_act16", "act14", None, None]
    assert each(spark, taxonomy.is_new_build, ["НОВО СТРОИТЕЛСТВО", "off-plan", "акт 16", "панел", None]) == [True, True, True, False, False]


def test_kinds_rooms_floors(spark):
    assert each(spark, taxonomy.kind_of, ["Голяма ВИЛА", "Penthouse in town", "малка къща", "Двустаен"]) == ["villa", "penthouse", "house", "apartment"]
    df = spark.createDataFrame([("Двустаен апартамент", None), ("x", 2), (None, None)], "k string, b int")
    assert [r[0] for r in df.select(taxonomy.rooms_of(F.col("k"), F.col("b"))).collect()] == [2, 3, None]
    assert each(spark, lambda c: taxonomy.bedrooms_of(c, F.lit("")), ["3 bedroom flat", "Тристаен", "2-стаен", "Studio", "plot"]) == [3, 2, 1, 0, None]
    assert each(spark, taxonomy.floor_number, ["third floor", "minus third floor", "7th floor", "ground floor", "?", "Twentieth floor", "-2 floor", "101 floor", "the third floor is up"]) == [3, -3, 7, 0, None, 20, -2, None, None]
    assert each(spark, taxonomy.deal_of, ["Под наем", "for sale"]) == ["rent", "sale"]
    assert each(spark, taxonomy.is_sold, ["ПРОДАДЕН", "Продан", "нов"]) == [True, True, False]


def test_features_are_three_valued(spark):
    df = spark.createDataFrame([("", "", ""), ("море", "", ""), ("двор", "", ""), ("", "панелен", "без асансьор"), ("басейн", "", "лифт")], "view string, title string, notes string")
    cols = {c: F.col(c) for c in df.columns}
    got = [r[0] for r in df.select(features.resolve(cols)).collect()]
    assert got[0] == {} and got[1]["sea_view"] is True and got[1]["pool_view"] is False
    assert got[2]["sea_view"] is False and got[2]["garden"] is True
    assert got[3].get("lift") is True  # the plain feature does not see the denial; the requirement does
    assert [r[0] for r in df.select(features.requirement("lift", cols)).collect()] == [None, None, None, False, True]
    assert got[4]["pool"] is True and got[4]["pool_view"] is True


def test_requirements(spark):
    df = spark.createDataFrame([("Без двор",), ("Акт 16 през 2027",), ("има акт 16",), ("акт 15",), ("x",)], "notes string")
    cols = {"notes": F.col("notes")}
    assert [r[0] for r in df.select(features.requirement("garden", cols)).collect()][0] is False
    assert [r[0] for r in df.select(features.requirement("act16", cols)).collect()][1:] == [False, True, False, None]
    assert each(spark, lambda c: features.pets_allowed(c, F.lit("")), ["No pets", "Pet-friendly home", "Допускат се домашни любимци", "x"]) == [False, True, True, None]


def test_keys(spark):
    df = spark.createDataFrame([("Варна", "Синя Ракита", 2, 62.4, 3), ("Varna", "", None, None, 3), ("Варна", "СИНЯ ракита", 2, 61.0, 3), ("Варна", "Синя Ракита", 2, 12.5, 3)], "l string, t string, b int, a double, f int")
    keys = [r[0] for r in df.select(identity.dedup_key(*(F.col(c) for c in "ltbaf"))).collect()]
    assert keys[0] == keys[2] != keys[3] and keys[1] == "" and len(keys[0]) == 16
    df = spark.createDataFrame([("sofia", "sale", "k"), (None, "sale", "k"), ("sofia", "sale", "")], "c string, d string, k string")
    assert [r[0] for r in df.select(identity.cluster_key(F.col("c"), F.col("d"), F.col("k"))).collect()] == ["sofia:sale:k", "", ""]


def test_page_helpers(spark):
    assert each(spark, recon.page_kind, ["100 000 € and 65 кв.м", "600 € studio", "news", '"@type": "BlogPosting" 100 000 € 65 m2', "1000 € 50 m2 " * 10]) == ["detail", "detail", "other", "other", "catalogue"]
    assert each(spark, recon.platforms, ["/wp-content/ houzez", "/wp-content/", "x"]) == [["Houzez"], ["WordPress"], []]
    assert each(spark, lambda c: recon.absolute(c, F.lit("https://a.b/x/y?z")), ["c", "/c", "//d/e", "?q", "http://f"]) == ["https://a.b/x/c", "https://a.b/c", "https://d/e", "https://a.b/x/y?q", "http://f"]
    got = each(spark, feeds.robots, ["Disallow: /b\ndisallow:/a\nDisallow:\nSitemap: http://x/s.xml\nDisallow: /a"])[0]
    assert got.disallow == ["/a", "/b"] and got.sitemaps == ["http://x/s.xml"]
    listing = lambda u: recon.is_listing(u, F.array(F.lit("/offer/"), F.lit(r"re:/\d+$")), F.array(F.lit("/blog")))
    assert each(spark, listing, ["http://a/offer/1", "http://a/x/77", "http://a/blog/offer/", "http://a/y"]) == [True, True, False, False]
    assert each(spark, lambda u: recon.is_page_of(u, F.lit("http://a/sale/")), ["http://a/sale/?page=2", "http://a/sale/page/3", "http://a/rent?page=2", "http://b/sale/?page=2"]) == [True, True, False, False]


def test_units_and_notes(spark):
    content = "Price list\nground floor\nA1 50.5 m2 100 000 EUR\nsecond floor\nA7 60 m2 120 000 EUR\nA8 sold"
    units = each(spark, catalogue.units, [content])[0]
    assert [(u.floor, u.number, u.area, u.price) for u in units] == [(0, "A1", 50.5, 100000.0), (2, "A7", 60.0, 120000.0)]
    assert each(spark, lambda c: catalogue.merge_note(c, "phones", F.lit("1")), ["", "old", "a\nphones: 9\nb"]) == ["phones: 1", "old\nphones: 1", "a\nphones: 1\nb"]


def test_first_longest_alias(spark):
    aliases = [("влас", "Vlas"), ("свети влас", "Sveti Vlas")]
    assert each(spark, lambda c: geo.first_longest_alias(text.fold(c), aliases), ["Свети Влас!", "до Влас", "x"]) == ["Sveti Vlas", "Vlas", None]


def test_decode(spark):
    df = spark.createDataFrame([(bytearray("é".encode("cp1252")), "iso-8859-1"), (bytearray("€".encode("cp1252")), "windows-1252"), (bytearray("я".encode()), None)], "c binary, h string")
    assert [r[0] for r in df.select(feeds.decode(F.col("c"), F.col("h"))).collect()] == ["é", "€", "я"]


def test_strict_numbers_integers_kinds_pets(spark):
    values = ["1 234,5", "12'345", "1,234", "1.234.567", "1,23", "1.2.3", "12,345.67", "about 5", "-7", ""]
    assert [None if x is None else float(x) for x in each(spark, prices.strict_number, values)] == [1234.5, 12345, 1234, 1234567, 1.23, None, 12345.67, None, -7, None]
    assert [None if x is None else float(x) for x in each(spark, prices.first_number, ["EUR 98’500 now", "from 1 200.50", "none"])] == [98500, 1200.5, None]
    assert each(spark, prices.single_integer, ["3 of 8", "Ground floor", "партер", "-1", "3rd", "12"]) == [3, 0, 0, -1, None, 12]
    assert each(spark, prices.bounded_integer, [" 7 ", "Партер", "101", "-4", "x", "-3"]) == [7, 0, None, None, None, -3]
    got = each(spark, taxonomy.kind_and_rooms, ["Продава ТРИСТАЕН апартамент", "5-стаен", "ателие", "Вила с двор", "Студио", "мезонет"])
    assert [tuple(x) for x in got] == [("Тристаен апартамент", 3), ("Многостаен апартамент", 5), ("ателие", None), ("Къща", None), ("Студио", 1), ("Мезонет", None)]
    assert each(spark, taxonomy.pet_fact, ["Светъл. Без домашни любимци!", "домашни любимци са разрешени", "котка"]) == ["Без домашни любимци", "домашни любимци са разрешени", ""]


def test_places_by_half_a_name(spark):
    aliases = [("sveti vlas", "Свети Влас"), ("stara planina", "Стара планина"), ("nova planina", "Нова планина"), ("свети влас", "Свети Влас")]
    assert geo.distinctive_words(aliases) == {"vlas": "Свети Влас", "влас": "Свети Влас", "stara": "Стара планина", "nova": "Нова планина"}
    assert each(spark, lambda c: geo.first_longest_alias_or_word(c, aliases), ["near vlas", "in stara planina", "planina", "sveti"]) == ["Свети Влас", "Стара планина", None, None]
    assert each(spark, lambda c: geo.first_longest_alias(c, aliases), ["near vlas"]) == [None]


def test_dot_segments_and_bases(spark):
    base = F.lit("https://a.b/x/y/z.html?q")
    assert each(spark, lambda c: recon.absolute(c, base), ["../c", "../../../c", "./d/./e/../f", "..", "/g/../h?i=../j", "k?l=1#m"]) == [
        "https://a.b/x/c", "https://a.b/c", "https://a.b/x/y/d/f", "https://a.b/x/", "https://a.b/h?i=../j", "https://a.b/x/y/k?l=1#m",
    ]
    pages = spark.createDataFrame([(1, "https://a.b/x/y", '<base href="/root/"><a href="p">1</a><a href="../q">2</a>'), (2, "https://a.b/x/y", '<a href="p">1</a>')], "id int, url string, html string")
    assert sorted((r.id, r.link) for r in recon.links_on(pages, ["id"]).collect()) == [(1, "https://a.b/q"), (1, "https://a.b/root/p"), (2, "https://a.b/x/p")]


def test_decode_single_byte_sets(spark):
    rows = [(bytearray("Цена".encode("cp1251")), "windows-1251"), (bytearray(b'<meta charset="koi8-r">' + "да".encode("koi8-r")), ""), (bytearray("\u017e".encode("iso-8859-2")), "ISO-8859-2"), (bytearray("ж".encode()), "no-such-set")]
    df = spark.createDataFrame(rows, "c binary, h string")
    assert [r[0] for r in df.select(feeds.decode(F.col("c"), F.col("h"))).collect()] == ["Цена", '<meta charset="koi8-r">да', "ž", "ж"]


def test_unpacking(spark):
    import gzip

    df = spark.createDataFrame([(bytearray(gzip.compress(b"<html>" * 500)),), (bytearray(b"plain"),), (None,), (bytearray(b"\x1f\x8bbroken"),)], "c binary")
    got = [None if r[0] is None else bytes(r[0]) for r in feeds.unpacked(df, "c").collect()]
    assert got == [b"<html>" * 500, b"plain", None, None]
