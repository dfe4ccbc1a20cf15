from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from test_operators import offers

from rooftide.operators import match, merge, recon, search
from rooftide.plans import api
from rooftide.sources import flight


@pytest.fixture
def market(spark):
    rows = [
        {"dedup_key": "k", "price": 100.0, "neighbourhood": "n"}, {"dedup_key": "k", "price": 130.0, "last_seen": 5}, {"dedup_key": "k", "city": "varna"}, {"deal": "rent"},
        {"is_active": False}, {"dedup_key": "", "price": 5.0},
    ]
    images = spark.createDataFrame([(1, 2, 1, "b"), (1, 1, 2, "a")], "offer_id long, position int, image_id int, local_path string")
    agencies = spark.createDataFrame([(1, "a", "A")], "agency_id long, slug string, name string")
    places = spark.createDataFrame([("sofia", "n", "Н", "N", True), ("sofia", "m", "М", "M", False)], "city string, slug string, name_bg string, name_en string, active boolean")
    cities = spark.createDataFrame([("sofia", "София", "Sofia", True), ("varna", "Варна", "Varna", True), ("old", "x", "x", False)], "slug string, name_bg string, name_en string, active boolean")
    return api.Market(offers(spark, rows), images, agencies, places, cities)


def test_lists(market):
    assert sorted(r.slug for r in api.cities(market).collect()) == ["sofia", "varna"]
    assert [r.slug for r in api.neighbourhoods(market, "sofia").collect()] == ["n"]
    with pytest.raises(api.BadRequest):
        api.neighbourhoods(market)
    assert api.agencies(market).first().live == 5
    assert tuple(api.stats(market, "sofia").first()) == (4, 1, 1, 3, 1)


def test_offers_and_facets(market):
    out = api.offers(market, city="sofia", neighbourhood="n", sort="price_asc")
    assert out["total"] == 3 and [r.id for r in out["results"].collect()] == [6, 1, 2]
    counts, agencies = api.facet_summary(market, city="sofia")
    assert counts.first().total == 3 and counts.first().deal_rent == 1 and agencies.first().n == 3


def test_detail(market):
    out = api.offer_detail(market, 1, "sofia")
    assert [r.id for r in out["siblings"].collect()] == [2] and out["spread"] == 30.0 and out["images"] == ["a", "b"]
    assert api.offer_detail(market, 6)["spread"] is None
    with pytest.raises(api.NotFound):
        api.offer_detail(market, 1, "varna")
    with pytest.raises(api.NotFound):
        api.offer_detail(market, 5)


def test_buyers(market):
    out = api.buyer_matches(market, {"city": "sofia", "price_max": 110})
    assert out["total"] == 2 and {r.id for r in out["results"].collect()} == {1, 6}
    for bad in ({"city": "old"}, {"city": "sofia", "neighbourhoods": ["m"]}):
        with pytest.raises(match.ProfileError):
            api.buyer_matches(market, bad)
    with pytest.raises(api.BadRequest):
        api.buyer_matches(market, {"city": "sofia"}, 0)
    wishes = api.buyer_wishlist(market, [6, 5, 1])
    assert [r.id for r in wishes["results"].collect()] == [6, 1] and wishes["unavailable"] == [5]
    assert {o["key"] for o in api.buyer_options()} == set(match.LABELS)


def test_flight_records(spark):
    text = "line\n9:[\"$\",\"a\",null,{\"fake\":1}]"
    stream = f'1:["$","div",null,{{"id":7}}]\n2:T{len(text.encode()):x},{text}3:["$","p",null,{{"id":8,"t":"é"}}]\n4:{{"x":1}}\n5:[1,2]\n'
    cut = stream.index("id") + 1
    page = "".join(f"<script>self.__next_f.push({json.dumps([1, part])})</script>" for part in (stream[:cut], stream[cut:]))
    rows = flight.with_records(spark.createDataFrame([(page,), ("<p>none</p>",), ("<script>self.__next_f.push([1,\"2:Tff,short\"])</script>",), (None,)], "html string")).collect()
    assert [json.loads(x) for x in rows[0].records] == [{"id": 7}, {"id": 8, "t": "é"}] and rows[1].records == [] and rows[2].records is None and rows[3].records == []


def test_specs_rates_and_repairs(spark):
    df = spark.createDataFrame([("https://h.bg/en/start", "/en/property/*", ["/en/sale/*"])], "u string, p string, c array<string>")
    spec = df.select(recon.derived_spec(F.col("u"), F.col("p"), F.col("c")).alias("s")).first().s
    assert spec.catalog == ["https://h.bg/en/property/", "https://h.bg/en/sale/", "https://h.bg/en/start"]
    assert spec.include == ["re:/en/property/[^/]+"] and spec.drop == ["/en/property/page/", "/ru/", "/de/"]
    rates = spark.createDataFrame([(100.0, 30.0, None), (100.0, 0.0, None), (1.0, 1.0, 9.4)], "p double, a double, s double")
    assert [r[0] for r in rates.select(search.shown_rate(F.col("p"), F.col("a"), F.col("s"))).collect()] == [3, None, 9]
    rows = spark.createDataFrame([(1, "rent", "sale", 5.0, 9.0), (2, "sale", "sale", 5.0, 9.0)], "id long, old_deal string, deal string, price double, prev_price double")
    fixed = {r.id: r for r in merge.repair_deals(rows).collect()}
    assert fixed[1].prev_price is None and fixed[1].history.field == "identity_repair" and fixed[2].prev_price == 9.0 and fixed[2].history is None
