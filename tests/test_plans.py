"""Plans that must keep their shape at any size."""

from __future__ import annotations

from pyspark.sql import functions as F
from test_operators import offers

from rooftide.functions import taxonomy
from rooftide.operators import facets, latest, report, search


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def stored(spark, tmp_path):
    offers(spark, [{"price": 5.0}, {"price": None}]).write.parquet(f"{tmp_path}/offers")
    return spark.read.parquet(f"{tmp_path}/offers")


def test_filters_that_let_unknowns_pass_reach_the_scan(spark, tmp_path):
    found = search.filtered(search.live(stored(spark, tmp_path)), {"price_max": "9", "beds": "2"})
    text = plan(search.page_of(found, "price_asc").select("id", "price"))
    assert "Or(LessThanOrEqual(price,9.0),IsNull(price))" in text and "Or(GreaterThanOrEqual(bedrooms,2),IsNull(bedrooms))" in text
    assert "EqualTo(deal,sale)" in text and "TakeOrderedAndProject" in text
    schema = text.split("ReadSchema: ")[1].split("\n")[0]
    assert "notes" not in schema and "title" not in schema


def test_facets_are_one_pass(spark, tmp_path):
    text = plan(facets.facet_counts(search.live(stored(spark, tmp_path))))
    assert text.count("Scan parquet") == 2 and "Join" not in text  # once in the tree, once in the details
    assert len(taxonomy.KIND_GROUPS) == 4


def test_photo_filter_is_a_semi_join(spark, tmp_path):
    images = spark.createDataFrame([(1, "a")], "offer_id long, local_path string")
    text = plan(search.filtered(stored(spark, tmp_path), {"with_photo": "1"}, images))
    assert "LeftSemi" in text and "Aggregate" not in text


def test_latest_and_medians_combine_before_the_shuffle(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1, "x")], "agency_slug string, run_started int, probed_at int, status string")
    assert "Window" not in plan(latest.latest_probe(df)) and "partial_max_by" in plan(latest.latest_probe(df))
    text = plan(report.upper_median(df.withColumn("n", F.lit(1)), ["agency_slug"], "probed_at", "m"))
    assert "collect_list" not in text
