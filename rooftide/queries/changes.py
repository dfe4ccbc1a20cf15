"""Snapshot merges, history, identity matches, evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import latest, merge
from ._tables import read

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Two snapshots of orders: the stored one lacks every 10th, the incoming one every 7th; every 4th price is cut, every 9th is
# missing, every 6th status moves.
_OLD = "SELECT o_orderkey AS key, o_totalprice AS price_eur, o_orderstatus AS status, CAST(CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderkey % 5 END AS INT) AS floor, o_orderkey % 13 <> 0 AS is_active, CAST(1 AS INT) AS first_seen, CAST(3 AS INT) AS last_seen, CAST(2 AS INT) AS last_changed, CAST(4 AS INT) AS times_seen FROM orders WHERE o_orderkey % 10 <> 0"
_NEW = "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN o_totalprice - 100 ELSE o_totalprice END AS price_eur, CASE WHEN o_orderkey % 6 = 0 THEN 'X' WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderstatus END AS status, CAST(CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderkey % 5 END AS INT) AS floor FROM orders WHERE o_orderkey % 7 <> 0"
_TRACKED = ["price_eur", "status", "floor"]
_BOTH = f"WITH o AS ({_OLD}), i AS ({_NEW})"
_SHOWN = "coalesce(regexp_replace(regexp_replace(({0})::DECIMAL(38, 9)::VARCHAR, '0+$', ''), '[.]$', ''), '')"
_PRICE_MOVED = "(o.price_eur IS DISTINCT FROM i.price_eur)"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    read(spark, sf_dir, "orders").createOrReplaceTempView("__orders")
    return tuple(spark.sql(q.replace("FROM orders", "FROM __orders")) for q in (_OLD, _NEW))


def _merged(spark: SparkSession, sf_dir: str, policy: merge.Policy) -> DataFrame:
    old, new = _snapshots(spark, sf_dir)
    return merge.merge(old, new, ["key"], _TRACKED, F.lit(5), policy, "price_eur")


@query(
    f"""{_BOTH} SELECT coalesce(o.key, i.key) AS key, CASE WHEN o.key IS NULL THEN 'new' WHEN i.key IS NULL AND o.is_active THEN 'gone' WHEN i.key IS NULL THEN 'absent'
WHEN {_PRICE_MOVED} OR o.status IS DISTINCT FROM i.status THEN 'changed' ELSE 'unchanged' END AS outcome,
CASE WHEN i.key IS NOT NULL THEN i.price_eur ELSE o.price_eur END AS price_eur, CASE WHEN i.key IS NOT NULL THEN i.status ELSE o.status END AS status, i.key IS NOT NULL AS is_active,
CASE WHEN o.key IS NOT NULL AND i.key IS NOT NULL AND {_PRICE_MOVED} THEN o.price_eur END AS prev_price,
(CASE WHEN i.key IS NULL THEN 4 WHEN o.key IS NULL THEN 1 ELSE 5 END)::INT AS times_seen FROM o FULL JOIN i ON o.key = i.key"""
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, merge.SHEET).select("key", "outcome", "price_eur", "status", "is_active", "prev_price", "times_seen")


@query(
    f"""{_BOTH} SELECT key, 'changed' AS event, 'status' AS field, o.status AS old_value, i.status AS new_value, 5 AS changed_on FROM o JOIN i USING (key) WHERE o.status IS DISTINCT FROM i.status
UNION ALL SELECT key, 'changed', 'price_eur', {_SHOWN.format('o.price_eur')}, {_SHOWN.format('i.price_eur')}, 5 FROM o JOIN i USING (key) WHERE {_PRICE_MOVED}
UNION ALL SELECT i.key, 'new', '', '', '', 5 FROM i WHERE key NOT IN (SELECT key FROM o) UNION ALL SELECT o.key, 'removed', 'is_active', '1', '0', 5 FROM o WHERE is_active AND key NOT IN (SELECT key FROM i)"""
)
def history_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.history(_merged(spark, sf_dir, merge.SHEET), ["key"], F.lit(5))


@query(
    f"""{_BOTH} SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN o.key IS NULL THEN 'new' WHEN i.key IS NULL AND o.is_active THEN 'gone' WHEN i.key IS NULL THEN 'absent'
WHEN {_PRICE_MOVED} OR o.status IS DISTINCT FROM i.status THEN 'changed' ELSE 'unchanged' END AS outcome FROM o FULL JOIN i ON o.key = i.key) GROUP BY outcome"""
)
def sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.sync_counts(_merged(spark, sf_dir, merge.SHEET))


@query(
    f"""{_BOTH}, m AS (SELECT o.key IS NULL AS is_new, i.key IS NULL AS missing, coalesce(o.key, i.key) AS key, o.is_active, {_PRICE_MOVED} AS moved, i.price_eur AS p, o.price_eur AS q, o.status IS DISTINCT FROM i.status AS s FROM o FULL JOIN i ON o.key = i.key)
SELECT key, CASE WHEN is_new THEN 'new' WHEN missing THEN 'absent' WHEN moved OR s THEN 'changed' ELSE 'unchanged' END AS outcome, CASE WHEN missing THEN is_active ELSE true END AS is_active, CASE WHEN missing THEN q ELSE p END AS price_eur FROM m"""
)
def web_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, merge.WEB).select("key", "outcome", "is_active", "price_eur")


@query(
    f"""{_BOTH}, m AS (SELECT coalesce(o.key, i.key) AS key, o.key IS NULL AS is_new, i.key IS NULL AS missing, o.is_active AS was, coalesce(i.price_eur, o.price_eur) AS price_eur, coalesce(nullif(i.status, ''), o.status) AS status, o.price_eur AS op, o.status AS os FROM o FULL JOIN i ON o.key = i.key)
SELECT key, price_eur, CASE WHEN is_new THEN nullif(status, '') ELSE status END AS status, CASE WHEN is_new THEN 'new' WHEN missing THEN 'absent' WHEN NOT was THEN 'returned' WHEN price_eur IS DISTINCT FROM op OR status IS DISTINCT FROM os THEN 'changed' ELSE 'unchanged' END AS outcome FROM m"""
)
def retain_last_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, merge.VERIFIED).select("key", "price_eur", "status", "outcome")


@query(
    """WITH held AS (SELECT o_orderkey AS url, o_custkey % 50 AS agency_id FROM orders), found AS (SELECT * FROM held WHERE url % (2 + agency_id % 4) = 0),
t AS (SELECT agency_id FROM (SELECT agency_id, count(*) AS h FROM held GROUP BY 1) JOIN (SELECT agency_id, count(*) AS f FROM found GROUP BY 1) USING (agency_id) WHERE f >= h * 0.5)
SELECT agency_id, url FROM held WHERE agency_id IN (SELECT agency_id FROM t) AND url NOT IN (SELECT url FROM found)"""
)
def retire_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS url", "o_custkey % 50 AS agency_id", "true AS is_active")
    return merge.retire_missing(held, held.where("url % (2 + agency_id % 4) = 0")).select("agency_id", "url")


@query(
    """WITH s AS (SELECT c_nationkey AS agency_id, concat('old', c_custkey) AS fp, concat(c_mktsegment, c_custkey % 40) AS weak FROM customer WHERE c_custkey % 3 <> 0),
i AS (SELECT c_nationkey AS agency_id, CASE WHEN c_custkey % 2 = 0 THEN concat('old', c_custkey) ELSE concat('new', c_custkey) END AS fp, concat(c_mktsegment, c_custkey % 40) AS weak FROM customer WHERE c_custkey % 5 <> 0),
u AS (SELECT * FROM s WHERE (agency_id, fp) NOT IN (SELECT (agency_id, fp) FROM i)), one AS (SELECT agency_id, weak, min(fp) AS old_key FROM u GROUP BY ALL HAVING count(*) = 1),
n AS (SELECT * FROM i WHERE (agency_id, fp) NOT IN (SELECT (agency_id, fp) FROM s)), claim AS (SELECT agency_id, weak, min(fp) AS fp FROM n GROUP BY ALL HAVING count(*) = 1)
SELECT agency_id, fp AS fingerprint, old_key FROM claim JOIN one USING (agency_id, weak)"""
)
def weak_rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    weak = "concat(c_mktsegment, c_custkey % 40) AS weak_core"
    state = c.where("c_custkey % 3 <> 0").selectExpr("c_nationkey AS agency_id", "concat('old', c_custkey) AS fingerprint", weak, "true AS is_active")
    incoming = c.where("c_custkey % 5 <> 0").selectExpr("c_nationkey AS agency_id", "CASE WHEN c_custkey % 2 = 0 THEN concat('old', c_custkey) ELSE concat('new', c_custkey) END AS fingerprint", weak)
    return merge.rekeyed(state, incoming, ["agency_id"], "fingerprint", "weak_core").where("old_key IS NOT NULL").select("agency_id", "fingerprint", "old_key")


@query("SELECT o_custkey AS agency_id, o_orderpriority AS fingerprint, arg_min(o_totalprice, o_orderkey) AS price FROM orders GROUP BY ALL")
def first_in_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").selectExpr("o_custkey AS agency_id", "o_orderpriority AS fingerprint", "o_totalprice AS price", "o_orderkey AS source_row")
    return merge.first_rows(rows, ["agency_id", "fingerprint"], "source_row").select("agency_id", "fingerprint", "price")


@query("SELECT page_id FROM pages WHERE page_id % 4 = 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 6 = 0)")
def known_url_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return merge.known_urls(pages.where("page_id % 4 = 0"), pages.where("page_id % 6 = 0")).select("page_id")


@query(
    """WITH r AS (SELECT concat('r', o_custkey) AS ref, concat('u', o_orderkey) AS url FROM orders WHERE o_orderkey % 5 = 0), s AS (SELECT o_orderkey AS offer_id, concat('r', o_custkey) AS ref, concat('u', o_orderkey) AS url FROM orders WHERE o_orderkey % 3 = 0),
m AS (SELECT r.ref, offer_id FROM r JOIN s USING (ref) UNION SELECT r.ref, offer_id FROM r JOIN s USING (url)) SELECT ref, min(offer_id) AS offer_id, count(*) > 1 AS ambiguous FROM m GROUP BY ref"""
)
def source_ref_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS offer_id", "concat('r', o_custkey) AS ref", "concat('u', o_orderkey) AS url")
    return merge.single_matches(orders.where("offer_id % 5 = 0").select("ref", "url"), orders.where("offer_id % 3 = 0"))


_PROBES = "SELECT user_id AS agency_slug, event_id AS probe, CASE WHEN event_id % 97 = 0 THEN NULL ELSE event_id % 50 END AS run_started, ts AS probed_at, value FROM events"


@query(f"WITH p AS ({_PROBES}) SELECT agency_slug, probe, value FROM (SELECT *, row_number() OVER (PARTITION BY agency_slug ORDER BY run_started DESC NULLS FIRST, probed_at DESC, probe DESC) AS place FROM p) WHERE place = 1")
def latest_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    read(spark, sf_dir, "events").createOrReplaceTempView("__events")
    probes = spark.sql(_PROBES.replace("FROM events", "FROM __events"))
    return latest.latest_probe(probes, tie="probe").select("agency_slug", "probe", "value")


@query("SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), -1) AS carried FROM events")
def heading_carried_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumns({"heading": F.when(F.col("event_type") == "signup", F.col("event_id")), "at": F.struct("ts", "event_id")})
    return latest.carried_down(rows, "user_id", "at", "heading").select("event_id", F.coalesce("carried", F.lit(-1).cast("long")).alias("carried"))


@query("SELECT o_custkey AS id, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS prev_price FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY o_custkey")
def price_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "orders").selectExpr("o_custkey AS id", "o_orderkey AS seq", "o_orderdate AS changed_on", "'changed' AS event", "CASE WHEN o_orderkey % 3 = 0 THEN 'status' ELSE 'price_eur' END AS field", "CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) AS old_value")
    return merge.previous_price(log).select("id", F.col("prev_price").cast("double").alias("prev_price"))


@query(
    """WITH a AS (SELECT p_partkey AS path, sha256(p_name) AS d FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey AS path, sha256(CASE WHEN p_partkey % 9 = 0 THEN concat(p_name, '!') ELSE p_name END) AS d FROM part WHERE p_partkey % 7 <> 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.d IS NULL THEN 'missing' WHEN a.d IS NULL THEN 'unrecorded' WHEN a.d = b.d THEN 'same' ELSE 'drifted' END AS status FROM a FULL JOIN b ON a.path = b.path"""
)
def manifest_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    a = part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("path"), F.sha2("p_name", 256).alias("digest"))
    b = part.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("path"), F.sha2(F.expr("CASE WHEN p_partkey % 9 = 0 THEN concat(p_name, '!') ELSE p_name END"), 256).alias("digest"))
    return merge.manifest_compare(a, b)


@query(
    """WITH f AS (SELECT s_suppkey AS agency_id, sha256(concat(s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'x' ELSE '' END)) AS h FROM supplier), l AS (SELECT s_suppkey AS agency_id, sha256(s_name) AS h FROM supplier WHERE s_suppkey % 4 <> 0)
SELECT agency_id, f.h IS DISTINCT FROM l.h AS changed FROM f LEFT JOIN l USING (agency_id)"""
)
def unchanged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    fetched = s.select(F.col("s_suppkey").alias("agency_id"), F.sha2(F.concat("s_name", F.when(F.col("s_suppkey") % 3 == 0, "x").otherwise("")), 256).alias("content_hash"))
    runs = s.where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("agency_id"), F.sha2("s_name", 256).alias("content_hash"), F.lit(2).alias("run_id"))
    older = runs.withColumns({"content_hash": F.lit("old"), "run_id": F.lit(1)})
    return merge.unchanged_sources(fetched, runs.unionByName(older)).select("agency_id", "changed")


@query("SELECT count(*) AS n, 2::BIGINT AS same FROM orders")
def row_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    both = merge.row_checksum(orders).unionByName(merge.row_checksum(orders.repartition(3, "o_totalprice")))
    return both.groupBy("n", "checksum").agg(F.count("*").alias("same")).select("n", "same")


@query(
    """WITH s AS (SELECT c_custkey AS key, c_name AS name FROM customer WHERE c_custkey % 2 = 0), i AS (SELECT c_custkey AS key, upper(c_name) AS name FROM customer WHERE c_custkey % 3 = 0)
SELECT * FROM s WHERE key NOT IN (SELECT key FROM i) UNION ALL SELECT * FROM i"""
)
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    state = c.where("c_custkey % 2 = 0").selectExpr("c_custkey AS key", "c_name AS name")
    return merge.upsert(state, c.where("c_custkey % 3 = 0").selectExpr("c_custkey AS key", "upper(c_name) AS name"), ["key"])


@query("SELECT doc_id AS id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def manual_is_sticky(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    curated = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"), F.lit("manual").alias("matched_by"))
    return merge.keep_manual(docs, curated)


@query("SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS repaired, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_totalprice END AS prev_price FROM orders")
def deal_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 3 = 0 THEN 'rent' ELSE 'sale' END AS old_deal", "'sale' AS deal", "o_totalprice AS price", "o_totalprice AS prev_price")
    return merge.repair_deals(rows).select("id", "repaired", F.coalesce("prev_price", F.lit(-1.0)).alias("prev_price"))


@query(
    """WITH s AS (SELECT o_orderkey AS offer_id, concat('r', o_orderkey % 9001) AS ref, concat('u', o_orderkey) AS url FROM orders WHERE o_orderkey % 2 = 0), e AS (SELECT concat('r', o_orderkey % 9001) AS ref, concat('u', o_orderkey) AS url FROM orders WHERE o_orderkey % 9 = 0 AND o_orderkey % 5 <> 0),
m AS (SELECT e.ref, offer_id FROM e JOIN s USING (ref) UNION SELECT e.ref, offer_id FROM e JOIN s USING (url)) SELECT DISTINCT min(offer_id) AS offer_id FROM m GROUP BY ref HAVING count(*) = 1"""
)
def evidence_deactivates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS offer_id", "concat('r', o_orderkey % 9001) AS ref", "concat('u', o_orderkey) AS url", "o_orderkey % 2 = 0 AS is_active")
    said = rows.where("offer_id % 9 = 0").selectExpr("ref", "url", "'unavailable' AS outcome", "offer_id % 5 <> 0 AS in_scope")
    return merge.deactivate_with_evidence(rows, said)


@query("SELECT count(*) FILTER (o_totalprice < prev) AS dropped, count(*) AS n FROM (SELECT o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders)")
def price_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = read(spark, sf_dir, "orders").withColumn("prev", F.lag("o_totalprice").over(w))
    return rows.agg(F.count_if(merge.price_dropped(F.col("o_totalprice"), F.col("prev"))).alias("dropped"), F.count("*").alias("n"))
