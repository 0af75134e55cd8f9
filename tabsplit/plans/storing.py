"""Queries of the shared store: reading, joining, state changes and upserts, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsplit.operators import store
from tabsplit.sources import views

QUERIES: dict = {}
ORACLES: dict = {}
CELLS = "WITH cells AS (SELECT bill_id, item_no, CASE WHEN item_no % 7 = 0 THEN '' ELSE item_id END AS item_id, CASE WHEN item_no % 3 = 0 THEN '' ELSE name END AS name, CASE item_no % 4 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE qty::VARCHAR END AS quantity, unit_cents::VARCHAR AS unit_price, total_cents::VARCHAR AS total_price FROM items)"
STORED = """WITH stored AS (SELECT bill_id, item_id, user_id, '0' AS quantity, mode FROM claims WHERE mode = 'shared' AND named
  UNION ALL SELECT bill_id, item_id, user_id, claimed::VARCHAR, mode FROM claims WHERE mode = 'individual')"""


def query(oracle: str | None, head: str = f"WITH {views.SQL}"):
    def add(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = f"{head}, {oracle[5:]}" if head and oracle.startswith("WITH ") else f"{head} {oracle}"
        return function

    return add


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as string cells, with blanks and text where numbers should be."""
    text = {"item_id": "CASE WHEN item_no % 7 = 0 THEN '' ELSE item_id END", "name": "CASE WHEN item_no % 3 = 0 THEN '' ELSE name END", "quantity": "CASE item_no % 4 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE string(qty) END", "unit_price": "string(unit_cents)", "total_price": "string(total_cents)"}
    return views.items(spark, sf_dir).select("bill_id", "item_no", *(F.expr(e).alias(c) for c, e in text.items()))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.claims(views.items(spark, sf_dir))


@query(CELLS + " SELECT bill_id, item_no, item_id, CASE WHEN name = '' THEN 'Unnamed item' ELSE name END AS name, coalesce(try_cast(quantity AS DOUBLE), 0) AS quantity, coalesce(try_cast(unit_price AS DOUBLE), 0) AS unit_price FROM cells WHERE item_id <> ''")
def row_coerce_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.coerce_items(cells(spark, sf_dir)).drop("total_price")


@query("SELECT c_custkey, c_name AS name FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 9 <> 0", "")
def row_filter_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 5 = 0 THEN '' ELSE string(c_custkey) END").alias("user_id"), F.expr("CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_name END").alias("name"))
    return store.filter_users(rows).select("c_custkey", "name")


@query("SELECT user_id, event_type, arg_min(props, event_id) AS value FROM events GROUP BY ALL", "")
def meta_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events").select("user_id", "event_type", F.col("props").alias("value"), F.col("event_id").alias("row_no"))
    return store.first_meta(rows, ["user_id", "event_type"])


META = "WITH meta AS (SELECT o_orderkey AS bill_id, CASE o_orderkey % 4 WHEN 0 THEN 'percent' WHEN 1 THEN 'amount' WHEN 2 THEN '' ELSE 'other' END AS kind, CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN '0' WHEN 3 THEN '-5' ELSE (o_orderkey % 150)::VARCHAR END AS value FROM orders)"


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "CASE o_orderkey % 4 WHEN 0 THEN 'percent' WHEN 1 THEN 'amount' WHEN 2 THEN '' ELSE 'other' END"
    value = "CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN '0' WHEN 3 THEN '-5' ELSE string(o_orderkey % 150) END"
    return views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bill_id"), F.expr(kind).alias("kind"), F.expr(value).alias("value"))


@query(META + " SELECT bill_id, CASE WHEN kind IN ('amount', 'percent') AND try_cast(value AS DOUBLE) > 0 THEN kind END AS type, CASE WHEN kind IN ('amount', 'percent') AND try_cast(value AS DOUBLE) > 0 THEN try_cast(value AS DOUBLE) END AS value FROM meta", "")
def meta_parse_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta(spark, sf_dir).select("bill_id", store.lenient_discount(F.col("kind"), F.col("value")).alias("d")).select("bill_id", "d.type", "d.value")


@query(META + " SELECT bill_id, CASE WHEN try_cast(value AS DOUBLE) >= 0 THEN try_cast(value AS DOUBLE) END AS amount FROM meta", "")
def meta_parse_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta(spark, sf_dir).select("bill_id", store.lenient_amount(F.col("value")).alias("amount"))


@query(META + ", s AS (SELECT *, try_cast(value AS DOUBLE) AS v FROM meta) SELECT bill_id, CASE WHEN kind = '' AND value = '' THEN 'none' WHEN kind NOT IN ('amount', 'percent') OR v IS NULL OR v < 0 OR (kind = 'percent' AND v > 100) THEN 'error' WHEN v = 0 THEN 'none' ELSE 'ok' END AS status FROM s", "")
def meta_parse_receipt_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta(spark, sf_dir).select("bill_id", store.strict_discount(F.col("kind"), F.col("value")).alias("d")).select("bill_id", "d.status")


@query(STORED + " SELECT * FROM stored")
def explode_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.explode_claims(claims(spark, sf_dir))


@query(STORED + """ SELECT i.bill_id, i.item_id, coalesce(string_agg(user_id, ',' ORDER BY user_id) FILTER (WHERE mode = 'shared'), '') AS shared_with,
  coalesce(string_agg(user_id || '=' || quantity, ',' ORDER BY user_id) FILTER (WHERE mode = 'individual'), '') AS quantities FROM items i LEFT JOIN stored USING (bill_id, item_id) GROUP BY i.bill_id, i.item_id""")
def join_items_claims_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.nest_claims(views.items(spark, sf_dir), store.explode_claims(claims(spark, sf_dir)))


@query("SELECT bill_id, item_id, user_id, claimed FROM claims JOIN (SELECT bill_id, item_no FROM items WHERE total_cents > 2000000) USING (bill_id, item_no)")
def join_claims_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    dear = views.items(spark, sf_dir).where("total_cents > 2000000").select("bill_id", "item_no")
    return claims(spark, sf_dir).join(dear, ["bill_id", "item_no"]).select("bill_id", "item_id", "user_id", "claimed")


@query("SELECT bill_id, item_id, sum(claimed)::BIGINT AS claimed, greatest(any_value(qty) - sum(claimed), 0)::BIGINT AS remaining, sum(claimed) <= any_value(qty) AS valid FROM claims GROUP BY ALL")
def claim_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = claims(spark, sf_dir).groupBy("bill_id", "item_id").agg(F.sum("claimed").alias("claimed"), F.max("qty").alias("qty"))
    return sums.select("bill_id", "item_id", "claimed", F.greatest(F.col("qty") - F.col("claimed"), F.lit(0)).alias("remaining"), (F.col("claimed") <= F.col("qty")).alias("valid"))


@query("SELECT bill_id, item_id, sum(claimed)::BIGINT AS claimed FROM claims GROUP BY ALL")
def sum_claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims(spark, sf_dir).groupBy("bill_id", "item_id").agg(F.sum("claimed").alias("claimed"))


@query("SELECT bill_id, item_id, greatest(any_value(qty) - sum(claimed), 0)::BIGINT AS remaining FROM claims GROUP BY ALL")
def remaining_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claim_valid(spark, sf_dir).select("bill_id", "item_id", "remaining")


@query("SELECT bill_id, item_id, coalesce(sum(claimed) FILTER (WHERE user_id = 'user-1'), 0)::BIGINT AS claimed FROM items LEFT JOIN claims USING (bill_id, item_id) GROUP BY ALL")
def claimed_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one user claims of every item, 0 where there is no claim."""
    own = claims(spark, sf_dir).where("user_id = 'user-1'").select("bill_id", "item_id", "claimed")
    return views.items(spark, sf_dir).select("bill_id", "item_id").join(own, ["bill_id", "item_id"], "left").withColumn("claimed", F.coalesce("claimed", F.lit(0)))


@query("SELECT bill_id, item_id, user_id, claimed FROM claims c WHERE EXISTS (SELECT 1 FROM items i WHERE i.bill_id = c.bill_id AND i.item_no = c.item_no AND i.qty > 20)")
def semi_retain_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    surviving = views.items(spark, sf_dir).where("qty > 20").select("bill_id", "item_id")
    return claims(spark, sf_dir).join(surviving, ["bill_id", "item_id"], "left_semi").select("bill_id", "item_id", "user_id", "claimed")


@query("SELECT bill_id, item_id FROM items i WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.bill_id = i.bill_id AND c.item_no = i.item_no AND c.claimed > 0)")
def anti_new_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = claims(spark, sf_dir).where("claimed > 0").select("bill_id", "item_id")
    return views.items(spark, sf_dir).select("bill_id", "item_id").join(known, ["bill_id", "item_id"], "left_anti")


@query("SELECT bill_id, item_id, user_id, claimed FROM claims WHERE ord < 2")
def semi_participant_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    staying = views.participants(spark, sf_dir).where("ord < 2").select("bill_id", "user_id")
    return claims(spark, sf_dir).join(staying, ["bill_id", "user_id"], "left_semi").select("bill_id", "item_id", "user_id", "claimed")


@query("SELECT i.bill_id, i.item_id, p.user_id, 0 AS quantity FROM items i JOIN participants p USING (bill_id)")
def cross_default_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with every participant of its bill."""
    both = views.items(spark, sf_dir).select("bill_id", "item_id").join(views.participants(spark, sf_dir).select("bill_id", "user_id"), "bill_id")
    return both.withColumn("quantity", F.lit(0))


@query("SELECT c.bill_id, c.item_id, c.user_id, coalesce(p.user_name, c.user_id) AS label FROM claims c LEFT JOIN (SELECT * FROM participants WHERE ord < 2) p USING (bill_id, user_id)")
def join_share_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = views.participants(spark, sf_dir).where("ord < 2").select("bill_id", "user_id", "user_name")
    return claims(spark, sf_dir).join(people, ["bill_id", "user_id"], "left").select("bill_id", "item_id", "user_id", F.coalesce("user_name", "user_id").alias("label"))


@query("SELECT bill_id, item_id, user_id, greatest(least(9, qty - (sum(claimed) OVER (PARTITION BY bill_id, item_id) - claimed)), 0)::BIGINT AS granted FROM claims")
def cap_requested_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.cap_requested(claims(spark, sf_dir), F.lit(9)).select("bill_id", "item_id", "user_id", "granted")


@query("SELECT bill_id, item_id, sum(claimed)::BIGINT AS total_claimed, bool_and(named) AS all_shared, bool_or(named) AND NOT bool_and(named) AS some_shared, any_value(mode) = 'shared' AND NOT bool_or(named) AS shared_warning FROM claims GROUP BY ALL")
def claim_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    every, some = F.bool_and("named"), F.bool_or("named")
    return claims(spark, sf_dir).groupBy("bill_id", "item_id").agg(F.sum("claimed").alias("total_claimed"), every.alias("all_shared"), (some & ~every).alias("some_shared"), ((F.min("mode") == "shared") & ~some).alias("shared_warning"))


UPSERT = """WITH existing AS (SELECT user_id, event_type, arg_max(props, event_id) AS props, arg_max(value, event_id) AS value FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
wanted AS (SELECT user_id, event_type, arg_max(props, event_id) AS props, arg_max(value, event_id) AS value FROM events WHERE event_id % 2 = 1 OR event_id % 3 = 0 GROUP BY ALL)"""


@query(UPSERT + """ SELECT user_id, event_type, CASE WHEN w.props IS NULL THEN 'kept' WHEN e.props IS NULL THEN 'append' WHEN e.props = w.props AND e.value = w.value THEN 'same' ELSE 'update' END AS action,
  coalesce(w.props, e.props) AS props, coalesce(w.value, e.value) AS value FROM existing e FULL JOIN wanted w USING (user_id, event_type)""", "")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events").withColumnRenamed("event_id", "row_no")
    wanted = rows.where("row_no % 2 = 1 OR row_no % 3 = 0").groupBy("user_id", "event_type").agg(F.max_by("props", "row_no").alias("props"), F.max_by("value", "row_no").alias("value"))
    return store.upsert(rows.where("row_no % 2 = 0"), wanted, ["user_id", "event_type"], ["props", "value"])


@query("SELECT bill_id, item_id FROM items WHERE item_no % 2 = 0 UNION ALL SELECT bill_id, 'new-' || item_id FROM items WHERE item_no % 2 = 1")
def union_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = views.items(spark, sf_dir)
    return items.where("item_no % 2 = 0").select("bill_id", "item_id").unionByName(items.where("item_no % 2 = 1").select("bill_id", F.concat(F.lit("new-"), F.col("item_id")).alias("item_id")))


@query("SELECT bill_id, key, value FROM (SELECT bill_id, total_cents::VARCHAR AS total, coalesce(receipt_type, '') AS receipt_type, coalesce(receipt_value::VARCHAR, '') AS receipt_value, coalesce(group_type, '') AS group_type, coalesce(group_value::VARCHAR, '') AS group_value FROM printed) UNPIVOT (value FOR key IN (total, receipt_type, receipt_value, group_type, group_value))")
def state_to_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = views.printed(spark, sf_dir).select("bill_id", F.col("total_cents").cast("string").alias("total"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("receipt_type", "receipt_value", "group_type", "group_value")))
    return told.unpivot("bill_id", ["total", "receipt_type", "receipt_value", "group_type", "group_value"], "key", "value")


@query("SELECT bill_id, item_id, user_id, claimed FROM claims WHERE ord <> 0")
def remove_participant(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = views.participants(spark, sf_dir).where("ord = 0").select("bill_id", "user_id")
    return store.cascade(claims(spark, sf_dir), gone, ["bill_id", "user_id"]).select("bill_id", "item_id", "user_id", "claimed")


@query("SELECT bill_id, item_id, user_id, claimed FROM claims WHERE item_no <> 1")
def remove_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = views.items(spark, sf_dir).where("item_no = 1").select("bill_id", "item_id")
    return store.cascade(claims(spark, sf_dir), gone, ["bill_id", "item_id"]).select("bill_id", "item_id", "user_id", "claimed")
