"""The bill domain over the given tables: bills from orders, items from lineitem, and rule-made participants and claims.

Money is whole cents throughout. Order is explicit: item_no within a bill, ord among participants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(major: Column | str) -> Column:
    """Whole cents of an amount in major units, halves upwards."""
    value = F.col(major) if isinstance(major, str) else major
    return F.floor(value * 100 + 0.5).cast("long")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bill_id, item_no, item_id, name, qty, unit_cents, total_cents; unit prices are cut to whole cents."""
    return items_of(table(spark, sf_dir, "lineitem"))


def items_of(lineitem: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """items() of the given rows, with more columns that are made of theirs, or over in_bill()."""
    rows = lineitem.withColumnRenamed("l_orderkey", "bill_id").withColumns({"_place": F.row_number().over(in_bill()), **(more or {})})
    lines = rows.select("bill_id", F.col("_place").cast("long").alias("item_no"), "l_partkey", F.col("l_quantity").cast("long").alias("qty"), cents("l_extendedprice").alias("total_cents"), *(more or {}))
    return lines.select("bill_id", "item_no", F.concat(F.lit("item-"), F.col("item_no")).alias("item_id"), F.concat(F.lit("Part "), F.col("l_partkey")).alias("name"), "qty", F.expr("total_cents div qty").alias("unit_cents"), "total_cents", *(more or {}))


def in_bill() -> WindowSpec:
    """A bill's rows of lineitem in the order of their items."""
    return Window.partitionBy("bill_id").orderBy(*LINE_ORDER)


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bill_id with the printed total, whether a subtotal is printed, and the receipt's and the group's discount."""
    key = F.col("o_orderkey")
    typed = lambda k, amount: F.when(key % k == 1, F.lit("percent")).when(key % k == 2, F.lit("amount")).alias(amount)
    value = lambda k, amount: F.when(key % k == 1, key % 130 - 5).when(key % k == 2, (key * 37) % 500_000).alias(amount)
    return table(spark, sf_dir, "orders").select(
        key.alias("bill_id"), cents("o_totalprice").alias("total_cents"), (key % 7 != 0).alias("has_subtotal"),
        typed(5, "receipt_type"), value(5, "receipt_value"), typed(4, "group_type"), value(4, "group_value"),
    )


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bill_id, ord, user_id, user_name: two to four on every bill."""
    people = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bill_id"), F.explode(F.sequence(F.lit(0).cast("long"), 1 + F.col("o_orderkey") % 3)).alias("ord"))
    return people.select("bill_id", "ord", F.concat(F.lit("user-"), F.col("ord")).alias("user_id"), F.concat(F.lit("User "), F.col("ord")).alias("user_name"))


def people_count(bill: Column | str = "bill_id") -> Column:
    return 2 + (F.col(bill) if isinstance(bill, str) else bill) % 3


def claims(item_rows: DataFrame) -> DataFrame:
    """One row an item and participant: mode, qty for individual claims, and whether a shared claim names the participant.

    Every third item is shared. Of the others some are claimed exactly, some by everyone in full, and most in part.
    """
    n = people_count()
    each = item_rows.withColumn("ord", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    mode = F.when(F.col("item_no") % 3 == 0, F.lit("shared")).otherwise(F.lit("individual"))
    exact = F.expr("qty div (2 + bill_id % 3)") + F.when(F.col("ord") < F.col("qty") % n, 1).otherwise(0)
    qty = F.when(F.col("item_no") % 4 == 1, exact).when(F.col("item_no") % 4 == 2, F.col("qty")).otherwise((F.col("bill_id") + F.col("item_no") + F.col("ord")) % 4)
    named = (F.col("mode") == "shared") & ((F.col("ord") + F.col("item_no") + F.col("bill_id")) % 4 != 0)
    return each.withColumn("mode", mode).withColumn("claimed", F.when(F.col("mode") == "individual", qty).otherwise(0).cast("long")).withColumn("named", named).withColumn("user_id", F.concat(F.lit("user-"), F.col("ord")))


#: The same views for the oracle, as the head of a WITH clause.
SQL = """
items AS (
  SELECT bill_id, item_no, 'item-' || item_no AS item_id, 'Part ' || l_partkey AS name, qty, total_cents // qty AS unit_cents, total_cents
  FROM (SELECT l_orderkey AS bill_id, l_partkey, CAST(l_quantity AS BIGINT) AS qty, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS total_cents,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS item_no
    FROM lineitem)),
printed AS (
  SELECT o_orderkey AS bill_id, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS total_cents, o_orderkey % 7 <> 0 AS has_subtotal,
    CASE o_orderkey % 5 WHEN 1 THEN 'percent' WHEN 2 THEN 'amount' END AS receipt_type,
    CASE o_orderkey % 5 WHEN 1 THEN o_orderkey % 130 - 5 WHEN 2 THEN (o_orderkey * 37) % 500000 END AS receipt_value,
    CASE o_orderkey % 4 WHEN 1 THEN 'percent' WHEN 2 THEN 'amount' END AS group_type,
    CASE o_orderkey % 4 WHEN 1 THEN o_orderkey % 130 - 5 WHEN 2 THEN (o_orderkey * 37) % 500000 END AS group_value
  FROM orders),
participants AS (
  SELECT o_orderkey AS bill_id, o.ord, 'user-' || o.ord AS user_id, 'User ' || o.ord AS user_name
  FROM orders JOIN (SELECT unnest([0, 1, 2, 3])::BIGINT AS ord) o ON o.ord < 2 + o_orderkey % 3),
claims AS (
  SELECT *, mode = 'shared' AND (ord + item_no + bill_id) % 4 <> 0 AS named,
    CASE WHEN mode = 'shared' THEN 0 WHEN item_no % 4 = 1 THEN qty // (2 + bill_id % 3) + CASE WHEN ord < qty % (2 + bill_id % 3) THEN 1 ELSE 0 END
      WHEN item_no % 4 = 2 THEN qty ELSE (bill_id + item_no + ord) % 4 END AS claimed
  FROM (SELECT i.*, p.ord, p.user_id, CASE WHEN item_no % 3 = 0 THEN 'shared' ELSE 'individual' END AS mode FROM items i JOIN participants p USING (bill_id)))
"""
