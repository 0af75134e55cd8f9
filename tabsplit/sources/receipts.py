"""Printed receipts made from bills: text lines in order, with headers, wrapped names and summary rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsplit.operators.settle import money
from tabsplit.sources import views


def item_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their part's name, and with a total that is quantity times unit price."""
    return named(spark, sf_dir).select("name", "bill_id", "item_no", "item_id", "qty", "unit_cents", "total_cents", "p_name", "row_cents")


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_names() with the bill's sum, and whether a row is the first of its bill.

    Parts meet the items before these are dealt by bill and numbered, so that all that follows keeps that partitioning. Items without
    a part count when items are numbered, and go then.
    """
    parts = views.table(spark, sf_dir, "part").groupBy("p_partkey").agg(F.collect_list(F.struct("p_name")).alias("parts"))
    held = views.table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    n, order = F.coalesce(F.size("parts"), F.lit(0)), views.in_bill()
    row = F.expr("cast(l_quantity as bigint)") * F.expr("cast(floor(l_extendedprice * 100 + 0.5) as bigint) div cast(l_quantity as bigint)")
    more = {
        "parts": F.col("parts"), "bill_cents": F.sum(F.when(n > 0, row * n)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "above": F.coalesce(F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    }
    rows = views.items_of(held, more).withColumn("row_cents", F.col("qty") * F.col("unit_cents"))
    each = rows.select(*(c for c in rows.columns if c != "parts"), F.posexplode("parts").alias("copy", "part"))
    return each.select("*", F.col("part.p_name").alias("p_name"), (F.col("above") + F.col("copy") == 0).alias("opens"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bill_id, line_no, line: the receipt's lines, line_no ascending from top to bottom, dealt by bill.

    The first item of a bill brings the lines that no item has, so that bills are neither grouped nor read twice.
    """
    rows = named(spark, sf_dir).withColumnRenamed("bill_cents", "s")
    row = F.concat_ws(" ", "p_name", "qty", money("unit_cents"), money("row_cents"))
    line = lambda no, text: F.struct(F.lit(no).cast("long").alias("line_no"), text.alias("line"))
    at = 1000 + F.col("item_no") * 10
    placed = lambda no, text: F.struct(no.cast("long").alias("line_no"), text.alias("line"))
    wrapped = [F.when(F.col("item_no") % 5 == 4, placed(at - 1, F.lit("Chef Special"))), placed(at, row)]
    half = F.expr("s div 40")
    charge, off, rounding = F.when(F.col("bill_id") % 5 == 0, 2500).otherwise(0), F.when(F.col("bill_id") % 4 == 1, 100).otherwise(0), F.when(F.col("bill_id") % 3 == 1, -50).otherwise(0)
    total = F.col("s") + 2 * half + charge - off + rounding + F.when(F.col("bill_id") % 13 == 0, 700).otherwise(0)
    rest = [
        line(0, F.concat(F.lit("Table "), F.col("bill_id") % 40)), line(1, F.concat(F.lit("Bill No: T"), F.col("bill_id"))),
        F.when(F.col("bill_id") % 8 != 3, line(2, F.lit("Item Qty Rate Amount"))),
        F.when(F.col("bill_id") % 9 != 0, line(900_000, F.concat(F.lit("Sub Total "), money("s")))),
        line(900_001, F.concat(F.lit("CGST "), money(half))), line(900_002, F.concat(F.lit("SGST "), money(half))),
        F.when(F.col("bill_id") % 6 == 0, line(900_003, F.concat(F.lit("Total GST "), money(2 * half)))),
        F.when(charge > 0, line(900_004, F.concat(F.lit("Service Charge "), money(charge)))),
        F.when(off > 0, line(900_005, F.concat(F.lit("Discount "), money(off)))),
        F.when(rounding < 0, line(900_006, F.concat(F.lit("Round Off "), money(rounding)))),
        line(900_007, F.concat(F.when(F.col("bill_id") % 2 == 0, "Grand Total $").otherwise("Total Rs. "), money(total))),
        F.when(F.col("bill_id") % 7 == 0, line(900_008, F.concat(F.lit("Cash "), money(total)))), line(900_009, F.lit("Thank you visit again 24")),
    ]
    # an array with a gap filter is made by a projection of its own: as part of the rest its code is too large for the JVM to compile
    held = F.array_compact(F.when(F.col("opens"), F.array(*rest, *wrapped)).when(F.col("item_no") % 5 == 4, F.array(*wrapped)).otherwise(F.array(wrapped[-1])))
    return rows.select("bill_id", held.alias("held")).select("bill_id", F.inline_outer("held"))


def token_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as a reading with geometry: `tokens` of (text, x, width, confidence). Amounts end at fixed edges, the last
    one in the column of amounts; on every third bill decimals are split over two tokens; some confidences are missing."""
    amount = lambda t: t.rlike(r"^[$]?-?[0-9]+[.][0-9]{2}$")
    sure = lambda t, i: F.when((F.col("bill_id") + i) % 11 != 0, (50 + (7 * F.length(t) + 3 * i + F.col("bill_id")) % 50).cast("double"))
    one = lambda t, x, i: F.struct(t.alias("text"), x.cast("double").alias("x"), (8.0 * F.length(t)).alias("width"), sure(t, i).alias("confidence"))

    def told(words: Column) -> Column:
        edge = lambda i: F.when(i == F.size(words) - 1, 900).otherwise(700)

        whole = lambda t, i: one(t, F.when(amount(t), edge(i) - 8 * F.length(t)).otherwise(60 * i + 20), i)

        def parts(t: Column, i: Column) -> Column:
            head, tail = F.left(t, F.length(t) - 2), F.right(t, F.lit(2))
            return F.when(amount(t), F.array(one(head, edge(i) - 8 * F.length(head), i), one(tail, edge(i) + 4, i))).otherwise(F.array(one(t, 60 * i + 20, i)))

        return F.when(F.col("bill_id") % 3 == 0, F.flatten(F.transform(words, parts))).otherwise(F.transform(words, whole))

    return lines(spark, sf_dir).withColumn("tokens", told(F.split("line", " ")))


def _money(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || (abs({x}) // 100) || '.' || lpad((abs({x}) % 100)::VARCHAR, 2, '0'))"


SQL = f"""
named AS (SELECT i.*, p_name, qty * unit_cents AS row_cents FROM items i JOIN (SELECT 'Part ' || p_partkey AS name, p_name FROM part) USING (name)),
sums AS (SELECT *, s // 40 AS half, CASE WHEN bill_id % 5 = 0 THEN 2500 ELSE 0 END AS charge, CASE WHEN bill_id % 4 = 1 THEN 100 ELSE 0 END AS off, CASE WHEN bill_id % 3 = 1 THEN -50 ELSE 0 END AS rounding
  FROM (SELECT bill_id, sum(row_cents)::BIGINT AS s FROM named GROUP BY ALL)),
totals AS (SELECT *, s + 2 * half + charge - off + rounding + CASE WHEN bill_id % 13 = 0 THEN 700 ELSE 0 END AS t FROM sums),
lines AS (
  SELECT bill_id, 1000 + item_no * 10 AS line_no, p_name || ' ' || qty || ' ' || {_money('unit_cents')} || ' ' || {_money('row_cents')} AS line FROM named
  UNION ALL SELECT bill_id, 1000 + item_no * 10 - 1, 'Chef Special' FROM named WHERE item_no % 5 = 4
  UNION ALL SELECT bill_id, 0, 'Table ' || (bill_id % 40) FROM totals
  UNION ALL SELECT bill_id, 1, 'Bill No: T' || bill_id FROM totals
  UNION ALL SELECT bill_id, 2, 'Item Qty Rate Amount' FROM totals WHERE bill_id % 8 <> 3
  UNION ALL SELECT bill_id, 900000, 'Sub Total ' || {_money('s')} FROM totals WHERE bill_id % 9 <> 0
  UNION ALL SELECT bill_id, 900001, 'CGST ' || {_money('half')} FROM totals
  UNION ALL SELECT bill_id, 900002, 'SGST ' || {_money('half')} FROM totals
  UNION ALL SELECT bill_id, 900003, 'Total GST ' || {_money('(2 * half)')} FROM totals WHERE bill_id % 6 = 0
  UNION ALL SELECT bill_id, 900004, 'Service Charge ' || {_money('charge')} FROM totals WHERE charge > 0
  UNION ALL SELECT bill_id, 900005, 'Discount ' || {_money('off')} FROM totals WHERE off > 0
  UNION ALL SELECT bill_id, 900006, 'Round Off ' || {_money('rounding')} FROM totals WHERE rounding < 0
  UNION ALL SELECT bill_id, 900007, CASE WHEN bill_id % 2 = 0 THEN 'Grand Total $' ELSE 'Total Rs. ' END || {_money('t')} FROM totals
  UNION ALL SELECT bill_id, 900008, 'Cash ' || {_money('t')} FROM totals WHERE bill_id % 7 = 0
  UNION ALL SELECT bill_id, 900009, 'Thank you visit again 24' FROM totals)
"""

#: Tokens of the lines: place counts words from 0, part tells the halves of a split decimal apart.
TOKENS_SQL = """
worded AS (SELECT bill_id, line_no, line, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) - 1 AS place, len(string_split(line, ' ')) AS n FROM lines),
priced AS (SELECT *, regexp_matches(word, '^[$]?-?[0-9]+[.][0-9]{2}$') AS amount, CASE WHEN place = n - 1 THEN 900 ELSE 700 END AS edge FROM worded),
split AS (
  SELECT *, 0 AS part, CASE WHEN amount AND bill_id % 3 = 0 THEN word[1:-3] ELSE word END AS text FROM priced
  UNION ALL SELECT *, 1, word[-2:] FROM priced WHERE amount AND bill_id % 3 = 0),
tokens AS (SELECT bill_id, line_no, line, place, part, text, (CASE WHEN part = 1 THEN edge + 20 WHEN amount THEN edge ELSE 60 * place + 20 + 8 * length(text) END)::DOUBLE AS right_edge,
  CASE WHEN (bill_id + place) % 11 <> 0 THEN (50 + (7 * length(text) + 3 * place + bill_id) % 50)::DOUBLE END AS confidence FROM split),
merged AS (SELECT bill_id, line_no, line, place, part, right_edge, confidence, text || CASE WHEN regexp_matches(text, '[0-9][.,]$') AND regexp_matches(next, '^[0-9]{2}$') THEN next ELSE '' END AS text
  FROM (SELECT *, lead(text) OVER ahead AS next, lag(text) OVER ahead AS last FROM tokens WINDOW ahead AS (PARTITION BY bill_id, line_no ORDER BY place, part))
  WHERE NOT coalesce(regexp_matches(last, '[0-9][.,]$') AND regexp_matches(text, '^[0-9]{2}$'), false)),
counted AS (SELECT bill_id, line_no, count(*) AS n_tokens FROM tokens GROUP BY ALL),
token_amounts AS (SELECT *, (CASE WHEN contains(text, '-') THEN -1 ELSE 1 END) * regexp_replace(text, '[^0-9]', '', 'g')::BIGINT * CASE WHEN contains(text, '.') THEN 1 ELSE 100 END AS cents
  FROM merged WHERE regexp_matches(text, '^[$]?-?[0-9]+([.][0-9]+)?$') AND (SELECT n_tokens FROM counted c WHERE c.bill_id = merged.bill_id AND c.line_no = merged.line_no) > 1)
"""
