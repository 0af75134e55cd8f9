"""Queries of allocation, settlement, reconciliation and review, with their oracles."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsplit.operators import allocate, settle
from tabsplit.sources import views

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None):
    """Register a query under its function's name; the oracle's text follows the views' WITH clause."""

    def add(function):
        QUERIES[function.__name__] = function
        if oracle:
            head = f"WITH {views.SQL}"
            ORACLES[function.__name__] = f"{head}, {oracle[5:]}" if oracle.startswith("WITH ") else f"{head} {oracle}"
        return function

    return add


class Views:
    """The domain views of one folder, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.items = views.items(spark, sf_dir)
        self.printed = views.printed(spark, sf_dir)
        self.participants = views.participants(spark, sf_dir)
        self.claims = views.claims(self.items)


SHARES = """WITH someone AS (SELECT bill_id, item_no, bool_or(named) AS s FROM claims GROUP BY ALL),
even AS (
  SELECT bill_id, item_no, ord, total_cents // n + CASE WHEN place < total_cents % n THEN 1 ELSE 0 END AS share_cents
  FROM (SELECT *, count(*) OVER (PARTITION BY bill_id, item_no) AS n, row_number() OVER (PARTITION BY bill_id, item_no ORDER BY ord) - 1 AS place FROM claims WHERE named)),
sums AS (SELECT c.*, sum(claimed) OVER (PARTITION BY bill_id, item_no)::BIGINT AS claimed_all, row_number() OVER (PARTITION BY bill_id, item_no ORDER BY ord) - 1 AS place
  FROM claims c JOIN someone USING (bill_id, item_no) WHERE NOT s),
scaled AS (SELECT *, CASE WHEN claimed_all > qty THEN claimed * qty // claimed_all ELSE claimed END AS down FROM sums),
capped AS (SELECT *, down + CASE WHEN claimed_all > qty AND place < qty - sum(down) OVER (PARTITION BY bill_id, item_no) THEN 1 ELSE 0 END AS capped FROM scaled),
base AS (SELECT bill_id, ord, sum(share_cents)::BIGINT AS base_cents FROM
  (SELECT bill_id, ord, share_cents FROM even UNION ALL SELECT bill_id, ord, capped * unit_cents FROM capped) GROUP BY ALL)"""
BILLS = SHARES + """,
bills AS (SELECT *, CASE WHEN receipt_value IS NULL OR receipt_value <= 0 THEN 0 WHEN receipt_type = 'percent' THEN (2 * least(receipt_value, 100) * subtotal_cents + 100) // 200 ELSE receipt_value END AS receipt_cents
  FROM (SELECT *, coalesce(printed_subtotal, item_cents) AS subtotal_cents FROM
    (SELECT p.*, coalesce(s.item_cents, 0) AS item_cents, CASE WHEN has_subtotal THEN coalesce(s.item_cents, 0) + CASE WHEN bill_id % 11 = 0 THEN 137 ELSE 0 END END AS printed_subtotal
     FROM printed p LEFT JOIN (SELECT bill_id, sum(total_cents)::BIGINT AS item_cents FROM items GROUP BY ALL) s USING (bill_id)))),
taxes AS (SELECT *, total_cents + receipt_cents AS gross_cents, greatest(total_cents + receipt_cents - subtotal_cents, 0) AS tax_cents FROM bills)"""
SETTLED = BILLS + """,
people AS (SELECT p.bill_id, p.ord, p.user_id, p.user_name, coalesce(b.base_cents, 0) AS base_cents, t.* EXCLUDE (bill_id, has_subtotal)
  FROM participants p LEFT JOIN base b USING (bill_id, ord) JOIN taxes t ON t.bill_id = p.bill_id),
part1 AS (SELECT *, CASE WHEN tax_cents > 0 AND item_cents > 0 THEN (2 * base_cents * tax_cents + item_cents) // (2 * item_cents) END AS part FROM people),
taxed AS (SELECT * EXCLUDE (part), coalesce(part + CASE WHEN ord = 1 + bill_id % 3 THEN tax_cents - sum(part) OVER (PARTITION BY bill_id) ELSE 0 END, 0)::BIGINT AS tax_share FROM part1),
owed AS (SELECT *, sum(base_cents + tax_share) OVER (PARTITION BY bill_id)::BIGINT AS owed_cents,
  CASE WHEN group_value IS NULL OR group_value <= 0 THEN 0 WHEN group_type = 'percent' THEN (2 * least(group_value, 100) * subtotal_cents + 100) // 200 ELSE group_value END AS group_asked FROM taxed),
applied AS (SELECT *, least(receipt_cents, greatest(owed_cents, 0)) AS receipt_applied FROM owed),
grouped AS (SELECT *, least(group_asked, greatest(owed_cents - receipt_applied, 0)) AS group_applied FROM applied),
part2 AS (SELECT *, receipt_applied + group_applied AS discount_cents,
  CASE WHEN receipt_applied + group_applied > 0 AND item_cents > 0 THEN (2 * base_cents * (receipt_applied + group_applied) + item_cents) // (2 * item_cents) END AS part FROM grouped),
cut AS (SELECT * EXCLUDE (part), coalesce(part + CASE WHEN ord = 1 + bill_id % 3 THEN discount_cents - sum(part) OVER (PARTITION BY bill_id) ELSE 0 END, 0)::BIGINT AS discount_share FROM part2),
settled AS (SELECT *, base_cents + tax_share - discount_share AS share_cents, CASE WHEN gross_cents > 0 THEN gross_cents ELSE item_cents END - discount_cents AS bill_cents FROM cut)"""
SETTLED_COLUMNS = ["bill_id", "user_id", "ord", "base_cents", "tax_share", "discount_share", "share_cents", "bill_cents", "tax_cents", "receipt_applied", "group_applied", "discount_cents"]


@query(SETTLED + f" SELECT {', '.join(SETTLED_COLUMNS)} FROM settled")
def settle_bill(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return settle.settle_bills(v.items, v.claims, v.participants, v.printed).select(*SETTLED_COLUMNS)


@query(SHARES + " SELECT bill_id, item_no, ord, share_cents FROM even")
def split_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle.shared_shares(Views(spark, sf_dir).claims).select("bill_id", "item_no", "ord", "share_cents")


@query(SHARES + " SELECT bill_id, item_no, ord, claimed, capped::BIGINT AS capped FROM capped")
def cap_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle.individual_shares(Views(spark, sf_dir).claims).select("bill_id", "item_no", "ord", "claimed", "capped")


@query(SHARES + " SELECT bill_id, item_no, ord, (capped * unit_cents)::BIGINT AS share_cents FROM capped")
def individual_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle.individual_shares(Views(spark, sf_dir).claims).select("bill_id", "item_no", "ord", "share_cents")


@query(SHARES + " SELECT bill_id, ord, base_cents FROM base")
def share_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle.base_shares(Views(spark, sf_dir).claims)


@query("SELECT bill_id, sum(total_cents)::BIGINT AS item_cents FROM items GROUP BY ALL")
def item_subtotal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.items(spark, sf_dir).groupBy("bill_id").agg(F.sum("total_cents").alias("item_cents"))


@query(SETTLED + " SELECT bill_id, ord, tax_share FROM settled")
def distribute_proportional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle_bill(spark, sf_dir).select("bill_id", "ord", "tax_share")


@query(BILLS + " SELECT bill_id, receipt_cents FROM bills")
def resolve_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return settle.derive_tax(settle.bill_frame(v.items, v.printed)).select("bill_id", "receipt_cents")


DECIMALS = "CASE bill_id % 4 WHEN 0 THEN 'percent' WHEN 1 THEN 'amount' WHEN 2 THEN 'percent' END AS kind, CAST(CASE bill_id % 4 WHEN 0 THEN bill_id * 37 % 13000 ELSE bill_id % 900 - 100 END AS DECIMAL(18, 4)) / CAST(100 AS DECIMAL(3, 0)) AS value"


@query("SELECT bill_id, (CASE WHEN kind IS NULL OR value <= 0 THEN 0 WHEN kind = 'percent' THEN floor(least(value::DECIMAL(18, 4), 100) * item_cents / 100 + 0.5) ELSE value * 100 END)::BIGINT AS cents FROM (SELECT bill_id, item_cents, "
  + DECIMALS.replace("DECIMAL(18, 4)) / CAST(100 AS DECIMAL(3, 0))", "DOUBLE) / 100") + " FROM (SELECT bill_id, sum(total_cents)::BIGINT AS item_cents FROM items GROUP BY ALL))")
def resolve_discount_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentages and amounts with decimals, as typed: a percentage of the items' sum, halves upwards, or major units."""
    sums = item_subtotal(spark, sf_dir).selectExpr("bill_id", "item_cents", *DECIMALS.split(", CAST", 1)[:1], "CAST" + DECIMALS.split(", CAST", 1)[1])
    cents = F.when(F.col("kind") == "amount", F.col("value") * 100).otherwise(F.col("value")).cast("decimal(18,4)")
    return sums.withColumn("value", cents).select("bill_id", allocate.resolve_discount("kind", "value", "item_cents").cast("long").alias("cents"))


@query(BILLS + " SELECT bill_id, gross_cents, subtotal_cents, tax_cents FROM taxes")
def derive_tax(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return settle.derive_tax(settle.bill_frame(v.items, v.printed)).select("bill_id", "gross_cents", "subtotal_cents", "tax_cents")


@query("SELECT bill_id, least(group_value, greatest(total_cents - 3000000, 0)) AS clamped FROM printed WHERE group_type = 'amount'")
def clamp_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    capped = views.printed(spark, sf_dir).where("group_type = 'amount'").withColumn("cap", F.col("total_cents") - 3_000_000)
    return capped.select("bill_id", allocate.clamp("group_value", "cap").alias("clamped"))


@query(SETTLED + " SELECT bill_id, sum(share_cents)::BIGINT AS share_sum, (sum(share_cents) - any_value(bill_cents))::BIGINT AS gap, abs(sum(share_cents) - any_value(bill_cents)) <= 1 AS adds_up FROM settled GROUP BY ALL")
def share_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = settle_bill(spark, sf_dir).groupBy("bill_id").agg(F.sum("share_cents").alias("share_sum"), F.first("bill_cents").alias("bill"))
    return sums.select("bill_id", "share_sum", (F.col("share_sum") - F.col("bill")).alias("gap"), (F.abs(F.col("share_sum") - F.col("bill")) <= 1).alias("adds_up"))


@query(SHARES + ", t AS (SELECT bill_id, item_no, item_id, name, qty, sum(claimed)::BIGINT AS claimed FROM sums GROUP BY ALL) SELECT bill_id, item_id, name, claimed FROM t WHERE claimed > qty")
def items_needing_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle.over_claimed(Views(spark, sf_dir).claims).select("bill_id", "item_id", "name", "claimed")


@query(SHARES + ", t AS (SELECT bill_id, item_no, name, qty, sum(claimed) AS claimed FROM sums GROUP BY ALL) SELECT bill_id, string_agg(name, ', ' ORDER BY item_no) AS names FROM t WHERE claimed > qty GROUP BY ALL")
def overclaimed_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = settle.over_claimed(Views(spark, sf_dir).claims)
    return found.groupBy("bill_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_no", "name"))), lambda x: x["name"]), ", ").alias("names"))


UNCLAIMED = """, per AS (SELECT bill_id, item_no, sum(claimed)::BIGINT AS claimed, bool_or(named) AS named FROM claims GROUP BY ALL),
unclaimed AS (SELECT * FROM (SELECT i.bill_id, i.item_no, i.item_id, i.name, i.qty, coalesce(p.claimed, 0) AS claimed,
  CASE WHEN coalesce(p.named, false) THEN 0 ELSE greatest(i.qty - coalesce(p.claimed, 0), 0) END AS remaining FROM items i LEFT JOIN per p USING (bill_id, item_no)) WHERE remaining > 0)"""


@query(SHARES + UNCLAIMED + " SELECT bill_id, string_agg(CASE WHEN claimed > 0 THEN name || ' (' || remaining || ' of ' || qty || ')' ELSE name END, ', ' ORDER BY item_no) AS names FROM unclaimed GROUP BY ALL")
def unclaimed_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    text = F.when(F.col("claimed") > 0, F.concat("name", F.lit(" ("), F.col("remaining"), F.lit(" of "), F.col("qty"), F.lit(")"))).otherwise(F.col("name"))
    found = settle.unclaimed(v.items, v.claims).withColumn("text", text)
    return found.groupBy("bill_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_no", "text"))), lambda x: x["text"]), ", ").alias("names"))


@query(SETTLED + " SELECT bill_id, string_agg(user_name, ', ' ORDER BY ord) AS names FROM settled WHERE share_cents < -1 GROUP BY ALL")
def negatives_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    found = settle.settle_bills(v.items, v.claims, v.participants, v.printed).where("share_cents < -1")
    return found.groupBy("bill_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "user_name"))), lambda x: x["user_name"]), ", ").alias("names"))


MATCHED = """, m AS (SELECT bill_id, item_cents, CASE WHEN printed_subtotal IS NOT NULL THEN 'subtotal' ELSE 'total' END AS reference, item_cents - coalesce(printed_subtotal, total_cents) AS difference,
  coalesce(total_cents + greatest(receipt_cents, 0) < printed_subtotal - 1, false) AS total_below_subtotal FROM bills)"""


@query(BILLS + MATCHED + " SELECT *, CASE WHEN difference IS NULL THEN 'insufficient_data' WHEN abs(difference) <= 1 THEN 'match' ELSE 'mismatch' END AS status FROM m")
def items_vs_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    known = settle.derive_tax(settle.bill_frame(v.items, v.printed))
    return settle.items_vs_total(known, F.col("receipt_cents")).select("bill_id", "item_cents", "reference", "difference", "total_below_subtotal", "status")


MONEY = "CASE WHEN {0} < 0 THEN '-' ELSE '' END || (abs({0}) // 100) || '.' || lpad((abs({0}) % 100)::VARCHAR, 2, '0')"
money_sql = partial(str.format, MONEY)


REVIEW = SETTLED + UNCLAIMED + f""",
b AS (SELECT bill_id, sum(share_cents)::BIGINT AS share_sum, count(*) AS people, any_value(bill_cents) AS bill_cents, any_value(printed_subtotal) AS printed_subtotal, any_value(total_cents) AS total_cents,
  any_value(item_cents) AS item_cents, any_value(receipt_type) AS receipt_type, any_value(receipt_value) AS receipt_value, any_value(receipt_applied) AS receipt_applied, any_value(group_type) AS group_type,
  any_value(group_value) AS group_value, any_value(group_applied) AS group_applied, string_agg(user_name, ', ' ORDER BY ord) FILTER (WHERE share_cents < -1) AS negative FROM settled GROUP BY ALL),
ov AS (SELECT bill_id, string_agg(name, ', ' ORDER BY item_no) AS over_names FROM (SELECT bill_id, item_no, name, qty, sum(claimed) AS claimed FROM sums GROUP BY ALL) WHERE claimed > qty GROUP BY ALL),
op AS (SELECT bill_id, string_agg(CASE WHEN claimed > 0 THEN name || ' (' || remaining || ' of ' || qty || ')' ELSE name END, ', ' ORDER BY item_no) AS open_names FROM unclaimed GROUP BY ALL),
k AS (SELECT *, share_sum - bill_cents AS gap, coalesce(total_cents + greatest(receipt_applied, 0) < printed_subtotal - 1, false) AS below, abs(item_cents - coalesce(printed_subtotal, total_cents)) > 1 AS mismatch,
  CASE WHEN printed_subtotal IS NOT NULL THEN 'subtotal' ELSE 'total' END AS reference, coalesce(printed_subtotal, item_cents) AS basis FROM b LEFT JOIN ov USING (bill_id) LEFT JOIN op USING (bill_id)),
c AS (
  SELECT bill_id, 'shares-add-up' AS check_id, 'Participant shares add up to the total bill' AS label, abs(gap) > 1 AS bad, 'fail' AS how, 'Shares sum to ₹' || {money_sql('share_sum')} || ' but the total bill is ₹' || {money_sql('bill_cents')} || ' (off by ₹' || {money_sql('abs(gap)')} || ').' AS detail FROM k
  UNION ALL SELECT bill_id, 'no-negative-shares', 'No participant owes a negative amount', negative IS NOT NULL, 'fail', 'Negative share for ' || negative || '.' FROM k
  UNION ALL SELECT bill_id, 'has-participants', 'The bill has at least one participant', people = 0, 'fail', 'Add participants before settling.' FROM k
  UNION ALL SELECT bill_id, 'receipt-discount-in-full', 'The receipt discount was applied in full', asked - receipt_applied > 1, 'warn', 'The receipt discount resolves to ₹' || {money_sql('floor(asked + 0.5)::BIGINT')} || ' but only ₹' || {money_sql('receipt_applied')} || ' could be applied — it exceeds what participants owe, so check the receipt discount value.'
    FROM (SELECT *, CASE WHEN receipt_type = 'percent' THEN least(receipt_value, 100) * basis / 100 ELSE receipt_value END AS asked FROM k WHERE receipt_value > 0)
  UNION ALL SELECT bill_id, 'discount-in-full', 'The discount was applied in full', asked - group_applied > 1, 'warn', 'Requested ₹' || {money_sql('floor(asked + 0.5)::BIGINT')} || ' but only ₹' || {money_sql('group_applied')} || ' could be applied — the discount was capped at the amount owed.'
    FROM (SELECT *, CASE WHEN group_type = 'percent' THEN group_value * basis / 100 ELSE group_value END AS asked FROM k WHERE group_value > 0)
  UNION ALL SELECT bill_id, 'items-match-receipt', 'Item prices match the receipt', below OR mismatch, 'warn', CASE WHEN below THEN 'Receipt total is below the receipt subtotal — one of them was likely misread.'
    ELSE 'Items total ₹' || {money_sql('item_cents')} || ' differs from the receipt ' || reference || ' (₹' || {money_sql('coalesce(printed_subtotal, total_cents)')} || ').' END FROM k
  UNION ALL SELECT bill_id, 'no-over-claimed-items', 'No item is claimed more than it exists', over_names IS NOT NULL, 'warn', 'Over-claimed: ' || over_names || '. Shares are capped so they still add up, but fix the claim in Item Claims.' FROM k
  UNION ALL SELECT bill_id, 'all-items-claimed', 'Every item is fully claimed', open_names IS NOT NULL, 'fail', 'Unclaimed: ' || open_names || '. Assign the remaining quantity in Item Claims.' FROM k)"""


@query(REVIEW + " SELECT bill_id, check_id, CASE WHEN bad THEN how ELSE 'pass' END AS status, CASE WHEN bad THEN detail END AS detail FROM c")
def review_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return settle.review_checks(v.items, v.claims, v.participants, v.printed).drop("label")


@query(REVIEW + " SELECT check_id, label, detail, count(*) AS bills FROM c WHERE bad GROUP BY ALL")
def detail_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that bills which fail a check get, and how many bills get each."""
    v = Views(spark, sf_dir)
    failed = settle.review_checks(v.items, v.claims, v.participants, v.printed).where("status <> 'pass'")
    return failed.groupBy("check_id", "label", "detail").agg(F.count("*").alias("bills"))
