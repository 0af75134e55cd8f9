"""Queries of state changes, display and store layout, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsplit.operators import committed, settle, state, store
from tabsplit.plans.billing import BILLS, SETTLED, SHARES, Views
from tabsplit.shared import new_path
from tabsplit.sources import views

QUERIES: dict = {}
ORACLES: dict = {}
CLAIM = ["bill_id", "item_id", "user_id", "mode", "claimed"]


def query(oracle: str, head: str = f"WITH {views.SQL}"):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLES[function.__name__] = f"{head}, {oracle[5:]}" if head and oracle.startswith("WITH ") else f"{head} {oracle}"
        return function

    return add


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.claims(views.items(spark, sf_dir))


def whole(spark: SparkSession, sf_dir: str) -> state.State:
    """The state of all bills."""
    items = views.items(spark, sf_dir)
    told = items.select("bill_id", "item_id", "name", "qty", "unit_cents", "total_cents")
    bills = views.printed(spark, sf_dir).select("bill_id", F.col("total_cents").alias("subtotal_cents"), (F.col("total_cents") + 500).alias("total_cents"), "receipt_type", "receipt_value", "group_type", "group_value")
    return state.State(told, views.participants(spark, sf_dir).select("bill_id", "user_id", "user_name"), views.claims(items).select(*CLAIM, "named"), bills)


def replaced_items(spark: SparkSession, sf_dir: str) -> state.State:
    """Every second item is kept, the others are replaced by new ones; two of three bills come with totals."""
    now = whole(spark, sf_dir)
    number = F.regexp_extract("item_id", "([0-9]+)$", 1).cast("long")
    items = now.items.withColumn("item_id", F.when(number % 2 == 0, F.col("item_id")).otherwise(F.concat(F.lit("new-"), "item_id")))
    totals = now.bills.where("bill_id % 3 > 0").select("bill_id", F.when(F.col("bill_id") % 3 == 1, 1000).cast("long").alias("subtotal_cents"), F.lit(2000).cast("long").alias("total_cents"))
    return state.set_items(now, items, totals)


@query("""SELECT bill_id, item_id, user_id, mode, claimed FROM claims WHERE item_no % 2 = 0
  UNION ALL SELECT bill_id, 'new-' || i.item_id, p.user_id, 'individual', 0 FROM items i JOIN participants p USING (bill_id) WHERE i.item_no % 2 = 1""")
def set_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced_items(spark, sf_dir).claims.select(CLAIM)


@query("SELECT bill_id, CASE WHEN bill_id % 3 = 1 THEN 1000 END AS subtotal_cents, CASE WHEN bill_id % 3 > 0 THEN 2000 END AS total_cents, NULL::VARCHAR AS receipt_type, NULL::BIGINT AS receipt_value, group_type, group_value FROM printed")
def set_items_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New items bring their totals, or none, and clear the receipt's discount; the group's stays."""
    return replaced_items(spark, sf_dir).bills


@query("SELECT bill_id, item_id, user_id, CASE WHEN item_no = 1 THEN 'individual' ELSE mode END AS mode, CASE WHEN item_no = 1 THEN qty ELSE claimed END AS claimed FROM claims")
def update_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = claims(spark, sf_dir)
    edits = rows.where("item_no = 1").select("bill_id", "item_id", "user_id", F.lit("individual").alias("mode"), F.col("qty").alias("claimed"))
    return state.replaced(rows.select(CLAIM), edits, ["bill_id", "item_id", "user_id"])


@query("""WITH typed AS (SELECT *, CASE item_no % 5 WHEN 0 THEN 3 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 12 END AS q, CASE item_no % 4 WHEN 0 THEN 1250 WHEN 1 THEN 700 END AS p FROM items),
 first AS (SELECT * EXCLUDE (qty, total_cents), coalesce(q, qty) AS qty, CASE WHEN q IS NULL THEN total_cents ELSE q * unit_cents END AS total_cents FROM typed)
 SELECT bill_id, item_id, qty, coalesce(p, unit_cents) AS unit_cents, CASE WHEN p IS NULL THEN total_cents ELSE qty * p END AS total_cents FROM first""")
def edit_qty_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed quantities and prices, good and bad ones."""
    typed = views.items(spark, sf_dir).withColumns({
        "q": F.expr("CASE item_no % 5 WHEN 0 THEN '3' WHEN 1 THEN 'abc' WHEN 2 THEN '-4' WHEN 3 THEN '12.7x' END"),
        "p": F.expr("CASE item_no % 4 WHEN 0 THEN '12.50' WHEN 1 THEN '7.' WHEN 2 THEN 'x1' END"),
    })
    return state.edit_price(state.edit_quantity(typed, F.col("q")), F.col("p")).select("bill_id", "item_id", "qty", "unit_cents", "total_cents")


@query("""SELECT bill_id, CASE bill_id % 4 WHEN 0 THEN total_cents - 100 WHEN 2 THEN 1235 WHEN 3 THEN 0 END AS subtotal_cents,
  CASE bill_id % 3 WHEN 0 THEN total_cents WHEN 2 THEN 990 END AS total_cents FROM printed""")
def update_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    bills = views.printed(spark, sf_dir).select("bill_id", (F.col("total_cents") - 100).alias("subtotal_cents"), "total_cents")
    subtotal = F.expr("CASE bill_id % 4 WHEN 1 THEN ' ' WHEN 2 THEN '12.345' WHEN 3 THEN 'abc' END")
    return state.update_totals(bills, subtotal, F.expr("CASE bill_id % 3 WHEN 1 THEN '' WHEN 2 THEN '9.9' END"))


LISTED = """SELECT bill_id, 'items' AS tab, item_id AS key, concat_ws('|', name, qty, unit_cents, total_cents) AS cells FROM ({items})
  UNION ALL SELECT bill_id, 'users', user_id, user_name FROM ({users})
  UNION ALL SELECT bill_id, 'claims', item_id || ' ' || user_id, concat_ws('|', mode, claimed, named) FROM ({claims})
  UNION ALL SELECT bill_id, 'bill', '', concat_ws('|', coalesce(subtotal_cents::VARCHAR, '-'), coalesce(total_cents::VARCHAR, '-'), coalesce(receipt_type, '-'), coalesce(receipt_value::VARCHAR, '-'), coalesce(group_type, '-'), coalesce(group_value::VARCHAR, '-')) FROM ({bills})"""


def listed(now: state.State) -> DataFrame:
    """All tables of a state as rows of one: bill_id, tab, key and cells."""
    row = lambda df, tab, key, *cells: df.select("bill_id", F.lit(tab).alias("tab"), key.alias("key"), F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cells]).alias("cells"))
    found = row(now.items, "items", F.col("item_id"), "name", "qty", "unit_cents", "total_cents").union(row(now.participants, "users", F.col("user_id"), "user_name"))
    found = found.union(row(now.claims, "claims", F.concat_ws(" ", "item_id", "user_id"), "mode", "claimed", "named"))
    return found.union(row(now.bills, "bill", F.lit(""), "subtotal_cents", "total_cents", "receipt_type", "receipt_value", "group_type", "group_value"))


def stored(spark: SparkSession, sf_dir: str) -> state.State:
    """What the store holds of every second bill: fewer items and people, other totals, and a discount of the group's."""
    now = whole(spark, sf_dir)
    odd = lambda df: df.where("bill_id % 2 = 0")
    bills = now.bills.select("bill_id", F.lit(None).cast("long").alias("subtotal_cents"), (F.col("total_cents") + 1).alias("total_cents"), F.lit(None).cast("string").alias("receipt_type"), F.lit(None).cast("long").alias("receipt_value"), F.lit("amount").alias("group_type"), F.lit(5).cast("long").alias("group_value"))
    first = F.regexp_extract("item_id", "([0-9]+)$", 1).cast("long") <= 2
    return state.State(odd(now.items.where(first)).withColumn("qty", F.lit(7).cast("long")), odd(now.participants.where("user_id <> 'user-1'")), odd(now.claims.where(first & (F.col("user_id") != "user-1"))), odd(bills))


@query(LISTED.format(
    items="SELECT bill_id, item_id, name, CASE WHEN bill_id % 2 = 0 THEN 7 ELSE qty END AS qty, unit_cents, total_cents FROM items WHERE bill_id % 2 = 1 OR item_no <= 2", users="SELECT * FROM participants WHERE bill_id % 2 = 1 OR ord <> 1",
    claims="SELECT * FROM claims WHERE bill_id % 2 = 1 OR (item_no <= 2 AND ord <> 1)",
    bills="SELECT bill_id, CASE WHEN bill_id % 2 = 1 THEN total_cents END AS subtotal_cents, total_cents + 500 + CASE WHEN bill_id % 2 = 0 THEN 1 ELSE 0 END AS total_cents, CASE WHEN bill_id % 2 = 1 THEN receipt_type END AS receipt_type, CASE WHEN bill_id % 2 = 1 THEN receipt_value END AS receipt_value, CASE WHEN bill_id % 2 = 0 THEN 'amount' ELSE group_type END AS group_type, CASE WHEN bill_id % 2 = 0 THEN 5 ELSE group_value END AS group_value FROM printed"))
def restore_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second bill is in the store, which overwrites all tables of it."""
    return listed(state.restored(whole(spark, sf_dir), stored(spark, sf_dir)))


@query("SELECT bill_id, item_id, user_id, bill_id % 2 = 0 AS named FROM claims WHERE mode = 'shared'")
def toggle_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.toggle_all(claims(spark, sf_dir), F.col("bill_id") % 2 == 0).select("bill_id", "item_id", "user_id", "named")


@query("SELECT bill_id, item_id, user_id, claimed FROM claims WHERE ord < 2")
def set_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    staying = views.participants(spark, sf_dir).where("ord < 2")
    return state.set_participants(claims(spark, sf_dir), staying).select("bill_id", "item_id", "user_id", "claimed")


@query(SETTLED + """, one AS (SELECT bill_id, any_value(subtotal_cents) AS subtotal_cents, any_value(total_cents) AS total_cents, any_value(receipt_applied) AS receipt_cents, any_value(discount_cents) AS discount_cents FROM settled GROUP BY ALL)
 SELECT bill_id, discount_cents - receipt_cents AS group_cents, total_cents - subtotal_cents AS tax_row, total_cents - subtotal_cents < 0 AND receipt_cents > 0 AS receipt_row, discount_cents > receipt_cents AS has_group FROM one""")
def display_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    settled = settle.settle_bills(v.items, v.claims, v.participants, v.printed)
    bills = settled.groupBy("bill_id").agg(*(F.first(c).alias(c) for c in ("subtotal_cents", "total_cents", "bill_cents", "receipt_applied", "discount_cents"))).withColumnRenamed("receipt_applied", "receipt_cents")
    return state.display_summary(bills).select("bill_id", "group_cents", "tax_row", "receipt_row", "has_group")


@query(BILLS + """ SELECT bill_id, CASE WHEN group_value <= 0 THEN NULL WHEN group_type = 'percent' AND group_value > 100 THEN 'percent' WHEN group_type = 'amount' AND group_value > printed_subtotal + 1 THEN 'amount' END AS error FROM bills""")
def discount_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return settle.bill_frame(v.items, v.printed).select("bill_id", state.discount_error(F.col("group_type"), F.col("group_value"), F.col("printed_subtotal")).alias("error"))


@query("SELECT c_custkey, lower(trim(n)) = 'all' AS rejected FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' All ' WHEN 1 THEN ' ' WHEN 2 THEN 'ALL' ELSE c_name END AS n FROM customer)", "")
def reserved_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("CASE c_custkey % 4 WHEN 0 THEN ' All ' WHEN 1 THEN ' ' WHEN 2 THEN 'ALL' ELSE c_name END")
    return views.table(spark, sf_dir, "customer").select("c_custkey", state.reserved(name).alias("rejected"))


@query("""SELECT bill_id, CASE bill_id % 5 WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN receipt_type = 'percent' THEN 100 ELSE 150 END WHEN 2 THEN 12.5 WHEN 3 THEN receipt_value ELSE NULL END::DOUBLE AS committed FROM printed""")
def commit_receipt_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank, too large, decimal, not a number, and zero."""
    typed = F.expr("CASE bill_id % 5 WHEN 0 THEN '' WHEN 1 THEN '150' WHEN 2 THEN '12.5' WHEN 3 THEN '1x' ELSE '0' END")
    return views.printed(spark, sf_dir).select("bill_id", state.committed_discount(F.col("receipt_type"), typed, F.col("receipt_value").cast("double")).alias("committed"))


@query("SELECT bill_id, CASE WHEN group_value > 0 THEN group_value END AS value FROM printed")
def normalise_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.printed(spark, sf_dir).select("bill_id", state.positive(F.col("group_value")).alias("value"))


@query("""SELECT bill_id, item_id, user_id, coalesce(asked, mode) AS mode, CASE WHEN asked = 'individual' AND named THEN 0 ELSE claimed END AS claimed, named
  FROM (SELECT *, CASE WHEN item_no % 6 = 3 THEN 'individual' WHEN item_no % 6 = 4 THEN 'shared' END AS asked FROM (SELECT * REPLACE (claimed + ord AS claimed) FROM claims))""")
def mode_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared items back to individual claims, others to shared: whole items change, and quantities of those not named stay."""
    asked = F.when(F.col("item_no") % 6 == 3, "individual").when(F.col("item_no") % 6 == 4, "shared")
    now = claims(spark, sf_dir).withColumn("claimed", F.col("claimed") + F.col("ord"))
    return state.switch_mode(now, asked).select("bill_id", "item_id", "user_id", "mode", "claimed", "named")


@query("SELECT bill_id, item_id, user_id, CASE WHEN ord = 0 THEN NOT named ELSE named END AS named FROM claims WHERE mode = 'shared'")
def shared_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.toggle_shared(claims(spark, sf_dir), F.col("ord") == 0).select("bill_id", "item_id", "user_id", "named")


@query("""SELECT bill_id, item_id, user_id, mode, CASE WHEN user_id = 'user-0' AND bill_id % 2 = 0 THEN 0 ELSE claimed END AS claimed, named FROM claims
  UNION ALL SELECT bill_id, item_id, 'guest', CASE WHEN item_no % 3 = 0 THEN 'shared' ELSE 'individual' END, 0, false FROM items""")
def add_participant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A guest joins every bill and claims nothing, whatever the items' mode; on half of the bills one joins who is there."""
    now = whole(spark, sf_dir)
    guest = now.bills.select("bill_id", F.lit("guest").alias("user_id"), F.lit("Guest").alias("user_name"))
    again = now.bills.where("bill_id % 2 = 0").select("bill_id", F.lit("user-0").alias("user_id"), F.lit("Other").alias("user_name"))
    return state.add_participant(now, guest.union(again)).claims.select(*CLAIM, "named")


@query("SELECT bill_id, item_id, name, qty, total_cents FROM items UNION ALL SELECT bill_id, 'item-new', 'New item', 1, 0 FROM printed")
def add_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = whole(spark, sf_dir)
    return state.add_item(now, now.bills.select("bill_id", F.lit("item-new").alias("item_id"))).items.select("bill_id", "item_id", "name", "qty", "total_cents")


@query("SELECT bill_id, item_id, user_id, mode, claimed FROM claims UNION ALL SELECT bill_id, 'item-new', user_id, 'individual', 0 FROM participants")
def add_item_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new item comes with everyone's claim of 0."""
    now = whole(spark, sf_dir)
    return state.add_item(now, now.bills.select("bill_id", F.lit("item-new").alias("item_id"))).claims.select(CLAIM)


@query("SELECT bill_id, item_id, CASE WHEN item_no = 1 THEN 'Edited' ELSE name END AS name, CASE WHEN item_no = 1 THEN 2 * unit_cents ELSE total_cents END AS total_cents FROM items")
def update_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit joined in by key; its total is the new quantity times the price."""
    items = views.items(spark, sf_dir)
    edits = items.where("item_no = 1").select("bill_id", "item_id", F.lit("Edited").alias("name"), (2 * F.col("unit_cents")).alias("total_cents"))
    return state.replaced(items.select("bill_id", "item_id", "name", "total_cents"), edits, ["bill_id", "item_id"])


# what was only part of another query

@query(SETTLED + " SELECT bill_id, (sum(share_cents) - any_value(bill_cents))::BIGINT AS gap FROM settled GROUP BY ALL")
def share_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    settled = settle.settle_bills(v.items, v.claims, v.participants, v.printed)
    return settled.groupBy("bill_id").agg((F.sum("share_cents") - F.first("bill_cents")).alias("gap"))


@query(SHARES + " SELECT bill_id, item_no, ord, total_cents // n + CASE WHEN place < total_cents % n THEN 1 ELSE 0 END AS share_cents FROM (SELECT *, count(*) OVER (PARTITION BY bill_id, item_no) AS n, row_number() OVER (PARTITION BY bill_id, item_no ORDER BY ord) - 1 AS place FROM claims WHERE named)")
def remainder_first_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even splits, of which the first in order get a cent more."""
    return settle.shared_shares(Views(spark, sf_dir).claims).select("bill_id", "item_no", "ord", "share_cents")


@query(SETTLED + " SELECT bill_id, (tax_share - CASE WHEN tax_cents > 0 AND item_cents > 0 THEN (2 * base_cents * tax_cents + item_cents) // (2 * item_cents) ELSE 0 END)::BIGINT AS remainder FROM settled WHERE ord = 1 + bill_id % 3")
def remainder_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last participant takes over or under the own rounded share of the tax."""
    v = Views(spark, sf_dir)
    settled = settle.settle_bills(v.items, v.claims, v.participants, v.printed).where("ord = 1 + bill_id % 3")
    own = F.expr("CASE WHEN tax_cents > 0 AND item_cents > 0 THEN (2 * base_cents * tax_cents + item_cents) div (2 * item_cents) ELSE 0 END")
    return settled.select("bill_id", (F.col("tax_share") - own).alias("remainder"))


REVIEW = """WITH twice AS (SELECT bill_id, item_no, user_id, claimed, 0 AS v FROM claims UNION ALL SELECT bill_id, item_no, user_id, claimed + 1, 1 FROM claims WHERE ord = 0),
 last AS (SELECT bill_id, item_no, user_id, arg_max(claimed, v) AS claimed FROM twice GROUP BY ALL)"""


@query(REVIEW + " SELECT i.bill_id, i.item_id, greatest(any_value(qty) - sum(claimed), 0)::BIGINT AS remaining FROM items i LEFT JOIN last l USING (bill_id, item_no) GROUP BY ALL")
def join_items_claims_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with what is left of them, where of two claims of one participant the last counts."""
    items = views.items(spark, sf_dir)
    each = views.claims(items).select("bill_id", "item_no", "user_id", "claimed", F.lit(0).alias("row_no"), "ord")
    twice = each.drop("ord").union(each.where("ord = 0").select("bill_id", "item_no", "user_id", F.col("claimed") + 1, F.lit(1)))
    last = settle.last_claims(twice, "row_no")
    sums = last.groupBy("bill_id", "item_no").agg(F.sum("claimed").alias("claimed"))
    return items.join(sums, ["bill_id", "item_no"], "left").select("bill_id", "item_id", F.greatest(F.col("qty") - F.coalesce("claimed", F.lit(0)), F.lit(0)).alias("remaining"))


@query(SHARES + " SELECT p.bill_id, p.user_id, coalesce(base_cents, 0) AS base_cents FROM participants p LEFT JOIN base USING (bill_id, ord)")
def semi_on_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of those who take part, and of nobody else; who claims nothing has 0."""
    v = Views(spark, sf_dir)
    return v.participants.join(settle.base_shares(v.claims), ["bill_id", "ord"], "left").select("bill_id", "user_id", F.coalesce("base_cents", F.lit(0)).alias("base_cents"))


SINK = """WITH old AS (SELECT user_id, event_type, arg_max(props, event_id) AS props FROM events WHERE event_type <> 'error' GROUP BY ALL),
wanted AS (SELECT user_id, event_type, arg_max(props, event_id) AS props FROM events WHERE event_type <> 'view' GROUP BY ALL)"""


@query(SINK + " SELECT user_id, event_type, coalesce(w.props, o.props) AS props FROM old o FULL JOIN wanted w USING (user_id, event_type)", "")
def sink_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after two upserts, and the second one again, which makes no version."""
    rows = views.table(spark, sf_dir, "events")
    last = lambda kind: rows.where(f"event_type <> '{kind}'").groupBy("user_id", "event_type").agg(F.max_by("props", "event_id").alias("props"))
    held = committed.Store(spark, new_path(spark, "store"), {"rows": committed.Table("user_id long, event_type string, props string", ("user_id", "event_type"))})
    for kind in ("error", "view", "view"):
        held.upsert({"rows": last(kind)})
    return held.read("rows")


@query("""SELECT 'items' AS tab, bill_id, item_id AS key, CASE WHEN item_no <= 2 AND bill_id % 2 = 0 THEN 7 ELSE qty END::VARCHAR AS cell FROM items
  UNION ALL SELECT 'users', bill_id, user_id, user_name FROM participants""")
def snapshot_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables that change together: all bills are stored, then half of them with other quantities; a snapshot reads one version."""
    now, told = whole(spark, sf_dir), stored(spark, sf_dir)
    tables = {"items": committed.Table("bill_id long, item_id string, qty long", ("bill_id", "item_id")), "users": committed.Table("bill_id long, user_id string, user_name string", ("bill_id", "user_id"))}
    held = committed.Store(spark, new_path(spark, "store"), tables)
    for state_ in (now, told):
        held.upsert({"items": state_.items.select("bill_id", "item_id", "qty"), "users": state_.participants})
    found = held.snapshot()
    return found["items"].select(F.lit("items").alias("tab"), "bill_id", F.col("item_id").alias("key"), F.col("qty").cast("string").alias("cell")).union(found["users"].select(F.lit("users"), "bill_id", "user_id", "user_name"))


@query(SINK + " SELECT user_id || chr(0) || event_type AS key, o.props = w.props AS same FROM old o JOIN wanted w USING (user_id, event_type)", "")
def merge_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events")
    last = lambda kind, name: rows.where(f"event_type <> '{kind}'").groupBy("user_id", "event_type").agg(F.max_by("props", "event_id").alias(name))
    met = last("error", "old").join(last("view", "new"), ["user_id", "event_type"])
    return met.select(store.join_key("user_id", "event_type").alias("key"), (F.col("old") == F.col("new")).alias("same"))


@query("SELECT o_orderkey || chr(0) || o_custkey || chr(0) || o_orderstatus AS key FROM orders", "")
def join_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "orders").select(store.join_key("o_orderkey", "o_custkey", "o_orderstatus").alias("key"))


@query("SELECT user_id, event_type FROM (SELECT user_id, event_type FROM events WHERE value > 50 INTERSECT SELECT user_id, event_type FROM events WHERE value <= 50) EXCEPT SELECT user_id, event_type FROM events WHERE event_type = 'error'", "")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events of a user with low and high values, but errors."""
    kinds = views.table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    some = lambda where: kinds.where(where).select("user_id", "event_type")
    return some("value > 50").intersect(some("value <= 50")).exceptAll(some("event_type = 'error'").distinct())


@query("SELECT DISTINCT user_id, event_type FROM events", "")
def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select("user_id", "event_type").dropDuplicates()


@query("SELECT l_orderkey AS bill_id, l_linenumber AS line, floor(l_extendedprice * 100 + 0.5)::BIGINT AS cents, (floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) / 100)::DOUBLE AS net FROM lineitem", "")
def round_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.5) / 100
    return views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bill_id"), F.col("l_linenumber").alias("line"), views.cents("l_extendedprice").alias("cents"), net.cast("double").alias("net"))


@query("SELECT bill_id, item_id, CASE WHEN bill_id % 3 = 0 THEN '-' ELSE '' END || (total_cents // 100) || '.' || lpad((total_cents % 100)::VARCHAR, 2, '0') AS text FROM items WHERE total_cents > 0")
def to_fixed2(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = F.when(F.col("bill_id") % 3 == 0, -F.col("total_cents")).otherwise(F.col("total_cents"))
    return views.items(spark, sf_dir).where("total_cents > 0").select("bill_id", "item_id", settle.money(signed).alias("text"))


@query("SELECT bill_id, item_id, -abs(CASE WHEN item_no % 2 = 0 THEN -total_cents ELSE total_cents END) AS amount FROM items")
def adjust_to_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tabsplit.operators import parse

    mixed = F.when(F.col("item_no") % 2 == 0, -F.col("total_cents")).otherwise(F.col("total_cents"))
    return views.items(spark, sf_dir).select("bill_id", "item_id", parse.adjust_to_negative(mixed).alias("amount"))


@query("SELECT bill_id, item_id, qty * (1 + item_no % 3) <= 50 OR item_no % 5 = 0 AS plausible FROM items")
def plausible_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unknown quantity is plausible, one above 50 isn't."""
    from tabsplit.operators import parse

    read = F.when(F.col("item_no") % 5 != 0, F.col("qty") * (1 + F.col("item_no") % 3))
    return views.items(spark, sf_dir).select("bill_id", "item_id", parse.plausible(read).alias("plausible"))


@query("""WITH stored AS (SELECT 'meta' AS tab, bill_id, 1 AS row_no, 'total' AS key, total_cents::VARCHAR AS cells FROM printed UNION ALL SELECT 'users', bill_id, ord, user_id, user_name FROM participants UNION ALL SELECT 'items', bill_id, item_no, item_id, name FROM items
   UNION ALL SELECT 'claims', bill_id, 10 * item_no + ord, item_id || ' ' || user_id, mode || '|' || claimed FROM claims WHERE mode = 'individual' OR named)
 SELECT tab, bill_id, key, cells FROM (SELECT *, row_number() OVER (PARTITION BY tab, bill_id ORDER BY row_no) AS n FROM stored) WHERE n < CASE tab WHEN 'meta' THEN 20 WHEN 'claims' THEN 5 ELSE 4 END""")
def scan_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the four tabs of every bill, read up to their bounds; three of the bounds are small here so that they cut."""
    items = views.items(spark, sf_dir)
    kept = views.claims(items).where("mode = 'individual' OR named")
    tabs = {
        "meta": views.printed(spark, sf_dir).select("bill_id", F.lit(1).cast("long").alias("row_no"), F.lit("total").alias("key"), F.col("total_cents").cast("string").alias("cells")),
        "users": views.participants(spark, sf_dir).select("bill_id", F.col("ord").alias("row_no"), F.col("user_id").alias("key"), F.col("user_name").alias("cells")),
        "items": items.select("bill_id", F.col("item_no").alias("row_no"), F.col("item_id").alias("key"), F.col("name").alias("cells")),
        "claims": kept.select("bill_id", (10 * F.col("item_no") + F.col("ord")).alias("row_no"), F.concat_ws(" ", "item_id", "user_id").alias("key"), F.concat_ws("|", "mode", "claimed").alias("cells")),
    }
    read = store.bounded_tabs(tabs, "bill_id", {**store.BOUNDS, "users": 4, "items": 4, "claims": 5})
    found = [df.select(F.lit(tab).alias("tab"), "bill_id", "key", "cells") for tab, df in read.items()]
    return found[0].union(found[1]).union(found[2]).union(found[3])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem) WHERE n < 1000", "")
def range_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of each supplier's table as a bounded read gives them: 1000 rows with the header."""
    rows = views.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    return store.bounded(rows, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"], store.BOUNDS["items"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT user_id, count(DISTINCT event_type) FILTER (WHERE event_type IN ('click', 'view', 'error')) = 3 AS complete, bool_or(event_type = 'view' AND value > 90) AS versioned FROM events GROUP BY ALL", "")
def scan_schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a party has every required tab, and a row of the version asked for."""
    rows = views.table(spark, sf_dir, "events")
    return store.schema_check(rows, "user_id", F.col("event_type"), ["click", "view", "error"], (F.col("event_type") == "view") & (F.col("value") > 90))


@query("""WITH books AS (SELECT c_custkey, c_custkey % 6 AS kind, c_custkey % 12 < 6 AS upper_half, c_custkey % 5 = 0 AS filled FROM customer)
 SELECT c_custkey, CASE kind WHEN 0 THEN CASE WHEN filled THEN 'refuse' ELSE 'create' END WHEN 3 THEN CASE WHEN upper_half THEN 'ready' ELSE 'refuse' END WHEN 4 THEN CASE WHEN upper_half THEN 'ready' ELSE 'refuse' END ELSE 'refuse' END AS action FROM books""", "")
def store_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What opening a workbook does: leave a store of our version, lay out tabs in a fresh workbook, refuse any other: one with a
    second tab, a renamed or filled one, and a store of another version, alone or among other tabs."""
    tabs = F.expr("CASE c_custkey % 6 WHEN 0 THEN array('Sheet1') WHEN 1 THEN array('Sheet1', 'Notes') WHEN 2 THEN array('Other') WHEN 3 THEN array('META', 'USERS', 'ITEMS', 'CLAIMS') WHEN 4 THEN array('META') ELSE array('sheet1') END")
    return views.table(spark, sf_dir, "customer").select("c_custkey", store.init_action(tabs, F.col("c_custkey") % 12 < 6, F.col("c_custkey") % 5 == 0).alias("action"))


LINKS = """CASE page_id % 8 WHEN 0 THEN 'https://docs.google.com/spreadsheets/d/id' || page_id || '_-x/edit#gid=0' WHEN 1 THEN 'https://docs.google.com.evil.example/spreadsheets/d/abc' || page_id WHEN 2 THEN url
  WHEN 3 THEN 'not a url ' || page_id WHEN 4 THEN 'https://docs.google.com/x/spreadsheets/d/id' || page_id WHEN 5 THEN '  HTTPS://Docs.Google.COM:443/spreadsheets/d/id' || page_id || '?usp=sharing  '
  WHEN 6 THEN 'https://docs.google.com/open?to=/spreadsheets/d/id' || page_id ELSE 'http://me@docs.google.com/spreadsheets/d/' END"""


@query(f"SELECT page_id, url, CASE page_id % 8 WHEN 0 THEN 'id' || page_id || '_-x' WHEN 5 THEN 'id' || page_id END AS id FROM (SELECT page_id, {LINKS} AS url FROM pages)", "")
def url_extract_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workbook's id where a link's path begins with it, on the one trusted host; nothing from any other."""
    return views.table(spark, sf_dir, "pages").select("page_id", F.expr(LINKS).alias("url")).withColumn("id", store.workbook_id(F.col("url")))
