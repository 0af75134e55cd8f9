"""Changes of state and of the store's layout, case by case."""

import pytest
from pyspark.sql import functions as F

from tabsplit.operators import state, store


@pytest.fixture(scope="module")
def now(spark):
    items = spark.createDataFrame([(1, "a", "Tea", 2, 100, 200), (1, "b", "Soup", 1, 300, 300)], "bill_id long, item_id string, name string, qty long, unit_cents long, total_cents long")
    people = spark.createDataFrame([(1, "u", "Uma"), (1, "v", "Vik")], "bill_id long, user_id string, user_name string")
    claims = spark.createDataFrame([(1, "a", "u", "individual", 2, False), (1, "a", "v", "individual", 0, False), (1, "b", "u", "shared", 1, True), (1, "b", "v", "shared", 3, False)], "bill_id long, item_id string, user_id string, mode string, claimed long, named boolean")
    bills = spark.createDataFrame([(1, 500, 550, "amount", 10, None, None)], "bill_id long, subtotal_cents long, total_cents long, receipt_type string, receipt_value long, group_type string, group_value long")
    return state.State(items, people, claims, bills)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_a_new_participant_keeps_modes_and_names(spark, now):
    new = spark.createDataFrame([(1, "w", "Wes"), (1, "u", "Ulf"), (9, "x", "Xi")], "bill_id long, user_id string, user_name string")
    after = state.add_participant(now, new)
    assert rows(after.participants, "user_id", "user_name") == [("u", "Uma"), ("v", "Vik"), ("w", "Wes"), ("x", "Xi")]
    assert rows(after.claims, "item_id", "user_id", "mode", "claimed", "named") == [
        ("a", "u", "individual", 0, False), ("a", "v", "individual", 0, False), ("a", "w", "individual", 0, False),
        ("b", "u", "shared", 0, True), ("b", "v", "shared", 3, False), ("b", "w", "shared", 0, False),
    ]


def test_a_mode_holds_for_the_whole_item(now):
    back = state.switch_mode(now.claims, F.when(F.col("item_id") == "b", "individual"))
    assert rows(back, "item_id", "user_id", "mode", "claimed", "named")[2:] == [("b", "u", "individual", 0, True), ("b", "v", "individual", 3, False)]
    shared = state.switch_mode(now.claims, F.lit("shared"))
    assert rows(shared, "mode", "claimed")[0] == ("shared", 0) and {r.mode for r in shared.collect()} == {"shared"} and rows(shared, "claimed") == rows(now.claims, "claimed")


def test_new_items_clear_totals_and_the_receipts_discount(spark, now):
    items = spark.createDataFrame([(1, "b", "Soup", 1, 300, 300), (1, "c", "Cake", 1, 50, 50)], now.items.schema)
    none = spark.createDataFrame([], "bill_id long, subtotal_cents long, total_cents long")
    after = state.set_items(now, items, none)
    assert tuple(after.bills.first()) == (1, None, None, None, None, None, None)
    assert rows(after.claims, "item_id", "user_id", "mode") == [("b", "u", "shared"), ("b", "v", "shared"), ("c", "u", "individual"), ("c", "v", "individual")]


def test_a_restored_bill_is_the_stores(now):
    stored = state.State(now.items.where("item_id = 'a'"), now.participants.where("user_id = 'v'"), now.claims.where("user_id = 'v' AND item_id = 'a'"), now.bills.withColumn("subtotal_cents", F.lit(None).cast("long")))
    for mine, theirs in zip(state.restored(now, stored), stored, strict=True):
        assert mine.collect() == theirs.collect()


@pytest.mark.parametrize(("tabs", "versioned", "filled", "action"), [
    (["META", "USERS", "ITEMS", "CLAIMS"], True, True, "ready"), (["META"], False, False, "refuse"), (["Sheet1"], False, False, "create"), (["Sheet1"], False, True, "refuse"),
    (["Sheet2"], False, False, "refuse"), (["Sheet1", "Sheet2"], False, False, "refuse"), ([], False, False, "refuse"), (["META", "Notes"], True, True, "ready"),
])
def test_only_fresh_workbooks_are_laid_out(spark, tabs, versioned, filled, action):
    row = spark.createDataFrame([(tabs, versioned, filled)], "tabs array<string>, versioned boolean, filled boolean")
    assert row.select(store.init_action(F.col("tabs"), F.col("versioned"), F.col("filled")).alias("a")).first().a == action


@pytest.mark.parametrize(("url", "found"), [
    ("https://docs.google.com/spreadsheets/d/abc_-9/edit", "abc_-9"), (" https://DOCS.google.com:8443/spreadsheets/d/abc ", "abc"), ("https://docs.google.com/x/spreadsheets/d/abc", None),
    ("https://docs.google.com.evil.org/spreadsheets/d/abc", None), ("https://evil.org/docs.google.com/spreadsheets/d/abc", None), ("docs.google.com/spreadsheets/d/abc", None), ("https://docs.google.com/spreadsheets/d/", None),
    ("https://docsxgoogle.com/spreadsheets/d/abc", None), ("https://docs.google.com/?q=/spreadsheets/d/abc", None), (None, None),
])
def test_ids_of_workbooks(spark, url, found):
    assert spark.createDataFrame([(url,)], "u string").select(store.workbook_id(F.col("u")).alias("i")).first().i == found
