"""Changes of a bill's state as functions of tables: items, claims, participants, totals and discounts.

Items are (bill_id, item_id, name, qty, unit_cents, total_cents), claims (bill_id, item_id, user_id, mode, claimed, named) with one row an
item and participant, bills (bill_id, subtotal_cents, total_cents, discounts).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = ["bill_id", "item_id"]


def default_claims(items: DataFrame, participants: DataFrame) -> DataFrame:
    """A claim of 0 of every participant on every item of the bill."""
    both = items.select(*ITEM).join(participants.select("bill_id", "user_id"), "bill_id")
    return both.select(*ITEM, "user_id", F.lit("individual").alias("mode"), F.lit(0).cast("long").alias("claimed"), F.lit(False).alias("named"))


class State(NamedTuple):
    """What a party's members see of their bills; a change of state gives all four tables anew."""

    items: DataFrame
    participants: DataFrame
    claims: DataFrame
    bills: DataFrame


def set_items(state: State, items: DataFrame, totals: DataFrame) -> State:
    """The state after bills' items are replaced: claims of items that stay, default ones of new items, the totals given with the
    items (bill_id, subtotal_cents, total_cents; none where there are none), and no discount on the receipt."""
    kept = state.claims.join(items.select(*ITEM), ITEM, "left_semi")
    new = items.join(state.claims.select(*ITEM).distinct(), ITEM, "left_anti")
    bills = state.bills.drop("subtotal_cents", "total_cents").join(totals, "bill_id", "left")
    bills = bills.withColumns({c: F.lit(None).cast(kind) for c, kind in bills.dtypes if c.startswith("receipt_")})
    return State(items, state.participants, kept.unionByName(default_claims(new, state.participants)), bills.select(state.bills.columns))


def replaced(rows: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with those of the edits' keys replaced; edits of unknown keys change nothing."""
    told = [c for c in rows.columns if c not in keys]
    new = edits.select(*keys, F.struct(*told).alias("_new"))
    pick = [F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in told]
    return rows.join(new, keys, "left").select(*keys, *pick)


def add_participant(state: State, new: DataFrame) -> State:
    """New participants (bill_id, user_id, user_name) claim nothing yet: each claimed item gets a quantity of 0 of theirs and keeps
    its mode and its names. One who is there already keeps the name, and starts anew at 0."""
    key = ["bill_id", "user_id"]
    people = state.participants.unionByName(new.join(state.participants.select(*key), key, "left_anti"), allowMissingColumns=True)
    mine = state.claims.join(new.select(*key, F.lit(True).alias("_new")), key, "left")
    cleared = mine.withColumn("claimed", F.when(F.col("_new"), F.lit(0)).otherwise(F.col("claimed")).cast("long")).select(state.claims.columns)
    modes = state.claims.groupBy(*ITEM).agg(F.first("mode").alias("mode"))
    added = modes.join(new.select(*key), "bill_id").join(state.claims.select(*ITEM, "user_id"), [*ITEM, "user_id"], "left_anti")
    added = added.select(*ITEM, "user_id", "mode", F.lit(0).cast("long").alias("claimed"), F.lit(False).alias("named"))
    return State(state.items, people, cleared.unionByName(added, allowMissingColumns=True), state.bills)


def set_participants(claims: DataFrame, participants: DataFrame) -> DataFrame:
    """Claims of those who stay only."""
    return claims.join(participants.select("bill_id", "user_id"), ["bill_id", "user_id"], "left_semi")


def add_item(state: State, asked: DataFrame) -> State:
    """A new item (bill_id, item_id) of no price, and a claim of 0 on it of everyone."""
    told = {"name": F.lit("New item"), "qty": F.lit(1).cast("long"), "unit_cents": F.lit(0).cast("long"), "total_cents": F.lit(0).cast("long")}
    new = asked.select(*ITEM).withColumns(told)
    items, claims = state.items.unionByName(new, allowMissingColumns=True), state.claims.unionByName(default_claims(new, state.participants), allowMissingColumns=True)
    return State(items, state.participants, claims, state.bills)


def whole_number(text: Column) -> Column:
    """The whole number that a typed text begins with, at least 0; else 0."""
    return F.greatest(F.coalesce(F.regexp_extract(text, r"^\s*([+-]?[0-9]{1,18})", 1).try_cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))


def amount_cents(text: Column) -> Column:
    """Whole cents of the decimal number that a typed text begins with, at least 0; else 0."""
    number = F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))", 1).try_cast("decimal(18,4)")
    return F.greatest(F.floor(F.coalesce(number, F.lit(0)) * 100 + F.lit(0.5).cast("decimal(2,1)")).cast("long"), F.lit(0).cast("long"))


def edit_quantity(items: DataFrame, typed: Column) -> DataFrame:
    """Items with a typed quantity where there is one; the total follows."""
    qty = F.when(typed.isNull(), F.col("qty")).otherwise(whole_number(typed))
    return items.withColumn("qty", qty).withColumn("total_cents", F.when(typed.isNull(), F.col("total_cents")).otherwise(F.col("qty") * F.col("unit_cents")))


def edit_price(items: DataFrame, typed: Column) -> DataFrame:
    """Items with a typed unit price; what isn't a number being typed leaves them as they are."""
    good = typed.isNotNull() & typed.rlike(r"^[0-9]*\.?[0-9]*$")
    edited = items.withColumn("_good", good).withColumn("unit_cents", F.when(F.col("_good"), amount_cents(typed)).otherwise(F.col("unit_cents")))
    return edited.withColumn("total_cents", F.when(F.col("_good"), F.col("qty") * F.col("unit_cents")).otherwise(F.col("total_cents"))).drop("_good")


def update_totals(bills: DataFrame, subtotal: Column, total: Column) -> DataFrame:
    """Bills with typed totals: null leaves one as it is, a blank clears it, and editing one keeps the other."""
    told = lambda typed, old: F.when(typed.isNull(), F.col(old)).when(F.trim(typed) != "", amount_cents(typed))
    return bills.withColumns({"subtotal_cents": told(subtotal, "subtotal_cents"), "total_cents": told(total, "total_cents")})


def positive(value: Column) -> Column:
    """A discount's value; nothing where it isn't above 0."""
    return F.when(value > 0, value)


def committed_discount(kind: Column, typed: Column, old: Column) -> Column:
    """A receipt discount's value after typing: what isn't a number is ignored, a blank clears it, a percentage is at most 100."""
    value = F.regexp_extract(typed, r"^([0-9]*\.?[0-9]*)$", 1).try_cast("double")
    capped = F.when(kind == "percent", F.least(F.coalesce(value, F.lit(0.0)), F.lit(100.0))).otherwise(F.coalesce(value, F.lit(0.0)))
    return F.when(typed.rlike(r"^[0-9]*\.?[0-9]*$"), F.when(F.trim(typed) != "", positive(capped))).otherwise(old)


def discount_error(kind: Column, value: Column, subtotal: Column) -> Column:
    """Why a discount can't be: a percentage over 100, or an amount over a known subtotal by more than a cent."""
    return F.when(value <= 0, F.lit(None)).when((kind == "percent") & (value > 100), "percent").when((kind == "amount") & (value > subtotal + 1), "amount")


def reserved(name: Column) -> Column:
    """Whether a name is taken by the engine: `all` in any case; a blank name is no name and isn't reserved."""
    return F.lower(F.trim(name)) == "all"


def switch_mode(claims: DataFrame, asked: Column) -> DataFrame:
    """Claims with the mode asked for an item, or as they are where it is null: an item is claimed in one mode, so all its rows
    change. Going back to individual claims, those who shared start at 0; their names are kept."""
    back = (asked == "individual") & F.col("named")
    return claims.withColumns({"mode": F.coalesce(asked, F.col("mode")), "claimed": F.when(back, 0).otherwise(F.col("claimed")).cast("long")})


def toggle_shared(claims: DataFrame, asked: Column) -> DataFrame:
    """Shared claims with the asked participants' names turned on or off."""
    return claims.where("mode = 'shared'").withColumn("named", F.when(asked, ~F.col("named")).otherwise(F.col("named")))


def toggle_all(claims: DataFrame, checked: Column) -> DataFrame:
    """Shared claims with everyone's name, or nobody's."""
    return claims.where("mode = 'shared'").withColumn("named", checked)


def restored(state: State, store: State) -> State:
    """The state with every bill of the store overwritten, all four tables together: rows that the store lacks go, nulls come."""
    bills = store.bills.select("bill_id")
    return State(*(mine.join(bills, "bill_id", "left_anti").unionByName(theirs.select(mine.columns)) for mine, theirs in zip(state, store, strict=True)))


def display_summary(settled: DataFrame) -> DataFrame:
    """What a settlement shows, of (bill_id, subtotal_cents, total_cents, bill_cents, receipt_cents, discount_cents): the group's
    own discount, the tax row, and whether the receipt's discount has a row because tax would be negative."""
    before = F.coalesce("total_cents", "bill_cents")
    told = settled.withColumns({"group_cents": F.col("discount_cents") - F.col("receipt_cents"), "tax_row": before - F.coalesce("subtotal_cents", F.lit(0))})
    return told.withColumns({"receipt_row": (F.col("tax_row") < 0) & (F.col("receipt_cents") > 0), "has_group": F.col("group_cents") > 0})
