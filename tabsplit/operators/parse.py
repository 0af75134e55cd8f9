"""Receipt lines to items and totals: classification with a running summary flag, the item scan, and reconciliation.

Lines are (bill_id, line_no, line), and where a reading has geometry also `tokens`, an array of (text, x, width, confidence)
from left to right. Every line is read once, into one struct; what follows are windows and sums by bill, which share the
lines' one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsplit.functions import money as m
from tabsplit.functions import rules
from tabsplit.functions.columns import half_up, let, once

MOST_QUANTITY, TOLERANCE = 50, 1
#: Confidences without any of the tokens', in ten-thousandths: of an amount, of an item row, without a quantity, without a unit price.
BASELINE, ROW_BASELINE, NO_QUANTITY, NO_UNIT = 7500, 7000, 2500, 1000
#: The confidence of a subtotal that is the items' sum, and the fixed text of a bill whose total differs.
DERIVED_SUBTOTAL, DIFFERS = 6500, "Summary values differ from the selected total by %d minor units."
#: A payment's share of its confidence as a total, and a derived unit price's, in hundredths.
AS_TOTAL, DERIVED = 72, 82
#: How far an amount's right edge may lie from the column: pixels, or a share of the image's width.
NEAR, NEAR_SHARE, WIDTH = 24.0, 0.045, 1000
#: place is the token's in its line; null where there is no geometry.
AMOUNT = "struct<text: string, cents: bigint, right: double, confidence: double, place: int>"


def confidence(tokens: Column, baseline: int) -> Column:
    """Mean of the confidences that are known, in percent, as ten-thousandths from 0 to 10000; else the baseline."""
    known = F.filter(F.transform(tokens, lambda t: t["confidence"]), lambda c: c.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, c: a + c) / F.size(known)
    return F.coalesce(F.when(F.size(known) > 0, F.least(F.greatest(half_up(mean * 100), F.lit(0)), F.lit(10000))), F.lit(baseline)).cast("long")


def amounts_of(line: Column, tokens: Column | None) -> Column:
    """The amounts of a line: of its tokens where it has several, else of its text; a line's only token is then their place."""
    only = F.get(tokens, F.lit(0)) if tokens is not None else None
    right, sure, place = ((only["x"] + only["width"]).cast("double"), only["confidence"].cast("double"), F.when(only.isNotNull(), 0)) if tokens is not None else (F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("int"))
    told = lambda t: F.struct(t["text"].alias("text"), t["cents"].alias("cents"), right.alias("right"), sure.alias("confidence"), place.alias("place"))
    of_text = F.when(line.rlike("[0-9]"), F.transform(m.text_amounts(line), told)).otherwise(F.array().cast(f"array<{AMOUNT}>"))
    return of_text if tokens is None else F.when(F.size(tokens) > 1, m.token_amounts(tokens)).otherwise(of_text)


def in_column(amounts: Column, column: Column, width: Column) -> Column:
    """Whether an amount ends near the column; so does one without a place, and any where no column is known."""
    near = F.greatest(F.lit(NEAR), F.coalesce(width, F.lit(WIDTH)) * NEAR_SHARE)
    return (F.size(amounts) > 0) & (column.isNull() | F.exists(amounts, lambda a: a["right"].isNull() | (F.abs(a["right"] - column) <= near)))


def with_amounts(lines: DataFrame) -> DataFrame:
    """Lines with their amounts: text, minor units, right edge and confidence."""
    tokens = F.col("tokens") if "tokens" in lines.columns else None
    return lines.withColumn("amounts", amounts_of(F.col("line"), tokens))


def classified(lines: DataFrame, dealt: bool = False) -> DataFrame:
    """Lines with amounts, seen, section, confidence, item_header, named and bare.

    `seen` tells whether a summary row with an amount came after the last header row above. It changes only classes that
    never set it, so a line's class is read once, but for the choice that depends on `seen`. Lines are dealt by bill before they
    are read: they are smaller then, reading is the costly part, and all that follows keeps that partitioning. dealt: they are already,
    by what made them.
    """
    lines = lines if dealt else lines.repartition("bill_id")
    tokens = F.col("tokens") if "tokens" in lines.columns else None
    # no function of arrays around the rules: their code is generated then, not interpreted
    small = lines.withColumn("_small", rules.in_small(F.col("line")))
    read = small.select(*lines.columns, rules.reading(F.col("line"), F.col("_small")).alias("_r"), *([m.text_runs(F.col("line")).alias("_runs")] if tokens is None else [amounts_of(F.col("line"), tokens).alias("amounts")]))
    if tokens is None:
        nothing = [F.array().cast(f"array<{kind}>") for kind in ("double", "double", "int")]
        read = read.withColumn("amounts", F.arrays_zip("_runs", m.run_cents(F.col("_runs")), *nothing).cast(f"array<{AMOUNT}>")).withColumn("_priced", F.size("_runs") > 0)
    else:
        read = read.withColumn("_priced", F.size("amounts") > 0)
    read = read.select(*lines.columns, "amounts", "_priced", "_r.code", "_r.itemlike", "_r.wordy", "_r.named")
    sums = [k for k, (section, _) in enumerate(rules.CLASSES) if section in rules.SUMMARY_SECTIONS]
    event = F.when(F.col("code") == rules.ITEM_HEADER, False).when(F.col("code").isin(sums) & F.col("_priced"), True)
    order = Window.partitionBy("bill_id").orderBy("line_no")
    seen = F.coalesce(F.last("_event", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    end = F.coalesce(F.last("_event", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(False))
    known = read.withColumn("_event", event).withColumns({"seen": seen, "seen_at_end": end})
    kind = rules.settled(F.col("code"), F.col("itemlike"), F.col("wordy"), F.col("seen"))
    known = known.withColumn("_kind", kind).withColumns({"section": rules.section_of(F.col("_kind")), "confidence": rules.confidence_of(F.col("_kind"))})
    known = known.withColumns({"item_header": F.col("_kind") == rules.ITEM_HEADER, "bare": ~F.col("named") & F.col("_priced")})
    return known.drop("_event", "_kind", "_priced", "code", "itemlike", "wordy")


def candidates(known: DataFrame) -> DataFrame:
    """Classified lines with item_no, anchor, open, and `resets` and `begins`: the number of header lines so far, and that of the line that begins
    the item. They are windows of the order that classified() has, all in two passes.

    Rows that print an amount in the column (anchors) close an item, a run of bare amounts closes one item together. Lines
    above it that name something, or are bare numbers, belong to it, unless a header line lies between. Where the receipt has a
    header row of its items, anchors count between it and the next summary only.

    known may have amount_column and image_width beside what classified() gives.
    """
    order = Window.partitionBy("bill_id").orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summary = F.col("section").isin(rules.SUMMARY_SECTIONS) | (F.col("section") == "footer")
    inside = F.coalesce(F.last(F.when(F.col("item_header"), True).when(summary, False), ignorenulls=True).over(upto), F.lit(False))
    column = F.col("amount_column") if "amount_column" in known.columns else F.lit(None).cast("long")
    width = F.col("image_width") if "image_width" in known.columns else F.lit(None).cast("long")
    told = known.withColumn("_placed", in_column(F.col("amounts"), column, width))
    told = told.withColumns({"_bare": (F.col("section") == "unknown") & F.col("bare") & F.col("_placed"), "_item": (F.col("section") == "item") & F.col("_placed")})
    told = told.withColumns({
        "_inside": inside, "_gated": F.max("item_header").over(whole), "resets": F.count_if(F.col("section") == "header").over(upto), "_follows": F.coalesce(F.lag("_bare").over(order), F.lit(False)),
    })
    told = told.withColumn("anchor", (F.col("_bare") | F.col("_item")) & (F.col("_inside") | ~F.col("_gated")))
    begins = F.col("anchor") & ~(F.col("_bare") & F.col("_follows"))
    open_ = ~F.col("anchor") & (F.col("section") != "header") & ~summary & (F.col("_inside") | ~F.col("seen_at_end")) & (F.col("named") | F.col("bare"))
    told = told.withColumns({"_begins": begins, "open": open_})
    told = told.withColumn("item_no", F.count_if("_begins").over(upto) + F.when(F.col("anchor"), 0).otherwise(1))
    return told.withColumn("begins", F.when(F.col("_begins"), F.col("resets"))).drop("_inside", "_gated", "_bare", "_item", "_begins", "_placed", "_follows")


def scanned(known: DataFrame) -> DataFrame:
    """candidates() with member: whether the line belongs to the candidate item of that number."""
    at = F.max("begins").over(Window.partitionBy("bill_id", "item_no"))
    told = candidates(known).withColumn("_at", at)
    return told.withColumn("member", F.coalesce((F.col("anchor") | F.col("open")) & (F.col("_at") == F.col("resets")), F.lit(False))).drop("_at", "begins", "resets")


def resolve(texts: Column, cents: Column) -> Column:
    """qty, unit_cents and whether the price was derived, by the number of an item's amounts and their places."""
    total, rate, second = F.element_at(cents, -1), F.get(cents, F.size(cents) - 2), F.get(cents, F.lit(0))
    made = lambda qty, unit, derived: F.struct(qty.cast("long").alias("qty"), unit.cast("long").alias("unit_cents"), F.lit(derived).alias("derived"))
    near = lambda a, b: F.abs(a - b) <= TOLERANCE
    nothing = made(F.lit(None), F.lit(None), True)

    def chosen(q: Column) -> Column:
        derived = made(q, F.expr("0") + half_up(total / q), True)
        several = F.when(q.isNull(), nothing).when(near(q * rate, total) | near(q * rate, total / 100) | near(q * rate, total * 100), made(q, rate, False)).when(total % q == 0, derived).otherwise(nothing)
        two = F.when(second == total, made(F.lit(1), total, False)).when(q.isNotNull() & (total % q == 0), derived).otherwise(nothing)
        return F.when(F.size(cents) >= 3, several).when(F.size(cents) == 2, two).otherwise(nothing)

    return let(m.parse_quantity(F.get(texts, F.lit(0))), chosen)


def row_item(text: Column, amounts: Column) -> Column:
    """name, total_cents and r (qty, unit_cents, derived) of a row's text and amounts, which are columns; null where they are no item's."""
    cents = amounts["cents"]
    good = (F.size(cents) > 0) & (F.element_at(cents, -1) > 0) & rules.has_name_word(text) & ~rules.is_metadata(text)
    return F.when(good, F.struct(resolve(amounts["text"], cents).alias("r"), m.clean_item_name(text).alias("name"), F.element_at(cents, -1).alias("total_cents")))


def plausible(qty: Column) -> Column:
    return qty.isNull() | (qty <= MOST_QUANTITY)


def item_rows(known: DataFrame) -> DataFrame:
    """bill_id, item_no, text, amounts, pending and anchors (numbers of lines), and tokens where lines have them: one row a candidate item.

    Lines of a number that a header parts from the item's begin are not its own: they are gathered with it, and go then.
    """
    counts = F.col("anchor") | F.col("bare")
    none = F.array().cast(f"array<{AMOUNT}>")
    parts = ["line_no", "line", "resets", F.when(counts, F.col("amounts")).otherwise(none).alias("amounts"), "anchor"]
    gathered = [F.collect_list(F.struct(*parts)).alias("x"), F.max("begins").alias("at")]
    if "tokens" in known.columns:
        gathered.append(F.collect_list(F.struct("line_no", "resets", F.coalesce("tokens", F.array().cast(dict(known.dtypes)["tokens"])).alias("tokens"))).alias("t"))
    whole = candidates(known).where(F.col("anchor") | F.col("open")).groupBy("bill_id", "item_no").agg(*gathered).where("at IS NOT NULL")
    own = lambda c: F.sort_array(F.filter(c, lambda x: x["resets"] == F.col("at")))
    more = [F.flatten(own("t")["tokens"]).alias("tokens")] if "tokens" in known.columns else []
    flat = whole.select("bill_id", "item_no", own("x").alias("x"), *more)
    text = F.trim(F.regexp_replace(F.array_join(F.col("x.line"), " "), r"\s+", " "))
    anchors = F.size(F.filter("x", lambda x: x["anchor"]))
    return flat.select("bill_id", "item_no", text.alias("text"), F.flatten("x.amounts").alias("amounts"), (F.size("x") - anchors).alias("pending"), anchors.alias("anchors"), *(["tokens"] if more else []))


def parsed_items(known: DataFrame) -> DataFrame:
    """bill_id, item_no, name, qty, unit_cents, total_cents, derived, and confidences in ten-thousandths of the row, the
    quantity and the unit price: what the scanned rows hold, without those that are none."""
    rows = item_rows(known)
    certain = confidence(F.col("tokens"), ROW_BASELINE) if "tokens" in rows.columns else F.lit(ROW_BASELINE).cast("long")

    read = once(rows.withColumn("confidence", certain), "t", row_item(F.col("text"), F.col("amounts")))
    flat = read.select("bill_id", "item_no", "t.name", "t.r.qty", "t.r.unit_cents", "t.total_cents", "t.r.derived", "confidence")
    good = flat.where(F.col("name").isNotNull() & plausible(F.col("qty"))).where(rules.has_name_word(F.col("name")))
    number = F.row_number().over(Window.partitionBy("bill_id").orderBy("item_no")).cast("long")
    unit = F.when(F.coalesce("unit_cents", F.lit(0)) == 0, NO_UNIT).when(F.col("derived"), half_up(F.col("confidence") * DERIVED / 100)).otherwise(F.col("confidence"))
    return good.withColumns({"item_no": number, "qty_confidence": F.when(F.coalesce("qty", F.lit(0)) == 0, NO_QUANTITY).otherwise(F.col("confidence")).cast("long"), "unit_confidence": unit.cast("long")})


def summary_rows(known: DataFrame) -> DataFrame:
    """bill_id, line_no, kind, label, amount and confidence in ten-thousandths; a payment may also be a total candidate."""
    rows = known.where(F.col("section").isin(rules.SUMMARY_SECTIONS) & (F.size("amounts") > 0))
    paid = F.col("line").rlike(rules.worded(rules.PAID))
    kind = F.when(F.col("section") != "payment", F.col("section")).when(paid, "total")
    last = F.element_at("amounts", -1)
    told = rows.select("bill_id", "line_no", "section", "line", kind.alias("kind"), last["cents"].alias("cents"), confidence(F.array(last), BASELINE).alias("sure")).where("kind IS NOT NULL")
    amount = F.when(F.col("section") == "discount", adjust_to_negative(F.col("cents"))).otherwise(F.col("cents"))
    sure = F.when(F.col("section") == "payment", half_up(F.col("sure") * AS_TOTAL / 100)).otherwise(F.col("sure"))
    label = let(m.label_of(F.col("line")), lambda x: F.when(x == "", F.col("line")).otherwise(x))
    return told.select("bill_id", "line_no", "kind", label.alias("label"), amount.alias("amount"), sure.cast("long").alias("confidence"))


def adjust_to_negative(cents: Column) -> Column:
    return -F.abs(cents)


def tax_total(taxes: DataFrame) -> DataFrame:
    """Tax sum of each bill; of three or more the first that equals the others' sum, to one cent, is an aggregate and not counted."""
    group = Window.partitionBy("bill_id")
    known = taxes.withColumn("_all", F.sum("amount").over(group)).withColumn("_n", F.count("*").over(group))
    repeats = (F.col("_n") >= 3) & (F.abs(F.col("amount") - (F.col("_all") - F.col("amount"))) <= TOLERANCE)
    return known.groupBy("bill_id").agg((F.sum("amount") - F.coalesce(F.min_by("amount", F.when(repeats, F.col("line_no"))), F.lit(0))).alias("tax_cents"))


def joined(lines: Column) -> Column:
    """The text of several lines as one, white space single."""
    return F.trim(F.regexp_replace(F.array_join(lines["line"], " "), r"\s+", " "))


def in_order(parts: Column) -> Column:
    """Arrays of structs of several rows as one, by their first field."""
    return F.sort_array(F.flatten(parts))


RECORD = "array<struct<line_no: bigint, kind: string, label: string, amount: bigint, confidence: bigint, place: int, token_no: bigint>>"


def summary_records(x: Column) -> Column:
    """line_no, kind, label, amount, confidence and the token of each line that says something of the whole bill; payments that may be
    the total are of that kind."""
    paid = lambda l: l["line"].rlike(rules.worded(rules.PAID))
    rows = F.filter(x, lambda l: l["section"].isin(rules.SUMMARY_SECTIONS) & (F.size(l["amounts"]) > 0) & ((l["section"] != "payment") | paid(l)))

    def record(l: Column) -> Column:
        payment = l["section"] == "payment"
        told = lambda last: F.struct(
            l["line_no"].alias("line_no"), F.when(payment, "total").otherwise(l["section"]).alias("kind"), let(m.label_of(l["line"]), lambda t: F.when(t == "", l["line"]).otherwise(t)).alias("label"),
            F.when(l["section"] == "discount", adjust_to_negative(last["cents"])).otherwise(last["cents"]).alias("amount"),
            let(confidence(F.array(last), BASELINE), lambda c: F.when(payment, half_up(c * AS_TOTAL / 100)).otherwise(c)).alias("confidence"), last["place"].alias("place"), F.get(l["token_nos"], last["place"]).alias("token_no"),
        )
        return let(F.element_at(l["amounts"], -1), told)

    return F.transform(rows, record).cast(RECORD)


def parsed_bills(lines: DataFrame, dealt: bool = False) -> DataFrame:
    """One nested row a bill, of lines (bill_id, line_no, line) that may have tokens, amount_column, image_width and columns.

    items, with the numbers of their lines and of the tokens that they were read from; subtotal, total, taxes, charges,
    adjustments and totals (all that could be the total), each with its line and token; what should add up and whether it
    does; and what the reading made of every line: `lines`, `ignored` and `warnings`.

    Lines are dealt by bill once, and read once: an item's lines are grouped within a bill's partition, and its items and
    the rest of its lines again, so that a bill is never joined with itself. A bill is one printed paper, gathered in one row.
    """
    known = scanned(classified(lines, dealt))
    tokens = F.col("tokens") if "tokens" in known.columns else F.lit(None).cast("array<struct<token_no: bigint, confidence: double>>")
    numbered = "tokens" not in known.columns or "token_no" in known.schema["tokens"].dataType.elementType.fieldNames()
    of_tokens = F.coalesce(F.transform(tokens, lambda t: t["token_no"].cast("long") if numbered else F.lit(None).cast("long")), F.array().cast("array<long>"))
    sure = F.coalesce(F.transform(tokens, lambda t: F.struct(t["confidence"].cast("double").alias("confidence"))), F.array().cast("array<struct<confidence: double>>"))
    column = F.col("columns") if "columns" in known.columns else F.array().cast("array<long>")
    part = F.struct("line_no", "line", "section", "confidence", "item_header", "anchor", "open", "bare", "amounts", of_tokens.alias("token_nos"), sure.alias("sure"))
    slot = F.when(F.col("member"), F.col("item_no"))
    rows = known.select("bill_id", slot.alias("slot"), part.alias("p"), column.alias("columns")).groupBy("bill_id", "slot").agg(F.sort_array(F.collect_list("p")).alias("x"), F.first("columns").alias("columns"))

    amounts = F.flatten(F.transform(F.filter("x", lambda l: l["anchor"] | l["bare"]), lambda l: l["amounts"]))
    item = F.when(F.col("slot").isNotNull(), F.struct(joined(F.col("x")).alias("text"), amounts.alias("amounts")))
    rows = rows.withColumn("i", item).withColumns({"text": F.col("i.text"), "amounts": F.col("i.amounts")}).withColumn("t", F.when(F.col("slot").isNotNull(), row_item(F.col("text"), F.col("amounts"))))
    rows = rows.withColumn("sure", confidence(F.flatten("x.sure"), ROW_BASELINE))
    good = F.coalesce(F.col("t.name").isNotNull() & plausible(F.col("t.r.qty")) & rules.has_name_word(F.col("t.name")), F.lit(False))
    unit = F.when(F.coalesce("t.r.unit_cents", F.lit(0)) == 0, NO_UNIT).when(F.col("t.r.derived"), half_up(F.col("sure") * DERIVED / 100)).otherwise(F.col("sure")).cast("long")
    counted = F.when(F.coalesce("t.r.qty", F.lit(0)) == 0, NO_QUANTITY).otherwise(F.col("sure")).cast("long")
    told = F.struct(
        "slot", F.col("t.name").alias("name"), F.col("t.r.qty").alias("qty"), F.col("t.r.unit_cents").alias("unit_cents"), F.col("t.total_cents").alias("total_cents"), F.col("t.r.derived").alias("derived"),
        F.col("sure").alias("confidence"), counted.alias("qty_confidence"), unit.alias("unit_confidence"), F.col("x.line_no").alias("line_nos"), F.flatten("x.token_nos").alias("token_nos"),
    )
    rows = rows.withColumn("good", good)
    heads = lambda l: (l["section"] == "header") & ~l["item_header"]
    left = F.filter("x", lambda l: F.when(F.col("slot").isNull(), heads(l) | ((l["section"] == "unknown") & ~l["anchor"] & ~l["open"])).otherwise(l["anchor"] & ~F.col("good")))
    ignored = F.transform(left, lambda l: F.struct(l["line_no"].alias("line_no"), l["line"].alias("text")))
    kept = F.transform("x", lambda l: F.struct(l["line_no"].alias("line_no"), l["line"].alias("text"), l["section"].alias("section"), l["confidence"].alias("confidence")))
    symbol = lambda s: F.exists("x", lambda l: l["line"].contains(s))
    bills = rows.groupBy("bill_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("good"), told))).alias("items"), F.first(F.when(F.col("slot").isNull(), summary_records(F.col("x"))), ignorenulls=True).alias("rest"),
        in_order(F.collect_list(kept)).alias("lines"), in_order(F.collect_list(ignored)).alias("ignored"), F.first("columns").alias("columns"),
        F.when(F.max(symbol("₹")), "INR").when(F.max(symbol("$")), "USD").alias("currency"),
    )
    return settled(bills)


def ranked_totals(totals: Column) -> Column:
    """Candidate totals, the surest first, of equals the one above."""
    ordered = F.array_sort(F.transform(totals, lambda r: F.struct((-r["confidence"]).alias("c"), r["line_no"].alias("l"), r.alias("r"))))
    return F.transform(ordered, lambda x: x["r"])


def settled(bills: DataFrame) -> DataFrame:
    """The sums of a bill's records and items, and whether what is printed adds up."""
    rest = F.coalesce("rest", F.array().cast(RECORD))
    of = lambda *kinds: F.filter("rest", lambda r: r["kind"].isin(*kinds))
    added = lambda records: F.aggregate(records, F.lit(0).cast("long"), lambda a, r: a + r["amount"])
    numbered = F.transform("items", lambda i, n: i.dropFields("slot").withField("item_no", (n + 1).cast("long")))
    bills = bills.withColumn("rest", rest).withColumns({
        "items": numbered, "taxes": of("tax"), "charges": of("service_charge"), "adjustments": of("discount", "adjustment"), "totals": of("total"), "printed": F.get(of("subtotal"), F.lit(0)),
    })
    all_tax = added(F.col("taxes"))
    aggregate = F.filter("taxes", lambda r: (F.size("taxes") >= 3) & (F.abs(2 * r["amount"] - F.col("_tax")) <= TOLERANCE))
    summed = F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + i["total_cents"])
    bills = bills.withColumn("_tax", all_tax).withColumns({
        "total": F.get(ranked_totals(F.col("totals")), F.lit(0)), "tax_cents": F.col("_tax") - F.coalesce(F.get(aggregate, F.lit(0))["amount"], F.lit(0)), "charge_cents": added(F.col("charges")), "adjustment_cents": added(F.col("adjustments")),
        "derived_subtotal": F.col("printed").isNull() & (F.size("items") > 0), "subtotal_cents": F.coalesce(F.col("printed.amount"), F.when(F.size("items") > 0, summed)),
    })
    sure = F.when(F.col("derived_subtotal"), DERIVED_SUBTOTAL).otherwise(F.col("printed.confidence"))
    bills = bills.withColumns({"total_cents": F.col("total.amount"), "subtotal_confidence": sure, "n_items": F.size("items").cast("long"), "expected_cents": F.col("subtotal_cents") + F.col("tax_cents") + F.col("charge_cents") + F.col("adjustment_cents")})
    bills = bills.withColumn("difference", F.col("total_cents") - F.col("expected_cents"))
    status = F.when(F.col("difference").isNull(), "insufficient_data").when(F.abs("difference") <= TOLERANCE, "match").otherwise("mismatch")
    warning = F.when(F.col("difference").isNotNull() & (F.abs("difference") > TOLERANCE), F.array(F.format_string(DIFFERS, "difference"))).otherwise(F.array().cast("array<string>"))
    return bills.withColumns({"status": status, "warnings": warning}).drop("rest", "_tax").withColumnRenamed("printed", "subtotal")


def items_of(bills: DataFrame) -> DataFrame:
    """One row an item of nested bills."""
    return bills.select("bill_id", F.inline("items"))


SUMS = ("bill_id", "currency", "tax_cents", "charge_cents", "adjustment_cents", "total_cents", "n_items", "derived_subtotal", "subtotal_cents", "expected_cents", "difference", "status")


def parse_receipts(lines: DataFrame, dealt: bool = False) -> tuple[DataFrame, DataFrame]:
    """Items, and one row a bill: subtotal, taxes, charges, adjustments, total, expected total, difference and status."""
    bills = parsed_bills(lines, dealt)
    return items_of(bills), bills.select(*SUMS)
