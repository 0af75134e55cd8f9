"""Amounts, quantities, classes, items and geometry of receipt text."""

import pytest
from pyspark.sql import functions as F

from tabsplit.functions import money as m
from tabsplit.functions import rules
from tabsplit.operators import layout, parse, raster
from tabsplit.streaming import debounce


@pytest.mark.parametrize(("text", "cents"), [("$1,234.50", 123_450), ("Rs 74.50", 7_450), ("Round Off: -0.50", -50), ("1O.5O", 1_050), ("POLLO", None), ("1.234,5", 123_450), ("1.234", 123_400), ("(12)", -1_200), ("", None), ("9" * 20, None)])
def test_money(spark, text, cents):
    found = spark.createDataFrame([(text,)], "t string").select(m.parse_money(F.col("t")).alias("c")).first().c
    assert found == cents


@pytest.mark.parametrize(("text", "quantity"), [("2.00", 2), ("1,5", None), ("0", None), ("1000", 1000), ("1001", None), ("x", None), (" 7 ", 7)])
def test_quantity(spark, text, quantity):
    assert spark.createDataFrame([(text,)], "t string").select(m.parse_quantity(F.col("t")).alias("q")).first().q == quantity


@pytest.mark.parametrize(("text", "seen", "section"), [("Sub Total 10.00", False, "subtotal"), ("CGST 2.5% 3.00", False, "tax"), ("Cash 5", False, "payment"), ("Masala Dosa 2 60.00", False, "item"), ("Masala Dosa 2 60.00", True, "footer"), ("Table 4", False, "header"), ("Total Qty 5", False, "header"), ("Item Qty Rate", False, "header"), ("a taxé 9", False, "tax"), ("7", False, "unknown")])
def test_sections(spark, text, seen, section):
    read = spark.createDataFrame([(text,)], "t string").select(rules.reading(F.col("t")).alias("r")).select("r.*")
    code = rules.settled(F.col("code"), F.col("itemlike"), F.col("wordy"), F.lit(seen))
    assert read.select(rules.section_of(code).alias("s")).first().s == section


def items_of(spark, *lines):
    rows = [(1, k, x) for k, x in enumerate(lines)]
    items, bills = parse.parse_receipts(spark.createDataFrame(rows, "bill_id long, line_no long, line string"))
    return [(r.name, r.qty, r.unit_cents, r.total_cents) for r in items.orderBy("item_no").collect()], bills.first()


def test_receipt_with_wrapped_names_and_an_aggregate_tax(spark):
    items, bill = items_of(spark, "Cash Memo", "Item Qty Rate Amount", "Red Cotta", "Pizza 1 260.00 260.00", "Cola 2 40.00 80.00", "Sub Total 340.00", "CGST 8.50", "SGST 8.50", "Total Tax 17.00", "Round Off -0.50", "Grand Total 356.50")
    assert items == [("Red Cotta Pizza", 1, 26_000, 26_000), ("Cola", 2, 4_000, 8_000)]
    assert (bill.subtotal_cents, bill.tax_cents, bill.adjustment_cents, bill.total_cents, bill.status) == (34_000, 1_700, -50, 35_650, "match")


def test_rows_check_themselves(spark):
    items, _ = items_of(spark, "Tea 150 150", "Rice 3 99.99 299.98", "Soup 2 50.00 10000", "Naan 60 1.00 60.00", "12.00")
    assert items[:3] == [("Tea", 1, 15_000, 15_000), ("Rice", 3, 9_999, 29_998), ("Soup", 2, 5_000, 1_000_000)]
    assert all(name != "Naan" for name, *_ in items)


def read_tokens(spark, *lines, column=None):
    rows = [(1, k, " ".join(t for t, *_ in line), [(t, float(x), 8.0 * len(t), c) for t, x, c in line]) for k, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "bill_id long, line_no long, line string, tokens array<struct<text: string, x: double, width: double, confidence: double>>")
    return df.withColumns({"amount_column": F.lit(column).cast("long"), "image_width": F.lit(1000)})


def test_decimals_split_over_tokens_and_rates(spark):
    line = [("CGST", 0, 90.0), ("@2.5%", 60, 80.0), ("650.", 300, 70.0), ("00", 340, None)]
    found = parse.with_amounts(read_tokens(spark, line)).first()
    assert [(a.text, a.cents, a.right, a.confidence) for a in found.amounts] == [("650.00", 65_000, 332.0, 70.0)]


def test_amounts_outside_their_column_close_no_item(spark):
    lines = [[("Red", 0, 90.0), ("Cotta", 40, 90.0), ("7", 300, 20.0)], [("Pizza", 0, 80.0), ("1", 300, None), ("260.00", 852, 90.0)], [("34K", 0, 50.0), ("Cola", 50, 50.0), ("40.00", 860, 50.0)]]
    read = parse.parsed_items(parse.classified(read_tokens(spark, *lines, column=900)).withColumns({"amount_column": F.lit(900), "image_width": F.lit(1000)})).orderBy("item_no").collect()
    assert [(r.name, r.qty, r.unit_cents, r.total_cents) for r in read] == [("Red Cotta 7 Pizza".replace(" 7", ""), 1, 26_000, 26_000), ("K Cola", None, None, 4_000)]
    assert [r.confidence for r in read] == [7400, 5000] and read[1].qty_confidence == parse.NO_QUANTITY and read[1].unit_confidence == parse.NO_UNIT


def test_header_lines_drop_what_is_pending(spark):
    items, _ = items_of(spark, "Lonely Name", "Table 4", "Tea 10.00", "Sub Total 10.00", "Gift Card 5.00")
    assert items == [("Tea", None, None, 1_000)]


def test_lines_of_jittered_tokens(spark):
    boxes = [("Total", 0, 100.0, 10.0), ("9.50", 1, 300.0, 11.0), ("Dosa", 2, 100.0, 41.0), ("２", 3, 200.0, 40.0), ("8.00", 4, 300.0, 42.0)]
    rows = [(1, n, t, x, y, 8.0 * len(t), 14.0) for t, n, x, y in boxes]
    tokens = spark.createDataFrame(rows, "doc_id long, token_no long, text string, x double, y double, width double, height double")
    assert [r.text for r in layout.detect_lines(tokens).orderBy("line_no").collect()] == ["Total 9.50", "Dosa 2 8.00"]


def test_a_bright_sheet_is_found(spark):
    cells = [(1, y, x) for y in range(10) for x in range(10) if 2 <= y <= 7 and 3 <= x <= 6] + [(1, 0, 0), (1, 0, 1)]
    r = raster.largest_component(spark.createDataFrame(cells, "img_id long, y long, x long")).first()
    assert (r.cells, r.left, r.top, r.right, r.bottom) == (24, 3, 2, 6, 7)


def test_stream_gives_the_batch_result(spark, tmp_path):
    rows = [(k, f"2024-01-01 {k // 6:02d}:{k % 6 * 3:02d}:00", k % 4, "x", 1.0, f"p{k}") for k in range(100)] + [(999, "2024-03-01 00:00:00", 9, "x", 1.0, "late")]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.parquet(f"{tmp_path}/in")
    debounce.sync_stream(spark, f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/checkpoint").awaitTermination(120)
    synced = spark.read.parquet(f"{tmp_path}/store").drop("batch").collect()
    batch = debounce.debounce_latest(debounce.changes_of(events), "30 minutes").where("party <> 9").collect()
    assert sorted(map(tuple, synced)) == sorted(map(tuple, batch))
