"""Scores of readings over names, item amounts and summary amounts; the texts that reviews give."""

import pytest
from pyspark.sql import functions as F

from tabsplit.functions.rules import SUMMARY_SECTIONS
from tabsplit.operators import score, settle

EXPECTED = [(1, 1, "item", "Masala Dosa", 6000), (1, 2, "item", "Filter Coffee", 4500), (1, 900, "summary", "subtotal", 10500), (1, 901, "summary", "total", 11025), (1, 902, "summary", "CGST", 263), (2, 1, "item", "Tea", 1000), (3, 1, "summary", "total", 500)]


def scores(spark, *texts):
    expected = spark.createDataFrame(EXPECTED, "receipt long, place long, kind string, label string, cents long")
    return {r.receipt: r for r in score.scored(expected, spark.createDataFrame(list(texts), "receipt long, text string")).collect()}


def test_names_amounts_and_what_is_missing(spark):
    found = scores(spark, (1, "MASALA D0SA 60.00\nFilter Coffe 4 4.50\nSub Total 105 00 GST 2.63"), (2, None))
    r = found[1]
    assert (r.names_found, r.names, r.items_found, r.summary_found, r.summary) == (2, 2, 1, 2, 3)
    assert list(r.missing_names) == [] and list(r.missing_amounts) == ["Filter Coffee=45.00", "total=110.25"] and r.score == pytest.approx(5 / 7)
    assert (found[2].score, list(found[2].missing_names), list(found[2].missing_amounts)) == (0.0, ["Tea"], ["Tea=10.00"]) and found[3].score == 0.0


def test_whole_units_and_adjacent_runs_tell_an_amount(spark):
    asked = [(6000, "60", True), (6050, "60", False), (6050, "6 0.50", False), (6050, "60 50", True), (-50, "0.50", True), (-50, "50", True), (1234, "a12b34", True)]
    rows = spark.createDataFrame(asked, "cents long, text string, found boolean").select("found", score.amount_found(F.col("cents"), F.col("text")).alias("told"))
    assert all(r.found == r.told for r in rows.collect())


def test_the_aggregate_is_the_plain_mean_and_rows_are_padded(spark):
    rows = spark.createDataFrame([("a.jpg", 4, 4, 4, 4, 4, 1.0), ("b.jpg", 1, 3, 1, 1, 5, 8 / 11)], "name string, names_found long, names long, items_found long, summary_found long, summary long, score double")
    assert score.aggregate(rows).first().score == pytest.approx((1 + 8 / 11) / 2) and score.aggregate(rows.where("false")).first().score == 0.0
    told = [r.t for r in rows.select(score.report_row(F.col("name")).alias("t")).collect()]
    assert told == ["a.jpg                    names 4/4    itemAmts 4/4    summary 4/4    100.0%", "b.jpg                    names 1/3    itemAmts 1/3    summary 1/5    72.7%"]


def test_letters_above_are_not_lost(spark):
    row = spark.createDataFrame([("Straße, Café no. 7",)], "t string").select(score.normalize_upper(F.col("t")).alias("u")).first()
    assert row.u == "STRASSE CAF NO 7"


def test_every_check_has_its_texts():
    assert set(settle.LABELS) == set(settle.DETAILS) and len(settle.LABELS) == 8 and "payment" in SUMMARY_SECTIONS
    assert settle.DETAILS["shares-add-up"] % ("1.00", "2.00", "1.00") == "Shares sum to ₹1.00 but the total bill is ₹2.00 (off by ₹1.00)."


def test_sweeps_are_bounded(spark):
    readings = spark.createDataFrame([("Masala Dosa", "MASALA")], "p_name string, seen string")
    found = score.swept(readings, spark.createDataFrame([(1,), (2,), (2,)], "share int")).collect()
    assert sorted(map(tuple, found)) == [(1, 0), (2, 10000)]
    with pytest.raises(ValueError, match="settings"):
        score.swept(readings, spark.range(100).select(F.col("id").cast("int").alias("share")))
