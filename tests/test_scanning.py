"""Readings with boxes, end to end: lines, the column of amounts, items, sources and diagnostics."""

import pytest

from tabsplit.operators import layout, parse

HEAD = [("Item", 10, 10), ("Qty", 150, 10), ("Amt", 250, 10)]


def read(spark, tokens, text="", width=None):
    """The parsed bill of tokens (text, x, y[, confidence]) with the usual sizes."""
    rows = [(1, n, t[0], float(t[1]), float(t[2]), 8.0 * len(t[0]), 14.0, t[3] if len(t) > 3 else 90.0) for n, t in enumerate(tokens)]
    drawn = spark.createDataFrame(rows, "doc_id long, token_no long, text string, x double, y double, width double, height double, confidence double")
    readings = spark.createDataFrame([(1, text, width)], "doc_id long, text string, image_width int")
    return parse.parsed_bills(layout.lines_of_readings(readings, drawn))


def rows(*lines, at=40, step=30):
    return [(t, x, at + k * step) for k, line in enumerate(lines) for t, x in line]


NAME, TWO, THREE, FOUR = [("Red", 10), ("Cotta", 50)], [("Pizza", 10), ("Mini", 60)], [("Idli", 10), ("3", 150), ("90.00", 280)], [("Vada", 10), ("4", 150), ("120.00", 280)]


@pytest.mark.parametrize(
    ("lines", "name", "qty", "unit", "derived", "total"),
    [
        ([[("Special", 10), ("9", 150), ("Recipe", 190)], [("Fried", 10), ("Rice", 60), ("2", 150), ("180.00", 280)], THREE, FOUR], "Special Recipe Fried Rice", 2, 9000, True, 18000),
        ([NAME, [("1", 150)], TWO, [("260.00", 280)], THREE, FOUR], "Red Cotta Pizza Mini", 1, 26000, True, 26000),
        ([NAME, [("1", 150)], TWO, [("260.00", 280)], [("260.00", 280)], THREE, FOUR], "Red Cotta Pizza Mini", 1, 26000, False, 26000),
        ([[("CLASSICO", 10), ("COLD", 90), ("BREW", 140), ("1", 190)], [("240.00", 280)], [("TEA", 10), ("20.00", 280)], [("COFFEE", 10), ("30.00", 280)]], "CLASSICO COLD BREW", None, None, True, 24000),
    ],
)
def test_wrapped_and_narrow_rows(spark, lines, name, qty, unit, derived, total):
    bill = read(spark, HEAD + rows(*lines)).first()
    found = {i.name: i for i in bill["items"]}
    assert (found[name].qty, found[name].unit_cents, found[name].derived, found[name].total_cents) == (qty, unit, derived, total)


def test_sources_diagnostics_and_totals(spark):
    lines = [[("Table", 10), ("7", 60)], [("Tea", 10), ("2", 150), ("45.00", 280)], [("Soup", 10), ("1", 150), ("60.00", 280)], [("***", 10)], [("Total", 10), ("105.00", 280)], [("Cash", 10), ("110.00", 280)]]
    tokens = HEAD + rows(*lines)
    tokens[-3] = (*tokens[-3], 60.0)  # the total's amount is hardly read, the payment's well
    bill = read(spark, tokens).first()
    texts = [t[0] for t in tokens]
    assert [[texts[n] for n in i.token_nos] for i in bill["items"]] == [["Tea", "2", "45.00"], ["Soup", "1", "60.00"]]
    assert [(r.label, r.amount, r.confidence, texts[r.token_no]) for r in bill.totals] == [("Total", 10500, 6000, "105.00"), ("Cash", 11000, 6480, "110.00")]
    assert (bill.total.amount, bill.derived_subtotal, bill.subtotal_cents, bill.subtotal_confidence, bill.status) == (11000, True, 10500, 6500, "mismatch")
    assert bill.warnings == ["Summary values differ from the selected total by 500 minor units."]
    assert [(i.line_no, i.text) for i in bill.ignored] == [(1, "Table 7"), (4, "***")]
    assert [x.section for x in bill.lines] == ["header", "header", "item", "item", "unknown", "total", "payment"]
    assert bill["columns"] == [158, 324]


def test_readings_without_boxes_are_read_as_text(spark):
    rows_ = [(1, 0, "Tea", None, None, None, None, 90.0)]
    tokens = spark.createDataFrame(rows_, "doc_id long, token_no long, text string, x double, y double, width double, height double, confidence double")
    readings = spark.createDataFrame([(1, "Tea 2 45.00\r\n\r\n  Total  $45.00 ", 900), (2, None, None), (3, "", None)], "doc_id long, text string, image_width int")
    found = parse.parsed_bills(layout.lines_of_readings(readings, tokens)).collect()
    assert [(b.bill_id, b.currency, b.status, b.warnings) for b in found] == [(1, "USD", "match", [])]
    assert [(x.line_no, x.text) for x in found[0].lines] == [(0, "Tea 2 45.00"), (2, "Total  $45.00")] and found[0]["items"][0].token_nos == []


def test_no_column_where_none_stands_out():
    page = lambda edges: layout.Page({"centre": [30.0 * k for k in range(len(edges))], "x": [e - 8.0 for e in edges], "y": [30.0 * k for k in range(len(edges))], "width": [8.0] * len(edges), "height": [14.0] * len(edges), "token_no": list(range(len(edges))), "text": ["1"] * len(edges), "numeric": [True] * len(edges)})
    for edges, column in (([900.0, 901.0], None), ([900.0, 901.0, 902.0], 901), ([900.0] * 3 + [990.0] * 3, None), ([900.0] * 3 + [990.0] * 2, 900), ([900.0] * 4 + [990.0] * 3, None)):
        assert page(edges).amount_column(page(edges).ranked()) == column


def test_running_means_drift():
    """A run reaches as far as its mean drifts; what a later value does not reach it never gets."""
    values = [0.0, 5.0, 10.0, 15.0, 30.0, 31.0]
    assert layout.runs(values, 10.0) == ([0, 0, 0, 0, 1, 1], [(7.5, 4), (30.5, 2)])
    assert layout.runs([], 1.0) == ([], [])


def test_damaged_captures_become_rows(spark, tmp_path):
    from tabsplit.operators import adapters

    good = '{"file": 3,\n "words": [\n {"text": "Tea", "bbox": {"x0": 1, "y0": 2, "x1": 30, "y1": 14}}]}'
    texts = spark.createDataFrame([("a", good), ("b", good[:-4]), ("c", ""), ("d", None)], "capture string, value string")
    path = adapters.recorded(texts.coalesce(1), "capture")
    with open(f"{tmp_path}/extra.json", "w") as out:
        out.write('{"capture": "e", "read')
    spark.read.text(path).union(spark.read.text(f"{tmp_path}/extra.json")).coalesce(1).write.text(f"{tmp_path}/all")
    found = {r.capture: r for r in adapters.captures(spark, f"{tmp_path}/all").collect()}
    assert found["a"].file == 3 and found["a"].damaged is None and adapters_words(found["a"]) == [("Tea", 1, 2, 30, 14)]
    assert {k: r.damaged for k, r in found.items() if k != "a"} == {"b": good[:-4], "c": "", "d": "", None: '{"capture": "e", "read'}


def adapters_words(row):
    return [(w.text, *w.bbox) for w in row.words]
