"""What lets receipts be read at size: values computed once, bills dealt once, and the same results as by the long way."""

import re

import pytest
from pyspark.sql import functions as F

from tabsplit.functions import money as m
from tabsplit.plans import registry

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name, physical=False):
    execution = registry.queries()[name](spark, FOLDER)._jdf.queryExecution()
    return (execution.executedPlan() if physical else execution.optimizedPlan()).toString()


@pytest.mark.parametrize("name", ["amount_in_column", "extract_amounts_tokens"])
def test_amounts_of_tokens_are_computed_once(spark, name):
    """A filter on amounts is not moved below them with a copy of what makes them, and of what makes the tokens."""
    assert plan(spark, name).count("flatten(transform(split(") == 1


def token_amounts_of(spark, *texts):
    rows = [([(t, 10.0 * k, 8.0, 90.0) for k, t in enumerate(texts)],)]
    df = spark.createDataFrame(rows, "tokens array<struct<text: string, x: double, width: double, confidence: double>>")
    return [(a.text, a.cents, a.place) for a in df.select(m.token_amounts(F.col("tokens")).alias("a")).first().a]


@pytest.mark.parametrize(
    ("texts", "found"),
    [
        (["Tea", "650.", "00", "12"], [("650.00", 65_000, 1), ("12", 1_200, 3)]),
        (["650.", "0", "7,", "50"], [("0", 0, 1), ("7,50", 750, 2)]),
        (["00", "5%", "$5%", "@2%", "65O.", "00"], [("00", 0, 0), ("$5%", 500, 2), ("00", 0, 5)]),
        (["Rs. 12.50", " 3 ", "-0.50", "1'234.5", "IO", "$-7.25", None, ""], [("Rs. 12.50", 1_250, 0), (" 3 ", 300, 1), ("-0.50", -50, 2), ("1'234.5", 123_450, 3), ("$-7.25", -725, 5)]),
        (["9" * 20, "9" * 13 + ".99"], [("9" * 13 + ".99", 10**15 - 1, 1)]),
    ],
)
def test_amounts_of_tokens(spark, texts, found):
    assert token_amounts_of(spark, *texts) == found


def free_runs(line):
    """Numeric runs with a digit that touch no letter, found one after the other."""
    found = []
    for run in re.finditer(m.RUN, line):
        before, after = line[: run.start()], line[run.end() :]
        if re.search("[0-9]", run[0]) and (re.search(r"^\s", run[0]) or not re.search(r"[A-Za-z]\Z", before)) and not re.search("^[A-Za-z]", after):
            found.append(run[0].strip(" "))
    return found


def test_amounts_of_text(spark):
    parts = ["1", "O", "l", ".", ",", " ", "-", "Rs.", "INR", "$", "x", "25.00", "'", "5A", "%"]
    lines = [a + b + c + d for a in parts for b in parts for c in parts for d in parts[::2]]
    df = spark.createDataFrame([(x,) for x in lines], "line string").select("line", F.transform(m.text_amounts(F.col("line")), lambda a: F.trim(a["text"])).alias("a"))
    assert [(r.line, r.a) for r in df.collect() if r.a != free_runs(r.line)] == []


def test_amounts_of_lines_are_read_together_as_one_by_one(spark):
    runs = ["1", " 12", "-3", "0.50", " -0.50", "Rs. 7.25", "$1.00", "Rs 4", "1,5", "1O.5O", "1.5", "1'000.00", "0", "0000000000000", " $ 5"]
    lists = [[a, b] for a in runs for b in runs] + [[a] for a in runs] + [[]]
    df = spark.createDataFrame([(x,) for x in lists], "runs array<string>").select("runs", m.run_cents(F.col("runs")).alias("c"), F.transform("runs", m.parse_money).alias("each"))
    assert [r for r in df.collect() if r.c != r.each] == []


@pytest.mark.parametrize("text", ["KASH 5", "PAİD 5", "Cash 5", "CASH é 5", "éCASH 5", "Item ÉQTY RATE", "TOTAL QTY 3", "ABC-12345Z", "a_cash 5"])
def test_rules_ignore_the_case_of_ascii_letters_only(spark, text):
    from tabsplit.functions import rules

    x = F.col("t")
    kept = F.when(x.rlike(f"(?i){rules.TOTAL_QTY}{rules.END}"), 0).when(rules.is_item_header(x), 1).otherwise(-1)
    found = spark.createDataFrame([(text,)], "t string").select(rules.reading(x)["code"].alias("code"), rules.keyword(x)["section"].alias("section"), rules.is_metadata(x).alias("meta"), kept.alias("kept")).first()
    expected = found.kept if found.kept >= 0 else 2 + [s for s, *_ in rules.KEYWORDS].index(found.section) if found.section else rules.METADATA_CODE if found.meta else rules.OPEN
    assert found.code == expected


def test_a_receipt_is_dealt_once(spark):
    """Items are dealt by bill; lines, windows and groups keep that. Bills are not read again for their sums."""
    for name in ("classify_line", "parse_item", "parse_item_tokens", "item_scan", "parse_receipt", "rank_totals"):
        found = re.findall(r"Exchange (?:hash|range)partitioning\((\w+)#", plan(spark, name, physical=True))
        assert [x for x in found if x != "p_partkey"] == ["bill_id"], name


def test_identifiers_and_amounts_too_large(spark):
    from tabsplit.functions import rules

    texts = ["abc123", "abc12", "1234567", "abcdefg", "a,bcde1", "x-1-abcdef", "é1abcdef", "no (AB12CD)", "12 abcdef"]
    read = spark.createDataFrame([(x,) for x in texts], "t string").where(rules.looks_like_identifier(F.col("t")))
    assert {r.t for r in read.collect()} == {"abc123", "x-1-abcdef", "é1abcdef", "no (AB12CD)"}
    large = spark.createDataFrame([("Tea 9999999999999999999 5 99999999999999.5",)], "t string").select(m.text_amounts(F.col("t"))["cents"].alias("c")).first().c
    assert large == [500]


@pytest.mark.parametrize(("name", "keys"), [("row_membership", {"bill_id"}), ("cluster_mean_count", {"bill_id", "doc_id"}), ("candidate_totals", {"bill_id"}), ("parse_item_readings", {"bill_id"}), ("field_sources", {"bill_id"})])
def test_tokens_are_not_dealt_again(spark, name, keys):
    """Tokens stay where their bills were dealt; after the fold only lines, or counts, are dealt."""
    found = re.findall(r"Exchange (?:hash|range)partitioning\(([^)]*?), \d+\)", plan(spark, name, physical=True))
    assert {re.sub(r"#\w+", "", x) for x in found if not x.startswith("p_partkey")} <= keys


ODD = ["２", "１２.５０", "Ｔｏｔａｌ", "　", "é1", "１O.５O", "a—b", "ﬁ 2", "９" * 14, "９９９９９９９９９９９９９.9", "９" * 20, "Ⅻ", "５,Ｏ", "①.50", "x  y"]


def test_odd_texts_are_cleaned_in_the_fold_as_in_columns(spark):
    from tabsplit.operators import layout

    df = spark.createDataFrame([(x,) for x in ODD], "raw string").withColumn("text", layout.normalize_token(F.col("raw")))
    for r in layout.numeric_tokens(df).collect():
        assert (layout.normalized(r.raw), layout.is_numeric(layout.normalized(r.raw))) == (r.text, r.numeric), r.raw


def test_readings_of_either_kind_meet_by_document(spark):
    from tabsplit.operators import layout

    rows = [(1, 0, "　", 0.0, 10.0, 8.0, 14.0, 90.0), (2, 0, "Tea", 0.0, 10.0, 24.0, 14.0, None), (2, 1, "４５.00", 90.0, 11.0, 40.0, 14.0, 80.0), (3, 0, "Tea", None, 10.0, 24.0, 14.0, 90.0), (5, 0, "Soup", 0.0, 10.0, 24.0, 14.0, 90.0)]
    tokens = spark.createDataFrame(rows, "doc_id long, token_no long, text string, x double, y double, width double, height double, confidence double")
    readings = spark.createDataFrame([(1, "\n Rice 5 \r\n", 800), (2, "not read", 900), (3, "Idli 7", None), (4, None, 700)], "doc_id long, text string, image_width int")
    found = {(r.bill_id, r.line_no): r for r in layout.lines_of_readings(readings, tokens).collect()}
    assert {k: (r.line, r.image_width) for k, r in found.items()} == {(1, 1): ("Rice 5", 800), (2, 0): ("Tea 45.00", 900), (3, 0): ("Idli 7", None), (5, 0): ("Soup", None)}
    assert [(t.text, t.token_no, t.confidence) for t in found[2, 0].tokens] == [("Tea", 0, None), ("45.00", 1, 80.0)] and found[1, 1].tokens is None


def test_levels_are_counted_as_paired(spark):
    from tabsplit.operators import layout

    tops = [0.0, 8.0, 8.0, 16.5, 24.5, -3.0, None, 100.0, float("nan")]
    tokens = spark.createDataFrame([(d, k, y) for d in (1, 2) for k, y in enumerate(tops[d - 1 :])], "doc_id long, token_no long, y double")
    pairs = layout.on_level(tokens, 8.0).groupBy("doc_id", "token_no").agg(F.count("*").alias("level"))
    assert sorted(map(tuple, layout.level_counts(tokens, 8.0).collect())) == sorted(map(tuple, pairs.collect()))
