"""Queries of receipt reading: scalars on text, classification, the summary flag, items, totals and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsplit.functions import money as m
from tabsplit.functions import rules
from tabsplit.functions.columns import clamped_share, once
from tabsplit.operators import parse
from tabsplit.operators.settle import money
from tabsplit.sources import receipts, views

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None, head: str = f"WITH {views.SQL}, {receipts.SQL}"):
    def add(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = f"{head}, {oracle[5:]}" if oracle.startswith("WITH ") else f"{head} {oracle}"
        return function

    return add


def line_query(name: str, make, oracle: str) -> None:
    """A query that adds one column to every receipt line."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return receipts.lines(spark, sf_dir).select("bill_id", "line_no", make(F.col("line")).alias(name))

    run.__name__ = name
    query(f"SELECT bill_id, line_no, {oracle} AS {name} FROM lines")(run)


META_SQL = " OR ".join(rules.worded_sql("line", *x) for x in rules.METADATA)
IDENTIFIER_SQL = r"len([t for t in regexp_split_to_array(line, '[\s,;|()\[\]{}]+') if regexp_matches(t, '[A-Za-z0-9]{6,}') AND regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '[0-9]')]) > 0"
HEADER_SQL = f"(({rules.worded_sql('line', rules.SUBJECT)} AND {rules.worded_sql('line', rules.COLUMN)}) OR regexp_matches(line, '(?i)\\b(?:{rules.PAIR_FIRST})\\b.*\\b(?:{rules.PAIR_SECOND})\\b'))"
NAMED_SQL = "regexp_matches(line, '[A-Za-z]{3,}')"
FIRST_SQL = "CASE " + " ".join(f"WHEN {rules.worded_sql('line', body)} THEN '{s}'" for s, body, _ in rules.KEYWORDS) + " END"
CONFIDENCE_SQL = "CASE " + " ".join(f"WHEN {rules.worded_sql('line', body)} THEN {c}" for _, body, c in rules.KEYWORDS) + " END"
LABEL_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(translate(line, '₹$€£', ''), '[-+]?[0-9.,]+', ' ', 'g'), '[:;|()\[\]{}-]+', ' ', 'g'), '\s+', ' ', 'g'))"
CLEAN_SQL = r"trim(regexp_replace(regexp_replace(line, '([₹$€£]\s*)?[0-9]+([.,][0-9]+)?', ' ', 'g'), '\s+', ' ', 'g'))"
for tail in m.NAME_TAILS:
    CLEAN_SQL = f"regexp_replace({CLEAN_SQL}, '{tail}', '', 'g')"

line_query("has_name_word", rules.has_name_word, NAMED_SQL)
line_query("looks_like_identifier", rules.looks_like_identifier, IDENTIFIER_SQL)
line_query("is_metadata", rules.is_metadata, f"({META_SQL} OR {IDENTIFIER_SQL})")
line_query("is_item_header", rules.is_item_header, HEADER_SQL)
line_query("first_match_rule", lambda x: rules.keyword(x)["section"], FIRST_SQL)
line_query("label_of", m.label_of, LABEL_SQL)
line_query("clean_item_name", m.clean_item_name, f"trim({CLEAN_SQL})")
line_query("currency_detect", lambda x: F.when(x.contains("₹"), "INR").when(x.contains("$"), "USD"), "CASE WHEN contains(line, '₹') THEN 'INR' WHEN contains(line, '$') THEN 'USD' END")

# amounts as they come out of a camera: with currencies, thousands, look-alike digits, brackets and words
NOISY = """CASE bill_id % 7 WHEN 0 THEN x WHEN 1 THEN concat('Rs ', x) WHEN 2 THEN concat('$', substring(x, 1, length(x) - 3), ',', substring(x, -2)) WHEN 3 THEN translate(x, '01', 'Ol')
  WHEN 4 THEN concat('(', x, ')') WHEN 5 THEN concat('Discount ', replace(x, '.', '')) ELSE concat(' 1,', lpad(x, 6, '0'), ' ') END"""
NOISY_SQL = """CASE bill_id % 7 WHEN 0 THEN x WHEN 1 THEN 'Rs ' || x WHEN 2 THEN '$' || x[1:-4] || ',' || x[-2:] WHEN 3 THEN translate(x, '01', 'Ol')
  WHEN 4 THEN '(' || x || ')' WHEN 5 THEN 'Discount ' || replace(x, '.', '') ELSE ' 1,' || lpad(x, 6, '0') || ' ' END"""
AMOUNT_SQL = f"WITH tokens AS (SELECT bill_id, item_no, {NOISY_SQL} AS token FROM (SELECT bill_id, item_no, (total_cents // 100) || '.' || lpad((total_cents % 100)::VARCHAR, 2, '0') AS x FROM items))"


def amount_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.items(spark, sf_dir).select("bill_id", "item_no", money("total_cents").alias("x")).select("bill_id", "item_no", F.expr(NOISY).alias("token"))


@query(AMOUNT_SQL + r""", a AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(token), '([0-9.,])[Oo]', '\1' || chr(1), 'g'), '[Oo]([0-9.,])', chr(1) || '\1', 'g'), '([0-9.,])[Il]', '\1' || chr(2), 'g'), '[Il]([0-9.,])', chr(2) || '\1', 'g') AS y FROM tokens),
b AS (SELECT *, regexp_replace(translate(y, chr(1) || chr(2), '01'), '[^0-9,.]', '', 'g') AS v, regexp_matches(token, '(?i)\(|-|\b(?:discount|less)\b') AS negative FROM a),
c AS (SELECT *, regexp_extract(v, '[.,]([0-9]{1,2})$', 1) AS f, regexp_replace(regexp_replace(v, '[.,][0-9]{1,2}$', ''), '[.,]', '', 'g') AS w FROM b)
SELECT bill_id, item_no, token, CASE WHEN regexp_matches(v, '[0-9]') THEN (CASE WHEN negative THEN -1 ELSE 1 END) * (coalesce(try_cast(w AS BIGINT), 0) * 100 + rpad(f, 2, '0')::BIGINT) END AS cents FROM c""")
def parse_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digit look-alikes here stand apart from each other, which is what the oracle's engine can express."""
    return amount_tokens(spark, sf_dir).select("bill_id", "item_no", "token", m.parse_money(F.col("token")).alias("cents"))


@query(AMOUNT_SQL + r" SELECT bill_id, item_no, regexp_matches(trim(regexp_replace(token, '(?i)^(?:Rs\.?|INR|USD|EUR|GBP|[₹$€£])\s*', '')), '^-?[0-9OoIl]+([.,''][0-9OoIl]+)*%?$') AS amount_like FROM tokens")
def is_amount_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amount_tokens(spark, sf_dir).select("bill_id", "item_no", m.is_amount_like(F.col("token")).alias("amount_like"))


@query(r"WITH rates AS (SELECT bill_id, item_no, CASE item_no % 4 WHEN 0 THEN '@' || qty || '.5%' WHEN 1 THEN qty || '%' WHEN 2 THEN '$' || qty || '%' ELSE qty || '.5' END AS token FROM items) SELECT bill_id, item_no, token, regexp_matches(token, '^@?[0-9]+(\.[0-9]+)?%$') AND NOT regexp_matches(token, '[₹$€£]') AS rate FROM rates")
def is_rate_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.expr("CASE item_no % 4 WHEN 0 THEN concat('@', qty, '.5%') WHEN 1 THEN concat(qty, '%') WHEN 2 THEN concat('$', qty, '%') ELSE concat(qty, '.5') END")
    return views.items(spark, sf_dir).select("bill_id", "item_no", token.alias("token")).withColumn("rate", m.is_rate_annotation(F.col("token")))


@query(r"WITH q AS (SELECT bill_id, item_no, CASE item_no % 6 WHEN 0 THEN qty || '.00' WHEN 1 THEN qty || ',0' WHEN 2 THEN ' ' || qty || ' ' WHEN 3 THEN qty || '.5' WHEN 4 THEN (qty * 40)::VARCHAR ELSE 'x' || qty END AS token FROM items), p AS (SELECT *, regexp_extract(regexp_replace(trim(token), ',', '.'), '^([0-9]+)(\.0+)?$', 1) AS v FROM q) SELECT bill_id, item_no, token, CASE WHEN v <> '' AND v::BIGINT BETWEEN 1 AND 1000 THEN v::BIGINT END AS quantity FROM p")
def parse_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.expr("CASE item_no % 6 WHEN 0 THEN concat(qty, '.00') WHEN 1 THEN concat(qty, ',0') WHEN 2 THEN concat(' ', qty, ' ') WHEN 3 THEN concat(qty, '.5') WHEN 4 THEN cast(qty * 40 AS string) ELSE concat('x', qty) END")
    return views.items(spark, sf_dir).select("bill_id", "item_no", token.alias("token")).withColumn("quantity", m.parse_quantity(F.col("token")))


AMOUNTS_SQL = r"""WITH marked AS (SELECT *, string_split_regex(regexp_replace(line, '((?i:Rs\.?|INR|USD|EUR|GBP|[$])?\s*-?(?i:[0-9OIL])+([,.'']\s*(?i:[0-9OIL])+)?)', chr(1) || '\1' || chr(2), 'g'), '[' || chr(1) || chr(2) || ']') AS x FROM lines),
found AS (SELECT *, [trim(x[i]) for i in range(2, len(x), 2) if regexp_matches(x[i], '[0-9]') AND (regexp_matches(x[i], '^\s') OR NOT regexp_matches(coalesce(x[i - 2], '') || x[i - 1], '[A-Za-z]$')) AND NOT regexp_matches(x[i + 1] || coalesce(x[i + 2], ''), '^[A-Za-z]')] AS amounts FROM marked)"""


@query(AMOUNTS_SQL + " SELECT bill_id, line_no, array_to_string(amounts, '|') AS amounts FROM found")
def extract_amounts_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.with_amounts(receipts.lines(spark, sf_dir)).select("bill_id", "line_no", F.array_join(F.transform("amounts", lambda x: F.trim(x["text"])), "|").alias("amounts"))


@query(AMOUNTS_SQL + " SELECT bill_id, line_no, amounts[-1] AS last_amount FROM found WHERE len(amounts) > 0")
def last_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.with_amounts(receipts.lines(spark, sf_dir)).where(F.size("amounts") > 0).select("bill_id", "line_no", F.trim(F.element_at("amounts", -1)["text"]).alias("last_amount"))


@query(AMOUNTS_SQL + f" SELECT bill_id, line_no, NOT {NAMED_SQL} AND len(amounts) > 0 AS bare FROM found")
def is_bare_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.classified(receipts.lines(spark, sf_dir), dealt=True).select("bill_id", "line_no", "bare")


SECTIONS = ", ".join(f"'{s}'" for s in rules.SUMMARY_SECTIONS)
SEEN_SQL = AMOUNTS_SQL + rf""", ruled AS (SELECT *, {FIRST_SQL} AS rule, {CONFIDENCE_SQL} AS rule_confidence, {HEADER_SQL} AS header, regexp_matches(line, '(?i){rules.TOTAL_QTY}\b') AS total_qty, ({META_SQL} OR {IDENTIFIER_SQL}) AS metadata FROM found),
events AS (SELECT *, CASE WHEN total_qty THEN NULL WHEN header THEN false WHEN rule IN ({SECTIONS}) AND len(amounts) > 0 THEN true END AS event FROM ruled),
flagged AS (SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY bill_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS seen FROM events),
classed AS (SELECT *, CASE WHEN total_qty OR header THEN 'header' WHEN rule IS NOT NULL THEN rule WHEN metadata THEN 'header'
    WHEN len(regexp_extract_all(line, '[A-Za-z]')) > 1 AND regexp_matches(line, '[0-9]') AND {NAMED_SQL} AND NOT seen THEN 'item' WHEN seen AND len(regexp_extract_all(line, '[A-Za-z]')) > 3 THEN 'footer' ELSE 'unknown' END AS section,
  CASE WHEN total_qty THEN 86 WHEN header THEN 92 WHEN rule IS NOT NULL THEN rule_confidence WHEN metadata THEN 80
    WHEN len(regexp_extract_all(line, '[A-Za-z]')) > 1 AND regexp_matches(line, '[0-9]') AND {NAMED_SQL} AND NOT seen THEN 62 WHEN seen AND len(regexp_extract_all(line, '[A-Za-z]')) > 3 THEN 50 ELSE 25 END AS confidence FROM flagged)"""


@query(SEEN_SQL + " SELECT bill_id, line_no, seen FROM flagged")
def seen_summary_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.classified(receipts.lines(spark, sf_dir), dealt=True).select("bill_id", "line_no", "seen")


@query(SEEN_SQL + " SELECT bill_id, line_no, section, confidence FROM classed")
def classify_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.classified(receipts.lines(spark, sf_dir), dealt=True).select("bill_id", "line_no", "section", "confidence")


@query(f"SELECT doc_id, count(*) AS lines, count({FIRST_SQL}) AS taken FROM texts GROUP BY ALL", "WITH texts AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)")
def first_match_rule_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of ordinary prose a keyword rule takes for a receipt's."""
    texts = views.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return texts.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count(rules.keyword(F.col("line"))["section"]).alias("taken"))


AMOUNT_CENTS = r"(CASE WHEN contains(amounts[-1], '-') THEN -1 ELSE 1 END) * regexp_replace(amounts[-1], '[^0-9]', '', 'g')::BIGINT"
SUMMARY_SQL = SEEN_SQL + rf""", priced AS (SELECT *, {AMOUNT_CENTS} AS amount, {LABEL_SQL} AS label FROM classed WHERE len(amounts) > 0 AND section IN ({SECTIONS})),
summary AS (SELECT bill_id, line_no, section AS kind, CASE WHEN section = 'discount' THEN -abs(amount) ELSE amount END AS amount, 7500 AS confidence, label FROM priced WHERE section <> 'payment'
  UNION ALL SELECT bill_id, line_no, 'total', amount, 5400, label FROM priced WHERE section = 'payment' AND {rules.worded_sql('line', rules.PAID)})"""


@query(SUMMARY_SQL + " SELECT * FROM summary")
def summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.summary_rows(parse.classified(receipts.lines(spark, sf_dir), dealt=True)).select("bill_id", "line_no", "kind", "amount", "confidence", "label")


@query(SUMMARY_SQL + " SELECT bill_id, arg_min(amount, line_no) AS subtotal_cents FROM summary WHERE kind = 'subtotal' GROUP BY ALL")
def first_subtotal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary_rows(spark, sf_dir).where("kind = 'subtotal'").groupBy("bill_id").agg(F.min_by("amount", "line_no").alias("subtotal_cents"))


TOKEN_HEAD = f"WITH {views.SQL}, {receipts.SQL}, {receipts.TOKENS_SQL}"
#: All that may be a total, with the confidence of the token that says it; a payment's counts 72 hundredths.
READ_TOTALS = """, ends AS (SELECT bill_id, line_no, line, (list(cents ORDER BY place, part))[-1] AS amount, coalesce(100 * (list(confidence ORDER BY place, part))[-1], 7500) AS sure FROM token_amounts WHERE regexp_matches(line, '^(Grand Total|Total Rs|Cash)') GROUP BY ALL),
read_totals AS (SELECT bill_id, line_no, amount, CASE WHEN line LIKE 'Cash%' THEN floor(sure * 72 / 100.0::DOUBLE + 0.5) ELSE sure END::BIGINT AS confidence FROM ends),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bill_id ORDER BY confidence DESC, line_no) AS place FROM read_totals)"""


@query(READ_TOTALS + " SELECT bill_id, amount AS total_cents, confidence FROM ranked WHERE place = 1", TOKEN_HEAD)
def best_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total that was read best: tokens' confidences differ, so a payment can win."""
    return parse.parsed_bills(receipts.token_lines(spark, sf_dir), dealt=True).select("bill_id", "total_cents", F.col("total.confidence").alias("confidence"))


@query(READ_TOTALS + " SELECT bill_id, line_no, amount, confidence, place FROM ranked", TOKEN_HEAD)
def rank_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All totals that were read, the best first."""
    told = F.posexplode(parse.ranked_totals(F.col("totals"))).alias("place", "r")
    return parse.parsed_bills(receipts.token_lines(spark, sf_dir), dealt=True).select("bill_id", told).select("bill_id", "r.line_no", "r.amount", "r.confidence", (F.col("place") + 1).cast("long").alias("place"))


@query("SELECT bill_id, 2 * half AS tax_cents FROM totals")
def tax_total_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bill prints two halves, and some the aggregate too, which must not count."""
    return parse.tax_total(summary_rows(spark, sf_dir).where("kind = 'tax'"))


PRINTED_ITEMS = """WITH printed_items AS (SELECT bill_id, item_no, CASE WHEN item_no % 5 = 4 AND bill_id % 8 <> 3 THEN 'Chef Special ' ELSE '' END || p_name AS name, qty, unit_cents, row_cents AS total_cents FROM named)"""


@query(PRINTED_ITEMS + " SELECT bill_id, row_number() OVER (PARTITION BY bill_id ORDER BY item_no) AS item_no, name, qty, unit_cents, total_cents FROM printed_items")
def parse_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read back from the printed lines; the oracle takes the items that were printed. Without a header row, names wrapped
    onto a line of their own aren't taken up once a summary row is known."""
    return parse.parsed_items(parse.classified(receipts.lines(spark, sf_dir), dealt=True)).select("bill_id", "item_no", "name", "qty", "unit_cents", "total_cents")


@query(PRINTED_ITEMS + " SELECT bill_id, row_number() OVER (PARTITION BY bill_id ORDER BY item_no) AS item_no, CASE WHEN name LIKE 'Chef%' THEN 1 ELSE 0 END AS pending, 1 AS anchors FROM printed_items")
def item_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.item_rows(parse.classified(receipts.lines(spark, sf_dir), dealt=True)).select("bill_id", "item_no", "pending", "anchors")


@query("SELECT bill_id, item_no, qty, unit_cents, false AS derived FROM named")
def resolve_qty_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = receipts.item_names(spark, sf_dir).select("bill_id", "item_no", F.array(F.col("qty").cast("string"), money("unit_cents"), money("row_cents")).alias("texts"))
    known = rows.withColumn("cents", F.transform("texts", m.parse_money))
    return known.select("bill_id", "item_no", parse.resolve(F.col("texts"), F.col("cents")).alias("r")).select("bill_id", "item_no", "r.qty", "r.unit_cents", "r.derived")


BILL_SQL = """ SELECT bill_id, s AS subtotal_cents, 2 * half AS tax_cents, charge AS charge_cents, rounding - off AS adjustment_cents, t AS total_cents, s + 2 * half + charge + rounding - off AS expected_cents,
  t - (s + 2 * half + charge + rounding - off) AS difference, CASE WHEN bill_id % 13 = 0 THEN 'mismatch' ELSE 'match' END AS status, CASE WHEN bill_id % 2 = 0 THEN 'USD' END AS currency, (SELECT count(*) FROM named n WHERE n.bill_id = totals.bill_id) AS n_items FROM totals"""


@query(BILL_SQL)
def parse_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole receipts read back; the oracle takes the amounts that were printed."""
    return parse.parse_receipts(receipts.lines(spark, sf_dir), dealt=True)[1].drop("derived_subtotal")


@query("SELECT bill_id, s + 2 * half + charge + rounding - off AS expected_cents, t AS total_cents, CASE WHEN bill_id % 13 = 0 THEN 'mismatch' ELSE 'match' END AS status FROM totals")
def printed_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_receipt(spark, sf_dir).select("bill_id", "expected_cents", "total_cents", "status")


@query("SELECT bill_id, s AS subtotal_cents FROM totals WHERE bill_id % 9 = 0")
def derived_subtotal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bills without a printed subtotal take their items' sum."""
    return parse.parse_receipts(receipts.lines(spark, sf_dir), dealt=True)[1].where("derived_subtotal").select("bill_id", "subtotal_cents")


@query("SELECT doc_id, line_no - 1 AS line_no, trim(line) AS line, 24 * (line_no - 1) AS y, 8 * length(line) AS width FROM texts WHERE trim(line) <> ''", r"WITH texts AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS line_no FROM documents)")
def text_lines_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of plain text with made-up boxes, counted before blank ones go."""
    texts = views.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))
    return texts.where(F.trim("line") != "").select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.trim("line").alias("line"), (24 * F.col("line_no")).cast("long").alias("y"), (8 * F.length("line")).cast("long").alias("width"))


@query(" SELECT bill_id, line_no, string_agg(text, ' ' ORDER BY place, part) AS text FROM merged GROUP BY ALL", TOKEN_HEAD)
def adjacent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals that were read as two tokens become one."""
    return receipts.token_lines(spark, sf_dir).select("bill_id", "line_no", F.array_join(F.transform(m.merged_tokens(F.col("tokens")), lambda t: t["text"]), " ").alias("text"))


def priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of several tokens with an amount among them: bill_id, line_no and the amounts, `a`."""
    amounts = F.when(F.size("tokens") > 1, m.token_amounts(F.col("tokens")))
    return once(receipts.token_lines(spark, sf_dir), "a", amounts).where("size(a) > 0").select("bill_id", "line_no", "a")


@query(" SELECT bill_id, line_no, string_agg(text, '|' ORDER BY place, part) AS amounts, sum(cents)::BIGINT AS cents FROM token_amounts GROUP BY ALL", TOKEN_HEAD)
def extract_amounts_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = priced_lines(spark, sf_dir)
    return rows.select("bill_id", "line_no", F.array_join("a.text", "|").alias("amounts"), F.aggregate("a.cents", F.lit(0).cast("long"), lambda x, y: x + y).alias("cents"))


@query(" SELECT bill_id, line_no, bool_or(abs(right_edge - 900) <= 45) AS placed FROM token_amounts GROUP BY ALL", TOKEN_HEAD)
def amount_in_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one of a line's amounts ends near the column of amounts, at 900 of 1000 pixels."""
    rows = priced_lines(spark, sf_dir)
    return rows.select("bill_id", "line_no", parse.in_column(F.col("a"), F.lit(900), F.lit(1000)).alias("placed"))


@query(" SELECT bill_id, line_no, coalesce(floor(avg(confidence) * 100 + 0.5), 7500)::BIGINT AS confidence FROM tokens GROUP BY ALL", TOKEN_HEAD)
def token_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return receipts.token_lines(spark, sf_dir).select("bill_id", "line_no", parse.confidence(F.col("tokens"), parse.BASELINE).alias("confidence"))


@query("SELECT o_orderkey AS bill_id, least(greatest(((o_orderkey % 150) - 20) / 100.0::DOUBLE, 0), 1)::DOUBLE AS sure FROM orders", "")
def clamp_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentages beyond both ends."""
    return views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bill_id"), clamped_share((F.col("o_orderkey") % 150 - 20) / 100).alias("sure"))


@query(PRINTED_ITEMS + " SELECT bill_id, row_number() OVER (PARTITION BY bill_id ORDER BY item_no) AS item_no, name, qty, unit_cents, total_cents FROM printed_items")
def parse_item_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items read from tokens with geometry: amounts count by the column that they end in."""
    known = parse.classified(receipts.token_lines(spark, sf_dir), dealt=True).withColumns({"amount_column": F.lit(900), "image_width": F.lit(1000)})
    return parse.parsed_items(known).select("bill_id", "item_no", "name", "qty", "unit_cents", "total_cents")
