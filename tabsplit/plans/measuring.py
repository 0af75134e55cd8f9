"""Queries of scoring, pixels, token geometry and the change stream, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsplit.operators import adapters, layout, photo, raster, score
from tabsplit.operators.settle import money
from tabsplit.sources import receipts, views
from tabsplit.streaming import debounce

QUERIES: dict = {}
ORACLES: dict = {}
LEFT_RADIUS = 2


def query(oracle: str | None):
    def add(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return add


# pixels: each vector's 64 numbers as an image of 8 by 8 bytes
PIXELS = "WITH pixels AS (SELECT vec_id AS img_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, least(greatest(floor((e::DOUBLE + 0.5) * 255), 0), 255)::BIGINT AS value FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings))"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), F.posexplode("embedding").alias("i", "e"))
    value = F.least(F.greatest(F.floor((F.col("e").cast("double") + 0.5) * 255), F.lit(0)), F.lit(255)).cast("long")
    return each.select("img_id", F.expr("cast(i div 8 as bigint)").alias("y"), (F.col("i") % 8).cast("long").alias("x"), value.alias("value"))


@query(PIXELS + " SELECT img_id, y, x, least(greatest(round_even((value - 128) * 115 / 100 + 128, 0), 0), 255)::BIGINT AS value FROM pixels")
def grayscale_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).withColumn("value", raster.contrast(F.col("value")))


@query(PIXELS + """ SELECT p.img_id, p.y, p.x, sum(q.value)::BIGINT // 25 AS blur FROM pixels p, range(-2, 3) a(dy), range(-2, 3) b(dx)
  JOIN pixels q ON q.img_id = p.img_id AND q.y = least(greatest(p.y + dy, 0), 7) AND q.x = least(greatest(p.x + dx, 0), 7) GROUP BY ALL""")
def box_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.box_blur(pixels(spark, sf_dir), LEFT_RADIUS, 8, 8).select("img_id", "y", "x", "blur")


@query(PIXELS + """ SELECT p.img_id, p.y, p.x, CASE WHEN p.x BETWEEN 1 AND 6 AND p.y BETWEEN 1 AND 6 THEN least(greatest(round_even(1.5::DOUBLE * p.value - 0.125::DOUBLE * (SELECT sum(q.value) FROM pixels q WHERE q.img_id = p.img_id AND abs(q.x - p.x) + abs(q.y - p.y) = 1), 0), 0), 255)::BIGINT ELSE p.value END AS sharp FROM pixels p""")
def unsharp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.unsharp(pixels(spark, sf_dir), 8, 8).select("img_id", "y", "x", "sharp")


@query(PIXELS + " SELECT img_id, y // 4 AS cell_y, x // 4 AS cell_x, (1000 * sum(value)::BIGINT) // count(*) AS mean_milli FROM pixels GROUP BY ALL")
def cell_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.cell_means(pixels(spark, sf_dir), 4)


@query(PIXELS + " SELECT img_id, list_sort(list(value))[floor((count(*) - 1) * 0.95 + 0.5)::BIGINT + 1] AS p95, list_sort(list(value))[floor((count(*) - 1) * 0.5 + 0.5)::BIGINT + 1] AS p50 FROM pixels GROUP BY ALL")
def percentile_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.collect_list("value")
    return pixels(spark, sf_dir).groupBy("img_id").agg(values.alias("v")).select("img_id", raster.nearest_percentile(F.col("v"), 0.95).alias("p95"), raster.nearest_percentile(F.col("v"), 0.5).alias("p50"))


@query(PIXELS + " SELECT img_id, y // 2 AS y, x // 2 AS x, least(greatest(round_even(avg(value), 0), 0), 255)::BIGINT AS value FROM pixels GROUP BY img_id, y // 2, x // 2")
def resize_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.halve(pixels(spark, sf_dir))


@query(PIXELS + " SELECT img_id, y - 1 AS y, x - 2 AS x, value FROM pixels WHERE x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 4")
def crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.crop(pixels(spark, sf_dir), 2, 1, 7, 5)


@query(PIXELS + " SELECT img_id, sum(value)::BIGINT AS total, ((1000 * (count(*) * sum(value * value) - sum(value) * sum(value))) // (count(*) * count(*)))::BIGINT AS var_milli, min(value) AS low, max(value) AS high FROM pixels GROUP BY ALL")
def luminance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = F.expr("(1000 * (count(*) * sum(value * value) - sum(value) * sum(value))) div (count(*) * count(*))")
    return pixels(spark, sf_dir).groupBy("img_id").agg(F.sum("value").alias("total"), exact.alias("var_milli"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("""SELECT p_partkey, greatest(floor(w * s + 0.5), 1)::BIGINT AS width, greatest(floor(h * s + 0.5), 1)::BIGINT AS height FROM
  (SELECT *, CASE WHEN greatest(w, h) > 2400 THEN 2400::DOUBLE / greatest(w, h) WHEN greatest(w, h) < 1900 THEN 1900::DOUBLE / greatest(w, h) ELSE 1.0::DOUBLE END AS s FROM (SELECT p_partkey, p_size * 97 + 1 AS w, (p_partkey * 31) % 3000 + 1 AS h FROM part))""")
def fit_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = raster.fit_within(F.col("p_size") * 97 + 1, (F.col("p_partkey") * 31) % 3000 + 1, 1900, 2400)
    return views.table(spark, sf_dir, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.width", "s.height")


# cells of a grid: bright inside a frame, with some colour, so that sheets, specks and full frames come about
CELLS = PIXELS + """, cells AS (SELECT img_id, y, x, least(value + CASE WHEN x BETWEEN img_id % 4 AND 7 - img_id % 3 AND y BETWEEN 1 AND 6 THEN 40 + img_id % 130 ELSE 0 END, 255)::DOUBLE AS lum, ((value * 7 + img_id) % 76)::DOUBLE AS sat FROM pixels),
paper AS (SELECT * FROM cells JOIN (SELECT img_id, list_sort(list(lum))[floor((count(*) - 1) * 0.95 + 0.5)::BIGINT + 1] AS white FROM cells GROUP BY ALL) USING (img_id) WHERE lum >= greatest(110, white * 0.74::DOUBLE) AND sat <= 70)"""
LABELS = CELLS.replace("WITH pixels", "WITH RECURSIVE pixels") + """, reached AS (SELECT img_id, y AS y0, x AS x0, y, x FROM paper
  UNION SELECT r.img_id, r.y0, r.x0, p.y, p.x FROM reached r JOIN paper p ON p.img_id = r.img_id AND abs(p.y - r.y) + abs(p.x - r.x) = 1),
labels AS (SELECT img_id, y, x, min(y0 * 8 + x0) AS label FROM reached GROUP BY ALL),
stats AS (SELECT img_id, label, count(*) AS cells, min(x) AS l, min(y) AS t, max(x) AS r, max(y) AS b FROM labels GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY cells DESC, label) AS place FROM stats) WHERE place = 1)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = pixels(spark, sf_dir)
    inside = F.col("x").between(F.col("img_id") % 4, 7 - F.col("img_id") % 3) & F.col("y").between(1, 6)
    lum = F.least(F.col("value") + F.when(inside, 40 + F.col("img_id") % 130).otherwise(0), F.lit(255)).cast("double")
    return grid.select("img_id", "y", "x", lum.alias("lum"), ((F.col("value") * 7 + F.col("img_id")) % 76).cast("double").alias("sat"))


@query(LABELS + " SELECT img_id, y, x, label FROM labels")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected cells that look like paper, named by their first cell in reading order."""
    found = raster.labelled(raster.paper_cells(cells(spark, sf_dir)))
    return found.select("img_id", "y", "x", (F.col("component.y") * 8 + F.col("component.x")).alias("label"))


@query(LABELS + " SELECT img_id, label, cells, l AS left_edge, t AS top_edge, r AS right_edge, b AS bottom_edge FROM stats")
def component_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raster.component_stats(raster.paper_cells(cells(spark, sf_dir)))
    edges = [F.col(c).alias(f"{c}_edge") for c in ("left", "top", "right", "bottom")]
    return found.select("img_id", (F.col("component.y") * 8 + F.col("component.x")).alias("label"), "cells", *edges)


REGIONS = LABELS + """, told AS (SELECT i.img_id, b.*  EXCLUDE (img_id), b.cells / 64.0::DOUBLE AS cover, b.cells / ((r - l + 1) * (b - t + 1))::DOUBLE AS fill FROM (SELECT DISTINCT img_id FROM cells) i LEFT JOIN best b USING (img_id)),
judged AS (SELECT *, CASE WHEN cells IS NULL OR cover < 0.04 THEN 0::DOUBLE WHEN cover > 0.92 THEN 0.5::DOUBLE WHEN fill < 0.55 THEN 0.3::DOUBLE END AS off FROM told),
regions AS (SELECT img_id, CASE WHEN off IS NULL THEN greatest(0, (l - 1) * 10) ELSE 0 END AS x, CASE WHEN off IS NULL THEN greatest(0, (t - 1) * 10) ELSE 0 END AS y,
  CASE WHEN off IS NULL THEN least(80, (r + 2) * 10) ELSE 80 END AS to_x, CASE WHEN off IS NULL THEN least(80, (b + 2) * 10) ELSE 80 END AS to_y,
  coalesce(off, least(0.95::DOUBLE, 0.28::DOUBLE + fill * 0.5::DOUBLE + least(cover, 0.4::DOUBLE) * 0.5::DOUBLE)) AS confidence, CASE WHEN off IS NOT NULL THEN 'full_image' WHEN fill > 0.72 THEN 'document_boundary' ELSE 'text_density' END AS reason FROM judged)"""


@query(REGIONS + " SELECT img_id, x, y, to_x - x AS width, to_y - y AS height, round(confidence, 6) AS confidence, reason FROM regions")
def detect_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet of paper in every image, of 8 by 8 cells of 10 pixels."""
    return raster.receipt_region(cells(spark, sf_dir), 10, 80, 80).withColumn("confidence", F.round("confidence", 6))


@query(REGIONS + " SELECT img_id, confidence >= 0.6 AND reason <> 'full_image' AS crops FROM regions")
def crop_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.receipt_region(cells(spark, sf_dir), 10, 80, 80).select("img_id", raster.crops(F.col("confidence"), F.col("reason")).alias("crops"))


GROUND = """SELECT p.img_id, p.y, p.x, any_value(p.value) AS value, sum(q.value) / 9.0::DOUBLE AS ground FROM pixels p, range(-1, 2) a(dy), range(-1, 2) b(dx)
  JOIN pixels q ON q.img_id = p.img_id AND q.y = least(greatest(p.y + dy, 0), 7) AND q.x = least(greatest(p.x + dx, 0), 7) GROUP BY ALL"""


@query(PIXELS + f" SELECT img_id, y, x, CASE WHEN ground >= 235 * 0.7::DOUBLE THEN value ELSE least(greatest(round_even(value * 235 / greatest(40::DOUBLE, ground), 0), 0), 255)::BIGINT END AS even FROM ({GROUND.replace(' GROUP BY ALL', ' GROUP BY p.img_id, p.y, p.x')})")
def illumination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shadows evened out; bright surroundings stay as they are."""
    return raster.illumination(pixels(spark, sf_dir), 8, 8).select("img_id", "y", "x", "even")


@query(PIXELS + f" SELECT img_id, y, x, CASE WHEN ground >= 235 * 0.7::DOUBLE THEN value ELSE least(greatest(round_even(value * 235 / greatest(40::DOUBLE, ground), 0), 0), 255)::BIGINT END AS even FROM ({GROUND.replace(' GROUP BY ALL', ' GROUP BY p.img_id, p.y, p.x')})")
def illumination_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shadows evened out tile by tile, as photos are: strips of three rows to tiles of five."""
    strips = photo.grey_strips(pixels(spark, sf_dir).withColumns({"image_width": F.lit(8), "image_height": F.lit(8)}), rows=3)
    return photo.pixels_of(photo.evened(strips, rows=5)).withColumnRenamed("value", "even")


QUADS = "quads AS (SELECT vec_id AS img_id, (vec_id % 3)::DOUBLE AS x0, (vec_id % 2)::DOUBLE AS y0, (6 - vec_id % 2)::DOUBLE AS x1, (vec_id % 3)::DOUBLE AS y1, (7 - vec_id % 3)::DOUBLE AS x2, (7 + vec_id % 4)::DOUBLE AS y2, (vec_id % 2)::DOUBLE AS x3, (6 - vec_id % 3)::DOUBLE AS y3 FROM embeddings)"
GOOD = "greatest(x0, x1, x2, x3) - least(x0, x1, x2, x3) > 8 * 0.15::DOUBLE AND greatest(y0, y1, y2, y3) - least(y0, y1, y2, y3) > 8 * 0.15::DOUBLE AND least(x0, x1, x2, x3) >= 0 AND least(y0, y1, y2, y3) >= 0 AND greatest(x0, x1, x2, x3) <= 8 AND greatest(y0, y1, y2, y3) <= 8"


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four corners in every image; on half of the images one lies outside."""
    corners = {"x0": "vec_id % 3", "y0": "vec_id % 2", "x1": "6 - vec_id % 2", "y1": "vec_id % 3", "x2": "7 - vec_id % 3", "y2": "7 + vec_id % 4", "x3": "vec_id % 2", "y3": "6 - vec_id % 3"}
    return views.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), *(F.expr(e).cast("double").alias(c) for c, e in corners.items()))


@query(f"WITH {QUADS} SELECT img_id, {GOOD} AS reliable FROM quads")
def reliable_quad(spark: SparkSession, sf_dir: str) -> DataFrame:
    xs, ys = ([F.col(f"{c}{k}") for k in range(4)] for c in "xy")
    return quads(spark, sf_dir).select("img_id", raster.reliable_quad(xs, ys, F.lit(8), F.lit(8)).alias("reliable"))


@query(f"WITH {QUADS} SELECT img_id, round(sqrt((x0 - x2) * (x0 - x2) + (y0 - y2) * (y0 - y2)), 9) AS diagonal FROM quads")
def hypot(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: (F.col(f"x{k}"), F.col(f"y{k}"))
    return quads(spark, sf_dir).select("img_id", F.round(raster.distance(at(0), at(2)), 9).alias("diagonal"))


@query(PIXELS + f""", {QUADS}, sized AS (SELECT *, greatest(1, floor((sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1)) + sqrt((x3 - x2) * (x3 - x2) + (y3 - y2) * (y3 - y2))) / 2 + 0.5))::BIGINT AS w,
  greatest(1, floor((sqrt((x0 - x3) * (x0 - x3) + (y0 - y3) * (y0 - y3)) + sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))) / 2 + 0.5))::BIGINT AS h FROM quads WHERE {GOOD}),
tall AS (SELECT *, unnest(range(h)) AS y FROM sized), grid AS (SELECT *, unnest(range(w)) AS x FROM tall),
spots AS (SELECT *, CASE WHEN w = 1 THEN 0 ELSE x::DOUBLE / (w - 1) END AS u, CASE WHEN h = 1 THEN 0 ELSE y::DOUBLE / (h - 1) END AS v FROM grid),
edges AS (SELECT *, x0 + (x1 - x0) * u AS tx, y0 + (y1 - y0) * u AS ty, x3 + (x2 - x3) * u AS bx, y3 + (y2 - y3) * u AS b_y FROM spots)
 SELECT e.img_id, e.x, e.y, p.value FROM edges e JOIN pixels p ON p.img_id = e.img_id AND p.x = greatest(0, least(7, floor(tx + (bx - tx) * v + 0.5))) AND p.y = greatest(0, least(7, floor(ty + (b_y - ty) * v + 0.5)))
 UNION ALL SELECT img_id, x, y, value FROM pixels WHERE img_id NOT IN (SELECT img_id FROM sized)""")
def perspective_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.perspective_warp(pixels(spark, sf_dir), quads(spark, sf_dir), 8, 8)


@query(r"SELECT doc_id, trim(regexp_replace(upper(replace(text, 'ß', 'SS')), '[^A-Z0-9]+', ' ', 'g')) AS text FROM documents")
def normalize_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts; a sharp s has two letters above."""
    return views.table(spark, sf_dir, "documents").select("doc_id", score.normalize_upper(F.col("text")).alias("text"))


@query("SELECT p_partkey, levenshtein(p_name, p_type) AS distance FROM part")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"))


READ = f"WITH {views.SQL}, {receipts.SQL}, told AS (SELECT bill_id, item_no, p_name, row_cents, translate(p_name, 'ie', '1c') || ' ' || CASE WHEN item_no % 3 = 0 THEN qty::VARCHAR ELSE '' END || ' ' || replace((row_cents // 100) || '.' || lpad((row_cents % 100)::VARCHAR, 2, '0'), '.', CASE WHEN item_no % 2 = 0 THEN ' ' ELSE '' END) AS seen FROM named)"


def read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item names and amounts beside what a poor reading made of them."""
    rows = receipts.item_names(spark, sf_dir)
    amount = F.replace(money("row_cents"), F.lit("."), F.when(F.col("item_no") % 2 == 0, " ").otherwise(""))
    seen = F.concat_ws(" ", F.translate("p_name", "ie", "1c"), F.when(F.col("item_no") % 3 == 0, F.col("qty").cast("string")).otherwise(""), amount)
    return rows.select("bill_id", "item_no", "p_name", "row_cents", seen.alias("seen"))


WORDS = r"string_split(trim(regexp_replace(upper({0}), '[^A-Z0-9]+', ' ', 'g')), ' ')"
NAME_FOUND = READ + f""", w AS (SELECT *, [x for x in {WORDS.format('p_name')} if length(x) >= 3] AS wanted, {WORDS.format('seen')} AS there FROM told),
f AS (SELECT *, len([x for x in wanted if len([t for t in there if abs(length(t) - length(x)) <= CASE WHEN length(x) <= 4 THEN 1 ELSE length(x) // 4 END + 1 AND levenshtein(t, x) <= CASE WHEN length(x) <= 4 THEN 1 ELSE length(x) // 4 END]) > 0]) AS hits FROM w)"""


@query(NAME_FOUND + " SELECT bill_id, item_no, len(wanted) > 0 AND 2 * hits >= len(wanted) AS found FROM f")
def name_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(spark, sf_dir).select("bill_id", "item_no", score.name_found(F.col("p_name"), F.col("seen")).alias("found"))


AMOUNT_FOUND = READ + r""", r AS (SELECT *, regexp_extract_all(seen, '[0-9]+') AS runs FROM told),
a AS (SELECT *, list_concat(runs, [runs[i] || coalesce(runs[i + 1], '') for i in range(1, len(runs) + 1)]) AS joined FROM r)"""


@query(AMOUNT_FOUND + " SELECT bill_id, item_no, list_contains(joined, row_cents::VARCHAR) OR (row_cents % 100 = 0 AND list_contains(joined, (row_cents // 100)::VARCHAR)) AS found FROM a")
def amount_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(spark, sf_dir).select("bill_id", "item_no", score.amount_found(F.col("row_cents"), F.col("seen")).alias("found"))


def readings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What receipts hold, and poor readings of whole ones: some without a subtotal, with a total that is off, or without text."""
    read, key = read_back(spark, sf_dir), "bill_id"
    sums = read.groupBy(key).agg(F.sum("row_cents").alias("s"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_no", "seen"))), lambda x: x["seen"]), " ").alias("t"))
    half = F.expr("s div 40")
    summary = lambda place, label, cents: F.struct(F.lit(place).cast("long").alias("place"), F.lit("summary").alias("kind"), F.lit(label).alias("label"), cents.cast("long").alias("cents"))
    rest = sums.select(key, F.inline(F.array(summary(900_000, "subtotal", F.col("s")), summary(900_001, "total", F.col("s") + 2 * half), summary(900_002, "CGST", half), summary(900_003, "SGST", half))))
    items = read.select(key, F.col("item_no").alias("place"), F.lit("item").alias("kind"), F.col("p_name").alias("label"), F.col("row_cents").alias("cents"))
    told = F.concat_ws(" ", "t", F.when(F.col(key) % 9 != 0, F.concat(F.lit("Sub Total "), money("s"))), F.concat(F.lit("GST "), money(half)), F.concat(F.lit("Total "), money(F.col("s") + 2 * half + F.when(F.col(key) % 13 == 0, 100).otherwise(0))))
    texts = sums.where(F.col(key) % 50 != 0).select(F.col(key).alias("receipt"), told.alias("text"))
    return items.unionByName(rest).withColumnRenamed(key, "receipt"), texts


def money_sql(x: str) -> str:
    return f"(({x}) // 100) || '.' || lpad((({x}) % 100)::VARCHAR, 2, '0')"


SCORED = READ + f""", whole AS (SELECT bill_id, sum(row_cents)::BIGINT AS s, string_agg(seen, ' ' ORDER BY item_no) AS t FROM told GROUP BY ALL),
texts AS (SELECT *, CASE WHEN bill_id % 50 = 0 THEN '' ELSE t || CASE WHEN bill_id % 9 <> 0 THEN ' Sub Total ' || {money_sql('s')} ELSE '' END || ' GST ' || {money_sql('s // 40')} || ' Total ' || {money_sql('s + 2 * (s // 40) + CASE WHEN bill_id % 13 = 0 THEN 100 ELSE 0 END')} END AS text FROM whole),
wanted AS (SELECT bill_id, item_no AS place, 'item' AS kind, p_name AS label, row_cents AS cents FROM told
  UNION ALL SELECT bill_id, 900000, 'summary', 'subtotal', s FROM whole UNION ALL SELECT bill_id, 900001, 'summary', 'total', s + 2 * (s // 40) FROM whole
  UNION ALL SELECT bill_id, 900002, 'summary', 'CGST', s // 40 FROM whole UNION ALL SELECT bill_id, 900003, 'summary', 'SGST', s // 40 FROM whole),
there AS (SELECT bill_id, {WORDS.format('text')} AS words, regexp_extract_all(text, '[0-9]+') AS runs FROM texts),
joins AS (SELECT *, list_concat(runs, [runs[i] || runs[i + 1] for i in range(1, len(runs))]) AS joined FROM there),
asked AS (SELECT w.*, words, joined, [x for x in {WORDS.format('label')} if length(x) >= 3] AS parts FROM wanted w JOIN joins USING (bill_id)),
seen AS (SELECT *, list_contains(joined, cents::VARCHAR) OR (cents % 100 = 0 AND list_contains(joined, (cents // 100)::VARCHAR)) AS priced,
  len(parts) > 0 AND 2 * len([x for x in parts if len([t for t in words if abs(length(t) - length(x)) <= CASE WHEN length(x) <= 4 THEN 1 ELSE length(x) // 4 END + 1 AND levenshtein(t, x) <= CASE WHEN length(x) <= 4 THEN 1 ELSE length(x) // 4 END]) > 0]) >= len(parts) AS named FROM asked),
scores AS (SELECT bill_id AS receipt, count(*) FILTER (WHERE kind = 'item' AND named) AS names_found, count(*) FILTER (WHERE kind = 'item') AS names, count(*) FILTER (WHERE kind = 'item' AND priced) AS items_found, count(*) FILTER (WHERE kind <> 'item' AND priced) AS summary_found,
  count(*) FILTER (WHERE kind <> 'item') AS summary, coalesce(string_agg(label, ', ' ORDER BY place) FILTER (WHERE kind = 'item' AND NOT named), '') AS missing_names, coalesce(string_agg(label || '=' || {money_sql('cents')}, ', ' ORDER BY place) FILTER (WHERE NOT priced), '') AS missing_amounts FROM seen GROUP BY ALL),
told_scores AS (SELECT *, (names_found + items_found + summary_found) / (2 * names + summary)::DOUBLE AS score FROM scores)"""


@query(SCORED + " SELECT * FROM told_scores")
def ocr_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each reading what it holds of the receipt's names and amounts, and what is missing."""
    found = score.scored(*readings(spark, sf_dir))
    return found.withColumns({c: F.array_join(c, ", ") for c in ("missing_names", "missing_amounts")})


@query(SCORED + " SELECT floor(10000 * avg(score) + 0.5)::BIGINT AS score FROM told_scores")
def aggregate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.aggregate(score.scored(*readings(spark, sf_dir))).select(F.floor(10000 * F.col("score") + 0.5).cast("long").alias("score"))


def laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed lines as tokens with boxes: words side by side, amounts right-aligned at fixed edges, with some jitter."""
    lines = receipts.lines(spark, sf_dir).withColumnRenamed("bill_id", "doc_id").withColumn("words", F.split("line", " "))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    before = F.coalesce(F.sum(F.size("words")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = lines.withColumns({"row": F.dense_rank().over(order), "before": before})
    words = rows.select("doc_id", "line_no", "line", "row", "before", F.posexplode("words").alias("place", "text"), F.size("words").alias("n"))
    number = (F.col("before") + F.col("place") + 1).cast("long")
    width = 8.0 * F.length("text")
    amount = F.col("text").rlike(r"^[$]?-?[0-9]+\.[0-9]{2}$")
    x = F.when(amount & (F.col("place") == F.col("n") - 1), 900.0 - width).when(amount, 700.0 - width).otherwise(60.0 * F.col("place") + 20)
    return words.withColumns({"token_no": number, "x": x, "width": width, "height": F.lit(14.0)}).withColumn("y", 24.0 * F.col("row") + F.col("place") % 3)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laid_out(spark, sf_dir).select("doc_id", "token_no", "text", "x", "y", "width", "height")


@query(f"WITH {views.SQL}, {receipts.SQL} SELECT bill_id AS doc_id, row_number() OVER (PARTITION BY bill_id ORDER BY line_no) - 1 AS line_no, line AS text FROM lines")
def detect_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines rebuilt from jittered boxes; the oracle takes the lines that were printed."""
    return layout.detect_lines(tokens(spark, sf_dir)).select("doc_id", "line_no", "text")


# last amounts of lines by their right edge, of tokens() and of what stands in the oracle for it: the edges of one column lie
# within its tolerance, columns far apart, so that gaps tell clusters
EDGES = f"""WITH {views.SQL}, {receipts.SQL}, words AS (SELECT bill_id AS doc_id, line_no, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) - 1 AS place, len(string_split(line, ' ')) AS n FROM lines),
 placed AS (SELECT *, regexp_matches(text, '^[$]?-?[0-9]+[.][0-9]{{2}}$') AS amount FROM words),
 edges AS (SELECT *, CASE WHEN amount AND place = n - 1 THEN 900 WHEN amount THEN 700 ELSE 60 * place + 20 + 8 * length(text) END AS edge FROM placed WHERE regexp_matches(text, '[0-9]')),
 last AS (SELECT doc_id, line_no, arg_max(edge, place) AS edge FROM edges GROUP BY ALL)"""
#: Runs of ascending edges by their running mean, folded one after the other: the edges' table and the tolerance.
FOLD = """, folded AS (SELECT doc_id, list_reduce(list({{'s': edge::DOUBLE, 'n': 1::BIGINT, 'done': []::STRUCT(s DOUBLE, n BIGINT)[]}} ORDER BY edge),
   lambda a, x: CASE WHEN abs(x.s - a.s / a.n) <= {0} THEN {{'s': a.s + x.s, 'n': a.n + 1, 'done': a.done}} ELSE {{'s': x.s, 'n': 1::BIGINT, 'done': list_append(a.done, {{'s': a.s, 'n': a.n}})}} END) AS r FROM {1} GROUP BY doc_id),
 runs AS (SELECT doc_id, unnest(list_append(r.done, {{'s': r.s, 'n': r.n}})) AS c FROM folded),
 found AS (SELECT doc_id, c.s / c.n AS mean, floor(c.s / c.n + 0.5)::BIGINT AS centre, c.n AS count FROM runs)"""


@query(EDGES + FOLD.format(18, "edges") + " SELECT doc_id, centre, count FROM found WHERE count >= 2")
def cluster_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of numbers: amounts, unit prices, and what counts and words with digits form."""
    return layout.detect_columns(tokens(spark, sf_dir)).select("doc_id", F.inline("columns"))


@query(EDGES + FOLD.format(21, "last") + " SELECT doc_id, centre, count, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, mean) AS place FROM found")
def rank_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the lines' last amounts, the largest first."""
    ranked = layout.detect_columns(tokens(spark, sf_dir)).select("doc_id", F.posexplode("ranked").alias("place", "c"))
    return ranked.select("doc_id", "c.centre", "c.count", (F.col("place") + 1).cast("long").alias("place"))


@query(EDGES + FOLD.format(18, "edges") + " SELECT doc_id, count(*) AS columns, max(count) AS most FROM found WHERE count >= 2 GROUP BY ALL")
def cluster_mean_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many columns a bill has, and how many numbers the fullest."""
    return cluster_columns(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("columns"), F.max("count").alias("most"))


@query(EDGES + " SELECT doc_id, CASE WHEN count(*) >= 3 AND count(*) FILTER (WHERE edge = 900) >= 3 THEN 900 END AS amount_column FROM last GROUP BY ALL")
def amount_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column at which amounts were set; none where too few lines end there."""
    return layout.detect_columns(tokens(spark, sf_dir)).select("doc_id", "amount_column")


TOKENS = f"""WITH {views.SQL}, {receipts.SQL}, lined AS (SELECT *, dense_rank() OVER (PARTITION BY bill_id ORDER BY line_no) AS row FROM lines),
 words AS (SELECT bill_id AS doc_id, row, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) - 1 AS place, len(string_split(line, ' ')) AS n FROM lined),
 tokens AS (SELECT doc_id, row, row_number() OVER (PARTITION BY doc_id ORDER BY row, place) AS token_no, text, 8.0::DOUBLE * length(text) AS width, (24.0 * row + place % 3)::DOUBLE AS y,
   CASE WHEN regexp_matches(text, '^[$]?-?[0-9]+[.][0-9]{{2}}$') THEN CASE WHEN place = n - 1 THEN 900 ELSE 700 END - 8.0 * length(text) ELSE 60.0 * place + 20 END::DOUBLE AS x, 10 + (doc_id + length(text)) % 9 AS tall FROM words)"""


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens with heights that differ."""
    return tokens(spark, sf_dir).withColumn("height", (10 + (F.col("doc_id") + F.length("text")) % 9).cast("double"))


@query(TOKENS + " SELECT doc_id, coalesce((list_sort(list(tall) FILTER (WHERE token_no % 4 > 0 AND doc_id % 50 > 0)))[count(*) FILTER (WHERE token_no % 4 > 0) // 2 + 1], 0)::DOUBLE AS median FROM tokens GROUP BY ALL")
def median_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median of the token heights that are known; some tokens, and all of some bills, have none."""
    known = heights(spark, sf_dir).withColumn("height", F.when((F.col("token_no") % 4 > 0) & (F.col("doc_id") % 50 > 0), F.col("height")).otherwise(0.0))
    return layout.detect_columns(known).select("doc_id", F.col("medium").alias("median"))


@query(TOKENS + " SELECT doc_id, token_no, row_number() OVER (PARTITION BY doc_id ORDER BY y + tall / 2.0, x, token_no) AS place FROM tokens")
def sort_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens in the order in which lines are made of them."""
    each = layout.documents_of(heights(spark, sf_dir)).select("doc_id", F.posexplode("tokens").alias("place", "t"))
    return each.select("doc_id", "t.token_no", (F.col("place") + 1).cast("long").alias("place"))


@query(TOKENS + " SELECT doc_id, row - 1 AS line_no, string_agg(text, ' ' ORDER BY x, token_no) AS text FROM tokens GROUP BY ALL")
def sort_within_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.detect_lines(tokens(spark, sf_dir)).select("doc_id", "line_no", "text")


@query(TOKENS + " SELECT doc_id, row - 1 AS line_no, min(y) AS top FROM tokens GROUP BY ALL")
def sort_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from the top; read from tokens that come from the bottom."""
    upside = tokens(spark, sf_dir).withColumn("token_no", -F.col("token_no"))
    return layout.detect_lines(upside).select("doc_id", "line_no", "top")


@query(TOKENS + " SELECT doc_id, row - 1 AS line_no, min(x) AS left_edge, min(y) AS top_edge, max(x + width) AS right_edge, max(y + 14)::DOUBLE AS bottom_edge FROM tokens GROUP BY ALL")
def union_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = [F.col(c).alias(f"{c}_edge") for c in ("left", "top", "right", "bottom")]
    return layout.detect_lines(tokens(spark, sf_dir)).select("doc_id", "line_no", *edges)


@query(EDGES + " SELECT doc_id, list_sort(list(edge))::VARCHAR AS edges FROM edges GROUP BY ALL")
def sort_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right edges of tokens with a digit, ascending, as columns are made of them."""
    found = layout.detect_columns(tokens(spark, sf_dir))
    return found.select("doc_id", F.concat(F.lit("["), F.array_join(F.transform("edges", lambda x: x.cast("long").cast("string")), ", "), F.lit("]")).alias("edges"))


@query(TOKENS + " SELECT a.doc_id, a.token_no, count(*) AS level FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id AND abs(a.y - b.y) <= 8 GROUP BY ALL")
def row_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens lie on a token's level: a window over the tops of a bill's tokens."""
    return layout.level_counts(tokens(spark, sf_dir).select("doc_id", "token_no", "y"), 8.0)


@query(r"SELECT p_partkey, trim(regexp_replace(p_name, '\s+', ' ', 'g')) || ' 12-3 ABC fi' AS token FROM part")
def normalize_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide letters, a ligature, a long dash and spaces of many kinds around a name."""
    odd = F.concat(F.lit(" \u00a0"), F.replace(F.col("p_name"), F.lit(" "), F.lit(" \t\u3000")), F.lit("  １２—３\u2009ＡＢＣ ﬁ "))
    return views.table(spark, sf_dir, "part").select("p_partkey", layout.normalize_token(odd).alias("token"))


@query("""SELECT p_partkey, len([t for t in string_split(upper(p_type), ' ') if abs(length(t) - length(w)) <= CASE WHEN length(w) <= 4 THEN 1 ELSE length(w) // 4 END + 1 AND levenshtein(t, w) <= CASE WHEN length(w) <= 4 THEN 1 ELSE length(w) // 4 END]) > 0 AS found
  FROM (SELECT p_partkey, p_type, upper(string_split(p_type, ' ')[1][2:]) AS w FROM part)""")
def word_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of a part's type, less a letter, among its words."""
    words = F.split(F.upper("p_type"), " ")
    return views.table(spark, sf_dir, "part").select("p_partkey", score.word_found(F.substr(F.get(words, F.lit(0)), F.lit(2)), words).alias("found"))


@query(AMOUNT_FOUND + " SELECT bill_id, item_no, list_sort(list_distinct(joined))::VARCHAR AS runs FROM a")
def adjacent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digit runs of a reading, and each with the next one."""
    runs = F.array_sort(score.digit_runs(F.col("seen")))
    return read_back(spark, sf_dir).select("bill_id", "item_no", F.concat(F.lit("["), F.array_join(runs, ", "), F.lit("]")).alias("runs"))


@query(SCORED + """ SELECT receipt, rpad('bill-' || receipt, 24, ' ') || ' ' || rpad('names ' || names_found || '/' || names, 12, ' ') || ' ' || rpad('itemAmts ' || items_found || '/' || names, 15, ' ') || ' ' || rpad('summary ' || summary_found || '/' || summary, 14, ' ')
 || ' ' || (floor(score * 1000 + 0.5)::BIGINT // 10) || '.' || (floor(score * 1000 + 0.5)::BIGINT % 10) || '%' AS row FROM told_scores""")
def pad_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's rows at fixed widths."""
    scores = score.scored(*readings(spark, sf_dir))
    return scores.select("receipt", score.report_row(F.concat(F.lit("bill-"), "receipt")).alias("row"))


@query(READ + f""", w AS (SELECT *, s.share, [x for x in {WORDS.format('p_name')} if length(x) >= 3] AS wanted, {WORDS.format('seen')} AS there FROM told, (SELECT unnest([1, 2, 3]) AS share) s),
 f AS (SELECT *, len([x for x in wanted if len([t for t in there if abs(length(t) - length(x)) <= CASE WHEN length(x) <= 4 THEN 1 ELSE length(x) // 4 END + 1 AND levenshtein(t, x) <= CASE WHEN length(x) <= 4 THEN 1 ELSE length(x) // 4 END]) > 0]) AS hits FROM w)
 SELECT share, (10000 * count(*) FILTER (WHERE len(wanted) > 0 AND share * hits >= len(wanted)) // count(*))::BIGINT AS score FROM f GROUP BY ALL""")
def param_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every setting: which share of a name's words must be found."""
    settings = spark.range(1, 4).select(F.col("id").cast("int").alias("share"))
    return score.swept(read_back(spark, sf_dir), settings)


@query("""WITH words AS (SELECT vec_id, unnest(range(8)) AS k FROM embeddings) SELECT vec_id, k AS word_no, 'w' || k AS text, (k * 10 + vec_id % 7)::BIGINT AS x, (vec_id % 5)::BIGINT AS y, (8 + k)::BIGINT AS width, 12::BIGINT AS height FROM words WHERE vec_id % 4 <> 0""")
def ocr_words_to_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with corners become tokens with sizes; a reading without words has no tokens."""
    word = lambda k: F.struct(F.concat(F.lit("w"), k).alias("text"), F.lit(90.0).alias("confidence"), F.struct((k * 10 + F.col("vec_id") % 7).alias("x0"), (F.col("vec_id") % 5).alias("y0"), (k * 10 + F.col("vec_id") % 7 + 8 + k).alias("x1"), (F.col("vec_id") % 5 + 12).alias("y1")).alias("bbox"))
    words = F.when(F.col("vec_id") % 4 != 0, F.transform(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")), word))
    read = views.table(spark, sf_dir, "embeddings").select("vec_id", adapters.tokens_of(words).alias("t"))
    return read.select("vec_id", F.posexplode("t").alias("word_no", "t")).select("vec_id", F.col("word_no").cast("long").alias("word_no"), "t.text", "t.x", "t.y", "t.width", "t.height")


@query(f"WITH {views.SQL}, {receipts.SQL} SELECT bill_id, 'item-' || item_no AS id, CASE WHEN item_no % 4 = 0 THEN 1 ELSE qty END AS quantity, (CASE WHEN item_no % 3 = 0 THEN row_cents ELSE unit_cents END / 100.0)::DOUBLE AS unit_price, (row_cents / 100.0)::DOUBLE AS total_price FROM named WHERE item_no % 5 <> 0 AND item_no % 7 <> 0")
def entry_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed items in major units: without a name or total there is no item, without a quantity it is one."""
    rows = receipts.item_names(spark, sf_dir).select(
        "bill_id", F.concat(F.lit("item-"), "item_no").alias("id"), F.when(F.col("item_no") % 5 != 0, F.col("p_name")).alias("name"), F.when(F.col("item_no") % 4 != 0, F.col("qty")).alias("qty"),
        F.when(F.col("item_no") % 3 != 0, F.col("unit_cents")).alias("unit_cents"), F.when(F.col("item_no") % 7 != 0, F.col("row_cents")).alias("total_cents"),
    )
    return adapters.legacy_items(rows).select("bill_id", "id", "quantity", "unit_price", "total_price")


@query("""SELECT user_id || '/' || (event_id // 20) AS capture, CASE WHEN event_id // 20 % 7 = 3 THEN NULL ELSE count(*) END AS words, CASE WHEN event_id // 20 % 7 = 3 THEN NULL ELSE arg_min(event_type, event_id) END AS first, event_id // 20 % 7 = 3 AS damaged
  FROM events GROUP BY user_id, event_id // 20""")
def fixture_json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded readings over many lines, packed many to a file, of which some were cut off: written from events and read back."""
    word = F.to_json(F.struct(F.col("event_type").alias("text"), F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(8).alias("x1"), F.lit(12).alias("y1")).alias("bbox")))
    each = views.table(spark, sf_dir, "events").select("user_id", F.expr("event_id div 20").alias("part"), F.struct("event_id", word.alias("w")).alias("w"))
    texts = each.groupBy("user_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["w"]), ",\n  ").alias("w"))
    text = F.concat(F.lit('{"file": '), F.col("user_id").cast("string"), F.lit(',\n "words": [\n  '), "w", F.lit("]}"))
    cut_off = F.when(F.col("part") % 7 == 3, F.left(text, F.length(text) - 9)).otherwise(text)
    told = texts.select(F.concat_ws("/", "user_id", "part").alias("capture"), cut_off.alias("value"))
    read = adapters.captures(spark, adapters.recorded(told, "capture"))
    return read.select("capture", F.size("words").cast("long").alias("words"), F.get("words", F.lit(0))["text"].alias("first"), F.col("damaged").isNotNull().alias("damaged"))


DEBOUNCE = """WITH marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events),
bursts AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM marked)"""


@query(DEBOUNCE + " SELECT user_id AS party, count(*) AS changes, arg_max(event_id, (ts, event_id)) AS revision FROM bursts GROUP BY user_id, burst")
def debounce_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = debounce.changes_of(views.table(spark, sf_dir, "events"))
    return debounce.debounce_latest(events, "30 minutes").select("party", "changes", "revision")


@query("SELECT user_id AS party, max(event_id) AS revision, arg_max(props, event_id) AS payload FROM events GROUP BY ALL")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debounce.latest_state(debounce.changes_of(views.table(spark, sf_dir, "events")))


@query("SELECT user_id AS party, event_id AS revision, props AS payload FROM events")
def change_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes as the stream takes them in."""
    return debounce.changes_of(views.table(spark, sf_dir, "events")).select("party", "revision", "payload")


@query(DEBOUNCE + ", closed AS (SELECT *, max(ts) OVER (PARTITION BY user_id, burst) AS last_ts FROM bursts) SELECT user_id AS party, arg_max(event_id, (ts, event_id)) AS revision FROM closed WHERE last_ts + INTERVAL 30 MINUTES <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY user_id, burst")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the change stream has synced: written by one run, and by a second that finds nothing new."""
    return debounce.synced(spark, f"{sf_dir}/event[s].parquet")


SETTLED = """WITH later AS (SELECT user_id AS party, event_id AS revision, props AS payload, ts, min(ts) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS next FROM events),
settled AS (SELECT party, revision, payload, ts FROM later WHERE next IS NULL OR next >= ts + INTERVAL 30 MINUTES),
passed AS (SELECT * FROM settled WHERE ts + INTERVAL 30 MINUTES <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events))"""


@query(SETTLED + " SELECT party, revision, payload FROM settled")
def settled_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes that no later revision overtakes within half an hour."""
    return debounce.settled_revisions(debounce.changes_of(views.table(spark, sf_dir, "events")), 1_800_000)


@query(SETTLED + " SELECT party, revision, payload FROM passed")
def settled_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream, as far as its watermark has come."""
    return debounce.settled(spark, f"{sf_dir}/event[s].parquet")


@query(SETTLED + " SELECT party, max(revision) AS revision, arg_max(payload, revision) AS payload FROM passed GROUP BY ALL")
def store_synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The committed store that the stream feeds: the highest settled revision of each party."""
    return debounce.store_synced(spark, f"{sf_dir}/event[s].parquet")
