"""URL filters: rules by host and path, and for the other urls logistic regression on hashed character n-grams.

DataFrame functions only. A url's terms are the distinct buckets of the n-grams of its host and of its path. The classifier
is fitted by gradient descent on a small labelled table: as its weights are a sum over the labelled rows, the descent moves
one coefficient a row over the table of their inner products, inside one `aggregate` of one row. The weights, one a bucket, are
read by a scalar subquery, so that urls are judged where they are read: no shuffle, no join.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and is left to the classifier;
urls are judged whole, however long; repeated rows and ids are judged each; an empty table gives no rows; extra columns
are ignored. A labelled table of one class gives that class; labelled rows without a url or label are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsplit.functions.columns import let
from tabsplit.shared import written

BLOCK, ALLOW = "block", "allow"
#: (host, path, verdict): the rules of the query.
RULES = (("net", "/", BLOCK), ("example.net", "/en/", ALLOW), ("example.com", "/de/", BLOCK), ("org", "/fr/", ALLOW))
#: Sizes of n-grams, bits of a bucket, and the most labelled rows that are fitted: those first by the checksum of their url.
SIZES, BITS, MOST_LABELLED = (3, 4, 5), 15, 400
#: Steps of the descent, their length, and the weight of the squared weights.
STEPS, RATE, DECAY = 600, 4.0, 0.001

# A small labelled table, ours: urls of the usual kinds that a filter keeps out, and of ordinary sites.
BLOCKED = """
http://www.grand-casino.example.com/en/7001 https://m.lucky-casino.example.org/fr/52.html http://casino-bonus.example.net/de/311 https://blog.online-poker.example.com/en/poker-tips
http://free-slots.example.org/en/21 https://www.sport-bets.example.net/en/9902/ http://m.live-bets.example.org/es/bets https://free-spins.example.com/de/16.html
http://www.best-pills.example.org/en/404 https://pills-online.example.com/fr/pills http://m.cheap-meds.example.net/en/8/ https://www.diet-pills.example.com/es/1200
http://pharma-cheap.example.com/de/30.html https://fast-loans.example.org/en/4/ http://www.payday-loans.example.com/en/77 https://m.cheap-credit.example.net/fr/5
http://www.spam-links.example.net/en/601 https://link-farm.example.com/en/2222.html http://m.content-farm.example.org/de/9 https://seo-spam.example.com/es/31/
http://ads-server.example.com/en/55 https://www.ads-click.example.org/fr/1001 http://m.track-pixel.example.net/en/track https://click-track.example.com/de/6.html
http://www.popup-ads.example.org/en/90/ https://banner-ads.example.net/es/44 http://adult-chat.example.com/en/18 https://www.adult-cams.example.org/de/7.html
http://m.xxx-videos.example.net/fr/300 https://hot-adult.example.com/en/12/ http://www.win-prize.example.org/en/prize https://win-money.example.com/fr/63
http://m.you-win.example.net/de/5005 https://free-prizes.example.org/es/17.html http://www.warez-crack.example.com/en/800 https://keygen-free.example.net/en/39/
"""
ALLOWED = """
http://www.city-news.example.com/en/7005 https://m.morning-post.example.org/fr/57.html http://weather.example.net/de/318 https://blog.gardeners.example.com/en/rose-care
http://library.example.org/en/25 https://www.history-museum.example.net/en/9907/ http://m.railways.example.org/es/horarios https://teachers.example.com/de/13.html
http://www.recipes.example.org/en/401 https://mathematics.example.com/fr/algebre http://m.orchestra.example.net/en/3/ https://www.mountains.example.com/es/1204
http://bird-watch.example.com/de/34.html https://rivers.example.org/en/6/ http://www.theatre.example.com/en/72 https://m.farmers-market.example.net/fr/8
http://www.linguist.example.net/en/609 https://open-source.example.com/en/2228.html http://m.hospital.example.org/de/2 https://bakery.example.com/es/36/
http://university.example.com/en/51 https://www.sciences.example.org/fr/1008 http://m.cycling.example.net/en/routes https://parliament.example.com/de/1.html
http://www.lighthouse.example.org/en/95/ https://philosophy.example.net/es/41 http://chess-club.example.com/en/14 https://www.village-hall.example.org/de/2.html
http://m.photography.example.net/fr/304 https://astronomy.example.com/en/19/ http://www.harbour.example.org/en/tides https://winter-sports.example.com/fr/68
http://m.windmills.example.net/de/5001 https://translators.example.org/es/11.html http://www.carpentry.example.com/en/807 https://neighbours.example.net/en/33/
http://www.editor.example.com/en/1999 https://blog.sailing.example.org/en/4411 http://m.pottery.example.com/fr/7 https://knitting.example.net/de/9280/
http://www.orchard.example.org/es/650 https://blog.treehouse.example.com/en/3141.html http://m.fisheries.example.org/en/271 https://thermal-baths.example.net/en/828
"""


def labelled_table(spark: SparkSession) -> DataFrame:
    """url and blocked (0 or 1) of the small table."""
    rows = [(u, 1) for u in BLOCKED.split()] + [(u, 0) for u in ALLOWED.split()]
    return spark.createDataFrame(rows, "url string, blocked int").coalesce(1)


def parts(url: Column) -> Column:
    """host and path: what follows the first `://`, A-Z lower-cased, and the path up to a query or fragment."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower())
    return F.struct(host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The longest rule that fits a host or one it is a subdomain of, and whose path the path starts with: rule and verdict, or null.

    Rules are one constant array, the longest first; of two of one length the first by text.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    held = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for h, p, v in ordered])
    fits = lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"])
    return F.get(F.filter(held, fits), F.lit(0))


def terms(host: Column, path: Column, bits: int = BITS) -> Column:
    """The distinct buckets of a host's and a path's n-grams, host and path apart; marks stand at their ends."""

    def codes(text: Column, begin: str) -> Column:
        return F.transform(F.regexp_extract_all(F.concat(F.lit(begin), text, F.lit("$")), F.lit("(?s)."), 0), lambda c: F.ascii(c).cast("long"))

    def bucket(of: Column, at: Column, size: int, kind: int) -> Column:
        value = F.lit(8 * kind + size).cast("long")
        for k in range(size):
            value = (value * 257 + F.get(of, at + k)) % 2147483647
        return F.floor((value * 2654435761) % 4294967296 / 2 ** (32 - bits)).cast("int")

    def grams(of: Column, size: int, kind: int) -> Column:
        places = F.when(F.size(of) >= size, F.sequence(F.lit(0), F.size(of) - size)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda at: bucket(of, at, size, kind))

    def all_of(text: Column, begin: str, kind: int) -> Column:
        return let(codes(text, begin), lambda of: F.concat(*[grams(of, size, kind) for size in SIZES]))

    return F.array_distinct(F.concat(all_of(host, "^", 1), all_of(path, ":", 2)))


def train(labelled: DataFrame, most: int = MOST_LABELLED, bits: int = BITS) -> DataFrame:
    """One row `model` (bias, weights by bucket), of labelled rows (url, blocked); written."""
    told = labelled.where("url IS NOT NULL AND blocked IS NOT NULL").withColumn("_crc", F.crc32(F.col("url").cast("binary"))).orderBy("_crc", "url", "blocked").limit(most)
    read = told.select("_crc", "url", "blocked", parts(F.col("url")).alias("p")).select("_crc", "url", F.col("blocked").cast("double").alias("y"), terms(F.col("p.host"), F.col("p.path"), bits).alias("terms"))
    one = read.agg(F.array_sort(F.collect_list(F.struct("_crc", "url", "y", "terms"))).alias("rows"))
    inner = lambda r, s: F.size(F.array_intersect(r["terms"], s["terms"])) / F.sqrt(F.size(r["terms"]) * F.size(s["terms"]).cast("double"))
    one = written(one.select("rows", F.transform("rows", lambda r: F.transform("rows", lambda s: inner(r, s))).alias("products")), "labelled")
    n = F.greatest(F.size("rows"), F.lit(1))

    def step(s: Column) -> Column:
        value = lambda row: F.aggregate(F.zip_with(row, s["a"], lambda k, a: k * a), s["bias"], lambda x, y: x + y)
        errors = F.zip_with("rows", "products", lambda r, row: r["y"] - 1 / (1 + F.exp(-value(row))))
        moved = lambda e: F.struct(F.zip_with(s["a"], e, lambda a, x: a + RATE * (x / n - DECAY * a)).alias("a"), (s["bias"] + RATE * F.aggregate(e, F.lit(0.0), lambda x, y: x + y) / n).alias("bias"))
        return let(errors, moved)

    start = F.struct(F.transform("rows", lambda r: F.lit(0.0)).alias("a"), F.lit(0.0).alias("bias"))
    fitted = written(one.select("rows", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda s, _: step(s)).alias("s")), "fitted")
    shares = fitted.select(F.explode(F.arrays_zip(F.col("rows.terms").alias("terms"), F.col("s.a").alias("a"))).alias("r"))
    sums = shares.select(F.explode("r.terms").alias("bucket"), (F.col("r.a") / F.sqrt(F.size("r.terms").cast("double"))).alias("x")).groupBy("bucket").agg(F.sum("x").alias("w"))
    dense = labelled.sparkSession.range(1 << bits).select(F.col("id").cast("int").alias("bucket")).join(sums, "bucket", "left")
    weights = dense.agg(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("w", F.lit(0.0)).alias("w")))).alias("ws")).select(F.col("ws.w").alias("weights"))
    bias = fitted.select("s.bias").scalar()
    return written(weights.select(F.struct(bias.alias("bias"), "weights").alias("model")), "model")


def blocked_score(model: Column, host: Column, path: Column, bits: int = BITS) -> Column:
    """The probability that a url is to be blocked; model is a column of train()'s row."""
    value = lambda x: x["m"]["bias"] + F.aggregate(x["terms"], F.lit(0.0), lambda a, t: a + F.get(x["m"]["weights"], t)) / F.sqrt(F.greatest(F.size(x["terms"]), F.lit(1)).cast("double"))
    return let(F.struct(model.alias("m"), terms(host, path, bits).alias("terms")), lambda x: 1 / (1 + F.exp(-value(x))))


def judged(pages: DataFrame, model: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row; the score is null where a rule decides."""
    told = pages.select("page_id", parts(F.col("url")).alias("p")).select("page_id", "p.host", "p.path")
    told = told.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    told = told.withColumn("_model", model.scalar())
    told = told.withColumn("score", F.when(F.col("r").isNull(), blocked_score(F.col("_model"), F.col("host"), F.col("path"))))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW))
    return told.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "score")


def filter_sql() -> str:
    """DuckDB's form of the report: the same rules, terms and descent."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rest = "regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's')"
    host, path = f"translate(regexp_extract({rest}, '^[^/?#]*', 0), '{upper}', '{upper.lower()}')", f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"

    def grams(codes: str, size: int, kind: int) -> str:
        value = str(8 * kind + size)
        for k in range(size):
            value = f"(({value}) * 257 + {codes}[i + {k}]) % 2147483647"
        return f"list_transform(range(1, len({codes}) - {size - 2}), lambda i: ((({value}) * 2654435761) % 4294967296) // {2 ** (32 - BITS)})"

    codes = lambda text, begin: f"list_transform(string_split('{begin}' || {text} || '$', ''), lambda c: unicode(c)::BIGINT)"
    both = " || ".join(grams(name, size, kind) for name, kind in (("hc", 1), ("pc", 2)) for size in SIZES)
    cases = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}:{v}'" for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r)))
    values = ", ".join(f"('{u}', {y})" for text, y in ((BLOCKED, 1), (ALLOWED, 0)) for u in text.split())
    reading = lambda source, columns: f"""SELECT {columns}, host, path, list_distinct({both}) AS terms FROM (
    SELECT *, {codes("host", "^")} AS hc, {codes("path", ":")} AS pc FROM (SELECT {columns}, {host} AS host, {path} AS path FROM {source}))"""  # noqa: E731
    return f"""WITH RECURSIVE labelled AS ({reading(f"(VALUES {values}) v(url, y)", "url, y")}),
numbered AS (SELECT row_number() OVER (ORDER BY url) AS k, * FROM labelled),
products AS (
  SELECT a.k, list(len(list_intersect(a.terms, b.terms)) / sqrt(len(a.terms)::DOUBLE * len(b.terms)) ORDER BY b.k) AS row
  FROM numbered a, numbered b GROUP BY a.k),
held AS (SELECT list(row ORDER BY k) AS rows, (SELECT list(y::DOUBLE ORDER BY k) FROM numbered) AS ys, count(*)::DOUBLE AS n FROM products),
descent AS (
  SELECT 0 AS step, list_transform(ys, lambda y: 0.0::DOUBLE) AS a, 0.0::DOUBLE AS bias FROM held
  UNION ALL
  SELECT step + 1, list_transform(a, lambda x, i: x + {RATE} * (e[i] / n - {DECAY} * x)), bias + {RATE} * list_sum(e) / n
  FROM (SELECT step, a, bias, n, list_transform(ys, lambda y, i: y - 1 / (1 + exp(-(bias + list_dot_product(rows[i], a))))) AS e
        FROM descent, held WHERE step < {STEPS})),
fitted AS (SELECT * FROM descent WHERE step = {STEPS}),
weights AS (
  SELECT t AS bucket, sum(x) AS w FROM (SELECT a[k] / sqrt(len(terms)::DOUBLE) AS x, unnest(terms) AS t FROM numbered, fitted) GROUP BY t),
urls AS ({reading("pages", "page_id, url")}),
told AS (SELECT row_number() OVER () AS id, *, CASE {cases} END AS r FROM urls),
scores AS (
  SELECT id, sum(w) AS s FROM (SELECT id, unnest(terms) AS t FROM told WHERE r IS NULL) JOIN weights ON t = bucket GROUP BY id)
SELECT page_id, host, path, regexp_extract(r, '^(.*):', 1) AS rule,
  CASE WHEN r IS NOT NULL THEN regexp_extract(r, ':([a-z]+)$', 1)
    WHEN bias + coalesce(s, 0) / sqrt(greatest(len(terms), 1)::DOUBLE) >= 0 THEN '{BLOCK}' ELSE '{ALLOW}' END AS verdict
FROM told LEFT JOIN scores USING (id), fitted"""
