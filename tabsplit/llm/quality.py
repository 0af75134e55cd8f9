"""Quality rules by robust multivariate outliers, with DataFrame functions only.

Base statistics of each whole text are computed within its row by array functions; nothing of the text is shuffled. The
statistics become a vector of rounded logarithms and shares. For each language and source a minimum-covariance-determinant
estimate is fitted by concentration steps: from each of several starts, a step takes the half of the documents with the
smallest distances, (n + p + 1) / 2 of n with p statistics, and estimates their mean and covariance anew, until the
determinant of the covariance falls no more; after two steps only the start with the least determinant goes on. Documents whose
Mahalanobis distance from it is beyond the cut-off are rejected.

The vectors are whole numbers, so sums over any number of partitions are exact and reruns agree. Every step is an
aggregate with partial sums; a hot group never meets in one task. Groups below `LEAST` documents are judged with the
other small groups of their language, and those with all other small languages; below `LEAST` there, nothing is rejected.

Defined results: a null text has no words and fails the base rule; null languages and sources are values of their own;
repeated rows are judged alike; a text of one very long line or word is one row; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsplit.functions.columns import let
from tabsplit.llm.common import WORD, text_of
from tabsplit.shared import dropped, written

SYMBOLS, WHITE, WINDOW = "#*$%&|<>", " \t\n\x0b\x0c\r", 8
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Quantiles of the statistics that the starts are centred on, steps that each takes, the fall of a determinant's logarithm that
#: another step of the best is taken for, and the smallest group with its own estimate.
STARTS, FIRST, FALL, LEAST = (0.5, 0.25, 0.75), 2, 0.02, 50
#: Units of a vector entry: a thousandth. The deviation that an estimate has in each direction at least.
UNIT, FLOOR = 1000, 250
#: The median of a chi-squared variable of 2 degrees, which distances are scaled to, as length and word length are all that
#: varies in most documents; and the squared distance that rejects.
MEDIAN, CUTOFF = 1.3863, 100.0
VECTOR = ["z_length", "z_word", "z_symbols", "z_lines", "z_repeats"]


def repeated_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more; equal windows are told by their hashes."""

    def covered(starts: Column) -> Column:
        # starts ascend; each window adds what the next one does not cover
        gaps = F.aggregate(F.sequence(F.lit(1), F.size(starts) - 1), F.lit(0).cast("long"), lambda n, k: n + F.least(F.lit(WINDOW), F.get(starts, k) - F.get(starts, k - 1)))
        return F.when(F.size(starts) == 0, F.lit(0)).when(F.size(starts) == 1, F.lit(WINDOW)).otherwise(gaps + WINDOW).cast("long")

    def among(windows: Column) -> Column:
        marked = F.array_sort(F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
        same = lambda x, a, b: F.get(x, a)["h"] == F.get(x, b)["h"]
        flagged = lambda x: F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda k: F.coalesce(same(x, k, k - 1), F.lit(False)) | F.coalesce(same(x, k, k + 1), F.lit(False)))
        starts = let(marked, lambda x: F.sort_array(F.transform(flagged(x), lambda k: F.get(x, k)["k"])))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(starts, covered))

    def hashed(of_word: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(1), F.size(of_word) - (WINDOW - 1)), lambda k: F.xxhash64(F.slice(of_word, k, WINDOW))), among)

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), hashed))


def base_statistics(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, lang, source, the five base counts, base_failed and further columns of every row, from its whole text."""
    text = text_of()
    found = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    counts = docs.select(
        "doc_id", "lang", "source", *more, found.alias("found"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    ).select("doc_id", "lang", "source", *more, "found.n_words", "word_chars", "n_symbols", "n_dup_lines", "found.n_repeat_words")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counts.withColumn("base_failed", failed)


def vectors(counts: DataFrame) -> DataFrame:
    share = lambda c: F.col(c) / F.greatest("n_words", F.lit(1))
    raw = [F.log(F.greatest("n_words", F.lit(1))), 4 * F.log1p(share("word_chars")), F.log1p(100 * share("n_symbols")), 10 * share("n_dup_lines"), 4 * share("n_repeat_words")]
    return counts.withColumns({name: F.round(x * UNIT).cast("long") for name, x in zip(VECTOR, raw, strict=True)})


def group_names(sizes: DataFrame) -> DataFrame:
    """lang, source and the group that judges them: their own, or the pool of small ones."""
    name = lambda *c: F.concat_ws("\x01", *(F.coalesce(F.concat(F.lit("="), F.col(x)), F.lit("-")) for x in c))
    small = F.col("count") < LEAST
    pool = F.sum(F.when(small, F.col("count")).otherwise(0)).over(Window.partitionBy("lang"))
    own = F.when(~small, name("lang", "source")).when(pool >= LEAST, name("lang")).otherwise(F.lit(""))
    return sizes.select("lang", "source", own.alias("group"))


def in_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    same = [rows[c].eqNullSafe(groups[c]) for c in ("lang", "source")]
    return rows.join(groups, same).select(rows["*"], "group")


def pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(VECTOR)) for j in range(i + 1)]


def estimate(rows: DataFrame) -> DataFrame:
    """Mean and Cholesky factor of the covariance of each group's rows, from exact sums; FLOOR is added to each direction."""
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(VECTOR)] + [F.sum((F.col(VECTOR[i]) * F.col(VECTOR[j])).cast("decimal(38,0)")).alias(f"p{i}{j}") for i, j in pairs()]
    found = rows.groupBy("group").agg(F.count("*").cast("double").alias("n"), *sums)
    found = found.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(len(VECTOR))})
    found = found.withColumns({f"c{i}{j}": F.col(f"p{i}{j}").cast("double") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") + F.lit(float(FLOOR**2) * (i == j)) for i, j in pairs()})
    for i, j in pairs():
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}"))  # noqa: B023
        found = found.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l{j}{j}"))
    spread = reduce(lambda a, i: a + 2 * F.log(F.col(f"l{i}{i}")), range(len(VECTOR)), F.lit(0.0))
    return found.withColumn("spread", spread).select("group", "n", "spread", *estimated())


def estimated() -> list[str]:
    return [*(f"m{i}" for i in range(len(VECTOR))), *(f"l{i}{j}" for i, j in pairs())]


def start(rows: DataFrame, share: float) -> DataFrame:
    """A first estimate: quantiles, and median absolute deviations from them on the diagonal; its determinant counts as endless."""
    middle = rows.groupBy("group").agg(*(F.percentile(c, F.lit(share)).alias(f"m{i}") for i, c in enumerate(VECTOR)))
    off = rows.join(middle, "group").groupBy("group", *(f"m{i}" for i in range(len(VECTOR)))).agg(
        F.count("*").cast("double").alias("n"), *(F.percentile(F.abs(F.col(c) - F.col(f"m{i}")), F.lit(0.5)).alias(f"a{i}") for i, c in enumerate(VECTOR))
    )
    scale = [F.sqrt((1.4826 * F.col(f"a{i}")) ** 2 + float(FLOOR**2)).alias(f"l{i}{i}") if i == j else F.lit(0.0).alias(f"l{i}{j}") for i, j in pairs()]
    return off.select("group", "n", F.lit(float("inf")).alias("spread"), *(f"m{i}" for i in range(len(VECTOR))), *scale)


def distances(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Squared Mahalanobis distances by forward substitution."""
    near = rows.join(estimates, "group")
    for i, c in enumerate(VECTOR):
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"y{k}"), range(i), F.col(c) - F.col(f"m{i}"))  # noqa: B023
        near = near.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    return near.withColumn("distance", sum((F.col(f"y{i}") ** 2 for i in range(1, len(VECTOR))), F.col("y0") ** 2)).select(*rows.columns, "n", "distance")


def half_below(near: DataFrame, more: int, name: str) -> DataFrame:
    """Per group the upper edge of the fine logarithmic bin of distances below which (n + more) / 2 of its n rows lie."""
    bins = near.withColumn("bin", F.ceil(F.log1p("distance") * 256)).groupBy("group", "bin").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("group").orderBy("bin")
    counted = bins.withColumn("upto", F.sum("rows").over(earlier)).withColumn("all", F.sum("rows").over(Window.partitionBy("group")))
    return counted.where(F.col("upto") >= F.least(F.floor((F.col("all") + more) / 2), F.col("all"))).groupBy("group").agg(F.expm1(F.min("bin") / 256).alias(name))


def concentrated(rows: DataFrame, now: DataFrame) -> DataFrame:
    """A concentration step: the estimates of the half of each group's rows that is nearest to the estimates so far."""
    near = distances(rows, now)
    # a written table's size is known, so that one row a group is broadcast and no group meets in one task
    limits = written(half_below(near, len(VECTOR) + 1, "limit"), "limits")
    kept = near.join(limits, "group").where(F.ceil(F.log1p("distance") * 256) <= F.round(F.log1p("limit") * 256))
    before = now.select("group", F.col("n").alias("all"), F.col("spread").alias("before"))
    found = written(estimate(kept).join(before, "group").withColumn("n", F.col("all")), "estimates")
    dropped(limits)
    return found


def robust_estimates(rows: DataFrame) -> DataFrame:
    """The final estimate of each group with `scale`, the median of its squared distances over the expected one.

    All starts take FIRST steps, each under a name of its own; the one with the least determinant in its group goes on.
    """
    named = lambda k: F.concat("group", F.lit(f"\x02{k}"))
    trials = rows.withColumn("group", F.explode(F.array(*(named(k) for k in range(len(STARTS))))))
    columns = ["group", "n", "spread", *estimated()]
    tried = written(reduce(DataFrame.union, (start(rows, share).withColumn("group", named(k)) for k, share in enumerate(STARTS))), "estimates")
    for _ in range(FIRST):
        tried = concentrated(trials, tried.select(columns))
    least = tried.withColumn("trial", F.col("group")).groupBy(F.left("group", F.length("group") - 2).alias("group")).agg(F.min(F.struct("spread", "trial", "n", *estimated())).alias("least"))
    moving = written(least.select("group", "least.n", "least.spread", *(f"least.{x}" for x in estimated())), "estimates")
    settled = [moving]
    while not moving.isEmpty():
        found = concentrated(rows, moving)
        settled.append(found.select(columns))
        moving = found.where(F.col("spread") < F.col("before") - FALL).select(columns)
    last = reduce(DataFrame.union, settled).groupBy("group").agg(F.min(F.struct("spread", "n", *estimated())).alias("least"))
    found = written(last.select("group", "least.n", "least.spread", *(f"least.{x}" for x in estimated())), "estimates")
    middle = half_below(distances(rows, found), 1, "middle")
    return written(found.join(middle.select("group", F.greatest(F.col("middle") / MEDIAN, F.lit(1e-3)).alias("scale")), "group"), "estimates")


def judged(counts: DataFrame) -> DataFrame:
    """The rows of counts (lang, source, the vector) that passed the base rule, with n (documents of its group) and distance, scaled."""
    passed = counts.where("not base_failed")
    sizes = written(passed.groupBy("lang", "source").count(), "sizes")
    groups = written(group_names(sizes), "groups")
    rows = written(in_groups(passed.select("lang", "source", *VECTOR), groups).select("group", *VECTOR), "vectors")
    found = robust_estimates(rows)
    near = distances(in_groups(passed, groups), found.drop("scale")).join(found.select("group", "scale"), "group")
    dropped(rows, sizes)
    return near.withColumn("distance", F.col("distance") / F.col("scale")).withColumn("kept", (F.col("n") < LEAST) | (F.col("distance") <= CUTOFF))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the scaled squared distance that decided (null if it failed before)."""
    counts = written(vectors(base_statistics(docs)), "statistics")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"]
    failed = counts.where("base_failed").withColumn("kept", F.lit(False)).withColumn("distance", F.lit(None).cast("double"))
    return judged(counts).select(columns).unionByName(failed.select(columns))


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows that are kept, with all their columns, whatever their names."""
    row = docs.select(docs["doc_id"], docs["lang"], docs["source"], docs["text"], F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    passed = written(vectors(base_statistics(row, "row")).where("not base_failed").select("lang", "source", "base_failed", "row", *VECTOR), "passed")
    return judged(passed).where("kept").select("row.*")
