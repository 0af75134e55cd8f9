"""Connected components of links between identifiers of any orderable type, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tabsplit.shared import dropped, written

MOST_ROUNDS = 60


def large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the least of the node and its neighbours; so u > v here and in what follows."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours, of links with u > v, are tied to the least of those."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    tied = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def marked(links: DataFrame, name: str) -> tuple:
    """The links, written, with a count and a sum that change with them, observed while they were."""
    seen = Observation()
    found = written(links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")), name)
    return found, (seen.get["n"], seen.get["s"])


def components(links: DataFrame) -> DataFrame:
    """node and component, its component's least node, for every node of the links (u, v); the least has its own row too.

    Each round is written to the shared folder, so that plans stay short and lost executors cost one round; the round before
    is deleted then. Rows of a hub are two identifiers each, and AQE splits its join where they are too many.
    """
    stars, before = marked(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        last = stars
        stars, now = marked(small_star(large_star(stars)), "stars")
        dropped(last)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    members = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = written(members.union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    dropped(stars)
    return found
