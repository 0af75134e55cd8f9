"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source is a queue that serves its documents, shuffled by a seeded hash, epoch after epoch. A copy of a document
has a virtual finish time: the words of its source up to its end, divided by the source's weight. All sources advance in
virtual time together, so cutting the order of finish times at the budget gives each source its weighted share; a queue
that has served its last epoch leaves its share to the others.

Running totals never gather a source in one task: documents fall into hash buckets, the totals of (source, bucket) give
each bucket's offset, and only one bucket's rows meet in a window. The global order is dealt in the same way, by ranges
of virtual time. Texts are read once, for their sizes; only identifiers and numbers are shuffled.

Defined results: a null text has size 0 and takes nothing; a null source is a source of its own, the last in order; rows
may repeat, each is a document of its own; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsplit.llm.common import WORD, text_of
from tabsplit.shared import written

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: Rows of a source's bucket and of a range of virtual time, about; both are as many as the rows ask for.
BUCKET_ROWS, SEED = 20_000, 42


def word_count(column: str = "text"):
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """One row a source: rank, weight, source_size, target, and the virtual time `until` at which the budget is spent.

    By time t source s is served min(most * size, weight * t) words. Summed, this is a concave line of pieces, one for each
    number of sources that have run dry, and the least of all its pieces; the budget is met where the last of them meets it.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1)
    ranked = ranked.withColumn("weight", weight.cast("double")).withColumn("full", (F.col("source_size") * most).cast("double"))
    dry = Window.orderBy(F.col("full") / F.col("weight"), "rank")
    before = dry.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = ranked.withColumns({
        "budget": F.sum("source_size").over(everything) * F.lit(share),
        "spent": F.coalesce(F.sum("full").over(before), F.lit(0.0)),
        "rest": F.sum("weight").over(dry.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    }).withColumn("end", (F.col("budget") - F.col("spent")) / F.col("rest"))
    until = F.max("end").over(everything)
    return ranked.withColumn("until", until).select(
        "source", "rank", "weight", "source_size", "budget", "until", F.least(F.col("full"), F.col("weight") * F.col("until")).alias("target")
    )


def running(df: DataFrame, group: list[str], bucket: str, order: list, value: str, name: str) -> DataFrame:
    """The sum of `value` over earlier rows of the group, buckets in order and rows in `order` within them."""
    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.join(offsets, [*group, bucket]).withColumn(name, F.col("_offset") + F.sum(value).over(within) - F.col(value)).drop("_offset")


def schedule(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: int = SEED, extra: tuple[str, ...] = ()) -> DataFrame:
    """Copies that the mix takes, from rows (doc_id, source, size): one row a copy with its place in the mix.

    epoch counts from 0; taken is below size only for the copy in service when the budget is spent; mix_offset is the
    number of words that the mix holds before this copy. `start` tells rows with equal doc_id apart; `extra` columns stay.
    """
    buckets = sized.count() // BUCKET_ROWS
    digits = max(2, math.ceil(math.log(buckets + 1, 16)))
    ranges = max(256, most * buckets)
    targets = source_targets(sized, weights, share, most)
    same = sized["source"].eqNullSafe(targets["source"])
    queued = sized.where("size > 0").join(targets, same).drop(targets["source"])
    queued = queued.withColumn("shuffle", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))).withColumn("bucket", F.substring("shuffle", 1, digits))
    queued = running(queued, ["rank"], "bucket", ["shuffle", "doc_id", "size"], "size", "start")
    copies = queued.withColumn("epoch", F.explode(F.array(*map(F.lit, range(most)))))
    begun = F.col("start") + F.col("epoch") * F.col("source_size")
    copies = copies.withColumn("finish", (begun + F.col("size")) / F.col("weight"))
    copies = copies.withColumn("served", F.least(F.col("size"), F.floor("target") - begun)).where("served > 0")
    time = F.least(F.floor(F.col("finish") / F.col("until") * ranges), F.lit(ranges - 1))
    copies = running(copies.withColumn("range", time), [], "range", ["finish", "rank", "epoch", "start"], "served", "mix_offset")
    taken = F.least("served", F.floor("budget") - F.col("mix_offset"))
    return copies.withColumn("taken", taken).where("taken > 0").select("doc_id", "source", "size", "start", "epoch", "taken", "mix_offset", *extra)


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count().alias("size"))


def mix_report(docs: DataFrame) -> DataFrame:
    """Per document its size, its source's size and target, and the words that the mix takes of it, over all copies."""
    sized = written(sizes(docs), "sizes")
    numbered = Window.partitionBy("doc_id", "source", "size").orderBy("start")
    taken = schedule(sized).groupBy("doc_id", "source", "size", "start").agg(F.sum("taken").alias("taken"), F.min("mix_offset").alias("mix_offset"))
    taken = taken.withColumn("same", F.row_number().over(numbered)).drop("start")
    all_rows = sized.withColumn("same", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("size")))
    both = [all_rows[c].eqNullSafe(taken[c]) for c in ("doc_id", "source", "size", "same")]
    found = all_rows.join(taken, both, "left").select(all_rows["doc_id"], all_rows["source"], all_rows["size"], "taken", "mix_offset")
    targets = source_targets(sized)
    return found.join(targets, found["source"].eqNullSafe(targets["source"])).select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.col("mix_offset").cast("long").alias("mix_offset"), found["source"]
    )


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows as often as the mix takes them; a copy that the budget cuts stays whole if at least half of it is taken.

    Rows that are equal in doc_id, source and text are numbered, so that each meets its own copies. Other columns stay.
    """
    row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"], docs["source"], docs["text"], F.xxhash64(docs["text"]).alias("key"))
    keyed = row.withColumn("same", F.row_number().over(Window.partitionBy("doc_id", "source", "key").orderBy(F.lit(1))))
    sized = written(keyed.select("doc_id", "source", F.struct("key", "same").alias("id"), word_count().alias("size")), "sizes")
    copies = schedule(sized, extra=("id",)).where("2 * taken >= size").groupBy("doc_id", "source", "id").agg(F.count("*").cast("int").alias("copies"))
    both = [keyed["key"] == copies["id.key"], keyed["same"] == copies["id.same"], *(keyed[c].eqNullSafe(copies[c]) for c in ("doc_id", "source"))]
    return keyed.join(copies, both).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


REPORT_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
ranked AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, (CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight, (source_size * 2)::DOUBLE AS dry FROM ranked),
pieces AS (
  SELECT *, (SELECT sum(size) * 1.5::DOUBLE FROM sized) AS budget,
    (SELECT coalesce(sum(e.dry), 0) FROM weighed e WHERE (e.dry / e.weight, e.rank) < (w.dry / w.weight, w.rank)) AS spent,
    (SELECT sum(e.weight) FROM weighed e WHERE (e.dry / e.weight, e.rank) >= (w.dry / w.weight, w.rank)) AS rest
  FROM weighed w),
targets AS (SELECT source, rank, weight, source_size, budget, max((budget - spent) / rest) OVER () AS until,
    least(dry, weight * max((budget - spent) / rest) OVER ()) AS target FROM pieces),
queued AS (
  SELECT d.doc_id, d.size, t.*, sum(d.size) OVER (PARTITION BY t.rank ORDER BY md5('42:' || d.doc_id), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT *, epoch, least(size, floor(target) - start - epoch * source_size) AS served, (start + epoch * source_size + size) / weight AS finish
  FROM queued, (VALUES (0), (1)) AS e(epoch)),
placed AS (
  SELECT *, sum(served) OVER (ORDER BY finish, rank, epoch, start ROWS UNBOUNDED PRECEDING) - served AS mix_offset FROM copies WHERE served > 0),
cut AS (SELECT rank, doc_id, start, size, least(served, floor(budget) - mix_offset) AS taken, mix_offset FROM placed)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(sum(c.taken) FILTER (WHERE c.taken > 0), 0)::BIGINT AS taken,
  (min(c.mix_offset) FILTER (WHERE c.taken > 0))::BIGINT AS mix_offset, q.source
FROM queued q LEFT JOIN cut c ON c.rank = q.rank AND c.doc_id = q.doc_id AND c.start = q.start AND c.size = q.size
GROUP BY q.doc_id, q.size, q.source_size, q.target, q.source, q.start
"""
