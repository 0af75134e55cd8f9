"""Near-duplicate documents by a signature-coordinate inverted join.

A document is the set of its word shingles; equal sets are one class. A class has COORDINATES coordinates, each the hash of
ROWS minimal shingle hashes, and is posted under every (coordinate, value). Two sets of at least the given similarity share
`threshold` of the postings but for a chance of MISSED.

1. Postings of a single class are skipped, and with them classes that are left with fewer shared postings than the threshold.
   The others are ordered from rare to common; of m shared postings a class enters the first m - threshold + 1 (its prefix),
   as two classes above the threshold meet in one of those.
2. Each prefix posting ties its classes to one of them, its pivot. Ties above the threshold are confirmed on full sets and
   give first components, so that most of a family of near copies is joined without its pairs.
3. In postings that still hold several components, collisions are counted by merging the postings of the classes that meet
   there: the short lists are merged, and the longest, which alone cannot reach the threshold, are only probed for what the
   short ones brought up. Classes that are joined already are skipped. Components with a pair above the threshold are a family.
4. The full sets of a family meet, and are merged in the same way: what two sets share is counted exactly, and a pair that
   reaches the given similarity joins their components.

A large posting or family is cut into blocks; each two blocks are a task's work of its own, but for those inside the component
of its pivot. Every step returns a spanning forest, so that rows grow with classes and never with the pairs of a group.

Defined results: with fewer words than a shingle takes, the whole sequence is the one shingle; null, empty and blank texts
have no shingle and are linked with nothing; rows with a null doc_id get a null component; rows that share a doc_id are one
node, whatever their texts. Repeated rows share their result, extra columns are ignored, an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsplit.llm.common import slices
from tabsplit.operators.components import components
from tabsplit.shared import dropped, written

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
COORDINATES, ROWS, MISSED = 48, 3, 1e-6
#: Classes of a posting's block, shingles of a family's, partners of a class in the first round, rows of a confirming task for
#: one class, and words whose hashes a worker remembers.
BLOCK, CHUNK, TIES, PART, REMEMBERED = 2048, 1 << 19, 3, 10_000, 500_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
NODE = "struct<a:long,b:long>"


def threshold(similarity: float, count: int = COORDINATES, rows: int = ROWS) -> int:
    """The most coordinates that two sets that similar share but for a chance of MISSED."""
    p = similarity**rows
    chance, odds = 0.0, (1 - p) ** count
    for k in itertools.count():
        chance += odds
        if chance > MISSED:
            return max(1, k)
        odds *= (count - k) / (k + 1) * p / (1 - p)
    raise AssertionError


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX[1]
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts."""

    def __init__(self, width: int):
        self.width, self.known = width, {}
        self.powers = mixed(np.arange(1, width + 1, dtype=np.uint64) * MIX[0]) | np.uint64(1)

    def hashes(self, words: list[bytes]) -> np.ndarray:
        of = self.known.get
        found = [of(w) for w in words]
        if None in found:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            for k, w in enumerate(words):
                if found[k] is None:
                    found[k] = self.known[w] = xxhash.xxh64_intdigest(w)
        return np.array(found, dtype=np.uint64)

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().translate(LOWER).split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        h = self.hashes(words)
        width = min(self.width, len(h))
        total = np.zeros(len(h) - width + 1, dtype=np.uint64)
        for k in range(width):
            total += mixed(h[k : len(h) - width + 1 + k] + np.uint64(k)) * self.powers[k]
        return np.unique(mixed(total + np.uint64(self.width - width)))


@functools.lru_cache(maxsize=4)
def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signatures(sets: list[np.ndarray], count: int = COORDINATES, rows: int = ROWS) -> np.ndarray:
    """A row of `count` postings, one for each coordinate and its value, for each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(x) for x in sets[:-1]])
    factors, masks = permutations(count * rows)
    found = np.empty((len(sets), count), dtype=np.uint64)
    for c in range(count):
        value = np.full(len(sets), np.uint64(c + 1))
        for k in range(c * rows, (c + 1) * rows):
            least = np.minimum.reduceat(((flat ^ masks[k]) * factors[k]) >> np.uint64(32), starts)
            value = mixed(value * MIX[2] + least)
        found[:, c] = value
    return found


def set_key(found: np.ndarray) -> tuple[int, int]:
    return tuple(int(mixed(found ^ m).sum(dtype=np.uint64).astype(np.int64)) for m in MIX[:2])


def nodes_of(keys: list[tuple[int, int]]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)], ["a", "b"])


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, n_shingles, node (the set's key) and postings (null without shingles) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in slices(batches, "text"):
            sets = [shingler.of(x) for x in batch.column("text").to_pylist()]
            full = [x for x in sets if len(x)]
            rows = iter(signatures(full).astype(np.int64) if full else ())
            postings = pa.array([next(rows) if len(x) else None for x in sets], pa.list_(pa.int64()))
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array([len(x) for x in sets], pa.int64()), nodes_of([set_key(x) for x in sets]), postings]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_shingles", "node", "postings"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return slim.mapInArrow(run, f"doc_id long, text_key long, n_shingles long, node {NODE}, postings array<long>")


def prefixes(classes: DataFrame, least: int) -> DataFrame:
    """posting, node of the rare postings that a class above the threshold with another must share with it."""
    each = classes.select("node", F.explode("postings").alias("posting"))
    shared = each.groupBy("posting").agg(F.count("*").alias("size")).where("size > 1")
    held = each.join(shared, "posting").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("size", "posting"))).alias("held"))
    return held.where(F.size("held") >= least).select("node", F.explode(F.slice("held", F.lit(1), F.size("held") - (least - 1))).alias("x")).select("x.posting", "node")


def alike(classes: DataFrame, pairs: DataFrame, percent: int, least: int) -> DataFrame:
    """The pairs (u, v) that share `least` postings and whose sizes allow a link."""
    of = lambda name: classes.select(F.col("node").alias(name), F.col("postings").alias(f"{name}_postings"), F.col("n_shingles").alias(f"{name}_size"))
    both = pairs.join(of("v"), "v").join(of("u"), "u")
    near = 100 * F.least("u_size", "v_size") >= percent * F.greatest("u_size", "v_size")
    return both.where(near & (F.size(F.array_intersect("u_postings", "v_postings")) >= least)).select("u", "v")


def pivot_pairs(prefix: DataFrame) -> DataFrame:
    """For each class the TIES pivots, of its postings, that it meets most often; every posting has its own pivot."""
    pivots = prefix.groupBy("posting").agg(F.min_by("node", F.xxhash64("posting", "node")).alias("pivot"), F.count("*").alias("size")).where("size > 1")
    met = prefix.join(pivots, "posting").where("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("n"))
    best = met.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "pivot")), asc=False), 1, TIES).alias("best"))
    return best.select(F.col("node").alias("u"), F.explode("best").alias("x")).select("u", F.col("x.pivot").alias("v"))


class Cell:
    """Classes that meet, as sets of numbers: counts what two of them share by merging the lists of classes of each number."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, blocks: np.ndarray):
        self.sizes, self.labels, self.blocks = np.array([len(x) for x in sets]), labels, blocks
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        _, self.starts, place, self.counts = np.unique(flat[order], return_index=True, return_inverse=True, return_counts=True)
        self.members, where = owner[order], np.empty(len(flat), dtype=np.int64)
        where[order] = place
        self.lists = np.split(where, np.cumsum(self.sizes)[:-1])

    def merged(self, lists: np.ndarray, n: int) -> np.ndarray:
        """How many of the lists hold each of the first n classes."""
        counts = self.counts[lists]
        held = self.members[np.repeat(self.starts[lists] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
        return np.bincount(held[held < n], minlength=n)

    def probed(self, k: int, j: np.ndarray) -> np.ndarray:
        """Of list k, which of the classes j it holds."""
        members = self.members[self.starts[k] : self.starts[k] + self.counts[k]]
        return members[np.minimum(np.searchsorted(members, j), len(members) - 1)] == j

    def forest(self, least: Callable[[np.ndarray, int], np.ndarray], apart: bool) -> Iterator[tuple[int, int]]:
        """Pairs that share the least number that their sizes ask for, as far as they join what was not joined yet."""
        for k in range(1, len(self.sizes)):
            open_ = self.labels[:k] != self.labels[k]
            if apart:
                open_ &= self.blocks[:k] != self.blocks[k]
            lists = self.lists[k]
            asked = least(self.sizes[:k], self.sizes[k])
            open_ &= asked <= np.minimum(self.sizes[:k], self.sizes[k])
            if not open_.any():
                continue
            lists = lists[self.counts[lists] > 1]
            lists = lists[np.argsort(self.counts[lists], kind="stable")]
            # a partner is missing from fewer lists than there are short ones
            short = max(0, len(lists) - int(asked[open_].min()) + 1)
            shared = self.merged(lists[:short], k)
            found = np.flatnonzero(open_ & (shared > 0))
            shared = shared[found]
            for n, probe in enumerate(lists[short:]):
                enough = shared + (len(lists) - short - n) >= asked[found]
                found, shared = found[enough], shared[enough]
                if not len(found):
                    break
                shared = shared + self.probed(probe, found)
            for j in found[shared >= asked[found]]:
                if self.labels[j] != self.labels[k]:
                    yield k, int(j)
                    self.labels[self.labels == self.labels[k]] = self.labels[j]


def cells(rows: DataFrame, key: str, most: int) -> DataFrame:
    """rows (key, node, label, weight, ...) of keys with several labels, as they meet: key, low, high, block and the other columns.

    A group of a weight up to `most` meets as a whole, a larger one block by block. Blocks of the pivot's component come last
    and don't meet each other.
    """
    own = F.col("label") == F.col("home")
    groups = rows.groupBy(key).agg(F.min_by("label", F.xxhash64(key, "node")).alias("home"), F.sum("weight").alias("all"), F.min("label").alias("one"), F.max("label").alias("other"))
    placed = rows.join(groups.where("one <> other").drop("one", "other"), key)
    at_home = placed.where(F.col("all") > most).groupBy(key).agg(F.sum(F.when(own, F.col("weight")).otherwise(0)).alias("at_home"))
    blocks = lambda n: F.ceil(n / most).cast("int")
    cut = placed.join(at_home, key, "left").withColumns({"rest": F.coalesce(blocks(F.col("all") - F.col("at_home")), F.lit(1)), "homes": F.coalesce(blocks(F.col("at_home")), F.lit(0))})
    drawn, split = F.xxhash64("node", key), F.col("homes") > 0
    block = F.when(~split, 0).when(own, F.col("rest") + F.pmod(drawn, F.greatest("homes", F.lit(1)))).otherwise(F.pmod(drawn, "rest")).cast("int")
    others = F.when(own & split, F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest") + F.col("homes") - 1))
    met = cut.withColumn("block", block).withColumn("meets", F.explode(others))
    return met.withColumns({"low": F.least("block", "meets"), "high": F.greatest("block", "meets")}).select("low", "high", "block", *rows.columns)


def joined_in(met: DataFrame, key: str, least: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """(u, v): labels of cells() that a pair joins which shares as many numbers of its sets as `least` asks of their sizes."""
    columns = ["label", "block", "set"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, high), rows in grouped(batches, [key, "low", "high"], columns):
            names = [(r[0]["a"], r[0]["b"]) for r in rows]
            known = {x: k for k, x in enumerate(dict.fromkeys(names))}
            if len(known) > 1:
                cell = Cell([np.frombuffer(r[2], dtype=np.int64) for r in rows], np.array([known[x] for x in names]), np.array([r[1] for r in rows]))
                found = list(cell.forest(least, low != high))
                if found:
                    yield pa.RecordBatch.from_arrays([nodes_of([names[k] for k in side]) for side in zip(*found, strict=True)], ["u", "v"])

    dealt = met.select(key, "low", "high", *columns).repartition(key, "low", "high").sortWithinPartitions(key, "low", "high")
    return dealt.mapInArrow(run, f"u {NODE}, v {NODE}").distinct()


def families(classes: DataFrame, prefix: DataFrame, labels: DataFrame, least: int) -> DataFrame:
    """(u, v): components that are to be compared, as a spanning forest, counted by merging postings."""
    labelled = prefix.join(labels, "node", "left").select("posting", "node", F.coalesce("component", "node").alias("label"), F.lit(1).alias("weight"))
    packed = F.unhex(F.array_join(F.transform("postings", lambda x: F.lpad(F.hex(x), 16, "0")), ""))
    met = cells(labelled, "posting", BLOCK).join(classes.select("node", packed.alias("set")), "node")
    return joined_in(met, "posting", lambda sizes, size: np.full(len(sizes), least))


def links_in(docs: DataFrame, classes: DataFrame, labels: DataFrame, family: DataFrame, width: int, percent: int) -> DataFrame:
    """(u, v): components of one family that a link joins; sets are counted in full."""
    of = classes.select("node", F.col("n_shingles").alias("weight")).join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    held = of.join(family.select(F.col("node").alias("label"), F.col("component").alias("family")), "label")
    sets = written(full_sets(docs, classes, held.select("node"), width), "sets")
    met = cells(held.select("family", "node", "label", "weight"), "family", CHUNK).join(sets, "node")
    # 100 * shared >= percent * (a + b - shared)
    found = written(joined_in(met, "family", lambda sizes, size: -(-percent * (sizes + size) // (100 + percent))), "links")
    dropped(sets)
    return found


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], values: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Each run of equal keys with its rows, over the borders of batches."""
    rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in (*keys, *values)), strict=True))
    for key, run in itertools.groupby(rows, key=lambda r: r[: len(keys)]):
        yield key, [r[len(keys) :] for r in run]


def full_sets(docs: DataFrame, classes: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """node and set (its sorted hashes as bytes) of the asked classes, made anew from the text of their first document."""
    wanted = classes.join(asked.distinct(), "node").select("node", F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    texts = keyed.join(wanted, ["doc_id", "text_key"]).groupBy("node").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in slices(batches, "text"):
            found = [shingler.of(x).tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], ["node", "set"])

    return texts.mapInArrow(run, f"node {NODE}, set binary")


def confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) with 100 * shared >= percent * united; a class with very many partners is cut into parts."""
    asked = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node")))
    held = written(full_sets(docs, classes, asked, width), "sets")
    parts = pairs.groupBy("v").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = pairs.join(parts, "v").withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int"))
    right = held.join(parts, held["node"] == parts["v"]).select("v", F.col("set").alias("v_set"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = dealt.join(right, ["v", "part"]).join(held.select(F.col("node").alias("u"), F.col("set").alias("u_set")), "u").select("u", "v", "u_set", "v_set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column("u_set"), batch.column("v_set"), strict=True):
                x, y = np.frombuffer(a.as_py(), dtype=np.uint64), np.frombuffer(b.as_py(), dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(linked, pa.bool_()))

    found = written(met.mapInArrow(run, f"u {NODE}, v {NODE}"), "links")
    dropped(held)
    return found


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; links are sets with 100 * shared >= percent * united."""
    least = threshold(percent / 100)
    rows = written(signed(docs, width), "signatures")
    named = rows.where("n_shingles > 0 and doc_id is not null")
    classes = written(named.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("postings").alias("postings")), "classes")
    prefix = written(prefixes(classes, least), "prefixes")
    ties = written(alike(classes, pivot_pairs(prefix), percent, least), "ties")
    links = confirmed(docs, classes, ties, width, percent)
    labels = components(links)
    family = components(written(families(classes, prefix, labels, least), "families"))
    more = links_in(docs, classes, labels, family, width, percent)
    same_id = named.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("one")).where("u <> one").select("doc_id", "u")
    same_id = named.join(same_id, "doc_id").select("u", F.col("node").alias("v")).where("u <> v").distinct()
    joined = components(links.union(more).union(same_id))
    of = classes.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("group"), "first.doc_id")
    least_id = of.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    told = written(of.join(least_id, "group").select("node", "component_id"), "components")
    dropped(classes, prefix, ties, links, labels, family, more, joined)
    linked = named.join(told, "node").select("doc_id", "n_shingles", "component_id")
    empty = rows.where("n_shingles = 0 and doc_id is not null").select("doc_id", "n_shingles")
    other = linked.join(empty.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("own"))
    alone = empty.join(other, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("own", "doc_id").alias("component_id"))
    no_id = rows.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    result = linked.union(alone).union(no_id)
    found = written(result.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")), "groups")
    dropped(rows, told)
    return found


def first_of_groups(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of documents that are kept, one for each doc_id; rows without a doc_id stay."""
    kept = found.where("kept and doc_id is not null").select("doc_id").distinct()
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.length("text").alias("length"), F.xxhash64("text").alias("hash"))
    same = row.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    one = same.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("length"), "hash"))).where("place = 1")
    return one.select("row").union(row.where("doc_id is null").select("row")).select("row.*")


#: The same rows in DuckDB: all pairs that share a shingle.
NEAR_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda k: w[k : k + 2]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS met FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT u, v FROM shared JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * met >= 85 * (x.n + y.n - met)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, CASE WHEN l.u = r.b THEN l.v ELSE l.u END FROM reached r JOIN links l ON r.b = l.u OR r.b = l.v),
groups AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, g.component_id, d.doc_id = g.component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN groups g ON g.doc_id = d.doc_id
"""
