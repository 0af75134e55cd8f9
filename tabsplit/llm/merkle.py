"""Merkle manifest of a dataset: a leaf a row, trees of runs of three by source, and a witness for every leaf.

Leaves are appended in order to a tree that is open at its right edge. A node that joins an open run takes the digests
before it as the left part of its witness, and extends the right part of those that wait there: a subtree's witness is
complete when its run is, and the leaves below share it by their paths, so an append costs the same however many leaves there are.

On a cluster a source is cut into aligned blocks of 3^7 leaves. Whole blocks are whole subtrees, so their roots are
appended to a tree of the next tier in the same way, tier by tier until a source has one root, and the roots of sources
to a last tree. Witnesses then come down: a tier's nodes add their block's witness to their own. One block's leaves meet in
a task, never a source's. Places come from range partitions and their counts, not from one sorted task.

Defined results: a null cell is the byte `-`; null and repeated ids are leaves as others are, in the order of id (null
first), then of the leaf; a null source is a tree of its own, the first; an empty table gives no rows; a source of one row
has its leaf as subroot; extra columns are ignored unless they are named in `carry`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsplit.shared import dropped, written

#: Nodes of a run, and levels of a block: its leaves are 3^7.
ARITY, LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WITNESS = "array<struct<left: string, right: string>>"
WITNESS_ARROW = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def cell(value: Column) -> Column:
    """The bytes of a cell: its UTF-8 length, a colon and itself, or a dash."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(**changed: Column) -> Column:
    """The leaf of a row of documents, with some columns replaced."""
    return F.sha2(F.concat(*[cell(changed.get(name, F.col(name))) for name in FIELDS]), 256)


class OpenTree:
    """A tree of runs that only grows at its right edge, in lists by node number; leaves are the nodes of `leaves`."""

    def __init__(self) -> None:
        self.digest: list[str] = []
        self.parent: list[int] = []
        self.left: list[str] = []
        self.right: list[str] = []
        self.runs: list[list[int]] = [[]]
        self.counts = [0]
        self.leaves: list[int] = []

    def append(self, digest: str) -> None:
        self.leaves.append(self.join(0, digest))

    def join(self, level: int, digest: str) -> int:
        """Put a complete subtree into the open run of its level: its witness is what stands there, and theirs grows by it."""
        node, run = len(self.digest), self.runs[level]
        self.digest.append(digest)
        self.parent.append(-1)
        self.left.append("".join(self.digest[x] for x in run))
        self.right.append("")
        for waiting in run:
            self.right[waiting] += digest
        run.append(node)
        self.counts[level] += 1
        if len(run) == ARITY:
            self.complete(level)
        return node

    def complete(self, level: int) -> None:
        run = self.runs[level]
        self.runs[level] = []
        if level + 1 == len(self.runs):
            self.runs.append([])
            self.counts.append(0)
        up = self.join(level + 1, hashlib.sha256("".join(self.digest[x] for x in run).encode()).hexdigest())
        for x in run:
            self.parent[x] = up

    def close(self, levels: int | None = None) -> str:
        """End the runs that are still open: up to `levels`, else until one node is left. The root."""
        level = 0
        while level < levels if levels is not None else self.counts[level] > 1:
            if self.runs[level]:
                self.complete(level)
            level += 1
        return self.digest[self.runs[level][0]]

    def witness(self, leaf: int) -> list[tuple[str, str]]:
        """What stands to the left and to the right of a leaf's subtree, level by level."""
        found, node = [], self.leaves[leaf]
        while self.parent[node] >= 0:
            found.append((self.left[node], self.right[node]))
            node = self.parent[node]
        return found


def grown(table: pa.Table, levels: int) -> tuple[pa.Table, OpenTree, str]:
    """A block's nodes in order, their tree and its root; a source's only block ends at its root, others at their level."""
    table = table.sort_by("place")
    tree = OpenTree()
    for digest in table.column("digest").to_pylist():
        tree.append(digest)
    return table, tree, tree.close(None if table.column("n")[0].as_py() <= ARITY**levels else levels)


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Nodes with `place`, their number within `tree` in the order of columns, and n, the nodes of the tree; written.

    `order` must tell any two rows apart that must not be swapped, and lets no equal rows be many: range partitions are cut by it.
    """
    spread = nodes.repartitionByRange("tree", *[F.col(c).asc_nulls_first() for c in order])
    dealt = spread.sortWithinPartitions("tree", *[F.col(c).asc_nulls_first() for c in order])
    number = F.monotonically_increasing_id()
    dealt = written(dealt.withColumns({"_part": F.shiftright(number, 33).cast("int"), "_at": number.bitwiseAND((1 << 33) - 1)}), "dealt")
    # one row for each part of a tree: few for each tree, however many rows it has
    held = dealt.groupBy("tree", "_part").agg(F.min("_at").alias("_from"), F.count("*").alias("_rows"))
    parts = Window.partitionBy("tree").orderBy("_part")
    before = F.coalesce(F.sum("_rows").over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.withColumns({"_before": before, "n": F.sum("_rows").over(Window.partitionBy("tree"))}).drop("_rows")
    found = written(dealt.join(held, ["tree", "_part"]).withColumn("place", F.col("_at") - F.col("_from") + F.col("_before")).drop("_part", "_at", "_from", "_before"), "placed")
    dropped(dealt)
    return found


def in_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("place") / ARITY**levels).cast("long"))


def block_roots(nodes: DataFrame, levels: int) -> DataFrame:
    """The next tier: a node for every block, its root, numbered by block."""

    def run(table: pa.Table) -> pa.Table:
        table, _, root = grown(table, levels)
        n = -(-table.column("n")[0].as_py() // ARITY**levels)
        return pa.table({"tree": [table.column("tree")[0].as_py()], "place": [table.column("block")[0].as_py()], "n": [n], "digest": [root]})

    return in_blocks(nodes.select("tree", "place", "n", "digest"), levels).groupBy("tree", "block").applyInArrow(run, "tree string, place long, n long, digest string")


def climbed(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Tiers of nodes from the leaves up; the last has one node a tree, its root. Each has a block's share of the one before."""
    tiers = [nodes]
    while (tiers[-1].agg(F.max("n")).first()[0] or 0) > 1:
        tiers.append(written(block_roots(tiers[-1], levels), "tier"))
    return tiers


def witnessed(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """Nodes with the witness up to the root, of `above`: the next tier (tree, place, witness, subroot, root)."""
    kept = [f.name for f in nodes.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)

    def run(table: pa.Table, upper: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table.select(kept).append_column("witness", pa.array([], WITNESS_ARROW)).append_column("subroot", pa.array([], pa.string())).append_column("root", pa.array([], pa.string()))
        table, tree, _ = grown(table, levels)
        rest = [(x["left"], x["right"]) for x in upper.column("witness")[0].as_py()]
        paths = [tree.witness(k) + rest for k in range(table.num_rows)]
        flat = pa.StructArray.from_arrays([pa.array([x[i] for path in paths for x in path], pa.string()) for i in (0, 1)], ["left", "right"])
        offsets = np.concatenate([[0], np.cumsum([len(path) for path in paths])]).astype(np.int32)
        out = table.select(kept).append_column("witness", pa.ListArray.from_arrays(pa.array(offsets), flat))
        for name in ("subroot", "root"):
            out = out.append_column(name, pa.array([upper.column(name)[0].as_py()] * table.num_rows, pa.string()))
        return out

    lower = in_blocks(nodes, levels).groupBy("tree", "block")
    upper = above.select("tree", F.col("place").alias("block"), "witness", "subroot", "root").groupBy("tree", "block")
    return lower.cogroup(upper).applyInArrow(run, f"{schema}, witness {WITNESS}, subroot string, root string")


def handed_down(tiers: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """The lowest tier's nodes with their whole witness; `above` has one row a tree, at place 0."""
    for nodes in tiers[-2:0:-1]:
        above = written(witnessed(nodes, above, levels), "witness")
    return witnessed(tiers[0], above, levels) if len(tiers) > 1 else tiers[0].join(above.drop("place"), "tree")


def manifest(docs: DataFrame, carry: tuple[str, ...] = (), levels: int = LEVELS) -> DataFrame:
    """doc_id, source, place, leaf, witness, subroot, root and the carried columns of every row of documents.

    `witness` lists, from the leaf's run to the run of its source's subroot, the digests to the left and to the right.
    """
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    read = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of().alias("digest"), *carry)
    leaves = written(read.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    nodes = placed(leaves, ["doc_id", "digest", "_row"])
    dropped(leaves)
    tiers = climbed(nodes.drop("_row"), levels)
    subroots = tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    top = climbed(placed(subroots, ["source"]), levels)
    none = F.array().cast(WITNESS)
    root = top[-1].select("tree", F.lit(0).cast("long").alias("place"), none.alias("witness"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    sources = handed_down(top, root, levels).select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("place"), "witness", F.col("digest").alias("subroot"), "root")
    found = handed_down(tiers, written(sources, "sources"), levels)
    source = F.when(F.col("tree") != "", F.substring("tree", 2, 2**31 - 1))
    return found.select("doc_id", source.alias("source"), "place", F.col("digest").alias("leaf"), "witness", "subroot", "root", *carry)


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and a witness give."""
    return F.aggregate(witness, leaf, lambda node, w: F.sha2(F.concat(w["left"], node, w["right"]), 256))


def proof_digest(witness: Column) -> Column:
    """One digest of all siblings of a witness, in order."""
    return F.sha2(F.array_join(F.transform(witness, lambda w: F.concat(w["left"], w["right"])), ""), 256)


def verified(manifested: DataFrame, leaf: str = "leaf") -> DataFrame:
    """manifested with folded_root and verified: whether a leaf column, with the witnesses, still gives the root."""
    told = manifested.withColumn("folded_root", folded(F.col(leaf), F.col("witness")))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_text() -> Column:
    """The text without its line feeds where the checksum of the id is even; rows without an id stay as they are."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    return F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))


def manifest_sql(levels: int = 24) -> str:
    """DuckDB's form of the report: all levels of all trees, written out up to a number of levels."""
    cells = ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in FIELDS[:-1])
    text = "CASE WHEN {t} IS NULL THEN '-' ELSE strlen({t}) || ':' || {t} END"
    steps = [f"""crcs AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i::BIGINT)) AS t),
ids AS (
  SELECT doc_id, 1 - list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT) % 2 AS odd
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crcs),
hashed AS (
  SELECT d.doc_id, d.source, sha256(concat({cells}, {text.format(t="text")})) AS leaf,
    sha256(concat({cells}, {text.format(t="told")})) AS bent
  FROM (SELECT documents.*, CASE WHEN odd = 0 THEN replace(text, chr(10), '') ELSE text END AS told
        FROM documents LEFT JOIN ids ON documents.doc_id = ids.doc_id) d),
leaves AS (
  SELECT row_number() OVER () AS id, *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY source) AS n FROM hashed),
p0 AS (SELECT id, coalesce('=' || source, '') AS tree, place, leaf AS own, '' AS proof, bent AS fold FROM leaves),
n0 AS (SELECT tree, place, own AS digest FROM p0)"""]

    def level(k: int, nodes: str, paths: str) -> str:
        return f"""c{k} AS (SELECT tree, count(*) AS n FROM {nodes} GROUP BY tree),
r{k} AS (SELECT tree, place // 3 AS run, list(digest ORDER BY place) AS digests FROM {nodes} GROUP BY tree, run),
n{k + 1} AS (
  SELECT tree, run AS place, CASE WHEN n > 1 THEN sha256(array_to_string(digests, '')) ELSE digests[1] END AS digest FROM r{k} JOIN c{k} USING (tree)),
p{k + 1} AS (
  SELECT id, tree, p.place // 3 AS place, n{k + 1}.digest AS own,
    CASE WHEN n > 1 THEN proof || array_to_string(digests[1:p.place % 3], '') || array_to_string(digests[p.place % 3 + 2:], '') ELSE proof END AS proof,
    CASE WHEN n > 1 THEN sha256(array_to_string(digests[1:p.place % 3], '') || fold || array_to_string(digests[p.place % 3 + 2:], '')) ELSE fold END AS fold
  FROM {paths} p JOIN r{k} USING (tree) JOIN c{k} USING (tree) JOIN n{k + 1} USING (tree)
  WHERE run = p.place // 3 AND n{k + 1}.place = run)"""

    steps += [level(k, f"n{k}", f"p{k}") for k in range(levels)]
    steps.append(f"""s AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS place, digest, tree AS source FROM n{levels}),
ps AS (SELECT id, '' AS tree, s.place, s.digest AS own, proof, fold FROM p{levels} p JOIN s ON s.source = p.tree)""")
    steps += [level(k, "s" if k == levels + 1 else f"n{k}", "ps" if k == levels + 1 else f"p{k}") for k in range(levels + 1, 2 * levels)]
    return f"""WITH {(", " + chr(10)).join(steps)}
SELECT doc_id, leaf, sub.own AS subroot, top.own AS root, sha256(top.proof) AS proof_sha256, top.fold AS folded_root, top.fold = top.own AS verified
FROM leaves JOIN p{levels} sub USING (id) JOIN p{2 * levels} top USING (id)"""
