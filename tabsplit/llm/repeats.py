"""Suffix-array deduplication: remove each byte covered by a string of `LENGTH` bytes that also starts anywhere else.

Suffixes are taken at anchors: of each window of LENGTH bytes the k-gram with the least hash. Equal windows have their anchor
at the same place, so a repeated window is always seen at two anchors with equal k-grams and equal bytes around them.

1. Anchors of all texts are keyed by the hash of their k-gram and of their whole context (all windows that may have chosen
   them). Anchors whose k-gram is unique end here. Equal contexts prove all of their windows repeated. K-grams that one in
   `CROWDED` anchors shares are counted by aggregates with partial sums and their anchors dealt into slices, so that no task
   holds all of them; windows over the k-gram count the others.
2. For k-grams with different contexts, one suffix for each context is sorted: tasks write sorted, front-coded runs, cut by
   range of the leading hash, and each range's runs are merged by a loser tree that carries common-prefix lengths and never
   compares a known prefix again. Neighbours that share the k-gram are compared to the left and right of it, which gives the
   windows that they share.
3. The byte ranges meet their texts, which are cut.

Suffixes are ordered by the hash of their first K bytes and then by their bytes, so that ranges are even without a sample.

Defined results: null and empty texts have 0 bytes and nothing removed; texts under LENGTH bytes are never touched; matches
never cross documents; rows that are repeated in full are documents of their own, so that each has the other as its copy.
Extra columns are ignored, doc_id may be null, and any row may hold most of the bytes; memory follows the longest text.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsplit.llm.common import slices, text_of
from tabsplit.llm.neardup import grouped, mixed
from tabsplit.shared import dropped, written

LENGTH, K = 200, 32
#: Positions of a k-gram in a window; bytes before an anchor that a window holding it can begin at.
PLACES, BEFORE = LENGTH - K + 1, LENGTH - K
#: Bytes of a batch of texts, suffixes of a range, ranges at least, suffixes that are compared pair by pair, and offsets that are hashed together.
SLICE, RANGE_ROWS, RANGES, PAIRWISE, BLOCK = 2_000_000, 20_000, 64, 6, 32
#: A key is crowded if it holds at least one in so many rows; so there are at most so many crowded keys, whose list is part of the plan.
CROWDED = 1000
#: Anchors of a slice of a crowded k-gram, about.
SLICED = 10_000
ANCHORS = "key_a long, key_b long, pos long, gram long, context long"
ENTRY = struct.Struct("<HHHqqq")


@functools.lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64, and a value for each byte."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n + 1, base, dtype=np.uint64), np.full(n + 1, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    np.cumprod(up, out=up)
    np.cumprod(down, out=down)
    return up, down, np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)


def summed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which any substring's hash follows, and the factors that make it independent of its place."""
    up, down, value = powers(1 << max(21, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(value[data] * up[: len(data)], out=sums[1:])
    return sums, down


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts data[starts[k]:ends[k]] the anchors: text, position in it, hash of the k-gram and of the context."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < LENGTH:
        return none, none, none, none
    sums, down = summed(data)
    grams = mixed((sums[K:] - sums[:-K]) * down[: len(data) - K + 1])
    bits = np.uint64(int(len(grams)).bit_length())
    ranked = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-(len(ranked) + PLACES) // PLACES) * PLACES, np.iinfo(np.uint64).max)
    padded[: len(ranked)] = ranked
    rows = padded.reshape(-1, PLACES)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = len(data) - LENGTH + 1
    least = (np.minimum(behind[:windows], ahead[PLACES - 1 : PLACES - 1 + windows]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    least = least[np.cumsum(inside[:-1])[:windows] > 0]
    at = least[np.concatenate([[True], np.diff(least) != 0])] if len(least) else least
    text = np.searchsorted(starts, at, side="right") - 1
    low, high = np.maximum(starts[text], at - BEFORE), np.minimum(ends[text], at + LENGTH)
    context = (sums[high] - sums[low]) * down[low]
    context = mixed(context + mixed((at - low).astype(np.uint64) * np.uint64(4099) + (high - at).astype(np.uint64)))
    return text, at - starts[text], grams[at].view(np.int64), context.view(np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with a key of 128 bits of both; rows that are equal in both share it."""
    text = text_of()
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("key_a"), F.xxhash64(text, "doc_id", F.lit(1)).alias("key_b"))


def anchored(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            parts = [x.encode() for x in batch.column("text").to_pylist()]
            sizes = np.array([len(x) for x in parts], dtype=np.int64)
            ends = np.cumsum(sizes)
            text, pos, gram, context = anchors(np.frombuffer(b"".join(parts), dtype=np.uint8), ends - sizes, ends)
            if len(text):
                of = pa.array(text)
                columns = [batch.column("key_a").take(of), batch.column("key_b").take(of), pa.array(pos), pa.array(gram), pa.array(context)]
                yield pa.RecordBatch.from_arrays(columns, ["key_a", "key_b", "pos", "gram", "context"])

    return texts.select("key_a", "key_b", "text").mapInArrow(run, ANCHORS)


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of two strings that agree in the first `start` bytes."""
    n = min(len(a), len(b))
    x, y = a[start:n], b[start:n]
    if x == y:
        return n
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return start + len(x) - (differ.bit_length() + 7) // 8


class LoserTree:
    """Merges sorted runs of (prefix shared with the entry before, suffix, payload) into one such run.

    Every entry carries what it shares with the last winner. Of two, the one that shares more comes first; only if both
    share equally much are bytes compared, from there on.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, tuple]]]):
        self.runs = runs
        self.width = 1 << max(0, len(runs) - 1).bit_length()
        self.heads: list = [next(r, None) for r in runs] + [None] * (self.width - len(runs))
        self.heads = [h and (0, h[1], h[2]) for h in self.heads]
        self.tree = [-1] * self.width
        self.winner = self.build(1)

    def play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser then carries what it shares with the winner."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if x[0] != y[0]:
            return (a, b) if x[0] > y[0] else (b, a)
        n = common(x[1], y[1], x[0])
        first = x[1][n:] <= y[1][n:]
        win, lose = (a, b) if first else (b, a)
        held = self.heads[lose]
        self.heads[lose] = (n, held[1], held[2])
        return win, lose

    def build(self, node: int) -> int:
        if node >= self.width:
            return node - self.width
        win, lose = self.play(self.build(2 * node), self.build(2 * node + 1))
        self.tree[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple[int, bytes, tuple]]:
        while (head := self.heads[self.winner]) is not None:
            yield head
            at = self.winner
            self.heads[at] = next(self.runs[at], None) if at < len(self.runs) else None
            node = (at + self.width) // 2
            while node:
                at, self.tree[node] = self.play(at, self.tree[node])
                node //= 2
            self.winner = at


def front_coded(entries: list[tuple[bytes, bytes, int, int, int]]) -> bytes:
    """A run of sorted (suffix, bytes before it, key_a, key_b, pos): each suffix without what it shares with the one before."""
    parts, last = [], b""
    for suffix, before, key_a, key_b, pos in entries:
        n = common(suffix, last)
        parts += (ENTRY.pack(n, len(suffix) - n, len(before), key_a, key_b, pos), suffix[n:], before)
        last = suffix
    return b"".join(parts)


def decoded(run: bytes) -> Iterator[tuple[int, bytes, tuple]]:
    at, last = 0, b""
    while at < len(run):
        n, more, before, key_a, key_b, pos = ENTRY.unpack_from(run, at)
        at += ENTRY.size
        last = last[:n] + run[at : at + more]
        at += more
        yield n, last, (run[at : at + before], key_a, key_b, pos)
        at += before


def shared_windows(group: list[tuple[bytes, bytes]]) -> list[list[tuple[int, int]]]:
    """For suffixes with the bytes before them, which agree in the first K: for each the ranges of offsets, from the begin
    of a window to the anchor, of windows that another one has too."""
    if len(group) <= PAIRWISE:
        found: list[list[tuple[int, int]]] = [[] for _ in group]
        for a in range(len(group)):
            for b in range(a):
                right = common(group[a][0], group[b][0], K)
                left = common(group[a][1][::-1], group[b][1][::-1])
                if left >= LENGTH - right:
                    for k in (a, b):
                        found[k].append((LENGTH - right, left))
        return found
    m = np.zeros((len(group), BEFORE + LENGTH), dtype=np.uint8)
    left = np.array([len(b) for _, b in group])
    right = np.array([len(s) for s, _ in group])
    for k, (suffix, before) in enumerate(group):
        m[k, BEFORE - len(before) : BEFORE] = np.frombuffer(before, dtype=np.uint8)
        m[k, BEFORE : BEFORE + len(suffix)] = np.frombuffer(suffix, dtype=np.uint8)
    up, down, value = powers(1 << 21)
    good = np.zeros((len(group), BEFORE + 1), dtype=bool)
    for low in range(0, BEFORE + 1, BLOCK):
        # hashes of a block of offsets at a time, so that a large group takes few bytes a suffix
        first = max(0, BEFORE - low - BLOCK + 1)
        part = m[:, first : BEFORE - low + LENGTH]
        hashes = np.empty((min(BLOCK, BEFORE + 1 - low), len(group)), dtype=np.uint64)
        for rows in np.array_split(np.arange(len(group)), -(-len(group) // 4096)):
            sums = np.zeros((len(rows), part.shape[1] + 1), dtype=np.uint64)
            np.cumsum(value[part[rows]] * up[: part.shape[1]], axis=1, out=sums[:, 1:])
            for k in range(len(hashes)):
                begin = BEFORE - low - k - first
                hashes[k, rows] = (sums[:, begin + LENGTH] - sums[:, begin]) * down[begin]
        for k, found in enumerate(hashes):
            rows = np.flatnonzero((left >= low + k) & (right >= LENGTH - low - k))
            _, place, n = np.unique(found[rows], return_inverse=True, return_counts=True)
            good[rows, low + k] = n[place] > 1
    edges = np.diff(np.pad(good.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    return [list(zip(np.flatnonzero(e == 1).tolist(), (np.flatnonzero(e == -1) - 1).tolist(), strict=True)) for e in edges]


def suffix_runs(texts: DataFrame, wanted: DataFrame, ranges: int) -> DataFrame:
    """Sorted, front-coded runs (range, run) of the wanted anchors (key_a, key_b, pos, gram)."""
    listed = wanted.groupBy("key_a", "key_b").agg(F.collect_set(F.struct("pos", "gram")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 * SLICE):
            cut: dict[int, list] = {}
            for text, key_a, key_b, places in zip(*(batch.column(c).to_pylist() for c in ("text", "key_a", "key_b", "wanted")), strict=True):
                data = text.encode()
                for x in places:
                    pos, gram = x["pos"], x["gram"] & (1 << 64) - 1
                    suffix = gram.to_bytes(8, "big") + data[pos : pos + LENGTH]
                    cut.setdefault(gram * ranges >> 64, []).append((suffix, data[max(0, pos - BEFORE) : pos], key_a, key_b, pos))
            if cut:
                yield pa.RecordBatch.from_arrays([pa.array(list(cut), pa.int32()), pa.array([front_coded(sorted(x)) for x in cut.values()], pa.binary())], ["range", "run"])

    return texts.select("key_a", "key_b", "text").join(listed, ["key_a", "key_b"]).mapInArrow(run, "range int, run binary")


def merged(runs: DataFrame, ranges: int) -> DataFrame:
    """Byte ranges (key_a, key_b, start, end) of windows that suffixes with equal k-grams share."""

    def resolved(group: list[tuple[bytes, tuple]]) -> Iterator[tuple]:
        for (_, (_, key_a, key_b, pos)), found in zip(group, shared_windows([(s[8:], p[0]) for s, p in group]), strict=True):
            for low, high in found:
                yield key_a, key_b, pos - high, pos - low + LENGTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, ["range"], ["run"]):
            group: list = []
            out: list[tuple] = []
            for shared, suffix, payload in LoserTree([decoded(r[0]) for r in rows]):
                if shared < 8 + K and group:
                    if len(group) > 1:
                        out.extend(resolved(group))
                    group = []
                group.append((suffix, payload))
            if len(group) > 1:
                out.extend(resolved(group))
            for k in range(0, len(out), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out[k : k + 100_000], strict=True)], ["key_a", "key_b", "start", "end"])

    return runs.repartitionById(ranges, F.col("range")).sortWithinPartitions("range").mapInArrow(run, "key_a long, key_b long, start long, end long")


def by_windows(found: DataFrame) -> DataFrame:
    """Anchors of k-grams that are not alone: copies and place among equal contexts, and whether a context of the k-gram is single."""
    gram, same = Window.partitionBy("gram"), Window.partitionBy("gram", "context")
    marked = found.withColumn("grams", F.count("*").over(gram)).where("grams > 1")
    marked = marked.withColumn("copies", F.count("*").over(same)).withColumn("place", F.row_number().over(same.orderBy("key_a", "key_b", "pos")))
    return marked.withColumn("open", F.min("copies").over(gram) == 1)


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """Byte ranges (key_a, key_b, start, end), overlapping, of all repeated windows; `end` may lie beyond a text's end."""
    found = written(anchored(texts), "anchors")
    rows = found.count()
    # k-grams that many rows share, at most CROWDED of them; the others are counted by windows over the k-gram
    crowded = found.groupBy("gram").count().where((F.col("count") * CROWDED >= F.lit(rows)) & (F.col("count") > 1)).collect()
    is_hot = F.col("gram").isin([r["gram"] for r in crowded])
    marked = written(by_windows(found.where(~is_hot)), "marked")
    whole, wanted = marked.where("copies > 1"), marked.where("open and place = 1").select("key_a", "key_b", "pos", "gram")
    # crowded ones are counted by context with partial sums
    hot = found.where(is_hot)
    contexts = hot.groupBy("gram", "context").agg(F.count("*").alias("copies"), F.min(F.struct("key_a", "key_b", "pos")).alias("first"))
    contexts = written(contexts, "contexts")
    opened = contexts.where("copies = 1").select("gram").distinct().collect()
    wanted = wanted.union(contexts.where(F.col("gram").isin([r["gram"] for r in opened])).select("first.*", "gram"))
    # anchors of a context are dealt into slices of bounded size; one with another in its slice is repeated, and only those that are
    # alone there, at most one a slice, meet the counted contexts
    slices_ = -(-max((r["count"] for r in crowded), default=1) // SLICED)
    sliced = hot.withColumn("slice", F.pmod(F.xxhash64("key_a", "key_b", "pos"), F.lit(slices_)))
    sliced = written(sliced.withColumn("here", F.count("*").over(Window.partitionBy("gram", "context", "slice"))), "sliced")
    alone = sliced.where("here = 1").join(contexts.where("copies > 1").select("gram", "context"), ["gram", "context"], "left_semi")
    repeated = sliced.where("here > 1").select("key_a", "key_b", "pos").union(alone.select("key_a", "key_b", "pos"))
    dropped(found)
    placed = ["key_a", "key_b", F.greatest(F.col("pos") - BEFORE, F.lit(0)).alias("start"), (F.col("pos") + LENGTH).alias("end")]
    whole = whole.select(placed).union(repeated.select(placed))
    # as many ranges as the suffixes ask for, each in a task of its own
    ranges = max(RANGES, -(-wanted.count() // RANGE_ROWS))
    return whole.union(merged(suffix_runs(texts, wanted, ranges), ranges))


def without_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; with_text adds the bytes that are kept."""
    texts = keyed(docs)
    ranges = repeated_ranges(texts).groupBy("key_a", "key_b").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    joined = texts.join(ranges, ["key_a", "key_b"], "left").select("doc_id", "text", "ranges")

    def cut(text: str, ranges: list | None) -> tuple[int, int, int, bytes]:
        data, spans = text.encode(), []
        for start, end in sorted((x["start"], min(x["end"], len(data))) for x in ranges or ()):
            if end - start >= LENGTH:
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([start, end])
        kept, at = [], 0
        for start, end in spans:
            kept.append(data[at:start])
            at = end
        kept = b"".join([*kept, data[at:]])
        return len(data), len(data) - len(kept), len(spans), kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [cut(*x) for x in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True)]
            n, removed, spans, kept = zip(*found, strict=True)
            columns = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_text, names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    kind = dict(docs.dtypes)["doc_id"]
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


#: The same rows in DuckDB: all windows of all texts, as hexadecimal digits.
REPEATS_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
chunks AS (SELECT r, n, c, substring(h, 512 * c + 1, {512 + 2 * LENGTH}) AS part FROM (SELECT *, unnest(range(n // 256 + 1)) AS c FROM texts WHERE n >= {LENGTH})),
windows AS (SELECT r, 256 * c + k AS k, md5(substring(part, 2 * k + 1, {2 * LENGTH})) AS w FROM (SELECT *, unnest(range(least(256, n - {LENGTH - 1} - 256 * c))) AS k FROM chunks)),
repeated AS (SELECT r, k FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)),
marked AS (SELECT r, k, coalesce(k - lag(k) OVER (PARTITION BY r ORDER BY k) > {LENGTH}, true)::INT AS new FROM repeated),
runs AS (SELECT r, min(k) AS a, max(k) + {LENGTH} AS b FROM (SELECT r, k, sum(new) OVER (PARTITION BY r ORDER BY k) AS run FROM marked) GROUP BY r, run),
pieces AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS last FROM runs),
cut AS (SELECT r, sum(b - a)::BIGINT AS removed, count(*) AS spans, max(b) AS rest, string_agg(h[2 * last + 1 : 2 * a], '' ORDER BY a) AS kept FROM pieces JOIN texts USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || h[2 * coalesce(rest, 0) + 1 :])) AS kept_sha256
FROM texts LEFT JOIN cut USING (r)
"""
