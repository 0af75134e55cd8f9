"""SentencePiece encoding and decoding by suffix-array matching, for BPE models with byte fallback.

The units of a batch (a run of spaces and what follows it, which no piece crosses) are concatenated and indexed by a suffix
array, built by prefix doubling up to the longest piece. Every piece is binary-searched for its range of occurrences; each
occurrence is an edge from its first to its last position. Edges are sorted by their end and relaxed in that order.

A BPE model has no additive score to relax by. What holds for it: the encoding of every prefix is unique, and an edge
extends the encoding of the prefix at its start exactly if its piece and that prefix's last piece, encoded alone, stay two
pieces. So relaxing an edge is this test of a pair, done for all edges at once along the two pieces' merge trees; the one
edge that passes gives each position its last piece, and walking back gives the same ids as the library's own encoder.

Defined results: null texts count as empty and have no ids; spaces are kept, so decoding gives the text back unless it
holds U+2581, which the model takes for a space; rows may repeat, extra columns stay. Memory is bounded by `SLICE` bytes of
text or the longest text, `BATCH` characters of units or the longest unit, and the units that a worker remembers.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tabsplit.llm.common import slices

SPACE = "▁"
SLICE, BATCH, REMEMBERED, LONGEST_REMEMBERED = 4_000_000, 800_000, 400_000, 48
NONE = np.int64(1) << 40


class PairTable:
    """Ranks of the pieces that two adjacent symbols make, by open addressing."""

    def __init__(self, pairs: dict[tuple[int, int], int], width: int):
        self.width = np.int64(width)
        self.bits = max(8, int(len(pairs) * 4 - 1).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, NONE, dtype=np.int64)
        keys = np.array([a * width + b for a, b in pairs], dtype=np.int64)
        ranks = np.array(list(pairs.values()), dtype=np.int64)
        slot = self.slot(keys)
        while len(keys):
            _, first = np.unique(slot, return_index=True)
            fits = np.zeros(len(keys), dtype=bool)
            fits[first] = True
            fits &= self.keys[slot] < 0
            self.keys[slot[fits]], self.ranks[slot[fits]] = keys[fits], ranks[fits]
            keys, ranks, slot = keys[~fits], ranks[~fits], (slot[~fits] + 1) & (len(self.keys) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.width + right
        slot = self.slot(keys)
        held = self.keys[slot]
        found = np.where(held == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[slot[open_]]
            same = held == keys[open_]
            found[open_[same]] = self.ranks[slot[open_[same]]]
            open_ = open_[~same & (held >= 0)]
        return found


class Model:
    """The pieces of a model file; symbols are piece ids, and above them single characters that are no piece."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        kinds = [sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k) for k in range(self.size)]
        self.text = [sp.id_to_piece(k) for k in range(self.size)]
        self.id = {self.text[k]: k for k in range(self.size) if not kinds[k]}
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        self.score = [sp.get_score(k) for k in range(self.size)]
        self.bytes = [b"" if kinds[k] else self.text[k].replace(SPACE, " ").encode() for k in range(self.size)]
        for b, k in enumerate(self.byte):
            self.bytes[k] = bytes([b])
        own = sorted(self.id.values(), key=lambda k: (-self.score[k], k))
        self.width = self.size + 0x110000
        self.rank = np.full(self.width, -1, dtype=np.int64)
        for place, k in enumerate(own):
            if len(self.text[k]) > 1:
                self.rank[k] = place
        self.left, self.right = np.zeros(self.size, dtype=np.int64), np.zeros(self.size, dtype=np.int64)
        self.reached, self.slow = np.ones(self.width, dtype=bool), np.zeros(self.width, dtype=bool)
        joined: dict[tuple[int, int], int] = {}
        for word, k in sorted(self.id.items(), key=lambda x: len(x[0])):
            if len(word) == 1:
                continue
            for cut in range(1, len(word)):
                a, b = self.symbol(word[:cut]), self.symbol(word[cut:])
                if a is not None and b is not None:
                    joined[a, b] = int(self.rank[k])
            made, last = self.merge(word)
            self.reached[k] = made == [k]
            if made == [k]:
                a, b = last
                self.left[k], self.right[k] = a, b
                self.slow[k] = self.slow[a] or self.slow[b] or max(self.rank[a], self.rank[b]) >= self.rank[k] or set(word) == {SPACE}
        self.pairs = PairTable(joined, self.width)
        self.slow_pairs: dict[tuple[int, int], bool] = {}
        words = sorted(self.id)
        self.longest = max(map(len, words))
        self.ids = np.array([self.id[w] for w in words], dtype=np.int64)
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.letters = np.zeros((len(words), self.longest), dtype=np.int64)
        for k, w in enumerate(words):
            self.letters[k, : len(w)] = [ord(c) for c in w]
        crossed = any(SPACE in w.lstrip(SPACE) for w in words)
        self.units = regex.compile("(?s).+" if crossed else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.known: dict[str, bytes] = {}

    def symbol(self, text: str) -> int | None:
        return self.id.get(text, self.size + ord(text) if len(text) == 1 else None)

    def letters_of(self, symbol: int) -> str:
        return self.text[symbol] if symbol < self.size else chr(symbol - self.size)

    def merge(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """The plain definition: join the adjacent pair with the best piece, the leftmost of equals. Also the last pair."""
        parts, last = list(text), None
        while len(parts) > 1:
            found = [(-self.score[k], i) for i in range(len(parts) - 1) if (k := self.id.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            i = min(found)[1]
            last = (self.symbol(parts[i]), self.symbol(parts[i + 1]))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.symbol(x) for x in parts], last

    def stay_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each two symbols, side by side, are encoded as those two."""
        good = self.reached[left] & self.reached[right]
        slow = good & (self.slow[left] | self.slow[right])
        for k in np.flatnonzero(slow):
            pair = (int(left[k]), int(right[k]))
            if pair not in self.slow_pairs:
                self.slow_pairs[pair] = self.merge(self.letters_of(pair[0]) + self.letters_of(pair[1]))[0] == list(pair)
            good[k] = self.slow_pairs[pair]
        at = np.flatnonzero(good & ~slow)
        x, y = left[at], right[at]
        over_x, over_y = np.full(len(at), NONE), np.full(len(at), NONE)
        while len(at):
            # x and y meet until one of them is merged away; before that the piece they make must not come first
            rank = self.pairs.rank(x, y)
            crossed = (rank < over_x) & (rank <= over_y)
            good[at[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry, over_x, over_y = at[go], x[go], y[go], rx[go], ry[go], over_x[go], over_y[go]
            down = rx > ry
            over_x, over_y = np.where(down, rx, over_x), np.where(down, over_y, ry)
            inner_x, inner_y = self.right[np.where(down, x, 0)], self.left[np.where(down, 0, y)]
            x, y = np.where(down, inner_x, x), np.where(down, y, inner_y)
        return good

    def suffixes(self, letters: np.ndarray) -> np.ndarray:
        """Starts in the order of their next `longest` letters, by prefix doubling."""
        _, rank = np.unique(letters, return_inverse=True)
        rank, step, n = rank.astype(np.int64) + 1, 1, len(letters)
        while step < self.longest and rank.max() < n:
            ahead = np.zeros(n, dtype=np.int64)
            ahead[:-step] = rank[step:]
            _, rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)
            rank, step = rank + 1, step * 2
        return np.argsort(rank, kind="stable")

    def ranges(self, letters: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each piece."""
        padded = np.concatenate([letters, np.full(self.longest, -1, dtype=letters.dtype)])
        inside = np.arange(self.longest) < self.lengths[:, None]

        def bound(upper: bool) -> np.ndarray:
            low, high = np.zeros(len(self.ids), dtype=np.int64), np.full(len(self.ids), len(order), dtype=np.int64)
            todo = np.arange(len(self.ids))
            while len(todo):
                middle = (low[todo] + high[todo]) // 2
                held = padded[order[middle][:, None] + np.arange(self.longest)]
                differ = (held != self.letters[todo]) & inside[todo]
                at = differ.argmax(axis=1)
                row = np.arange(len(todo))
                sign = np.where(differ[row, at], np.sign(held[row, at] - self.letters[todo, at]), 0)
                before = sign <= 0 if upper else sign < 0
                low[todo[before]], high[todo[~before]] = middle[before] + 1, middle[~before]
                todo = todo[low[todo] < high[todo]]
            return low

        return bound(False), bound(True)

    def match(self, units: list[str]) -> list[bytes]:
        """The ids of each non-empty unit, as little-endian 32-bit numbers."""
        letters = np.frombuffer("\0".join(units).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        sizes = np.array([len(u) for u in units], dtype=np.int64)
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        letters = letters.copy()
        letters[ends[:-1]] = -1
        order = self.suffixes(letters)
        low, high = self.ranges(letters, order)
        n = high - low
        piece = np.repeat(self.ids, n)
        begin = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        end = begin + np.repeat(self.lengths, n)
        single = np.zeros(len(letters) + 1, dtype=bool)
        single[begin[end == begin + 1]] = True
        bare = np.flatnonzero(~single[:-1] & (letters >= 0))
        begin, end, piece = np.concatenate([begin, bare]), np.concatenate([end, bare + 1]), np.concatenate([piece, self.size + letters[bare]])
        first = np.repeat(starts, sizes + 1)[: len(letters)]
        far = end - first[begin]
        by = np.argsort(far.astype(np.uint16) if far.max() < 1 << 16 else far, kind="stable")
        begin, end, piece, far = begin[by], end[by], piece[by], far[by]
        last, back = np.full(len(letters) + 1, -1, dtype=np.int64), np.zeros(len(letters) + 1, dtype=np.int64)
        bounds = np.searchsorted(far, np.arange(1, int(sizes.max()) + 2))
        for a, b in itertools.pairwise(bounds):
            s, e, p = begin[a:b], end[a:b], piece[a:b]
            opening = s == first[s]
            good = opening & self.reached[p]
            rest = np.flatnonzero(~opening)
            good[rest] = self.stay_apart(last[s[rest]], p[rest])
            last[e[good]], back[e[good]] = p[good], s[good]
        return self.walk(starts, ends, last, back)

    def walk(self, starts: np.ndarray, ends: np.ndarray, last: np.ndarray, back: np.ndarray) -> list[bytes]:
        unit, at, owners, symbols = np.arange(len(starts)), ends.copy(), [], []
        while len(unit):
            owners.append(unit)
            symbols.append(last[at])
            at = back[at]
            open_ = at > starts[unit]
            unit, at = unit[open_], at[open_]
        counts = np.bincount(np.concatenate(owners), minlength=len(starts))
        stops = np.cumsum(counts)
        symbol = np.empty(int(stops[-1]), dtype=np.int64)
        for step, (own, found) in enumerate(zip(owners, symbols, strict=True)):
            symbol[stops[own] - 1 - step] = found
        bare = np.flatnonzero(symbol >= self.size)
        if len(bare):
            fall = [self.byte[list(chr(c).encode())] for c in (symbol[bare] - self.size).tolist()]
            sizes = np.ones(len(symbol), dtype=np.int64)
            sizes[bare] = [len(x) for x in fall]
            begin = np.cumsum(sizes) - sizes
            stops = np.concatenate([begin, [sizes.sum()]])[stops]
            symbol = np.repeat(symbol, sizes)
            symbol[np.concatenate([np.arange(b, b + len(x)) for b, x in zip(begin[bare].tolist(), fall, strict=True)])] = np.concatenate(fall)
        data = symbol.astype("<i4").tobytes()
        return [data[a:b] for a, b in itertools.pairwise([0, *(stops * 4).tolist()])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        lists = [self.units.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        fresh = set(itertools.chain.from_iterable(lists)).difference(self.known)
        own: dict[str, bytes] = {}
        held, n = [], 0
        for unit in sorted(fresh):
            held.append(unit)
            n += len(unit)
            if n >= BATCH:
                own.update(zip(held, self.match(held), strict=True))
                held, n = [], 0
        if held:
            own.update(zip(held, self.match(held), strict=True))
        if len(self.known) < REMEMBERED:
            self.known.update((u, x) for u, x in own.items() if len(u) <= LONGEST_REMEMBERED)
        of = self.known.get
        return [b"".join([of(u) or own[u] for u in units]) for units in lists]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def appended(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, name])


def listed(found: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), dtype="<i4")))


def fields_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def encode(docs: DataFrame, path: str, text_column: str = "text", ids_column: str = "ids") -> DataFrame:
    """The rows with the ids of their texts in a new column; `path` must be readable on executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in slices(batches, text_column, SLICE):
            yield appended(batch, ids_column, listed(own.encode([x or "" for x in batch.column(text_column).to_pylist()])))

    return docs.mapInArrow(run, f"{fields_of(docs)}, `{ids_column}` array<int>")


def round_trip(docs: DataFrame, path: str, text_column: str = "text", ids_column: str = "ids", decoded_column: str = "decoded") -> DataFrame:
    """The rows with the ids of their texts and the texts of those ids, in one pass of one Python worker a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in slices(batches, text_column, SLICE):
            found = own.encode([x or "" for x in batch.column(text_column).to_pylist()])
            decoded = pa.array([own.decode(np.frombuffer(x, dtype="<i4").tolist()) for x in found], pa.string())
            yield appended(appended(batch, ids_column, listed(found)), decoded_column, decoded)

    return docs.mapInArrow(run, f"{fields_of(docs)}, `{ids_column}` array<int>, `{decoded_column}` string")


def decode(encoded: DataFrame, path: str, ids_column: str = "ids", text_column: str = "decoded") -> DataFrame:
    """The rows with the texts of their ids in a new column; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            ids = batch.column(ids_column)
            flat, offsets = ids.values.to_numpy(zero_copy_only=False).tolist(), ids.offsets.to_numpy().tolist()
            yield appended(batch, text_column, pa.array([own.decode(flat[a:b]) for a, b in itertools.pairwise(offsets)], pa.string()))

    return encoded.mapInArrow(run, f"{fields_of(encoded)}, `{text_column}` string")
