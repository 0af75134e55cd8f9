"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Pre-tokens of a batch are held as one flat array of symbols with sequence offsets. Each round looks up the rank of
every adjacent pair, takes the lowest rank of each sequence and merges that pair everywhere in its sequence at once.
A sequence without a ranked pair is finished; its surviving symbols are its tokens.

All occurrences of a pair may merge together because a merge never makes a pair of a lower rank than its own.

Defined results: a null text counts as empty (0 bytes, 0 tokens). A special token's string inside a text is one token,
as the library does by default. Rows are independent: repeated rows repeat their result, extra columns are ignored,
an empty table gives an empty table. Memory is bounded by `SLICE` bytes of text or the longest single text.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsplit.llm.common import slices

SLICE = 2_000_000
#: Pre-tokens whose counts a worker remembers, and the longest that it does.
REMEMBERED, LONGEST_REMEMBERED = 400_000, 48
NO_RANK = np.int64(1) << 40
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = (b for b in range(256) if b not in set(kept))
    letters = {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(moved)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Byte symbols, ranked pairs and special tokens of a tokenizers JSON file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        ids = told["model"]["vocab"]
        self.of_byte = np.array([ids[x] for x in byte_letters()], dtype=np.int64)
        self.size = np.int64(max(ids.values()) + 1)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in told["model"]["merges"]]
        keys = np.array([ids[a] * int(self.size) + ids[b] for a, b in pairs], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.pattern = regex.compile(pattern)
        special = sorted((x["content"] for x in told.get("added_tokens", ())), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def surviving(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty byte sequence when no ranked pair remains."""
        lengths = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
        symbols = self.of_byte[np.frombuffer(b"".join(sequences), dtype=np.uint8)]
        counts, owner = lengths.copy(), np.arange(len(sequences))
        while len(symbols):
            seq = np.repeat(np.arange(len(lengths)), lengths)
            rank = np.full(len(symbols), NO_RANK)
            inside = np.flatnonzero(seq[:-1] == seq[1:])
            rank[inside] = self.rank(symbols[inside], symbols[inside + 1])
            starts = np.cumsum(lengths) - lengths
            lowest = np.minimum.reduceat(rank, starts)
            open_ = lowest < NO_RANK
            counts[owner[~open_]] = lengths[~open_]
            merge = (rank == lowest[seq]) & open_[seq]
            at = np.flatnonzero(merge)
            # in a run such as "aaa" pairs overlap: every second one merges, from the left
            first = np.ones(len(at), dtype=bool)
            first[1:] = (np.diff(at) != 1) | (seq[at[1:]] != seq[at[:-1]])
            place = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[place % 2 == 0]
            symbols[at] = self.made[rank[at]]
            alive = open_[seq]
            alive[at + 1] = False
            lengths = lengths - np.bincount(seq[at], minlength=len(lengths))
            symbols, lengths, owner = symbols[alive], lengths[open_], owner[open_]
        return counts

    def learn(self, words: set[str]) -> dict[str, int]:
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = list(words)
        if fresh:
            counts = dict(zip(fresh, self.surviving([w.encode() for w in fresh]).tolist(), strict=True))
            self.known.update((w, n) for w, n in counts.items() if len(w) <= LONGEST_REMEMBERED)
            return counts
        return {}

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; special tokens count one each."""
        totals = [0] * len(texts)
        for group in grouped(self.pieces(texts), SLICE // 4):
            new = self.learn(set(itertools.chain.from_iterable(words for _, words in group)))
            of = self.known.get
            for k, words in group:
                totals[k] += sum(of(w) or new[w] for w in words)
        if self.special:
            for k, text in enumerate(texts):
                totals[k] += sum(1 for _ in self.special.finditer(text))
        return totals

    def pieces(self, texts: list[str]) -> Iterator[tuple[int, list[str]]]:
        """Lists of pre-tokens with the place of their text, at most some ten thousands in one list."""
        for k, text in enumerate(texts):
            for part in self.special.split(text) if self.special else [text]:
                if len(part) <= SLICE:
                    yield k, self.pattern.findall(part)
                else:
                    found = (m[0] for m in self.pattern.finditer(part))
                    while words := list(itertools.islice(found, 50_000)):
                        yield k, words


def grouped(pieces: Iterator[tuple[int, list[str]]], most: int) -> Iterator[list[tuple[int, list[str]]]]:
    held, n = [], 0
    for k, words in pieces:
        held.append((k, words))
        n += len(words)
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def count_tokens(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes and n_tokens of every text; the vocabulary file must be readable at `path` on executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in slices(batches, "text", SLICE):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            sizes = pa.array([len(x.encode()) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(vocab.count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return slim.mapInArrow(run, SCHEMA)
