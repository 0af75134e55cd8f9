"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed lower-case terms. The machine scores it by a bias, a weight a term and, for every pair
of terms, the inner product of their factors, so that it learns pairs that tell more than their terms do. Terms in fewer than
`LEAST_DOCS` training texts have no say, nor have those whose presence and label hang together no more than chance allows, be it
in all texts or in those that have a telling term; so the machine doesn't learn single texts by heart, but keeps a term that
matters only together with another.

Labelled rows are joined to their texts in Spark, and the `most` rows with the smallest hashes of their ids are fitted, a
bound that doesn't grow with the corpus; so small a table is broadcast to the texts. Terms are hashed where the texts are; the fit gets lists of buckets. Scoring reads
every whole text in Arrow batches, with the model (`2 ** BITS` rows of weights) as its only side input.

Defined results: null and empty texts get the score of the bias; without any training row all scores are 0.5 less a
little, so that nothing is called toxic; null labels are not learnt from; of repeated labels of one id the largest counts;
repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsplit.llm.common import slices

#: Buckets of terms as a power of 2, factors of a term, rounds over the training rows, and rows that are fitted at most.
BITS, FACTORS, ROUNDS, MOST_ROWS = 16, 4, 40, 20_000
#: Training texts that a term is in at least, and the least likelihood ratio (G squared) of its presence and the label: in all
#: texts, and, as very many pairs are looked at, among the texts that have a telling term.
LEAST_DOCS, LEAST_RATIO, PAIR_RATIO = 5, 8.0, 25.0
BATCH, RATE, SHRINK, SHRINK_FACTORS = 256, 0.2, 2e-5, 1e-4
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
EDGES = b".,;:!?\"'()[]{}*#-_|<>%&$"
REMEMBERED = 300_000


class Terms:
    """Buckets of a text's terms; remembers a bounded number of terms."""

    def __init__(self, bits: int):
        self.mask, self.known = (1 << bits) - 1, {}

    def bucket(self, word: bytes) -> int:
        found = zlib.crc32(word.strip(EDGES)) & self.mask
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[word] = found
        return found

    def of(self, text: str | None) -> np.ndarray:
        words = set((text or "").encode().translate(LOWER).split())
        known, bucket = self.known.get, self.bucket
        found = [known(w, -1) for w in words]
        if -1 in found:
            found = [bucket(w) if k < 0 else k for k, w in zip(found, words, strict=True)]
        return np.unique(np.array(found, dtype=np.int32))


@dataclass
class Machine:
    """bias, a weight and factors for each bucket; score() takes rows of buckets in one flat array with their lengths."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums before the logistic, and the factor sums of each row."""
        row = np.repeat(np.arange(len(lengths)), lengths)
        linear = np.bincount(row, self.weights[flat], minlength=len(lengths))
        v = self.factors[flat]
        sums = np.stack([np.bincount(row, v[:, f], minlength=len(lengths)) for f in range(v.shape[1])], axis=1)
        squares = np.bincount(row, (v * v).sum(axis=1), minlength=len(lengths))
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def score(self, flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(flat, lengths)[0], -30, 30)))


def ratios(rows: list[np.ndarray], labels: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket how many rows have it, and the likelihood ratio of its presence and the label."""
    flat, each = np.concatenate(rows), np.repeat(labels, [len(r) for r in rows])
    with_it = np.stack([np.bincount(flat, 1 - each, minlength=size), np.bincount(flat, each, minlength=size)])
    totals = np.array([[(1 - labels).sum()], [labels.sum()]])
    n = with_it.sum(axis=0)
    ratio = np.zeros(size)
    for part, of in ((with_it, n), (totals - with_it, len(rows) - n)):
        expected = totals * of / len(rows)
        ratio += 2 * np.sum(part * np.log(np.maximum(part, 1e-12) / np.maximum(expected, 1e-12)), axis=0)
    return n, ratio


def telling(rows: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """Buckets that tell the label, by themselves or among the rows that have a bucket which does."""
    n, ratio = ratios(rows, labels, size)
    found = (n >= LEAST_DOCS) & (ratio >= LEAST_RATIO)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows)
    own = found[flat]
    order = np.argsort(flat[own], kind="stable")
    both = found.copy()
    for held in np.split(owner[own][order], np.flatnonzero(np.diff(flat[own][order])) + 1):
        some = labels[held]
        if len(held) >= 2 * LEAST_DOCS and 0 < some.sum() < len(held):
            n, ratio = ratios([rows[k] for k in held], some, size)
            both |= (n >= LEAST_DOCS) & (ratio >= PAIR_RATIO)
    return both


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, seed: int = 7) -> Machine:
    """Adaptive gradient steps on the logistic loss, the same for the same rows in the same order."""
    size, rng = 1 << bits, np.random.default_rng(seed)
    machine = Machine(-0.1, np.zeros(size), np.zeros((size, FACTORS)))
    if not rows:
        return machine
    seen = telling(rows, labels, size)
    rows = [r[seen[r]] for r in rows]
    share = float(np.clip(labels.mean(), 1e-4, 1 - 1e-4))
    machine.bias = float(np.log(share / (1 - share)))
    machine.factors[seen] = rng.normal(0, 0.01, (int(seen.sum()), FACTORS))
    past_w, past_v, past_b = np.full(size, 1e-3), np.full((size, FACTORS), 1e-3), 1e-3
    for _ in range(ROUNDS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            chosen = order[k : k + BATCH]
            lengths = np.array([len(rows[i]) for i in chosen])
            flat = np.concatenate([rows[i] for i in chosen])
            out, sums = machine.raw(flat, lengths)
            error = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[chosen]) / len(chosen)
            each = np.repeat(error, lengths)
            terms, place = np.unique(flat, return_inverse=True)
            grad_w = np.bincount(place, each, minlength=len(terms)) + SHRINK * machine.weights[terms]
            inner = each[:, None] * (np.repeat(sums, lengths, axis=0) - machine.factors[flat])
            grad_v = np.stack([np.bincount(place, inner[:, f], minlength=len(terms)) for f in range(FACTORS)], axis=1) + SHRINK_FACTORS * machine.factors[terms]
            past_w[terms] += grad_w**2
            past_v[terms] += grad_v**2
            past_b += error.sum() ** 2
            machine.weights[terms] -= RATE * grad_w / np.sqrt(past_w[terms])
            machine.factors[terms] -= 0.3 * RATE * grad_v / np.sqrt(past_v[terms])
            machine.bias -= RATE * error.sum() / np.sqrt(past_b)
    return machine


def hashed(texts: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, label and the term buckets of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(bits)
        for batch in slices(batches, "text"):
            found = [terms.of(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "label", "terms"])

    return texts.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, terms array<int>")


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Machine:
    """A machine from labels (doc_id, label); `most` rows, those with the smallest hashes of their ids, reach the driver."""
    known = labels.where("label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    bounded = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # of texts that share an id one, so that at most `most` rows reach the driver
    texts = docs.select("doc_id", "text").join(F.broadcast(bounded), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    told = hashed(texts).toPandas()
    told = told.sort_values("doc_id", kind="stable")
    return fit([np.asarray(x, dtype=np.int32) for x in told["terms"]], told["label"].to_numpy(dtype=float))


def score(docs: DataFrame, machine: Machine, bits: int = BITS) -> DataFrame:
    """doc_id and score of every whole text."""
    told = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, machine = Terms(bits), told.value
        for batch in slices(batches, "text"):
            rows = [terms.of(x) for x in batch.column("text").to_pylist()]
            found = machine.score(np.concatenate(rows), np.array([len(r) for r in rows]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def held_out(column: str = "doc_id"):
    """Rows whose labels are never learnt; a null id is none of them."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))
