"""Whitening of embeddings by an exact scatter matrix from bit slices.

Entries are whole numbers x. Of the distinct vectors (the fit list) every dimension is shifted by its least value, and its
bits are sliced: plane b of a dimension holds bit b of 64 rows in a word. The product of two dimensions over all rows is
then the sum over pairs of planes of 2^(a+b) times the set bits of their AND, in whole numbers. Tasks count over batches of rows
and return counts by pair of dimensions and a+b, as many for any number of rows; n * products - sums * sums, also whole, is
the covariance times n^2, exact whatever the offset of the entries. The driver holds that one d x d matrix and its eigenvectors.

Defined results: rows are dropped whose vector is null, holds null or non-finite entries, or entries whose x is beyond
2^62; so are rows whose length is not that of the most rows (of two the longer), and empty vectors. Repeated vectors count once
in the fit list, and every row gets its own result; a null id is kept. A component whose eigenvalue is below 1e-10 of
the greatest has no whitened value and is left out; where all vectors are equal, or none is left, no row comes back. Extra
columns are ignored. A deviation beyond the range of a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsplit.shared import dropped, written

#: x = floor(SCALE * entry) + OFFSET.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Rows whose planes are packed together, values of a batch, and the part of the greatest eigenvalue that still counts.
ROWS, VALUES, LEAST = 8192, 1 << 21, 1e-10


@dataclass
class Whitening:
    """n, exact sums, components as rows of directions, their eigenvalues and shares of the variance, and how far the
    whitened fit list is from the identity."""

    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None


def whole_numbers(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """rows with x, the vector in whole numbers, without the rows that have none."""
    entries = F.col(column)
    most = float(2**62) / SCALE
    good = F.forall(entries, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < most)) & (F.size(entries) > 0)
    kept = rows.where(entries.isNotNull() & F.coalesce(good, F.lit(False)))
    return kept.withColumn("x", F.transform(entries, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET))


def of_one_length(numbered: DataFrame) -> DataFrame:
    """The rows of the length that most have; the longer of two."""
    counted = numbered.groupBy(F.size("x").alias("d")).count().agg(F.max(F.struct("count", "d"))["d"].alias("d")).first()
    return numbered.where(F.size("x") == (counted["d"] if counted["d"] is not None else -1))


def matrices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[np.ndarray]:
    """The vectors of a column x as matrices of about so many rows."""
    held: list[np.ndarray] = []
    n = 0
    for batch in batches:
        if batch.num_rows:
            x = batch.column("x")
            held.append(x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            n += batch.num_rows
            if n >= rows or n * held[0].shape[1] >= VALUES:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def ranges(fit: DataFrame) -> list[tuple[int, int]]:
    """Least and greatest x of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for x in matrices(batches):
            low = x.min(0) if low is None else np.minimum(low, x.min(0))
            high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low), dtype=np.int32)), pa.array(low), pa.array(high)], ["i", "low", "high"])

    found = fit.select("x").mapInArrow(run, "i int, low long, high long").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return [(r["low"], r["high"]) for r in sorted(found.collect(), key=lambda r: r["i"])]


def sliced(x: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The planes with a set bit: words over rows, and each one's dimension and bit."""
    shifted = (x - low).astype(np.uint64)
    planes, dims, bits = [], [], []
    for bit in range(int(shifted.max(initial=0)).bit_length()):
        plane = ((shifted >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
        which = np.flatnonzero(plane.any(0))
        packed = np.packbits(plane[:, which].T, axis=1)
        planes.append(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64))
        dims.append(which)
        bits.append(np.full(len(which), bit))
    if not planes:
        return np.zeros((0, 1), np.uint64), np.zeros(0, int), np.zeros(0, int)
    order = np.argsort(np.concatenate(dims), kind="stable")
    return np.concatenate(planes)[order], np.concatenate(dims)[order], np.concatenate(bits)[order]


def plane_counts(fit: DataFrame, span: list[tuple[int, int]]) -> DataFrame:
    """i, j, shift and the number of rows with both bits set, over pairs of planes with a + b = shift, i <= j; and for i, -1
    the bits of one dimension alone."""
    low = np.array([a for a, _ in span], np.int64)
    width = max((int(b) - int(a)).bit_length() for a, b in span)
    d, shifts = len(span), max(1, 2 * width - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, single = np.zeros(d * d * shifts, np.int64), np.zeros(d * shifts, np.int64)
        for x in matrices(batches):
            planes, dims, bits = sliced(x, low)
            for k in range(len(planes)):
                both = np.bitwise_count(planes[k] & planes[k:]).sum(axis=1, dtype=np.int64)
                np.add.at(pairs, (dims[k] * d + dims[k:]) * shifts + bits[k] + bits[k:], np.where((dims[k:] == dims[k]) & (np.arange(len(both)) > 0), 2 * both, both))
                single[dims[k] * shifts + bits[k]] += both[0]
        at, alone = np.flatnonzero(pairs), np.flatnonzero(single)
        if len(at):
            i, j = np.concatenate([at // shifts // d, alone // shifts]), np.concatenate([at // shifts % d, np.full(len(alone), -1)])
            columns = (i.astype(np.int32), j.astype(np.int32), np.concatenate([at, alone]) % shifts, np.concatenate([pairs[at], single[alone]]))
            for start in range(0, len(i), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[start : start + 50_000]) for c in columns], ["i", "j", "shift", "count"])

    return fit.select("x").mapInArrow(run, "i int, j int, shift long, count long").groupBy("i", "j", "shift").agg(F.sum("count").alias("count"))


def scatter(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums of x, and n * sum(x_i x_j) - sum(x_i) sum(x_j), which is n^2 times the covariance; all exact."""
    n, span = fit.count(), ranges(fit)
    d = len(span)
    sums, products = [0] * d, [[0] * d for _ in range(d)]
    for r in plane_counts(fit, span).toLocalIterator() if d else ():
        if r["j"] < 0:
            sums[r["i"]] += r["count"] << r["shift"]
        else:
            products[r["i"]][r["j"]] += r["count"] << r["shift"]
    centred = [[n * products[min(i, j)][max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    return n, [s + n * low for s, (low, _) in zip(sums, span, strict=True)], centred


def exact(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S in whole numbers: as int64 where that holds them, else as Python's."""
    bound = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if bound < 2**63:
        return n * x - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def whitened(x: np.ndarray, told: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S, and the projections over the roots of the eigenvalues."""
    centred = exact(x, told.n, told.sums)
    return centred, (centred / told.n).astype(float) @ told.directions.T / np.sqrt(told.values)


def identity_error(fit: DataFrame, told: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, measured on its rows."""
    c = len(told.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((c + 1, c))
        for x in matrices(batches):
            w = whitened(x, told)[1]
            total[:c] += w.T @ w
            total[c] += w.sum(0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], ["i", "j", "s"])

    total = np.zeros((c + 1, c))
    for r in fit.select("x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        total[r["i"], r["j"]] = r["s"] / told.n
    return float(np.abs(total[:c] - np.outer(total[c], total[c]) - np.eye(c)).max(initial=0.0))


def fitted(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of distinct vectors x; None where no component is left."""
    n, sums, centred = scatter(fit)
    if not n or not any(centred[i][i] for i in range(len(sums))):
        return None
    covariance = np.array([[c / (n * n) for c in row] for row in centred])
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > LEAST * values.max()]
    told = Whitening(n, sums, vectors[:, order].T.copy(), values[order], values[order] / np.trace(covariance))
    told.identity_error = identity_error(fit, told)
    return told


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row that has a vector of numbers."""
    numbered = of_one_length(whole_numbers(rows))
    fit = written(numbered.select("x").distinct(), "fit")
    told = fitted(fit, components)
    dropped(fit)
    if told is None:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    c = len(told.values)

    def deviations(centred: np.ndarray) -> list[int | None]:
        if centred.dtype != object and int(np.abs(centred).max(initial=0)) ** 2 * centred.shape[1] < 2**63:
            return (centred * centred).sum(1).tolist()
        return [s if (s := sum(int(v) ** 2 for v in row)) < 2**63 else None for row in centred]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                centred, w = whitened(next(matrices(iter([batch]))), told)
                at = pa.array(np.repeat(np.arange(batch.num_rows), c))
                many = lambda x, kind: pa.array(np.full(batch.num_rows * c, x), kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), batch.num_rows)), many(told.n, pa.int64()), pa.array(deviations(centred), pa.int64()).take(at), pa.array(w.ravel()), pa.array(np.tile(told.explained, batch.num_rows)), many(told.identity_error, pa.float64())],
                    [x.split()[0] for x in SCHEMA.split(", ")],
                )

    return numbered.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, SCHEMA)
