"""What the corpus operators share: words, texts and bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsplit.shared import ship

#: A word is a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Give Python workers this package, and keep their Arrow batches small: a worker holds one beside its own tables."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return ship(spark)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that one holds about `most` bytes of `column`; a longer row comes alone."""
    for batch in batches:
        sizes = [0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()]
        start = held = 0
        for k, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)
