"""The corpus pipeline: quality rules, line dedup, near-dedup, source mix and SentencePiece, over all documents.

Every stage takes what its predecessor kept, written as Parquet and reread, and returns rows with the columns of documents;
the last adds ids and the decoded text.

Nulls, empty and very long texts, ties, repeated rows and empty tables have the results that each stage's operator states. Extra
columns of documents are left out; those of its own may be null.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabsplit import shared
from tabsplit.llm import common, lines, mixing, neardup, pieces, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the outlier rule rejects go."""
    common.prepare(spark)
    return quality.kept_rows(docs).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents of which no line is left."""
    common.prepare(spark)
    return lines.kept_rows(docs).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: sets of five-word shingles with a similarity of 0.8 or more."""
    common.prepare(spark)
    return neardup.first_of_groups(docs, neardup.near_duplicates(docs, width=5, percent=80)).select(COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    common.prepare(spark)
    return mixing.mixed_rows(docs).select(COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the text decoded from them."""
    common.prepare(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.round_trip(docs.select(COLUMNS), path)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", source_mix),
    ("SentencePiece", sentencepiece),
]

#: The stages hash, sign and encode in ways that SQL cannot express; the tests hold run() to its own stages and to planted copies and junk.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and reread as the next one's input.

    What a stage made on its way, and its input, are deleted when its output is written.
    """
    docs, before = common.documents(common.prepare(spark), sf_dir), []
    for place, (_, stage) in enumerate(STAGES):
        with shared.made() as tables:
            docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = shared.written(docs, "stage")
            shared.dropped(*tables, *before)
            before = [docs]
    return docs
