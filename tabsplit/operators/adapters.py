"""Between readings, parsed bills and what a screen takes: words to tokens, recorded readings, and items in major units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsplit.shared import new_path

WORDS = "file long, words array<struct<text: string, bbox: struct<x0: long, y0: long, x1: long, y1: long>>>"


def tokens_of(words: Column) -> Column:
    """Words with corners (text, confidence, bbox of x0, y0, x1, y1) as tokens with a place and a size; no words, no tokens."""
    box = lambda w: F.struct(w["text"].alias("text"), w["confidence"].alias("confidence"), w["bbox"]["x0"].alias("x"), w["bbox"]["y0"].alias("y"), (w["bbox"]["x1"] - w["bbox"]["x0"]).alias("width"), (w["bbox"]["y1"] - w["bbox"]["y0"]).alias("height"))
    return F.transform(words, box)


def recorded(texts: DataFrame, key: str) -> str:
    """Texts (key, value) packed into files of lines in a new shared folder: a line is a capture's name and its text."""
    path = new_path(texts.sparkSession, "captures")
    texts.select(F.col(key).cast("string").alias("capture"), F.col("value").alias("reading")).write.json(path)
    return path


def captures(spark: SparkSession, path: str) -> DataFrame:
    """capture, file, words and damaged of the recorded readings of a folder. Files are read in ranges of bytes, many captures a
    file. A reading that is no whole JSON document has null words and its text in `damaged`; so has a line that is none, without a name."""
    packed = spark.read.schema("capture string, reading string, _line string").option("columnNameOfCorruptRecord", "_line").json(path)
    told = packed.select("capture", F.coalesce("reading", "_line", F.lit("")).alias("reading"), F.from_json("reading", f"{WORDS}, _damaged string", {"columnNameOfCorruptRecord": "_damaged"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._damaged").isNotNull()
    return told.select("capture", F.when(~bad, F.col("r.file")).alias("file"), F.when(~bad, F.col("r.words")).alias("words"), F.when(bad, F.col("reading")).alias("damaged"))


def legacy_items(items: DataFrame) -> DataFrame:
    """bill_id, id, name, quantity, unit_price and total_price in major units; without a name or total there is no item."""
    known = items.where((F.coalesce("name", F.lit("")) != "") & F.col("total_cents").isNotNull())
    unit = F.coalesce("unit_cents", "total_cents") / 100
    return known.select("bill_id", "id", "name", F.coalesce("qty", F.lit(1)).cast("long").alias("quantity"), unit.cast("double").alias("unit_price"), (F.col("total_cents") / 100).cast("double").alias("total_price"))
