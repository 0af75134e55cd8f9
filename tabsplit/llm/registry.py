"""Queries of the corpus operators over the given tables, and their DuckDB texts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsplit.llm import lines, media, merkle, mixing, neardup, pages, pieces, quality, repeats, tokens, toxicity, urls, whitening
from tabsplit.llm.common import documents, prepare
from tabsplit.shared import new_path

#: Tokens above which a document is over the limit.
TOKEN_LIMIT = 512


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.round_trip(documents(prepare(spark), sf_dir).select("doc_id", "text"), path)
    text = F.coalesce("text", F.lit(""))
    return coded.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == text).alias("restored"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(prepare(spark), "media")
    media.write_archive(documents(spark, sf_dir), folder)
    return media.media_features(media.read_archive(spark, folder))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(prepare(spark), sf_dir))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(prepare(spark), sf_dir), width=3, percent=85)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(documents(prepare(spark), sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.without_repeated_lines(documents(prepare(spark), sf_dir))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(prepare(spark).read.parquet(f"{sf_dir}/pages.parquet"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(prepare(spark), sf_dir))


def op9_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(documents(prepare(spark), sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(prepare(spark), sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.score(docs, toxicity.train(docs, labels.where(~toxicity.held_out())))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(prepare(spark), sf_dir)
    listed = merkle.manifest(docs.withColumn("tampered", merkle.leaf_of(text=merkle.tampered_text())), carry=("tampered",))
    told = merkle.verified(listed, "tampered").withColumn("proof_sha256", merkle.proof_digest(F.col("witness")))
    return told.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = urls.train(urls.labelled_table(spark))
    return urls.judged(prepare(spark).read.parquet(f"{sf_dir}/pages.parquet"), model).select("page_id", "host", "path", "rule", "verdict")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_media_columns, op3_source_mix, op4_near_duplicates, op5_token_counts, op6_line_dedup, op7_html_extraction, op8_quality_rules, op9_suffix_repeats, op10_toxicity, op11_merkle_manifest, op12_url_filters, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mix": mixing.REPORT_SQL, "op4_near_duplicates": neardup.NEAR_SQL, "op9_suffix_repeats": repeats.REPEATS_SQL, "op11_merkle_manifest": merkle.manifest_sql(), "op12_url_filters": urls.filter_sql()}
