"""The operators of this package over their whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from motionloom.llm import decontam, html_extract, huffman, license_scan, lm, media, packing, quality, simhash, suffix
from motionloom.llm import pipeline as stages
from motionloom.llm.common import read


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's operator on whole conversations: tokens, turns and loss-bearing tokens are limited at once."""
    return packing.pack_conversations(read(spark, sf_dir, "conversations"))


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.train(docs))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.read_ids(spark, huffman.write_ids(read(spark, sf_dir, "documents")))


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(read(spark, sf_dir, "documents"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return lm.score(docs, lm.train(docs))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.copies(media.rendered(read(spark, sf_dir, "embeddings")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_decontamination, op2_simhash, op3_packing, op4_license, op5_quality, op6_html, op7_token_ids, op8_suffix, op9_lm, op10_media, pipeline, packed_conversations)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontam.ORACLE_SQL}
