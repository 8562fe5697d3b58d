"""Registered queries of the operators, with production parameters, over
whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SHARDS = [f"shard-{i:03d}" for i in range(128)]


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .posting_lists import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"), 5, F.col("vec_id") % 50 == 0)


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import place_documents

    return place_documents(table(spark, sf_dir, "documents"), SHARDS, drained=SHARDS[-1])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify_documents

    return classify_documents(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), piece_model(), with_texts=False)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spotsigs import fingerprint_neighbours

    return fingerprint_neighbours(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dialogue import conversation_repairs

    return conversation_repairs(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_nearest, op2_kneser_ney, op3_sharding, op4_quality, op5_license_scan, op6_main_text, op7_source_mix,
                                   op8_near_duplicates, op9_sentencepiece, op10_fingerprints, op11_spelling_variants, op12_simhash_groups,
                                   op13_conversation_repair)}
