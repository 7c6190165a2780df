"""The queries of the operators, each over its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import language, lines, mixing, packing, passages, quality, search, simhash, tokens, urls
from quarry.sources.tables import table
from quarry.staging import stage

TOKEN_LIMIT = 4096
TOP_K, QUERY_IDS = 10, 20
PIECE_MODEL, WORD_MODEL = "piece_bpe_32k.model", "word_bpe_49k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sized = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
    counted = tokens.count_tokens(sized, public_tokenizers.path(PIECE_MODEL)).drop("text")
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.token_pieces(docs, public_tokenizers.path(WORD_MODEL))
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(stage(digests, "pieces"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    printed = stage(simhash.with_fingerprint(docs).drop("text"), "printed")
    return simhash.near_duplicates(printed).select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by ``QUERY_IDS``, as a query of its whole text, against all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.top_k(docs, docs.where(F.col("doc_id") % QUERY_IDS == 0), TOP_K)


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    sized = stage(mixing.size_documents(docs).drop("text"), "sized")
    mixed = mixing.mix(sized)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    marked = docs.withColumn("held_out", language.held_out(F.col("doc_id")))
    profiles = language.train_profiles(marked.where(~F.col("held_out")).select("lang", "text"))
    return language.identify(marked.select("doc_id", "held_out", "text"), profiles).drop("text")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    ruled = stage(quality.base_rules(docs).drop("text"), "ruled")
    return quality.apply_verdicts(ruled)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_packing, op3_simhash, op4_search, op5_passages, op6_mixing, op7_url_filter, op8_line_dedup, op9_language, op10_quality)}
