"""One query per operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from seqlens.llm import (
    alignment, bpe, iblt, mixing, negatives, partenum, quality, rules, simhash, substrings, token_counts, toxicity, warc,
)
from seqlens.llm.common import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def llm_query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@llm_query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@llm_query("op2_weak_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"))


@llm_query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


@llm_query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(bpe.encode_decode(
        table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


@llm_query("op5_warc", warc.PAGES_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    warc.write_archive(warc.page_records(table(spark, sf_dir, "pages")), folder)
    return warc.read_archive(spark, folder).select(
        F.col("record_key").alias("page_id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"), "record_type", "refers_to")


@llm_query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("failed_rules")


@llm_query("op7_mixing", mixing.MIX_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


@llm_query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@llm_query("op9_substrings")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.kept_digests(table(spark, sf_dir, "documents"))


@llm_query("op10_lookup_sketches")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprint_edits(table(spark, sf_dir, "documents"))


@llm_query("op11_ngram_jaccard", partenum.NEAR_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_documents(table(spark, sf_dir, "documents"))


@llm_query("op12_hard_negatives", negatives.NEGATIVES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


@llm_query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


@llm_query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
