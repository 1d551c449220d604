"""A training corpus from the table of documents, stage by stage.

Every stage reads what its predecessor kept. ``run`` writes each stage as Parquet below the
shared checkpoint folder and rereads it, so a stage's work is never repeated and does
not depend on executors that may be lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens.llm import bpe, mixing, simhash, substrings, toxicity
from seqlens.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity score is below one half."""
    scored = toxicity.scored(docs, table(spark, sf_dir, "labels"))
    return scored.filter(F.col("predicted") == 0).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    return simhash.without_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages of 35 words or more that occur twice anywhere in what is left."""
    return substrings.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of the ids and of the decoded text, and the ids themselves; one row per repetition."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encode_decode(docs, path, public_tokenizers.PATTERN))


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("repeated passages", cut_repeats),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: The fitted scores, fingerprint components and BPE ids have no SQL form; tests check every stage against a plain model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for at, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{at}")
        docs = spark.read.parquet(f"{folder}/{at}")
    return docs
