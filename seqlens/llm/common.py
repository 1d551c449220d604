"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens.session import cut_lineage

#: A word is a run of anything but the six ASCII white space characters. Python's
#: ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
#: Columns of the table of documents; a filtering stage returns exactly these.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast ``df`` if its counted ``rows`` are at most ``most``; beyond it Spark plans the join itself."""
    return F.broadcast(df) if rows <= most else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder of the session, for tables that are written and read again."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


__all__ = ["DOCUMENT_COLUMNS", "WORD", "cut_lineage", "n_words", "shared_folder", "small", "table", "text_of"]
