"""S11 on a stream of fault files: every batch replaces the chapters it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from seqlens import schemas
from seqlens.operators.review import type_counts
from seqlens.sources.writers import overwrite_groups


def keep_evidence(spark: SparkSession, source: str, ledger: str, checkpoint: str) -> StreamingQuery:
    """Read fault rows (JSON lines with chapter_id) as they land and upsert type counts.

    Replacing a chapter's partition is idempotent, so a batch that runs twice after a
    lost executor leaves the ledger as it was.
    """
    fields = schemas.FAULT.removeprefix("struct<").removesuffix(">").replace(":", " ")
    rows = spark.readStream.schema(f"chapter_id string, {fields}").json(source)

    def upsert(batch: DataFrame, _: int) -> None:
        overwrite_groups(type_counts(batch, ["chapter_id"]), ["chapter_id"], ledger)

    return rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
