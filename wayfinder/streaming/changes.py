"""Incremental runs over a stream of file rows: each micro-batch is diffed against the stored files and applied by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayfinder.operators.incremental import classify_files
from wayfinder.operators.store import last_wins


def stream_changes(spark: SparkSession, files: DataFrame, stored: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], checkpoint: str, order: str | None = None) -> StreamingQuery:
    """files: a stream of (path, hash, component_id). apply gets new and changed paths of each batch with the batch's number,
    by which a repeated batch can be told; deletions need a full snapshot and are not seen by a stream. order: a column that
    says which of a path's rows in one batch is the latest; without it the largest hash counts."""

    def batch(df: DataFrame, number: int) -> None:
        latest = last_wins(df.withColumn("__at", F.col(order or "hash")), ["path"], "__at")
        known = stored().join(latest.select("path"), "path", "left_semi")
        apply(classify_files(latest, known), number)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
