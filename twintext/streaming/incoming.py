"""Segments as they arrive: deduplicated by hash, matched against a memory, counted by window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from twintext.functions.text import normalize, text_hash


def arriving(stream: DataFrame, text_col: str = "text", time_col: str = "ts", late: str = "1 hour") -> DataFrame:
    """Adds hash; a text that came already within the watermark is dropped."""
    hashed = stream.withColumn("hash", text_hash(normalize(F.col(text_col))))
    return hashed.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["hash"])


def matched(stream: DataFrame, memory: DataFrame) -> DataFrame:
    """Stream-static join with a memory (hash, tu_id)."""
    return stream.join(memory.select("hash", "tu_id"), "hash", "left")


def counts(stream: DataFrame, by: str, time_col: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows per window and ``by``; late rows count until the watermark passes."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), by).agg(F.count(F.lit(1)).alias("n"))


def per_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch operator over each micro-batch; a batch that runs again replaces its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
