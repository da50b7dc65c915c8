"""Extension: the keep-first deduplication and progress snapshots over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame


def keep_first_stream(events: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """A key's first row within the watermark's delay; state older than that is dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def snapshots(df: DataFrame, path: str, checkpoint: str):
    """Append each micro-batch as a snapshot; a batch that is replayed overwrites its own folder."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
