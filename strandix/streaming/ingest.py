"""Streams into the store: idempotent batches, and keyed logs with ids and expiry. An extension of the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from strandix.sources.store import Store, digest_of


def ingest(stream: DataFrame, store: Store, table: str, key: str, checkpoint: str, source: str = "stream") -> DataStreamWriter:
    """A writer that upserts each micro-batch once: a batch that is run again after a failure finds its id in the ledger."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.dropDuplicates([key]).persist()
        try:
            if not batch.isEmpty():
                store.upsert(table, batch, key, request=f"{source}:{epoch}", digest=digest_of(batch))
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and key, with a watermark that bounds the state."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def last_values(events: DataFrame, key: str, time: str, value: str, keep_micros: int) -> DataFrame:
    """The newest value of each key as a state that expires `keep_micros` after it was set."""
    newest = events.groupBy(key).agg(F.max_by(F.struct(value, time), F.col(time)).alias("x"))
    return newest.select(F.col(key).alias("key"), F.col(f"x.{value}").alias("value"), (F.unix_micros(F.col(f"x.{time}").cast("timestamp")) + keep_micros).alias("expiry"))
