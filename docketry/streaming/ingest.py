"""Incremental ingest: new brief files become rows of a table, batch by batch.

A brief arrives whole, so no state crosses batches; the query's own checkpoint keeps a
file from being read twice, and each batch overwrites only its own partition, so a batch
that is run again after a failure leaves the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docketry.sources.readers import decoded

FILE = "path string, modificationTime timestamp, length bigint, content binary"


def brief_stream(spark: SparkSession, path: str, pattern: str = "*.pdf", per_batch: int = 100) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).load(path)


def ingest(files: DataFrame, decode: Callable[[bytes], Iterable[dict]], target: str, checkpoint: str, process: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Decode and process every new file, then stop. target: a Parquet folder, one
    partition for each batch."""

    def write(batch: DataFrame, number: int) -> None:
        blocks = decoded(batch, decode)
        rows = process(blocks) if process else blocks
        rows.write.mode("overwrite").parquet(f"{target}/batch_id={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
