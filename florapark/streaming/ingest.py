"""Incremental ingest of occurrence files: the batch read and split, file by file."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from florapark.sources.tables import write_by_species


def read_increments(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


def ingest(
    stream: DataFrame, target: str, checkpoint: str, key: str = "species", rows_per_file: int = 1_000_000, name: str | None = None,
) -> StreamingQuery:
    """Append named rows to a table partitioned by ``load`` and ``key``, one load per batch.

    A batch that is run again after a failure replaces its own load, so no row is written
    twice; the number of files follows the rows of a key. ``name`` tells the loads of several
    streams into one table apart; by default it is drawn from the checkpoint's path.
    """
    name = name or hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def write(batch: DataFrame, batch_id: int) -> None:
        write_by_species(batch, target, rows_per_file, key, f"{name}-{batch_id}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
