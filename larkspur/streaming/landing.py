"""The landing folder: files that arrive are ingested once each."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from larkspur.sources.catalog import Catalog
from larkspur.sources.ingest import FILE_SCHEMA, ingest_files
from larkspur.sources.readers import MAX_MB


def watch_landing(
    spark: SparkSession,
    directory: str,
    catalog: Catalog,
    workspace_id: str,
    checkpoint: str,
    max_mb: int = MAX_MB,
    files_per_batch: int = 1_000,
    every: str | None = None,
) -> StreamingQuery:
    """Start ingesting the files of `directory`; by default what is there now, else `every` interval.

    The checkpoint remembers the files that are done. A batch that is replayed after a failure has the
    same number and files, and replaces its own catalogue rows.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()
    arrived = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(directory)
        .select("path", "modificationTime", "length")
    )

    def take(files: DataFrame, number: int) -> None:
        ingest_files(files, catalog, workspace_id, max_mb, batch=f"{stream}-{number}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    writer = arrived.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()
