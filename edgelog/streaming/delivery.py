"""T1 with delivered names: a stream over arriving files (names only) whose batches are routed by ``arrivals.deliver``.

The file source remembers which files a batch holds, the batch's number names its manifest partition, and both steps of a
batch replace what an interrupted run left, so every file is delivered and recorded exactly once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from edgelog.operators.arrivals import deliver

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"  # of the source; content is never read


def start_delivery(spark: SparkSession, lake_root: str, target: str, manifest: str, checkpoint: str, source: str = "new",
                   available_now: bool = True, clean_source: str | None = None, files_per_batch: int | None = None) -> StreamingQuery:
    reader = spark.readStream.schema(FILE_SCHEMA).format("binaryFile").option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if clean_source:  # "archive" / "delete": the object-store clean-up after routing
        reader = reader.option("cleanSource", clean_source)
    files = reader.load(f"{lake_root}/{source}").select("path", "length")
    w = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, number: deliver(batch, lake_root, target, manifest, number + 1))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
