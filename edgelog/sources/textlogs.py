"""Raw text logs (sync-job logs per mirror, container access logs).

``write_sync_logs`` lays down one log per (mirror, day) derived from
``events``, a busy one as several consecutive files; ``read_log_lines`` reads
lines with their place (log folder, file, split, line), so files are cut into
splits and no file is ever one value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Which mirror a sync event is logged under (user id modulo 3).
SYNC_LOG_MIRRORS = ["pypi", "debian", "ubuntu"]


def sync_log_lines(events: DataFrame) -> DataFrame:
    """(mirror, day, ts, event_id, line_no, line): a start line
    ``yyyy-MM-dd HH:mm:ss,SSS LEVEL ...`` and ``event_id % 3`` continuation lines."""
    eid = F.col("event_id")
    mirror = F.element_at(F.array(*[F.lit(m) for m in SYNC_LOG_MIRRORS]), (F.col("user_id") % 3 + 1).cast("int"))
    start = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(","),
                     F.lpad((eid % 1000).cast("string"), 3, "0"), F.lit(" INFO "), F.col("event_type"),
                     F.lit(" user="), F.col("user_id").cast("string"))
    conts = F.transform(F.sequence(F.lit(1), (eid % 3 + 1).cast("int")),
                        lambda k: F.concat(F.lit("    detail "), k.cast("string"), F.lit(" of event "), eid.cast("string")))
    lines = F.slice(F.concat(F.array(start), conts), 1, (eid % 3 + 1).cast("int"))
    return events.select(mirror.alias("mirror"), F.date_format("ts", "yyyyMMdd").alias("day"), "ts", "event_id",
                         F.posexplode(lines).alias("line_no", "line"))


def write_sync_logs(events: DataFrame, root: str) -> None:
    """One folder per (mirror, day); its files follow each other by name, and a record may go on in the next file."""
    lines = sync_log_lines(events)
    order = ["mirror", "day", "ts", "event_id", "line_no"]
    (lines.repartitionByRange(*order).sortWithinPartitions(*order)
     .select("line", "mirror", "day").write.mode("overwrite").partitionBy("mirror", "day").text(root))


def read_log_lines(spark: SparkSession, root: str) -> DataFrame:
    """(mirror, log, file, block, at, line): ``log`` is the folder, ``block`` the offset of the split in its file, and ``at``
    grows inside a split."""
    df = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(root)
    path = F.col("_metadata.file_path")
    return df.select(F.regexp_extract(path, r"mirror=([^/]+)", 1).alias("mirror"),
                     F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("log"), path.alias("file"),
                     F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
                     F.col("value").alias("line"))
