"""D1, T3 and D4 over an arrival manifest.

Every micro-batch (or batch run) of delivered files is routed in two steps: the files are copied under their own names into
their hour folders (``write_named_files``), then one row per file is committed to the manifest under the batch's number.  A
crash between the two repeats the batch: the copies replace themselves and the manifest partition is overwritten, so
nothing is lost or doubled.  Compaction reads the files that the manifest names up to a batch and writes those rows to its
ledger; a late file is a manifest row that no ledger has.  File lists stay in Spark; the driver sees the number of the last
batch and, when it repairs, the hours concerned."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgelog.functions.timekeys import compaction_hour, hour_key
from edgelog.operators.layout import _write_hours, hour_folder, hour_predicate, object_key, route_keys
from edgelog.schema import FULL_SCHEMA, PARTITION_KEYS
from edgelog.session import path_exists
from edgelog.sources.accesslog import read_hot
from edgelog.sources.namedfiles import write_named_files

MANIFEST = "file string, key string, length long, year string, month string, day string, hour string, batch long"
LEDGER = "file string, batch long, year string, month string, day string, hour string"
SMALL_LIST = 100_000
"""Names of up to this many files (some 20 MB) go to every task; beyond it Spark joins by shuffle."""


def listed_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files under ``root``; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")


def manifest_of(spark: SparkSession, manifest: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(manifest) if path_exists(spark, manifest) else spark.createDataFrame([], MANIFEST)


def ledger_of(spark: SparkSession, ledger: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(ledger) if path_exists(spark, ledger) else spark.createDataFrame([], LEDGER)


def last_batch(arrived: DataFrame) -> int:
    return arrived.agg(F.max("batch")).first()[0] or 0


def routed_files(files: DataFrame, lake_root: str, arrived: DataFrame, batch: int) -> DataFrame:
    """(path, length, key, hour keys, target_key) of the files whose name carries a date; others stay.

    Files of different keys but one name in one hour stay apart: those after the first (by key; a file of an earlier
    batch comes first) get the CRC-32 of their key before the name."""
    keyed = files.withColumn("key", object_key(F.col("path"), lake_root, encoded=False))
    routed = route_keys(keyed, target_prefix="").where("routed")
    before = (arrived.where(F.col("batch") != batch).groupBy(F.col("file").alias("target_key"))
              .agg(F.min_by("key", "batch").alias("_first")))
    place = F.row_number().over(W.partitionBy("target_key").orderBy("key"))
    routed = routed.withColumn("_place", place).join(before, "target_key", "left")
    other = F.coalesce(F.col("_first") != F.col("key"), F.col("_place") > 1)
    folder = F.concat(*[x for k in PARTITION_KEYS for x in (F.lit(f"{k}="), F.col(k), F.lit("/"))])
    name = F.when(other, F.concat(F.crc32(F.col("key").cast("binary")).cast("string"), F.lit("."), F.col("basename"))).otherwise(F.col("basename"))
    return routed.select("path", "length", "key", *PARTITION_KEYS, F.concat(folder, name).alias("target_key"))


def deliver(files: DataFrame, lake_root: str, target: str, manifest: str, batch: int) -> None:
    """Route one batch of files (path, length) into the tier ``target`` and commit it to the manifest."""
    spark = files.sparkSession
    routed = routed_files(files, lake_root, manifest_of(spark, manifest), batch)
    write_named_files(routed, target)
    rows = routed.select(F.col("target_key").alias("file"), "key", "length", *PARTITION_KEYS, F.lit(batch).cast("long").alias("batch"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(manifest)


def hour_file(path: Column) -> Column:
    """Manifest name (hour folders and file name) of a tier's file from its URI-encoded path.  Scans take it for every row, so
    it cuts the end off and decodes only what is encoded, where ``object_key`` matches patterns and decodes the whole path."""
    end = F.substring_index(path, "/", -len(PARTITION_KEYS) - 1)
    decoded = F.url_decode(F.replace(end, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(end, F.lit("%")), decoded).otherwise(end)


def _rows_of(spark: SparkSession, hot_root: str, files: DataFrame, folders: list[str] | None) -> DataFrame:
    """The rows of exactly the named files."""
    paths = [f for f in ([hot_root] if folders is None else folders) if path_exists(spark, f)]
    if not paths:
        return spark.createDataFrame([], FULL_SCHEMA)
    rows = read_hot(spark, paths, base=hot_root).withColumn("file", hour_file(F.col("_metadata.file_path")))
    names = files.select("file").distinct()
    return rows.join(F.broadcast(names) if names.count() <= SMALL_LIST else names, "file", "left_semi").drop("file")


def compact_arrived(spark: SparkSession, hot_root: str, cold_root: str, manifest: str, ledger: str, where: Column,
                    folders: list[str] | None = None, write=_write_hours) -> int:
    """D4/D5 from the manifest: the selected hours as Parquet, and the ledger of the files consumed, published after the
    data.  Files of later batches are in neither.  Returns the last batch that counted."""
    arrived = manifest_of(spark, manifest)
    upto = last_batch(arrived)
    files = arrived.where(where & (F.col("batch") <= upto))
    write(_rows_of(spark, hot_root, files, folders).where(where), cold_root)
    (files.select(*LEDGER_COLUMNS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*PARTITION_KEYS).parquet(ledger))
    return upto


LEDGER_COLUMNS = ["file", "batch", *PARTITION_KEYS]


def compact_arrived_hour(spark: SparkSession, hot_root: str, cold_root: str, manifest: str, ledger: str, now: dt.datetime) -> dict[str, str]:
    """D4 as scheduled: the hour two hours before ``now``."""
    p = compaction_hour(now)
    compact_arrived(spark, hot_root, cold_root, manifest, ledger, hour_predicate(p), [hour_folder(hot_root, p)])
    return p


def late_arrivals(spark: SparkSession, manifest: str, ledger: str, cutoff: str) -> DataFrame:
    """Manifest rows of compacted hours (key < cutoff) that no compaction consumed: files that arrived after their hour
    was compacted, or arrived again.  Every hour counts, however old."""
    early = hour_key() < F.lit(cutoff)
    return manifest_of(spark, manifest).where(early).join(ledger_of(spark, ledger).where(early).select("file", "batch"), ["file", "batch"], "left_anti")


def repair_arrivals(spark: SparkSession, hot_root: str, cold_root: str, manifest: str, ledger: str, cutoff: str,
                    write=_write_hours) -> list[dict[str, str]]:
    """Compact every hour with late files again; only those hours are listed and read.  Returns them."""
    hours = [r.asDict() for r in late_arrivals(spark, manifest, ledger, cutoff).select(*PARTITION_KEYS).distinct().collect()]
    if hours:
        where = hour_key().isin(["".join(p[k] for k in PARTITION_KEYS) for p in hours])
        compact_arrived(spark, hot_root, cold_root, manifest, ledger, where, [hour_folder(hot_root, p) for p in hours], write)
    return hours
