"""Routing arriving log files into hourly partitions, partition
registration, hourly compaction gzip TSV -> Parquet, and pruning predicates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelog.functions.timekeys import compaction_hour, next_hour
from edgelog.schema import ALL_COLUMNS, FULL_SCHEMA, PARTITION_KEYS
from edgelog.session import path_exists
from edgelog.sources.accesslog import read_hot

# File-name date pattern (year, month, day, hour groups) and basename pattern.
DATE_PATTERN = r"[^\d](\d{4})-(\d{2})-(\d{2})-(\d{2})[^\d]"
BASENAME_PATTERN = r"[^/]+$"
DEFAULT_TARGET_PREFIX = "partitioned-gz/"


def route_keys(df: DataFrame, key_col: str = "key", target_prefix: str = DEFAULT_TARGET_PREFIX) -> DataFrame:
    """D1 as a pure mapping: object key -> (year, month, day, hour, basename, target_key).

    The first match of the date pattern anywhere in the whole key wins; keys
    without a match get ``routed = false`` and NULL targets (D2)."""
    k = F.col(key_col)
    parts = {name: F.regexp_extract(k, DATE_PATTERN, i + 1) for i, name in enumerate(PARTITION_KEYS)}
    routed = parts["year"] != F.lit("")
    basename = F.regexp_extract(k, BASENAME_PATTERN, 0)
    target = F.concat(F.lit(target_prefix),
                      F.lit("year="), parts["year"], F.lit("/month="), parts["month"],
                      F.lit("/day="), parts["day"], F.lit("/hour="), parts["hour"],
                      F.lit("/"), basename)
    return df.select(
        "*",
        *[F.when(routed, v).alias(n) for n, v in parts.items()],
        F.when(routed, basename).alias("basename"),
        F.when(routed, target).alias("target_key"),
        routed.alias("routed"),
    )


def unrouted(df: DataFrame, key_col: str = "key") -> DataFrame:
    """Keys that do not look like an access-log file (left in place)."""
    return route_keys(df, key_col).where(~F.col("routed")).select(key_col)


def list_files(spark: SparkSession, root: str, relative_to: str | None = None) -> DataFrame:
    """Distributed file listing (path, length, modificationTime, key) without
    reading file contents (binaryFile only reads bytes when ``content`` is selected)."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
          .select("path", "length", "modificationTime"))
    # keys relative to the bucket root, as an object store names them
    return df.withColumn("key", object_key(F.col("path"), relative_to or root, encoded=False))


def object_key(path: Column, root: str, encoded: bool = True) -> Column:
    """Key of a file under ``root``: its path without scheme and authority, less exactly the root.  File paths of
    ``_metadata`` are URI-encoded; a plus sign in them stands for itself."""
    if encoded:
        path = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    plain = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return plain.substr(F.lit(len(_strip_scheme(root)) + 2), F.length(plain))


def register_next_hour(spark: SparkSession, table: str, now: dt.datetime) -> dict[str, str]:
    """D3: ``ALTER TABLE .. ADD IF NOT EXISTS PARTITION`` for the hour after ``now``.

    Only catalog tables need it; path-based tables discover partitions."""
    p = next_hour(now)
    spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION "
              "(year = :year, month = :month, day = :day, hour = :hour)", args=p)
    return p


def next_hour_partitions(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """D3 over a column of trigger times: the zero-padded parts of ts + 60 min."""
    t = F.col(ts_col) + F.expr("INTERVAL 60 MINUTES")
    return df.select(F.col(ts_col), F.date_format(t, "yyyy").alias("year"), F.date_format(t, "MM").alias("month"),
                     F.date_format(t, "dd").alias("day"), F.date_format(t, "HH").alias("hour"))


def hour_predicate(parts: dict[str, str]) -> Column:
    """Equality on the four partition keys (a PartitionFilter)."""
    cond = None
    for k in PARTITION_KEYS:
        c = F.col(k) == F.lit(parts[k])
        cond = c if cond is None else cond & c
    return cond


def by_path(rows: DataFrame) -> DataFrame:
    """Rows as compacted files hold them.  ``rebalance`` lets AQE split a hot hour over several tasks and merge small ones, so
    files have an even size; inside a file rows go by path, so that the row group and page limits of ``uri`` tell a path
    filter (P5: a prefix or one path) which parts to skip.  The writer needs the order by hour anyway: still one sort."""
    return rows.hint("rebalance", *PARTITION_KEYS).select(*ALL_COLUMNS).sortWithinPartitions(*PARTITION_KEYS, "uri")


def _write_hours(rows: DataFrame, root: str, mode: str = "overwrite") -> None:
    (by_path(rows).write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .option("compression", "snappy").partitionBy(*PARTITION_KEYS).parquet(root))


def hour_folder(hot_root: str, p: dict[str, str]) -> str:
    return f"{hot_root}/" + "/".join(f"{k}={p[k]}" for k in PARTITION_KEYS)


def compact(spark: SparkSession, hot_root: str, cold_root: str, where: Column, mode: str = "overwrite",
            folders: list[str] | None = None) -> None:
    """Rewrite the selected hours of the gzip tier as SNAPPY Parquet.

    ``mode='overwrite'`` with dynamic partition overwrite replaces exactly the hours present in the input
    (idempotent); ``mode='append'`` is the parity option (a re-run duplicates rows).  ``folders`` are the hours to list.
    A lake with an arrival manifest is compacted by ``arrivals.compact_arrived``, which also keeps the ledger."""
    paths = [f for f in (folders if folders is not None else [hot_root]) if path_exists(spark, f)]
    rows = read_hot(spark, paths, base=hot_root).where(where) if paths else spark.createDataFrame([], FULL_SCHEMA)
    _write_hours(rows, cold_root, mode)  # an hour without files leaves an empty tier, not a missing one


def compact_hour(spark: SparkSession, hot_root: str, cold_root: str, now: dt.datetime,
                 mode: str = "overwrite", cold_table: str | None = None) -> dict[str, str]:
    """D4 as scheduled: the hour two hours before ``now``.  With ``cold_table``
    the new hour is added to the catalog and the table's file cache refreshed."""
    p = compaction_hour(now)
    compact(spark, hot_root, cold_root, hour_predicate(p), mode=mode, folders=[hour_folder(hot_root, p)])
    if cold_table is not None:
        add_hours(spark, cold_table, [p])
    return p


def add_hours(spark: SparkSession, table: str, hours: list[dict[str, str]]) -> None:
    """Add hours to a registered tier and drop its cached file list."""
    for p in hours:
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION "
                  "(year = :year, month = :month, day = :day, hour = :hour)", args=p)
    spark.catalog.refreshTable(table)


def _strip_scheme(path: str) -> str:
    if path.startswith("file:"):
        path = path[5:]
        while path.startswith("//"):
            path = path[1:]
    elif "://" in path:
        path = path.split("://", 1)[1]
        path = path[path.find("/"):] if "/" in path else ""
    return path.rstrip("/")
