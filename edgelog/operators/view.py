"""The two-tier combined view.

Hot tier for hours at or after the cut-off, cold tier for hours before it;
the cut-off is ``floor_hour(now - 15 min - 1 h)`` as ``yyyyMMddHH``.  Both
branches filter on ``concat(year, month, day, hour)`` which Spark turns into
``PartitionFilters``, so each scan lists only its own hours.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelog.functions.timekeys import hour_key, view_cutoff
from edgelog.schema import VIEW_COLUMNS
from edgelog.session import path_exists
from edgelog.sources.accesslog import read_cold, read_hot


def combined_view(spark: SparkSession, hot_root: str, cold_root: str, now: dt.datetime,
                  with_file: bool = False, name: str | None = None) -> DataFrame:
    """U1 over two tier folders (path-based tables)."""
    hot = read_hot(spark, hot_root, with_file) if path_exists(spark, hot_root) else None
    cold = read_cold(spark, cold_root, with_file) if path_exists(spark, cold_root) else None
    if hot is None and cold is None:
        raise FileNotFoundError(f"neither {hot_root} nor {cold_root} exists")
    return combine_tiers(hot, cold, now, with_file, name)


def combine_tiers(hot: DataFrame | None, cold: DataFrame | None, now: dt.datetime,
                  with_file: bool = False, name: str | None = None) -> DataFrame:
    """U1 over two tier DataFrames (folders or catalog tables) with the same columns."""
    cut = F.lit(view_cutoff(now))
    parts = []
    if hot is not None:
        parts.append(hot.where(hour_key() >= cut).withColumn("tier", F.lit("hot")))
    if cold is not None:
        parts.append(cold.where(hour_key() < cut).withColumn("tier", F.lit("cold")))
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    df = df.withColumnRenamed("result_id", "request_id")
    df = df.select(*VIEW_COLUMNS, *(["file", "tier"] if with_file else []))
    if name:
        df.createOrReplaceTempView(name)
    return df

