"""The two tiers of the access log.

Hot tier: gzip TSV, 33 positional fields, ``#`` header lines, Hive-style
``year=/month=/day=/hour=`` folders.  Cold tier: Parquet (SNAPPY), same
columns.  Partition keys are read as STRING (``month=01`` stays ``'01'``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgelog.schema import ALL_COLUMNS, DATA_COLUMNS, FULL_SCHEMA
from edgelog.session import mkdirs, work_path

HOT_OPTIONS = {
    "sep": "\t",
    "comment": "#",       # both header lines start with '#'
    "quote": "",          # a '"' is data, never a quote
    "escape": "",
    "mode": "PERMISSIVE",  # '-' in numeric fields -> NULL, short rows -> trailing NULLs
    "dateFormat": "yyyy-MM-dd",
    "header": "false",
}


DASHED = ("fle_encrypted_fields", "sc_range_start", "sc_range_end")
"""Numeric fields that are '-' in nearly every line.  Parsed as numbers each of them would throw and catch an exception per
row, so they are read as text, and only what is not '-' goes through the parser, with the same result."""

_HOT_SCHEMA = T.StructType([T.StructField(f.name, T.StringType() if f.name in DASHED else f.dataType) for f in FULL_SCHEMA])


def _dash_or_number(name: str) -> Column:
    number = F.from_csv(F.col(name), f"v {FULL_SCHEMA[name].dataType.simpleString()}", HOT_OPTIONS)
    return F.when(F.col(name) != "-", number["v"]).alias(name)


def read_hot(spark: SparkSession, root: str | list[str], with_file: bool = False, base: str | None = None) -> DataFrame:
    """Scan of the gzip TSV tier (gz files are unsplittable: one task per file).  ``root`` may be some hour folders
    of the tier ``base``."""
    reader = spark.read.schema(_HOT_SCHEMA).options(**HOT_OPTIONS)
    df = (reader.option("basePath", base) if base else reader).csv(root)
    return _with_file(df, with_file, {c: _dash_or_number(c) for c in DASHED})


def read_cold(spark: SparkSession, root: str, with_file: bool = False) -> DataFrame:
    """Scan of the Parquet tier (vectorised, filters pushed to row groups)."""
    df = spark.read.schema(FULL_SCHEMA).parquet(root)
    return _with_file(df, with_file)


def _with_file(df: DataFrame, with_file: bool, parsed: dict[str, Column] | None = None) -> DataFrame:
    # The file path pseudo-column must be taken here, before any view.
    cols = [(parsed or {}).get(c, F.col(c)) for c in ALL_COLUMNS]
    if with_file:
        cols.append(file_name(F.col("_metadata.file_path")).alias("file"))
    return df.select(*cols)


def file_name(path: Column) -> Column:
    """One spelling of local file URIs (``file:/x`` and ``file:///x`` both occur)."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def to_tsv_line(df: DataFrame) -> DataFrame:
    """Render the 33 data fields as one TAB-separated line; NULL -> '-'."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in DATA_COLUMNS]
    return df.select(F.concat_ws("\t", *parts).alias("value"), *[c for c in df.columns if c not in DATA_COLUMNS])


def _ddl_columns() -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in FULL_SCHEMA.fields)


def register_tier(spark: SparkSession, table: str, root: str, fmt: str) -> str:
    """Register a tier as an external partitioned catalog table and load its
    partitions.  Queries then prune partitions in the catalog and list only
    the files of the selected hours (cached per table), instead of listing
    every hour folder of the tier on each query.  After new files land in an
    existing hour, call ``spark.catalog.refreshTable``; new hours are added by
    ``ALTER TABLE .. ADD PARTITION`` (D3) or ``RECOVER PARTITIONS``."""
    if fmt == "csv":
        opts = ("OPTIONS (sep '\\t', comment '#', quote '', escape '', mode 'PERMISSIVE', "
                "dateFormat 'yyyy-MM-dd', header 'false')")
    elif fmt == "parquet":
        opts = ""
    else:
        raise ValueError(fmt)
    db = table.split(".")[0] if "." in table else None
    if db:
        # the database folder lives in the shared folder too, not in the caller's working directory
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {db} LOCATION '{work_path(spark, 'warehouse', db + '.db')}'")
    if not spark.catalog.tableExists(table):
        mkdirs(spark, root)
        spark.sql(f"CREATE TABLE {table} ({_ddl_columns()}) USING {fmt} {opts} "
                  f"PARTITIONED BY (year, month, day, hour) LOCATION '{root}'")
        spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    return table


def read_table(spark: SparkSession, table: str, with_file: bool = False) -> DataFrame:
    return _with_file(spark.table(table), with_file)
