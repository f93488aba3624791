"""U1 + D4: snapshots of the cold tier.

Compaction never touches what readers see: it writes its hours under a new run (``year=/month=/day=/hour=/run=``), then
publishes a new version of the pointer table (hour -> run), a few rows in a folder that appears by one rename.  A reader takes
one version when its DataFrame is made and keeps it: an hour that is compacted meanwhile is read from its old run, each row
once.  Two publishers can't overwrite each other: the rename fails where the version exists, and the loser builds on the
winner's.  An interrupted compaction leaves a run that no version names.  ``vacuum`` removes runs that only old versions name.

The pointer table has one row per hour (8,760 a year), so broadcasting it is bounded by the calendar.  The rename is atomic
on HDFS and local or mounted file systems; on an object store that copies instead, use one publisher."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from edgelog.operators.layout import by_path
from edgelog.schema import ALL_COLUMNS, FULL_SCHEMA, PARTITION_KEYS
from edgelog.session import mkdirs, path_exists, remove_path

POINTER = "year string, month string, day string, hour string, run string"
_RUN_SCHEMA = StructType([*FULL_SCHEMA.fields, StructField("run", StringType())])


def _pointer(root: str, version: int) -> str:
    return f"{root}/_versions/v{version:012d}"


def _names(spark: SparkSession, folder: str) -> list[str]:
    if not path_exists(spark, folder):
        return []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return [s.getPath().getName() for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]


def current_version(spark: SparkSession, root: str) -> int:
    """Number of the newest published version; 0 before the first."""
    return max((int(n[1:]) for n in _names(spark, f"{root}/_versions") if n.startswith("v")), default=0)


def pointers(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.schema(POINTER).parquet(_pointer(root, version)) if version else spark.createDataFrame([], POINTER)


def _publish(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a finished folder; False if the target exists."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    path, kind = jvm.org.apache.hadoop.fs.Path, getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(kind, 1)
    options[0] = kind.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(path(source), path(target), options)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise
    return True


def publish_hours(rows: DataFrame, root: str, mode: str = "overwrite") -> int:
    """Write ``rows`` (whole hours) as a new run and publish it; returns the version."""
    if mode != "overwrite":
        raise ValueError("a version replaces whole hours")
    spark, run = rows.sparkSession, uuid.uuid4().hex
    (by_path(rows).withColumn("run", F.lit(run)).write.mode("append")
     .option("compression", "snappy").partitionBy(*PARTITION_KEYS, "run").parquet(root))
    fresh = spark.read.schema(_RUN_SCHEMA).parquet(root).where(F.col("run") == run).select(*PARTITION_KEYS, "run").distinct()
    staged = f"{root}/_versions/_new-{run}"
    while True:
        base = current_version(spark, root)
        kept = pointers(spark, root, base).join(F.broadcast(fresh.select(*PARTITION_KEYS)), PARTITION_KEYS, "left_anti")
        kept.unionByName(fresh).coalesce(1).write.mode("overwrite").parquet(staged)
        if _publish(spark, staged, _pointer(root, base + 1)):
            return base + 1


def cold_rows(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The tier as of a version (the newest if none is given), fixed when this is called."""
    version = current_version(spark, root) if version is None else version
    if not version:
        mkdirs(spark, root)
    rows = spark.read.schema(_RUN_SCHEMA).parquet(root)
    return rows.join(F.broadcast(pointers(spark, root, version)), [*PARTITION_KEYS, "run"], "left_semi").select(*ALL_COLUMNS)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove versions before the last ``keep`` and the runs that only those name; returns the removed folders."""
    versions = sorted(int(n[1:]) for n in _names(spark, f"{root}/_versions") if n.startswith("v"))
    old, kept = versions[:-keep], versions[-keep:]
    if not old:
        return []
    named = [spark.read.schema(POINTER).parquet(*[_pointer(root, v) for v in some]).distinct() for some in (old, kept)]
    gone = named[0].join(named[1], [*PARTITION_KEYS, "run"], "left_anti").collect()  # hours replaced since: calendar entries
    folders = [f"{root}/" + "/".join(f"{k}={r[k]}" for k in (*PARTITION_KEYS, "run")) for r in gone]
    for folder in [*folders, *(_pointer(root, v) for v in old)]:
        remove_path(spark, folder)
    return folders
