"""Session construction and the shared working folder.

On a cluster the shared folder comes from ``spark.checkpoint.dir`` (set by the
cluster operator to a distributed file system path).  Only when that setting is
absent (local tests) do we create one of our own.
"""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "edgelog", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Sets our own checkpoint folder only where a local session has none (tests).
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        path = tempfile.mkdtemp(prefix="edgelog-ckpt-")
        sc.setCheckpointDir(path)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def work_path(spark: SparkSession, *parts: str) -> str:
    return "/".join([shared_dir(spark), "edgelog", *parts])


_scratch: set[str] = set()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder for one run's output; all of them go when the driver ends."""
    top = work_path(spark, "scratch", spark.sparkContext.applicationId)
    if top not in _scratch:
        _scratch.add(top)
        atexit.register(remove_path, spark, top)
    return f"{top}/{label}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through Hadoop's FileSystem so it works on any FS."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def path_stamp(spark: SparkSession, path: str) -> str:
    """Size and time of a file or folder (with its files): changes when the table behind a path does."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = [(s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(hpath)]
    return str(sorted(parts))


def input_tag(spark: SparkSession, sf_dir: str, *names: str) -> str:
    """Identifier of derived data: the input folder, what its ``events`` and ``part`` hold, and further names."""
    inputs = [path_stamp(spark, f"{sf_dir.rstrip('/')}/{t}.parquet") for t in ("events", "part")]
    return hashlib.sha1("|".join([sf_dir.rstrip("/"), *inputs, *names]).encode()).hexdigest()[:16]


def mkdirs(spark: SparkSession, path: str) -> None:
    """Create a folder through Hadoop's FileSystem (any FS the cluster uses)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hpath)


def write_marker(spark: SparkSession, path: str) -> None:
    """Completion marker ``<path>/_READY`` written after a derived dataset is
    complete (``_SUCCESS`` is not reliable: dynamic partition overwrite commits
    through a staging folder and leaves none)."""
    spark.createDataFrame([("ready",)], "s string").coalesce(1).write.mode("overwrite").json(f"{path}/_READY")


def has_marker(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/_READY")
