"""Helpers shared by the operators: shared-folder tables, row keys, batches, per-worker caches."""

from __future__ import annotations

import atexit
import re
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from edgelog.session import shared_dir

BATCH_BYTES = 1 << 18
"""Texts are handled in slices of about this many bytes (never less than one whole text)."""


ROWS_PER_CHUNK = 20_000


def bounded_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Arrow batches for long texts: the default of 10,000 rows would take a worker and the JVM tens of MB per task or,
    where long texts meet, GB.  Settings that are stricter already stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        number, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", spark.conf.get(key).strip().lower()).groups()
        if not 0 < int(number) << 10 * " kmgt".index(unit or " ") <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_folders: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    """The application's stored tables go when its driver ends."""
    if spark.sparkContext._jsc is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _drop(spark: SparkSession, name: str) -> None:
    if spark.sparkContext._jsc is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _shared(spark: SparkSession) -> str:
    folder = f"{shared_dir(spark)}/edgelog-llm/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: later stages start from files every executor can
    reach, so a lost executor costs no recomputation and each expensive pass runs once.  The tables go when the
    driver ends."""
    spark = df.sparkSession
    folder = _shared(spark)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_buckets(df: DataFrame, label: str, column: str) -> DataFrame:
    """As ``stored``, and bucketed by ``column``: what later groups or joins by that column stays where it is."""
    spark = df.sparkSession
    name = f"edgelog_llm_{label.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions()),
                  int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    df.write.option("compression", "zstd").option("path", f"{_shared(spark)}/{name}").bucketBy(buckets, column).saveAsTable(name)
    atexit.register(_drop, spark, name)
    return spark.table(name)


def row_key(df: DataFrame, column: str = "_row") -> DataFrame:
    """A key per row (repeated ids stay apart) for one evaluation.  How files are cut into tasks decides it, and that may
    change between passes (an executor more or less): what is read twice takes ``keyed``."""
    return df.withColumn(column, F.monotonically_increasing_id())


def keyed(df: DataFrame, column: str = "_row") -> DataFrame:
    """The rows with a key each, stored once: every pass reads the same keys."""
    return stored(row_key(df, column), "keyed")


def crc_mod(column: str, n: int):
    """crc32 of the value as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit_bytes: int = 16 << 20) -> DataFrame:
    """Broadcast hint only where the counted rows stay under a fixed size; else the planner shuffles."""
    return F.broadcast(df) if rows * row_bytes <= limit_bytes else df


def with_slots(df: DataFrame, group: str, order: list[str], rows: int) -> DataFrame:
    """Gapless positions ``slot`` from 0 inside each group.

    A group may hold any share of all rows, so no task takes a whole group: rows are dealt by hash into chunks of
    about ROWS_PER_CHUNK, numbered inside (group, chunk), and moved up by the sizes of the group's earlier chunks (a
    window over one small row per group and chunk).
    """
    chunks = max(16, -(-rows // ROWS_PER_CHUNK))
    dealt = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    before = (dealt.groupBy(F.col(group).alias("_s"), F.col("_chunk").alias("_c")).agg(F.count("*").alias("_n"))
              .withColumn("_before", F.sum("_n").over(W.partitionBy("_s").orderBy("_c")) - F.col("_n")))
    numbered = dealt.withColumn("_at", F.row_number().over(W.partitionBy(group, "_chunk").orderBy(*order)) - 1)
    joined = numbered.join(before, (numbered[group] == before["_s"]) & (numbered["_chunk"] == before["_c"]))
    return joined.withColumn("slot", (F.col("_at") + F.col("_before")).cast("long")).select(*df.columns, "slot")


def worker_cache(key: str, build: Callable):
    """One object per Python worker process, kept across its tasks."""
    kept = sys.__dict__.setdefault("_edgelog_llm_cache", {})
    if key not in kept:
        kept[key] = build()
    return kept[key]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an Arrow column and their offsets (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut record batches into runs of whole rows of about ``limit`` text bytes: (rows, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), data[offsets[at]: offsets[to]], offsets[at: to + 1] - offsets[at]
            at = to
    pa.default_memory_pool().release_unused()  # a worker lives on; what its task needed goes back


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Arrow list column of consecutive runs of ``values``."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, label_name: str) -> DataFrame:
    """Stored (text, y) of at most ``rows`` labelled documents, drawn by hash of the id so that the choice doesn't depend
    on order or partitions.  A document with several labels counts with the highest; null labels don't count; of documents
    with one id the smallest text counts."""
    chosen = (labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("y"))
              .orderBy(F.xxhash64("_id"), "_id").limit(rows))
    texts = docs.select(F.col("doc_id").alias("_doc"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_id", "y").agg(F.min("text").alias("text"))
    return stored(texts.select("text", "y"), label_name)
