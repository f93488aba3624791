"""Query keys of multi-line log stitching."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgelog.operators import stitch as L
from edgelog.plans.lake import build_lock
from edgelog.plans.registry import register
from edgelog.session import has_marker, input_tag, work_path, write_marker
from edgelog.sources.catalog import mirror_catalog
from edgelog.sources.fixture import access_log
from edgelog.sources.records import read_records, with_record_numbers
from edgelog.sources.tables import table
from edgelog.sources.textlogs import write_sync_logs


def _logs_root(spark, sf, kind):
    return work_path(spark, "textlogs", input_tag(spark, sf, kind, "v5"))


def _sync_logs(spark, sf):
    root = _logs_root(spark, sf, "sync")
    with build_lock(root):
        if not has_marker(spark, root):
            write_sync_logs(table(spark, sf, "events"), root)
            write_marker(spark, root)
    return root


SYNC_SQL = r"""WITH lines AS (
  SELECT ['pypi', 'debian', 'ubuntu'][user_id % 3 + 1] AS mirror, strftime(ts, '%Y%m%d') AS day, ts, event_id,
         unnest(generate_series(0, event_id % 3)) AS line_no, event_id % 3 AS n_cont,
         strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || ' INFO '
           || event_type || ' user=' || user_id AS start_line
  FROM events),
l2 AS (SELECT mirror, day, ts, event_id, line_no,
         CASE WHEN line_no = 0 THEN start_line ELSE '    detail ' || line_no || ' of event ' || event_id END AS line
       FROM lines),
recs AS (
  SELECT mirror, day, ts, event_id, min(line_no) AS first_line, string_agg(line, chr(10) ORDER BY line_no) AS record,
         count(*) AS n_lines
  FROM l2 WHERE mirror = 'pypi' GROUP BY mirror, day, ts, event_id
  UNION ALL
  SELECT mirror, day, ts, event_id, line_no, line, 1 FROM l2 WHERE mirror <> 'pypi')
SELECT mirror, day, CAST(row_number() OVER (PARTITION BY mirror, day ORDER BY ts, event_id, first_line) - 1 AS INT) AS record_no,
       record, CAST(n_lines AS INT) AS n_lines,
       CASE WHEN mirror = 'pypi' THEN CAST(strptime(substr(record, 1, 19), '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) END AS ts,
       'sync/mirrors/' || mirror AS log_group
FROM recs"""


@register("stitched_log_records", SYNC_SQL)
def stitched_log_records(spark, sf):
    """L1 + L3 + L4: sync-job logs stitched by each mirror's start pattern
    (from the catalog; mirrors without one give one record per line)."""
    root = _sync_logs(spark, sf)
    patterns = {r["name"]: r["log_start_pattern"] for r in mirror_catalog(spark).select("name", "log_start_pattern").collect()}  # 54 rows
    recs = with_record_numbers(spark, root, read_records(spark, root, patterns)).where("record != ''")
    return recs.select(
        "mirror", F.regexp_extract("log", r"day=(\d+)", 1).alias("day"), "record_no", "record", "n_lines",
        F.when(F.col("mirror").isin([m for m, p in patterns.items() if p]), L.sync_timestamp(F.col("record"))).alias("ts"),
        L.log_group("sync", F.col("mirror")).alias("log_group"))


def _container_logs(spark, sf):
    """Content-server access lines (combined log format) from the access log,
    in hourly folders; range partitioning splits a busy hour over several
    files, which stitching takes as one log."""
    root = _logs_root(spark, sf, "container")
    with build_lock(root):
        _write_container_logs(spark, sf, root)
    return root


def _write_container_logs(spark, sf, root):
    if not has_marker(spark, root):
        log = access_log(spark, sf)
        line = F.format_string('%s - - [%s +0000] "%s %s HTTP/1.1" %d %d', F.col("request_ip"),
                               F.date_format(F.to_timestamp_ntz(F.concat(F.col("date").cast("string"), F.lit(" "), F.col("time"))),
                                             "dd/MMM/yyyy:HH:mm:ss"),
                               F.col("method"), F.col("uri"), F.col("status"), F.col("bytes"))
        (log.select(line.alias("line"), F.concat("year", "month", "day", "hour").alias("hour"), "time", "result_id")
         .withColumn("mirror", F.lit("content-server"))
         .repartitionByRange("hour", "time", "result_id").sortWithinPartitions("hour", "time", "result_id")
         .select("line", "mirror", "hour").write.mode("overwrite").partitionBy("mirror", "hour").text(root))
        write_marker(spark, root)


@register("container_log_records", r"""
WITH log AS (SELECT * FROM events)
SELECT strftime(ts, '%Y%m%d%H') AS hour, CAST(count(*) AS BIGINT) AS records,
       CAST(min(date_trunc('second', ts)) AS TIMESTAMP) AS first_ts, CAST(max(date_trunc('second', ts)) AS TIMESTAMP) AS last_ts
FROM events GROUP BY 1""")
def container_log_records(spark, sf):
    """L2 + L3: container access lines stitched on the bracketed timestamp,
    parsed to UTC, summarised per hourly file."""
    recs = read_records(spark, _container_logs(spark, sf), {"": L.CONTAINER_START}, anchored=False).where("record != ''")
    recs = recs.withColumn("ts", L.container_timestamp(F.col("record")))
    return (recs.groupBy(F.regexp_extract("log", r"hour=(\d+)", 1).alias("hour"))
            .agg(F.count("*").alias("records"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))


@register("container_stack_traces", r"""
SELECT strftime(ts, '%Y%m%d%H') AS hour, event_id, CAST(1 + event_id % 4 AS INT) AS n_lines,
       '10.0.0.1 - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "GET /' || event_type || ' HTTP/1.1" 500 ' || event_id
         || CASE WHEN event_id % 4 > 0 THEN chr(10) || array_to_string(list_transform(generate_series(1, event_id % 4),
              lambda k: '  at frame ' || k || ' of ' || event_id), chr(10)) ELSE '' END AS record,
       CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts
FROM events""")
def container_stack_traces(spark, sf):
    """L2 + L3 on records with continuation lines: server errors whose stack trace follows the access line, with their text.
    Ranges of 64 KiB, so records go on over cuts and files."""
    root = _logs_root(spark, sf, "traces")
    with build_lock(root):
        if not has_marker(spark, root):
            eid = F.col("event_id").cast("string")
            first = F.format_string('10.0.0.1 - - [%s +0000] "GET /%s HTTP/1.1" 500 %s', F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), "event_type", eid)
            frames = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.concat(F.lit("  at frame "), k.cast("string"), F.lit(" of "), eid))
            order = ["hour", "ts", "event_id", "at"]
            (table(spark, sf, "events").withColumn("hour", F.date_format("ts", "yyyyMMddHH"))
             .select("hour", "ts", "event_id", F.posexplode(F.concat(F.array(first), F.slice(frames, 1, (F.col("event_id") % 4).cast("int")))).alias("at", "line"))
             .repartitionByRange(*order).sortWithinPartitions(*order)
             .select("line", F.lit("content-server").alias("mirror"), "hour").write.mode("overwrite").partitionBy("mirror", "hour").text(root))
            write_marker(spark, root)
    recs = read_records(spark, root, {"": L.CONTAINER_START}, anchored=False, range_bytes=1 << 16)
    return recs.select(F.regexp_extract("log", r"hour=(\d+)", 1).alias("hour"), F.regexp_extract("record", r'" 500 (\d+)', 1).cast("long").alias("event_id"),
                       "n_lines", "record", L.container_timestamp(F.col("record")).alias("ts"))
