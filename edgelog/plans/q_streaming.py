"""Query keys of the streaming forms (T1, T4, T6); each equals its batch twin."""

from __future__ import annotations


from pyspark.sql import functions as F

from edgelog.functions.timekeys import ntz_as_utc_instant
from edgelog.operators.alarms import AlarmSpec
from edgelog.operators.metrics import metric_samples
from edgelog.plans.q_metrics import BREACHING_SQL
from edgelog.streaming.alarms import evaluate_stream
from edgelog.streaming.delivery import start_delivery
from edgelog.operators.notify import notifications as accepted
from edgelog.plans.lake import lake_for
from edgelog.plans.oracle import DATA_COLS, LOG_CTE
from edgelog.plans.q_events import NOTIFICATIONS_SQL, topic_messages
from edgelog.plans.registry import register
from edgelog.schema import ALL_COLUMNS
from edgelog.session import scratch_path
from edgelog.sources.accesslog import read_hot
from edgelog.sources.arrivals import stage_arrivals
from edgelog.sources.eventsrc import envelopes
from edgelog.sources.fixture import access_log
from edgelog.sources.tables import table
from edgelog.streaming.metrics import start_windowed, start_windowed_with_late, windowed_counts
from edgelog.streaming.notify import start_notifications


def _run(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


@register("stream_ingest", LOG_CTE + "SELECT " + DATA_COLS.format(rid="result_id") + " FROM log")
def stream_ingest(spark, sf):
    """The delivered files streamed into a fresh hot tier, read back whole."""
    lake = lake_for(spark, sf)
    run = scratch_path(spark, "stream_ingest")
    _run(start_delivery(spark, lake.root, f"{run}/hot", f"{run}/manifest", f"{run}/_checkpoint"))
    return read_hot(spark, f"{run}/hot").select(*ALL_COLUMNS)


def _deliver(spark, staged: str, new: str) -> None:
    """Move staged ``f=<name>/part-*`` files to where a log delivery puts them: flat, one or three folders deep, the
    delivered name first.  A fixture step over file names; no data passes the driver."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for i, folder in enumerate(sorted(s.getPath().toString() for s in fs.listStatus(path(staged)) if s.isDirectory())):
        target = f"{new}/" + ("", "a/", "a/b/c/")[i % 3]
        fs.mkdirs(path(target))
        for s in fs.listStatus(path(folder)):
            if not s.getPath().getName().startswith((".", "_")):
                name = folder.rsplit("f=", 1)[1] + "." + s.getPath().getName()
                fs.rename(s.getPath(), path(target + name))


@register("stream_ingest_flat", LOG_CTE + "SELECT " + DATA_COLS.format(rid="result_id") + " FROM log")
def stream_ingest_flat(spark, sf):
    """T1/S3 as an object store delivers: files directly under ``new/`` and one and three folders below."""
    run = scratch_path(spark, "stream_flat")
    stage_arrivals(access_log(spark, sf), f"{run}/staged", mode="overwrite")
    _deliver(spark, f"{run}/staged", f"{run}/new")
    _run(start_delivery(spark, run, f"{run}/hot", f"{run}/manifest", f"{run}/_checkpoint"))
    return read_hot(spark, f"{run}/hot").select(*ALL_COLUMNS)


@register("stream_metric_1m", """
SELECT * FROM (
  SELECT date_trunc('minute', ts) AS bucket, event_type AS metric, count(*) AS samples, round(sum(value), 6) AS total
  FROM events GROUP BY 1, 2) w
WHERE bucket + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 15 MINUTE""")
def stream_metric_1m(spark, sf):
    """T4: closed 1-minute windows (end <= max(ts) - 15 min) from a stream."""
    run = scratch_path(spark, "stream_metric")
    src = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf.rstrip('/')}/events.parquet*")
    stream = windowed_counts(metric_samples(src).select("metric", "ts", "value"))
    _run(start_windowed(stream, f"{run}/out", f"{run}/_checkpoint"))
    return spark.read.parquet(f"{run}/out").withColumn("total", F.round("total", 6))


@register("stream_metric_late", """
WITH shown AS (SELECT event_type AS metric, ts, value, least(day(ts + to_hours(CAST(event_id % 7 AS INT) * 10)) // 11, 2) AS number FROM events),
marks AS (SELECT n AS number, (SELECT max(ts) FROM shown s WHERE s.number < n) - INTERVAL 15 MINUTE AS mark FROM range(3) t(n)),
rows AS (SELECT date_trunc('minute', ts) AS bucket, metric, value,
           coalesce(date_trunc('minute', ts) + INTERVAL 1 MINUTE <= mark, false) AS late FROM shown JOIN marks USING (number))
SELECT bucket, metric, count(*) FILTER (WHERE NOT late) AS samples, round(sum(value) FILTER (WHERE NOT late), 6) AS total,
  count(*) FILTER (WHERE late) AS late
FROM rows WHERE bucket + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 15 MINUTE GROUP BY 1, 2""")
def stream_metric_late(spark, sf):
    """T4 over three deliveries, dealt by the day of the month on which a row shows up, so that many come days or weeks behind:
    per closed window what was counted and what came too late."""
    run = scratch_path(spark, "stream_metric_late")
    events = table(spark, sf, "events")
    shown = F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 7).cast("int") * 10)
    number = F.least(F.floor(F.dayofmonth(shown) / 11), F.lit(2))
    for i in range(3):
        events.where(number == i).write.mode("append").parquet(f"{run}/in")
        src = spark.readStream.schema(events.schema).parquet(f"{run}/in")
        _run(start_windowed_with_late(metric_samples(src).select("metric", "ts", "value"), f"{run}/out", f"{run}/_checkpoint"))
    late = spark.read.parquet(f"{run}/out/late").groupBy("bucket", "metric").agg(F.count("*").alias("late"))
    closed = spark.read.parquet(f"{run}/out/closed").drop("batch")
    return closed.join(late, ["bucket", "metric"], "full").select(
        "bucket", "metric", F.coalesce("samples", F.lit(0)).alias("samples"), F.round("total", 6).alias("total"),
        F.coalesce("late", F.lit(0)).alias("late"))


@register("stream_notifications", NOTIFICATIONS_SQL)
def stream_notifications(spark, sf):
    """Envelopes as a stream -> the same notifications as the batch form."""
    run = scratch_path(spark, "stream_notify")
    envelopes(topic_messages_raw(spark, sf)).write.json(f"{run}/in")
    _run(start_notifications(spark, f"{run}/in", f"{run}/out", f"{run}/_checkpoint"))
    return accepted(spark.read.parquet(f"{run}/out").drop("batch_id"))


@register("doubled_messages", NOTIFICATIONS_SQL)
def doubled_messages(spark, sf):
    """Every envelope delivered twice, in batches of one file; each message becomes one record."""
    run = scratch_path(spark, "stream_doubled")
    envs = envelopes(topic_messages_raw(spark, sf)).repartition(3)
    for _ in range(2):
        envs.write.mode("append").json(f"{run}/in")
    _run(start_notifications(spark, f"{run}/in", f"{run}/out", f"{run}/_checkpoint", files_per_batch=1))
    return accepted(spark.read.parquet(f"{run}/out").drop("batch_id"))


def topic_messages_raw(spark, sf):
    """Published messages (before envelope delivery) as (msg_id, message)."""
    return topic_messages(spark, sf).select("msg_id", "message")


@register("stream_alarm_transitions", "SELECT * FROM (" + BREACHING_SQL + """) t
WHERE bucket + INTERVAL 15 MINUTE <= (SELECT max(date_trunc('hour', ts)) FROM events
  WHERE date_trunc('hour', ts) + INTERVAL 75 MINUTE <= (SELECT max(ts) FROM events))""")
def stream_alarm_transitions(spark, sf):
    """T5: hourly event counts as a stream of closed windows (T4 job), fed to the stateful alarm operator (second job),
    both with T4's delay of 15 minutes.  The events come in three deliveries, each out of order by up to 14 minutes; after each
    one both jobs run until they have read all, so state and watermarks go through two restarts.  Equals the batch W1-W3 on every hour
    that the second watermark has passed (the delay keeps the newest closed hour back)."""
    run = scratch_path(spark, "stream_alarm")
    events = table(spark, sf, "events")
    late = events.withColumn("_shown", F.col("ts") + F.make_dt_interval(secs=F.pmod(F.xxhash64("event_id"), F.lit(841)).cast("double")))
    cuts = late.agg(F.min("_shown").alias("a"), F.max("_shown").alias("b")).first()
    bounds = [] if cuts.a is None else [cuts.a + (cuts.b - cuts.a) * i / 3 for i in (1, 2)]
    number = sum(((F.col("_shown") >= F.lit(b)).cast("int") for b in bounds), F.lit(0))
    spec = AlarmSpec("hourly-events", "1 hour", ">=", 5, 3, "BREACHING")
    for i in range(len(bounds) + 1):
        late.where(number == i).select(events.columns).write.mode("append").parquet(f"{run}/in")
        src = spark.readStream.schema(events.schema).parquet(f"{run}/in")
        hourly = windowed_counts(metric_samples(src).select("metric", "ts", "value"), period="1 hour")
        _run(start_windowed(hourly, f"{run}/closed", f"{run}/_ckpt_closed"))
        # second job: closed windows as a file stream; its watermark drives the gap-filling timeouts
        closed = (spark.readStream.schema("bucket timestamp_ntz, metric string, samples long, total double")
                  .parquet(f"{run}/closed").select("metric", ntz_as_utc_instant(F.col("bucket")).alias("bucket"),
                                                   F.col("samples").alias("value"))
                  .withWatermark("bucket", "15 minutes"))
        _run(evaluate_stream(closed, spec, 3600).writeStream.format("parquet").option("path", f"{run}/out")
             .option("checkpointLocation", f"{run}/_ckpt_alarm").outputMode("append").trigger(availableNow=True).start())
    return spark.read.parquet(f"{run}/out")
