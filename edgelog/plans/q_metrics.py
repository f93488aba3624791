"""Query keys of the operations metrics (A5-A12) and alarms."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgelog.operators import alarms as AL
from edgelog.operators import metrics as M
from edgelog.plans.oracle import LOG_CTE
from edgelog.plans.registry import register
from edgelog.session import scratch_path
from edgelog.sources.fixture import access_log
from edgelog.sources.tables import table

SAMPLES_CTE = """WITH samples AS (
  SELECT event_type AS metric, ts, value, 'ami-'||(user_id%3) AS image, 'i-'||user_id AS instance,
         CASE WHEN user_id%2=0 THEN 'c5.large' ELSE 'c5.xlarge' END AS type, 'asg-'||(user_id%4) AS grp
  FROM events)
"""


def _samples(spark, sf):
    return M.metric_samples(table(spark, sf, "events"))


@register("metric_sum_1m", SAMPLES_CTE + """
SELECT date_trunc('minute', ts) AS bucket, metric, instance, round(sum(value), 6) AS value
FROM samples GROUP BY ALL""")
def metric_sum_1m(spark, sf):
    """A5: Sum per 1-minute period and (metric, instance) dimension."""
    r = M.windowed_stat(_samples(spark, sf), "1 minute", "Sum", keys=["metric", F.col("dims.instance").alias("instance")])
    return r.withColumn("value", F.round("value", 6))


@register("metric_avg_1m", SAMPLES_CTE + """
SELECT date_trunc('minute', ts) AS bucket, metric, round(avg(value), 6) AS value
FROM samples WHERE grp = 'asg-1' GROUP BY ALL""")
def metric_avg_1m(spark, sf):
    """A6 + A11: Average per minute, filtered on one dimension value."""
    r = M.windowed_stat(_samples(spark, sf), "1 minute", "Average", where=F.col("dims.grp") == "asg-1")
    return r.withColumn("value", F.round("value", 6))


@register("metric_samples_1m", SAMPLES_CTE + """
SELECT date_trunc('minute', ts) AS bucket, metric, count(value) AS value FROM samples GROUP BY ALL""")
def metric_samples_1m(spark, sf):
    """SampleCount per minute."""
    return M.windowed_stat(_samples(spark, sf), "1 minute", "SampleCount")


@register("metric_rollup", SAMPLES_CTE + """
SELECT metric, date_trunc('hour', ts) AS bucket, image, instance, type, grp,
       CAST(grouping(image, instance, type, grp) AS BIGINT) AS gid, round(sum(value), 6) AS value
FROM samples
GROUP BY GROUPING SETS ((metric, date_trunc('hour', ts), image, instance, type, grp), (metric, date_trunc('hour', ts), grp))""")
def metric_rollup(spark, sf):
    """A10: per full dimension set and per group alone, hourly Sum."""
    return M.dimension_rollup(_samples(spark, sf), "1 hour", "Sum").withColumn("value", F.round("value", 6))


GRAINS = {"hour": ["image", "instance", "type", "grp"], "day": ["grp"], "month": []}  # grain -> dimensions that it keeps


def _grain_sql(grain: str, dims: list[str]) -> str:
    kept = ", ".join(d if d in dims else f"CAST(NULL AS VARCHAR) AS {d}" for d in M.DIMENSIONS)
    return f"""SELECT '{grain}' AS grain, metric, CAST(date_trunc('{grain}', ts) AS TIMESTAMP) AS bucket, {kept}, count(value) AS samples,
  round(sum(value), 6) AS total, round(avg(value), 6) AS average, min(value) AS least, max(value) AS most FROM samples GROUP BY ALL"""


@register("metric_rollup_grains", SAMPLES_CTE + " UNION ALL ".join(_grain_sql(g, d) for g, d in GRAINS.items()))
def metric_rollup_grains(spark, sf):
    """A10 + A6 from stored partials: the samples are read once, at the minute grain of all dimensions; hours come from the
    minutes, days per group from the hours, months per metric from the days, each with all five statistics."""
    path = f"{scratch_path(spark, 'metric_partials')}/minute"
    M.partials(_samples(spark, sf), "1 minute", ["metric", *[F.col(f"dims.{d}").alias(d) for d in M.DIMENSIONS]]).write.parquet(path)
    hours = M.merge_partials(spark.read.parquet(path), "1 hour", ["metric", *GRAINS["hour"]])
    days = M.merge_partials(hours, "1 day", ["metric", *GRAINS["day"]])
    months = days.withColumn("bucket", F.trunc("bucket", "month").cast("timestamp_ntz"))
    months = M.merge_partials(months, "1 day", ["metric"])  # the first day of the month stands for it
    parts = None
    for grain, df in zip(GRAINS, (hours, days, months)):
        dims = [F.col(d) if d in GRAINS[grain] else F.lit(None).cast("string").alias(d) for d in M.DIMENSIONS]
        out = df.select(F.lit(grain).alias("grain"), "metric", "bucket", *dims, F.col("n").alias("samples"), F.round("total", 6).alias("total"),
                        F.round(M.partial_stat("Average"), 6).alias("average"), "least", "most")
        parts = out if parts is None else parts.unionByName(out)
    return parts


@register("http_class_per_minute", LOG_CTE + """
SELECT "date"||' '||substr("time", 1, 5) AS minute,
  count(*) FILTER (WHERE status BETWEEN 200 AND 299) AS http_2xx,
  count(*) FILTER (WHERE status BETWEEN 300 AND 399) AS http_3xx,
  count(*) FILTER (WHERE status BETWEEN 400 AND 499) AS http_4xx,
  count(*) FILTER (WHERE status BETWEEN 500 AND 599) AS http_5xx
FROM log GROUP BY 1""")
def http_class_per_minute(spark, sf):
    """Response classes per minute over the access log."""
    return M.http_class_counts(access_log(spark, sf))


@register("bytes_per_minute", LOG_CTE + """
SELECT "date"||' '||substr("time", 1, 5) AS minute, CAST(sum(bytes) AS BIGINT) AS bytes FROM log GROUP BY 1""")
def bytes_per_minute(spark, sf):
    """Processed bytes per minute."""
    return M.bytes_per_minute(access_log(spark, sf))


ERRORS_CTE = """WITH errors AS (
  SELECT CASE WHEN user_id%3=0 THEN 'transform-partition' WHEN user_id%3=1 THEN 'create-partitions'
              ELSE 'move-access-logs' END AS function, ts, 1 AS errors
  FROM events WHERE event_type = 'error')
"""


@register("errors_per_hour", ERRORS_CTE + """
SELECT function, date_trunc('hour', ts) AS bucket, CAST(sum(errors) AS BIGINT) AS errors FROM errors GROUP BY ALL""")
def errors_per_hour(spark, sf):
    """Function errors per hour."""
    return M.errors_per_hour(M.function_errors(table(spark, sf, "events")))


def _hourly_counts(spark, sf):
    ev = table(spark, sf, "events")
    return (ev.groupBy(F.col("event_type").alias("metric"), M.bucket_start(F.col("ts"), "1 hour").alias("bucket"))
            .agg(F.count("*").alias("value")))


ALARM_SQL = """WITH series AS (
  SELECT event_type AS metric, date_trunc('hour', ts) AS bucket, count(*) AS value FROM events GROUP BY ALL),
spans AS (SELECT metric, min(bucket) AS first FROM series GROUP BY metric),
grid AS (SELECT metric, unnest(generate_series(first, (SELECT max(bucket) FROM series), INTERVAL 1 HOUR)) AS bucket FROM spans),
filled AS (SELECT g.metric, g.bucket, s.value FROM grid g LEFT JOIN series s USING (metric, bucket)),
evald AS (
  SELECT metric, bucket, value,
    sum(CAST({breach} AS INT)) OVER (PARTITION BY metric ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS breaches,
    count(value) OVER (PARTITION BY metric ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS present
  FROM filled),
stated AS ({stated}),
trans AS (SELECT metric, bucket, coalesce(lag(state) OVER (PARTITION BY metric ORDER BY bucket), 'OK') AS previous, state, value FROM stated)
SELECT metric, bucket, previous, state, value FROM trans WHERE state <> previous"""

BREACHING_SQL = ALARM_SQL.format(
    breach="CASE WHEN value IS NULL THEN TRUE ELSE value >= 5 END",
    stated="SELECT metric, bucket, value, CASE WHEN breaches = 3 THEN 'ALARM' ELSE 'OK' END AS state FROM evald")
IGNORE_SQL = ALARM_SQL.format(
    breach="value >= 3",
    stated="SELECT metric, bucket, value, coalesce(last_value(CASE WHEN present < 3 THEN NULL WHEN breaches = 3 THEN 'ALARM' "
           "ELSE 'OK' END IGNORE NULLS) OVER (PARTITION BY metric ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING "
           "AND CURRENT ROW), 'OK') AS state FROM evald")


def _clock(spark, sf, period):
    """The evaluation clock of the fixture: the period of the last event (one narrow column, not the samples again)."""
    return table(spark, sf, "events").agg(F.max("ts").alias("ts")).select(M.bucket_start(F.col("ts"), period)).scalar()


def _last_event(spark, sf):
    return table(spark, sf, "events").agg(F.max("ts")).scalar()


@register("alarm_transitions_breaching", BREACHING_SQL)
def alarm_transitions_breaching(spark, sf):
    """W1+W2+W3: hourly count per event type >= 5 (missing = breach), 3 of 3."""
    spec = AL.AlarmSpec("hourly-events", "1 hour", ">=", 5, 3, "BREACHING")
    return AL.alarm_transitions(_hourly_counts(spark, sf), ["metric"], spec, _clock(spark, sf, "1 hour"))


@register("alarm_transitions_ignore", IGNORE_SQL)
def alarm_transitions_ignore(spark, sf):
    """W1+W2+W3 with the IGNORE policy: threshold 3, 3 of 3."""
    spec = AL.AlarmSpec("hourly-events", "1 hour", ">=", 3, 3, "IGNORE")
    return AL.alarm_transitions(_hourly_counts(spark, sf), ["metric"], spec, _clock(spark, sf, "1 hour"))


def _function_alarm_sql(fn, alarm, missing, n, thr):
    breach = f"CASE WHEN value IS NULL THEN TRUE ELSE value >= {thr} END" if missing == "BREACHING" else f"value >= {thr}"
    if missing == "BREACHING":
        state = f"CASE WHEN breaches = {n} THEN 'ALARM' ELSE 'OK' END"
    else:
        state = (f"coalesce(last_value(CASE WHEN present < {n} THEN NULL WHEN breaches = {n} THEN 'ALARM' ELSE 'OK' END "
                 "IGNORE NULLS) OVER (PARTITION BY function ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'OK')")
    return f"""SELECT * FROM (
  WITH series AS (SELECT function, date_trunc('hour', ts) AS bucket, CAST(sum(errors) AS BIGINT) AS value
                  FROM errors WHERE function = '{fn}' GROUP BY ALL),
  grid AS (SELECT function, unnest(generate_series(min(bucket), (SELECT date_trunc('hour', max(ts)) FROM events), INTERVAL 1 HOUR)) AS bucket
           FROM series GROUP BY function),
  filled AS (SELECT g.function, g.bucket, s.value FROM grid g LEFT JOIN series s USING (function, bucket)),
  evald AS (SELECT function, bucket, value,
      sum(CAST({breach} AS INT)) OVER (PARTITION BY function ORDER BY bucket ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS breaches,
      count(value) OVER (PARTITION BY function ORDER BY bucket ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS present
    FROM filled),
  stated AS (SELECT function, bucket, value, {state} AS state FROM evald),
  trans AS (SELECT function, bucket, coalesce(lag(state) OVER (PARTITION BY function ORDER BY bucket), 'OK') AS previous,
                   state, value FROM stated)
  SELECT function, bucket, previous, state, value, '{alarm}' AS alarm FROM trans WHERE state <> previous)"""


FUNCTION_ALARMS_SQL = ERRORS_CTE + "\nUNION ALL\n".join(
    _function_alarm_sql(spec.name[: -len("-errors")], spec.name, spec.missing, spec.periods, int(spec.threshold))
    for spec in AL.ALARM_CATALOG[:3])


@register("function_error_alarms", FUNCTION_ALARMS_SQL)
def function_error_alarms(spark, sf):
    """The catalog's three function-error alarms over A12, one pass, up to the period of the last event."""
    specs = AL.spec_table(spark, AL.ALARM_CATALOG[:3])
    hourly = M.errors_per_hour(M.function_errors(table(spark, sf, "events")))
    series = hourly.select(F.concat("function", F.lit("-errors")).alias("alarm"), "function",
                           AL.bucket_us(F.col("bucket"), F.lit(3600)).alias("bucket_us"), F.col("errors").alias("value"))
    return AL.alarm_transitions_by_table(series, specs, _last_event(spark, sf), ["function"]).select(
        "function", "bucket", "previous", "state", "value", "alarm")


# The six alarms as literal values: name, seconds, comparison, threshold, N, missing data, notify on OK.
_CATALOG = [("transform-partition-errors", 3600, ">=", 1, 3, "BREACHING", True),
            ("create-partitions-errors", 3600, ">=", 1, 3, "BREACHING", True),
            ("move-access-logs-errors", 3600, ">=", 1, 3, "IGNORE", True),
            ("worker-process-count", 60, "<", 1, 3, "BREACHING", True),
            ("cert-renew-scheduler-errors", 300, ">=", 1, 1, "IGNORE", False),
            ("cert-event-errors", 300, ">=", 1, 1, "IGNORE", False)]


def _catalog_sql(i, name, seconds, op, threshold, n, missing, notify_ok):
    breach = f"value {op} {threshold}"
    if missing == "BREACHING":
        breach = f"CASE WHEN value IS NULL THEN TRUE ELSE {breach} END"
        state = f"CASE WHEN breaches = {n} THEN 'ALARM' ELSE 'OK' END"
    else:
        state = (f"coalesce(last_value(CASE WHEN present < {n} THEN NULL WHEN breaches = {n} THEN 'ALARM' ELSE 'OK' END "
                 "IGNORE NULLS) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'OK')")
    frame = f"OVER (ORDER BY bucket ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    step = f"INTERVAL {seconds} SECOND"
    return f"""SELECT * FROM (
  WITH series AS (SELECT time_bucket({step}, ts) AS bucket, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS value
                  FROM events WHERE event_id % 6 = {i} GROUP BY ALL),
  filled AS (SELECT bucket, value FROM (SELECT unnest(generate_series((SELECT min(bucket) FROM series),
               (SELECT time_bucket({step}, max(ts)) FROM events), {step})) AS bucket) LEFT JOIN series USING (bucket)),
  evald AS (SELECT bucket, value, sum(CAST({breach} AS INT)) {frame} AS breaches, count(value) {frame} AS present FROM filled),
  stated AS (SELECT bucket, value, {state} AS state FROM evald),
  trans AS (SELECT bucket, coalesce(lag(state) OVER (ORDER BY bucket), 'OK') AS previous, state, value FROM stated)
  SELECT '{name}' AS alarm, bucket, previous, state, value FROM trans WHERE state <> previous{'' if notify_ok else " AND state = 'ALARM'"})"""


@register("catalog_alarms", "\nUNION ALL\n".join(_catalog_sql(i, *a) for i, a in enumerate(_CATALOG)))
def catalog_alarms(spark, sf):
    """W1-W3 for all six alarms of the catalog (``<``, N of 1, ALARM only), each over its own share of the events, in one
    pass over them (and one over ``ts`` for the clock)."""
    events = table(spark, sf, "events").select("event_id", "ts", "event_type")
    specs = AL.spec_table(spark, AL.ALARM_CATALOG)
    share = F.element_at(F.array(*(F.lit(a.name) for a in AL.ALARM_CATALOG)), (F.col("event_id") % len(AL.ALARM_CATALOG) + 1).cast("int"))
    series = (events.withColumn("alarm", share).join(F.broadcast(specs.select("alarm", "period_seconds")), "alarm")
              .groupBy("alarm", AL.bucket_us(F.col("ts"), F.col("period_seconds")).alias("bucket_us"))
              .agg(F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("value")))
    return AL.alarm_transitions_by_table(series, specs, _last_event(spark, sf))


@register("capacity_pressure", LOG_CTE + """
, per_min AS (
  SELECT "date"||' '||substr("time", 1, 5) AS minute, CAST(sum(bytes) AS BIGINT) AS net_bytes,
         round(100 * avg(CASE WHEN time_taken > 0 THEN CAST(time_to_first_byte AS DOUBLE) / CAST(time_taken AS DOUBLE) END), 6) AS iowait_pct
  FROM log GROUP BY 1),
r AS (SELECT minute, net_bytes, iowait_pct, CAST(net_bytes AS DOUBLE) / 3221225472.0 AS net_ratio, iowait_pct / 25.0 AS iowait_ratio FROM per_min)
SELECT minute, net_bytes, iowait_pct, round(net_ratio, 9) AS net_ratio, round(iowait_ratio, 9) AS iowait_ratio,
  CAST(least(16, greatest(1, ceil(net_ratio))) AS INT) AS tasks_by_net,
  CAST(least(16, greatest(1, ceil(iowait_ratio))) AS INT) AS tasks_by_iowait,
  greatest(CAST(least(16, greatest(1, ceil(net_ratio))) AS INT), CAST(least(16, greatest(1, ceil(iowait_ratio))) AS INT)) AS desired_tasks
FROM r""")
def capacity_pressure(spark, sf):
    """Per-minute bandwidth and wait ratios against the scaling targets."""
    log = access_log(spark, sf)
    ratio = F.when(F.col("time_taken") > 0, F.col("time_to_first_byte").cast("double") / F.col("time_taken").cast("double"))
    per_min = (log.groupBy(M.request_minute(log).alias("minute"))
               .agg(F.sum("bytes").alias("net_bytes"), F.round(100 * F.avg(ratio), 6).alias("iowait_pct")))
    r = AL.capacity_pressure(per_min, tasks=1)
    return r.withColumn("net_ratio", F.round("net_ratio", 9)).withColumn("iowait_ratio", F.round("iowait_ratio", 9))
