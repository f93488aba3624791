"""Windowed metric statistics, conditional counts, dimension roll-ups.

Every statistic is a ``groupBy(window(ts, period), keys...)`` hash aggregate:
partial aggregation runs map-side, so only one row per (task, bucket, key)
crosses the shuffle whatever the raw sample volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = {
    "Sum": lambda c: F.sum(c),
    "Average": lambda c: F.avg(c),
    "SampleCount": lambda c: F.count(c),
    "Minimum": lambda c: F.min(c),
    "Maximum": lambda c: F.max(c),
}

DIMENSIONS = ["image", "instance", "type", "grp"]


def metric_samples(events: DataFrame) -> DataFrame:
    """Samples ``(metric, ts, dims, value)`` from the ``events`` table: the
    metric is the event type, the instance is the user; image, instance type
    and auto-scaling group are fixed functions of the instance."""
    uid = F.col("user_id")
    dims = F.struct(
        F.concat(F.lit("ami-"), (uid % 3).cast("string")).alias("image"),
        F.concat(F.lit("i-"), uid.cast("string")).alias("instance"),
        F.when(uid % 2 == 0, "c5.large").otherwise("c5.xlarge").alias("type"),
        F.concat(F.lit("asg-"), (uid % 4).cast("string")).alias("grp"),
    )
    return events.select(F.col("event_type").alias("metric"), "ts", dims.alias("dims"), "value")


def bucket_start(ts: Column, period: str) -> Column:
    """Start of the tumbling window containing ``ts`` (stays TIMESTAMP_NTZ
    for NTZ input, so no session-time-zone shift)."""
    return F.window(ts, period).start


def windowed_stat(samples: DataFrame, period: str, stat: str, keys: list[str | Column] | None = None,
                  value_col: str = "value", where: Column | None = None) -> DataFrame:
    """A5/A6/A7 (and A11 through ``where``): one statistic per period and key."""
    df = samples if where is None else samples.where(where)
    keys = keys if keys is not None else ["metric"]
    return (df.groupBy(bucket_start(F.col("ts"), period).alias("bucket"), *keys)
            .agg(STATS[stat](F.col(value_col)).alias("value")))


def partials(samples: DataFrame, period: str, keys: list[str | Column], value_col: str = "value") -> DataFrame:
    """Mergeable statistics ``(bucket, keys, n, total, least, most)``: what is stored at the finest grain, so that every coarser
    period and every subset of the keys comes from these rows and the samples are read once.  Null values count nowhere."""
    v = F.col(value_col)
    return (samples.groupBy(bucket_start(F.col("ts"), period).alias("bucket"), *keys)
            .agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most")))


def _merged() -> list[Column]:
    return [F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most")]


def merge_partials(parts: DataFrame, period: str, keys: list[str]) -> DataFrame:
    """``partials`` of a coarser ``period`` (a multiple of the stored one) and of fewer ``keys``."""
    return parts.groupBy(bucket_start(F.col("bucket"), period).alias("bucket"), *keys).agg(*_merged())


def partial_stat(stat: str) -> Column:
    """A statistic of merged partials; the average is the whole sum over the whole count, never a mean of means."""
    if stat == "Average":
        return F.try_divide(F.col("total"), F.col("n"))
    return F.col({"Sum": "total", "SampleCount": "n", "Minimum": "least", "Maximum": "most"}[stat])


def dimension_rollup(samples: DataFrame, period: str, stat: str) -> DataFrame:
    """A10: every sample carries (image, instance, type, grp) and is also
    aggregated over the group alone - GROUPING SETS, with ``gid`` the bit
    mask of the dimensions rolled up (image=8, instance=4, type=2, grp=1).
    The sets expand the partials of the full set, not the samples."""
    fine = partials(samples, period, ["metric", *[F.col(f"dims.{d}").alias(d) for d in DIMENSIONS]])
    gid = sum(F.grouping(d) * (1 << (len(DIMENSIONS) - 1 - i)) for i, d in enumerate(DIMENSIONS))
    sets = [[F.col("metric"), F.col("bucket"), *[F.col(d) for d in DIMENSIONS]],
            [F.col("metric"), F.col("bucket"), F.col("grp")]]
    return (fine.groupingSets(sets, "metric", "bucket", *DIMENSIONS).agg(gid.cast("bigint").alias("gid"), *_merged())
            .select("metric", "bucket", *DIMENSIONS, "gid", partial_stat(stat).alias("value")))


def request_minute(log: DataFrame) -> Column:
    """Minute bucket of an access-log row as text ``yyyy-MM-dd HH:mm``."""
    return F.concat(F.col("date").cast("string"), F.lit(" "), F.substring("time", 1, 5))


def http_class_counts(log: DataFrame) -> DataFrame:
    """2XX/3XX/4XX/5XX counts per minute."""
    s = F.col("status")
    return (log.groupBy(request_minute(log).alias("minute"))
            .agg(*[F.count_if(s.between(k * 100, k * 100 + 99)).alias(f"http_{k}xx") for k in (2, 3, 4, 5)]))


def bytes_per_minute(log: DataFrame) -> DataFrame:
    """Processed bytes per minute."""
    return log.groupBy(request_minute(log).alias("minute")).agg(F.sum("bytes").alias("bytes"))


# The functions whose errors are counted hourly (A12) - an
# error event is attributed to one of them by its user id modulo 3.
FUNCTIONS = ["transform-partition", "create-partitions", "move-access-logs"]


def function_errors(events: DataFrame) -> DataFrame:
    """Invocation-error samples (function, ts, errors=1) from error events."""
    uid = F.col("user_id")
    fn = F.when(uid % 3 == 0, FUNCTIONS[0]).when(uid % 3 == 1, FUNCTIONS[1]).otherwise(FUNCTIONS[2])
    return events.where(F.col("event_type") == "error").select(fn.alias("function"), "ts", F.lit(1).alias("errors"))


def errors_per_hour(errors: DataFrame) -> DataFrame:
    """``metricErrors`` summed per function and hour."""
    return (errors.groupBy("function", bucket_start(F.col("ts"), "1 hour").alias("bucket"))
            .agg(F.sum("errors").cast("bigint").alias("errors")))
