"""N-of-N alarm evaluation with a missing-data policy, state
transitions, and the capacity-pressure report.

Input series are already aggregated per (key, bucket), so their size is the
number of periods, not the raw sample volume.  Gap filling generates the
missing buckets from each observed bucket up to the next one (``lead`` +
``sequence``) - no join, no cross product.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgelog.functions.timekeys import micros_to_ntz, ntz_as_utc_instant

COMPARATORS = {
    ">=": lambda v, t: v >= t,
    ">": lambda v, t: v > t,
    "<": lambda v, t: v < t,
    "<=": lambda v, t: v <= t,
}


@dataclass(frozen=True)
class AlarmSpec:
    name: str
    period: str          # e.g. "1 hour"
    comparator: str      # ">=" (the default) or "<"
    threshold: float
    periods: int         # N of N
    missing: str         # "BREACHING" or "IGNORE"
    notify_ok: bool = True


# The alarm catalog (metric, period, comparator, threshold, N, missing data, notify on OK).
ALARM_CATALOG = [
    AlarmSpec("transform-partition-errors", "1 hour", ">=", 1, 3, "BREACHING", True),
    AlarmSpec("create-partitions-errors", "1 hour", ">=", 1, 3, "BREACHING", True),
    AlarmSpec("move-access-logs-errors", "1 hour", ">=", 1, 3, "IGNORE", True),
    AlarmSpec("worker-process-count", "1 minute", "<", 1, 3, "BREACHING", True),
    AlarmSpec("cert-renew-scheduler-errors", "5 minutes", ">=", 1, 1, "IGNORE", False),
    AlarmSpec("cert-event-errors", "5 minutes", ">=", 1, 1, "IGNORE", False),
]


def gap_fill(series: DataFrame, keys: list[str], period: str, end: Column | None = None) -> DataFrame:
    """Every bucket from each key's first bucket to ``end`` (default: the
    last bucket of any key); missing buckets carry ``value = NULL``.

    No join and no grid: each observed bucket emits itself plus the missing
    buckets up to the key's next observation (``lead``), or up to ``end`` after
    its last one.  The window partitions by the alarm key and orders by bucket,
    the same layout the evaluation windows need, so it adds no extra shuffle."""
    last = end if end is not None else series.select(F.max("bucket")).scalar()
    step = F.expr(f"INTERVAL {period}")
    w = Window.partitionBy(*keys).orderBy("bucket")
    upto = F.coalesce(F.lead("bucket").over(w) - step, last)
    stamped = series.withColumn("_upto", F.greatest(F.col("bucket"), upto))
    filled = stamped.select(*keys, F.col("bucket").alias("_obs"), "value",
                            F.explode(F.sequence(F.col("bucket"), F.col("_upto"), step)).alias("bucket"))
    return filled.select(*keys, "bucket", F.when(F.col("bucket") == F.col("_obs"), F.col("value")).alias("value"))


def evaluate(filled: DataFrame, keys: list[str], spec: AlarmSpec) -> DataFrame:
    """Per bucket, ALARM iff the last N buckets all breach.

    BREACHING: a missing bucket counts as a breach.  IGNORE: a window with any
    missing bucket keeps the previous state (initial OK)."""
    v = F.col("value")
    breach = COMPARATORS[spec.comparator](v, F.lit(spec.threshold))
    if spec.missing == "BREACHING":
        breach = F.when(v.isNull(), True).otherwise(breach)
    n = spec.periods
    w = Window.partitionBy(*keys).orderBy("bucket")
    frame = w.rowsBetween(-(n - 1), Window.currentRow)
    breaches = F.sum(breach.cast("int")).over(frame)
    if spec.missing == "BREACHING":
        raw = F.when(breaches == n, F.lit("ALARM")).otherwise(F.lit("OK"))
        return filled.withColumn("state", raw)
    present = F.count(v).over(frame)
    raw = F.when(present < n, F.lit(None)).when(breaches == n, F.lit("ALARM")).otherwise(F.lit("OK"))
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (filled.withColumn("raw", raw)
            .withColumn("state", F.coalesce(F.last("raw", ignorenulls=True).over(running), F.lit("OK")))
            .drop("raw"))


def transitions(states: DataFrame, keys: list[str], notify_ok: bool = True) -> DataFrame:
    """Rows where the state changes (initial state OK); ALARM-only when
    ``notify_ok`` is false."""
    w = Window.partitionBy(*keys).orderBy("bucket")
    prev = F.coalesce(F.lag("state").over(w), F.lit("OK"))
    out = states.withColumn("previous", prev).where(F.col("state") != F.col("previous"))
    if not notify_ok:
        out = out.where(F.col("state") == "ALARM")
    return out.select(*keys, "bucket", "previous", "state", "value")


def alarm_transitions(series: DataFrame, keys: list[str], spec: AlarmSpec, end: Column | None = None) -> DataFrame:
    """W1+W2+W3 for one alarm spec over a (keys, bucket, value) series."""
    return transitions(evaluate(gap_fill(series, keys, spec.period, end), keys, spec), keys, spec.notify_ok)


SPEC_SCHEMA = ("alarm string, period_seconds long, comparator string, threshold double, periods int, missing string, "
               "notify_ok boolean")


def spec_table(spark: SparkSession, specs: list[AlarmSpec]) -> DataFrame:
    """Alarm specifications as rows (a configuration table, one row per alarm)."""
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    rows = []
    for s in specs:
        number, unit = s.period.split()
        rows.append((s.name, int(number) * seconds[unit.rstrip("s")], s.comparator, float(s.threshold), s.periods, s.missing, s.notify_ok))
    return spark.createDataFrame(rows, SPEC_SCHEMA)


def bucket_us(ts: Column, period_seconds: Column) -> Column:
    """Start of the period that holds ``ts`` (TIMESTAMP_NTZ) in epoch microseconds; the period is a column."""
    us, step = F.unix_micros(ntz_as_utc_instant(ts)), period_seconds.cast("long") * 1_000_000
    return us - F.pmod(us, step)


def alarm_transitions_by_table(series: DataFrame, specs: DataFrame, end: Column, keys: list[str] | None = None) -> DataFrame:
    """W1-W3 for all alarms of a specification table in one pass: ``series`` is (alarm, keys, bucket_us, value), ``end``
    the evaluation clock (TIMESTAMP_NTZ); period, comparator, threshold, N, missing-data policy and notify-on-OK are
    columns of ``specs`` (``SPEC_SCHEMA``).

    Gaps and islands instead of filled periods: an observation is a row of one period, the missing periods up to the
    key's next observation (or the clock) are one row with their number.  Rows have a place (running sum of periods); the length of
    the breaching run that ends at a row is its place less the place of the last row that does not breach, so N needs no
    window frame of its own.  An alarm that begins inside a gap begins at its (N - run)th period.  A null value counts as missing;
    an alarm without a specification gives nothing."""
    by = ["alarm", *(keys or [])]
    w = Window.partitionBy(*by).orderBy("at")
    upto_now = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.col("period_seconds") * 1_000_000
    named = series.join(F.broadcast(specs), "alarm")  # one row per alarm: configuration
    seen = named.select("*", F.col("bucket_us").alias("at")).withColumn(
        "_until", F.coalesce(F.lead("at").over(w), F.greatest(bucket_us(end, F.col("period_seconds")) + step, F.col("at") + step)))
    missed = ((F.col("_until") - F.col("at")) / step - 1).cast("long")
    rows = seen.select(*by, *[c for c in specs.columns if c != "alarm"], F.explode(F.array(
        F.struct(F.col("at"), F.lit(1).cast("long").alias("length"), F.col("value")),
        F.struct((F.col("at") + step).alias("at"), missed.alias("length"), F.lit(None).cast(series.schema["value"].dataType).alias("value")))).alias("r")).select("*", "r.*").drop("r").where("length > 0")
    over = F.lit(False)
    for op, test in COMPARATORS.items():
        over = F.when(F.col("comparator") == op, test(F.col("value"), F.col("threshold"))).otherwise(over)
    breaching, absent = F.col("missing") == "BREACHING", F.col("value").isNull()
    placed = (rows.withColumn("breach", F.when(absent, breaching).otherwise(over))
              .withColumn("place", F.sum("length").over(upto_now))
              .withColumn("run", F.col("place") - F.coalesce(F.max(F.when(~F.col("breach"), F.col("place"))).over(upto_now), F.lit(0)))
              .withColumn("whole", F.col("place") - F.coalesce(F.max(F.when(absent, F.col("place"))).over(upto_now), F.lit(0))))
    raw = F.when(F.col("run") >= F.col("periods"), "ALARM").otherwise(F.when(breaching | (F.col("whole") >= F.col("periods")), "OK"))
    stated = placed.withColumn("state", F.coalesce(F.last(raw, ignorenulls=True).over(upto_now), F.lit("OK")))
    changed = stated.withColumn("previous", F.coalesce(F.lag("state").over(w), F.lit("OK"))).where(
        (F.col("state") != F.col("previous")) & (F.col("notify_ok") | (F.col("state") == "ALARM")))
    inside = F.greatest(F.col("periods") - (F.col("run") - F.col("length")) - 1, F.lit(0)) * step
    return changed.select(*by, micros_to_ntz(F.col("at") + F.when(F.col("state") == "ALARM", inside).otherwise(0)).alias("bucket"),
                          "previous", "state", "value")


# Scaling targets and task-count bounds of the content service.
NET_TARGET_BYTES_PER_MIN = 3 * 1024 * 1024 * 1024
IOWAIT_TARGET_PCT = 25.0
MIN_TASKS, MAX_TASKS = 1, 16


def capacity_pressure(per_period: DataFrame, tasks: Column | int = 1) -> DataFrame:
    """``net_bytes`` (bytes per minute) and ``iowait_pct`` averages per
    period against their targets, with the task count each policy suggests
    (clamped to 1..16) and the larger of the two."""
    t = tasks if isinstance(tasks, Column) else F.lit(tasks)
    net_ratio = F.col("net_bytes").cast("double") / F.lit(float(NET_TARGET_BYTES_PER_MIN))
    io_ratio = F.col("iowait_pct").cast("double") / F.lit(IOWAIT_TARGET_PCT)

    def clamp(ratio: Column) -> Column:
        return F.least(F.lit(MAX_TASKS), F.greatest(F.lit(MIN_TASKS), F.ceil(t * ratio).cast("int")))

    return (per_period.withColumn("net_ratio", net_ratio).withColumn("iowait_ratio", io_ratio)
            .withColumn("tasks_by_net", clamp(F.col("net_ratio")))
            .withColumn("tasks_by_iowait", clamp(F.col("iowait_ratio")))
            .withColumn("desired_tasks", F.greatest("tasks_by_net", "tasks_by_iowait")))
