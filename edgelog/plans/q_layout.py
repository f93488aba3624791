"""Query keys of the partition layout operators."""

from __future__ import annotations


from pyspark.sql import functions as F

from edgelog.functions.timekeys import compaction_hour
from edgelog.operators import layout as D
from edgelog.plans.lake import LAKE_NOW, lake_for
from edgelog.plans.oracle import DATA_COLS, LOG_CTE
from edgelog.plans.registry import register
from edgelog.schema import ALL_COLUMNS
from edgelog.session import scratch_path
from edgelog.sources.accesslog import read_cold
from edgelog.sources.tables import table


def object_keys(events):
    """Object keys as a log bucket would see them, one per event, covering
    the naming cases: plain delivery, no date, date at the very start, date in
    a folder name, two dates (first wins)."""
    et, eid = F.col("event_type"), F.col("event_id").cast("string")
    stamp = F.date_format("ts", "yyyy-MM-dd-HH")
    h = F.substring(F.md5(eid), 1, 8)
    key = (F.when(et == "error", F.concat(F.lit("new/notalog-"), eid, F.lit(".gz")))
            .when(et == "signup", F.concat(stamp, F.lit(".gz")))
            .when(et == "click", F.concat(F.lit("new/x-"), stamp, F.lit("-/f"), eid, F.lit(".gz")))
            .when(et == "view", F.concat(F.lit("new/a."), stamp, F.lit(".b.2025-05-05-05.c.gz")))
            .otherwise(F.concat(F.lit("new/E2EXAMPLE."), stamp, F.lit("."), h, F.lit(".gz"))))
    return events.select("event_id", key.alias("key"))


KEYS_SQL = r"""WITH keys AS (
  SELECT event_id, CASE
    WHEN event_type = 'error' THEN 'new/notalog-' || event_id || '.gz'
    WHEN event_type = 'signup' THEN strftime(ts, '%Y-%m-%d-%H') || '.gz'
    WHEN event_type = 'click' THEN 'new/x-' || strftime(ts, '%Y-%m-%d-%H') || '-/f' || event_id || '.gz'
    WHEN event_type = 'view' THEN 'new/a.' || strftime(ts, '%Y-%m-%d-%H') || '.b.2025-05-05-05.c.gz'
    ELSE 'new/E2EXAMPLE.' || strftime(ts, '%Y-%m-%d-%H') || '.' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) || '.gz' END AS key
  FROM events),
r AS (SELECT event_id, key, regexp_extract(key, '[^\d](\d{4})-(\d{2})-(\d{2})-(\d{2})[^\d]', 1) AS y,
        regexp_extract(key, '[^\d](\d{4})-(\d{2})-(\d{2})-(\d{2})[^\d]', 2) AS mo,
        regexp_extract(key, '[^\d](\d{4})-(\d{2})-(\d{2})-(\d{2})[^\d]', 3) AS d,
        regexp_extract(key, '[^\d](\d{4})-(\d{2})-(\d{2})-(\d{2})[^\d]', 4) AS h,
        regexp_extract(key, '[^/]+$', 0) AS base FROM keys)
"""


@register("file_routing", KEYS_SQL + """
SELECT event_id, key, y AS year, mo AS month, d AS day, h AS hour, base AS basename,
  'partitioned-gz/year=' || y || '/month=' || mo || '/day=' || d || '/hour=' || h || '/' || base AS target_key
FROM r WHERE y <> ''""")
def file_routing(spark, sf):
    """Object key -> hourly partition target (first date match wins)."""
    r = D.route_keys(object_keys(table(spark, sf, "events")))
    return r.where("routed").select("event_id", "key", "year", "month", "day", "hour", "basename", "target_key")


@register("unrouted_files", KEYS_SQL + "SELECT key FROM r WHERE y = ''")
def unrouted_files(spark, sf):
    """Keys that do not look like an access-log file."""
    return D.unrouted(object_keys(table(spark, sf, "events")))


@register("next_hour_partition", """
SELECT ts, strftime(ts + INTERVAL 60 MINUTE, '%Y') AS year, strftime(ts + INTERVAL 60 MINUTE, '%m') AS month,
       strftime(ts + INTERVAL 60 MINUTE, '%d') AS day, strftime(ts + INTERVAL 60 MINUTE, '%H') AS hour
FROM events""")
def next_hour_partition(spark, sf):
    """D3: the partition registered at each trigger time (event times as triggers)."""
    return D.next_hour_partitions(table(spark, sf, "events").select("ts"))


_HOUR = compaction_hour(LAKE_NOW)
_HOUR_KEY = "".join(_HOUR[k] for k in ("year", "month", "day", "hour"))
COMPACT_SQL = LOG_CTE + "SELECT " + DATA_COLS.format(rid="result_id") + \
    f" FROM log WHERE year||month||day||hour = '{_HOUR_KEY}'"


def _compact(spark, sf, runs, mode="overwrite"):
    lake = lake_for(spark, sf)
    target = scratch_path(spark, "compact")
    for _ in range(runs):
        D.compact_hour(spark, lake.hot, target, LAKE_NOW, mode=mode)
    return read_cold(spark, target).select(*ALL_COLUMNS)


@register("compact_hour", COMPACT_SQL)
def compact_hour(spark, sf):
    """The hour two hours before ``now`` rewritten as Parquet."""
    return _compact(spark, sf, 1)


@register("compact_hour_rerun", COMPACT_SQL)
def compact_hour_rerun(spark, sf):
    """D4 run twice with dynamic partition overwrite: same rows (idempotent)."""
    return _compact(spark, sf, 2)


APPEND_SQL = LOG_CTE + "SELECT " + DATA_COLS.format(rid="result_id") + \
    f" FROM log, (VALUES (1), (2)) AS t(run) WHERE year||month||day||hour = '{_HOUR_KEY}'"


@register("compact_hour_append", APPEND_SQL)
def compact_hour_append(spark, sf):
    """D4 parity mode (plain INSERT/append): a re-run duplicates the hour."""
    return _compact(spark, sf, 2, mode="append")
