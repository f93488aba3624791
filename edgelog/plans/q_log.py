"""Query keys of the access-log lake: Q1-Q4 directly on the derived log and
through the two-tier view over files, tier scans and view properties."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from edgelog.functions.timekeys import compaction_hour, hour_key, view_cutoff
from edgelog.plans import oracle as O
from edgelog.plans.lake import LAKE_NOW, Lake, lake_for
from edgelog.plans.named import run_named, save_result
from edgelog.plans.registry import register
from edgelog.schema import ALL_COLUMNS, VIEW_COLUMNS
from edgelog.session import scratch_path
from edgelog.sources.accesslog import read_hot, to_tsv_line
from edgelog.sources.fixture import access_log

YEAR, MONTH = "2024", "01"
CUT = view_cutoff(LAKE_NOW)

_NAMED = {
    "requests_per_day": ("monthly_requests_per_day", O.Q1),
    "requests_per_path": ("monthly_requests_stats_per_path", O.Q2),
    "pypi_per_day": ("monthly_pypi_stats_per_day", O.Q3),
    "pypi_package_ranking": ("monthly_pypi_package_download_ranking", O.Q4),
}


def _direct(qname):
    return lambda spark, sf: run_named(spark, qname, access_log(spark, sf), YEAR, MONTH)


def _through_view(qname):
    return lambda spark, sf: run_named(spark, qname, lake_for(spark, sf).view(spark), YEAR, MONTH)


for _key, (_qname, _sql) in _NAMED.items():
    register(_key, O.LOG_CTE + _sql)(_direct(_qname))
    register("lake_" + _key, O.LOG_CTE + _sql)(_through_view(_qname))


@register("access_log_scan", O.LOG_CTE + "SELECT " + O.DATA_COLS.format(rid="result_id") + " FROM log")
def access_log_scan(spark, sf):
    """The whole gzip tier read back with the fixed schema."""
    return read_hot(spark, lake_for(spark, sf).hot).select(*ALL_COLUMNS)


@register("combined_view_rows", O.LOG_CTE + "SELECT " + O.DATA_COLS.format(rid="result_id AS request_id") + " FROM log")
def combined_view_rows(spark, sf):
    """Hot hours >= cut-off UNION ALL cold hours < cut-off = the whole log."""
    return lake_for(spark, sf).view(spark).select(*VIEW_COLUMNS)


@register("combined_view_by_tier", O.LOG_CTE + f"""
SELECT CASE WHEN year||month||day||hour >= '{CUT}' THEN 'hot' ELSE 'cold' END AS tier,
       count(DISTINCT year||month||day||hour) AS hours, count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS total_bytes
FROM log GROUP BY 1""")
def combined_view_by_tier(spark, sf):
    """U1 + S6: which tier (by ``file``) each row of the view came from."""
    v = lake_for(spark, sf).view(spark, with_file=True)
    return (v.groupBy("tier")
            .agg(F.countDistinct(hour_key()).alias("hours"), F.count("*").alias("requests"),
                 F.sum("bytes").alias("total_bytes")))


_LAST_HOURS = "2024013020"


@register("combined_view_after_arrival", O.LOG_CTE + f"""
SELECT year, month, day, hour, count(*) * 2 AS requests FROM log WHERE year||month||day||hour >= '{_LAST_HOURS}' GROUP BY ALL""")
def combined_view_after_arrival(spark, sf):
    """U1 within one session: files that land in a registered hour after a first query show up in the next one."""
    lake = Lake(scratch_path(spark, "arrival_lake"), dt.datetime(2024, 1, 30, 21, 20))
    rows = access_log(spark, sf).where(hour_key() >= _LAST_HOURS)
    lines = to_tsv_line(rows).select("value", "year", "month", "day", "hour")
    for seen in (False, True):
        (lines.write.mode("append").partitionBy("year", "month", "day", "hour").option("compression", "gzip").text(lake.hot))
        view = lake.view(spark)
        if not seen:
            view.count()  # fills the table's file cache
    return view.groupBy("year", "month", "day", "hour").agg(F.count("*").alias("requests"))


@register("saved_result", O.LOG_CTE + O.Q1)
def saved_result(spark, sf):
    """A named query's result written under the results location and read back."""
    result = run_named(spark, "monthly_requests_per_day", access_log(spark, sf), YEAR, MONTH)
    path = save_result(result, scratch_path(spark, "results"), "monthly_requests_per_day", "parquet")
    return spark.read.parquet(path)


_CLOCKS = [dt.datetime(2024, 1, d, h, m) for d, h, m in ((1, 0, 0), (1, 1, 14), (1, 1, 15), (30, 22, 14), (30, 22, 15), (30, 23, 59))]


@register("view_cutoffs_over_time", O.LOG_CTE + f"""
, clocks AS (SELECT unnest([{", ".join(f"TIMESTAMP '{t}'" for t in _CLOCKS)}]) AS now),
cuts AS (SELECT now, strftime(now - INTERVAL 75 MINUTE, '%Y%m%d%H') AS cutoff, strftime(now - INTERVAL 2 HOUR, '%Y%m%d%H') AS compacted FROM clocks)
SELECT strftime(now, '%Y-%m-%d %H:%M') AS clock, cutoff, compacted, count(*) FILTER (year||month||day||hour >= cutoff) AS hot_requests
FROM cuts, log GROUP BY ALL""")
def view_cutoffs_over_time(spark, sf):
    """The cut-off of the view, the hour compacted and the rows still in the hot tier as the clock moves."""
    log = access_log(spark, sf).groupBy(hour_key().alias("h")).agg(F.count("*").alias("n"))
    clocks = spark.createDataFrame([(f"{t:%Y-%m-%d %H:%M}", view_cutoff(t), "".join(compaction_hour(t).values())) for t in _CLOCKS],
                                   "clock string, cutoff string, compacted string")
    hot = clocks.join(log, F.col("h") >= F.col("cutoff"), "left")
    return hot.groupBy("clock", "cutoff", "compacted").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hot_requests"))
