"""T4 with late rows: every input row of a closed window is counted once or kept as late; a repeated batch changes nothing.
A10/A6: coarser grains from stored partials."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from edgelog.operators.metrics import dimension_rollup, merge_partials, partial_stat, partials
from edgelog.streaming.metrics import close_windows

SCHEMA = "metric string, ts timestamp_ntz, value double"


def _at(minute, second=0):
    return dt.datetime(2024, 1, 2, 3, 0) + dt.timedelta(minutes=minute, seconds=second)


BATCHES = [
    [("a", _at(0), 1.0), ("a", _at(0, 59), 2.0), ("a", _at(20), 3.0), ("b", _at(5), 4.0), ("b", _at(5, 1), 1.0)],
    [("a", _at(0, 30), 5.0), ("b", _at(4), 6.0), ("a", _at(6), 7.0), ("a", _at(5, 0), None), ("a", None, 9.0)],
    [],
    [("a", _at(20, 1), 8.0), ("a", _at(40), 9.0), ("b", _at(4, 59), 1.0)],
]


def _tables(spark, target):
    closed = {(r.metric, r.bucket): (r.samples, r.total) for r in spark.read.parquet(f"{target}/closed").collect()}
    late = sorted((r.metric, r.ts, int(r.batch)) for r in spark.read.parquet(f"{target}/late").collect())
    return closed, late


@pytest.mark.parametrize("repeat", [False, True])
def test_rows_are_counted_or_late(spark, tmpdir_path, repeat):
    target = os.path.join(tmpdir_path, "out")
    for n, rows in enumerate(BATCHES):
        for _ in range(2 if repeat else 1):
            close_windows(spark.createDataFrame(rows, SCHEMA), n, target, "1 minute", "15 minutes")
    closed, late = _tables(spark, target)
    # after batch 0 the newest is 3:20, so windows ending by 3:05 are closed; after batch 3 those ending by 3:25
    assert closed == {("a", _at(0)): (2, 3.0), ("b", _at(5)): (2, 5.0), ("a", _at(6)): (1, 7.0), ("a", _at(5)): (1, None),
                      ("a", _at(20)): (2, 11.0)}
    assert late == [("a", _at(0, 30), 1), ("b", _at(4), 1), ("b", _at(4, 59), 3)]
    still_open = spark.read.parquet(f"{target}/open/batch=3").collect()
    assert [(r.metric, r.bucket, r.samples) for r in still_open] == [("a", _at(40), 1)]


def test_coarser_grains_come_from_partials(spark):
    rows = [("m", _at(i % 90, i % 60), None if i % 11 == 0 else float(i)) for i in range(500)]
    samples = spark.createDataFrame(rows, SCHEMA)
    stored = partials(samples, "1 minute", ["metric"])
    for stat, want in (("Sum", F.sum("value")), ("Average", F.avg("value")), ("SampleCount", F.count("value")),
                       ("Minimum", F.min("value")), ("Maximum", F.max("value"))):
        got = merge_partials(stored, "1 hour", ["metric"]).select("bucket", partial_stat(stat).alias("v"))
        direct = samples.groupBy(F.window("ts", "1 hour").start.alias("bucket")).agg(want.alias("v"))
        assert {r.bucket: r.v for r in got.collect()} == pytest.approx({r.bucket: r.v for r in direct.collect()})
    none = partials(spark.createDataFrame([("m", _at(0), None)], SCHEMA), "1 minute", ["metric"])
    assert none.select(partial_stat("Average")).first()[0] is None


def test_rollup_expands_aggregated_rows(spark):
    dims = "struct<image:string,instance:string,type:string,grp:string>"
    rows = [("m", _at(i % 3), ("x", f"i-{i % 4}", "t", f"g{i % 2}"), float(i)) for i in range(40)]
    samples = spark.createDataFrame(rows, f"metric string, ts timestamp_ntz, dims {dims}, value double")
    got = dimension_rollup(samples, "1 hour", "Average")
    assert {r.grp: r.value for r in got.where("gid = 14").collect()} == {"g0": 19.0, "g1": 20.0}
    plan = got._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Expand"):]
    assert "HashAggregate" in below  # the samples are summed before the sets expand them
