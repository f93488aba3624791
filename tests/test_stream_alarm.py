"""T5: the streaming alarm on fractional values, several keys and periods that arrive late."""

import datetime as dt
import os

from pyspark.sql import functions as F

from edgelog.operators.alarms import AlarmSpec, alarm_transitions
from edgelog.streaming.alarms import evaluate_stream

SCHEMA = "site string, metric string, bucket timestamp, value double"
START = dt.datetime(2024, 1, 1)


def _rows(values, site="a", first=0):
    return [(site, "load", START + dt.timedelta(hours=first + i), v) for i, v in enumerate(values)]


def _stream(spark, root, batches, spec, hold, delay):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(os.path.join(root, "in"))
        closed = spark.readStream.schema(SCHEMA).parquet(os.path.join(root, "in")).withWatermark("bucket", delay)
        out = evaluate_stream(closed, spec, 3600, ["site", "metric"], hold)
        q = (out.writeStream.format("parquet").option("path", os.path.join(root, "out"))
             .option("checkpointLocation", os.path.join(root, "ckpt")).outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        assert q.exception() is None
    got = spark.read.parquet(os.path.join(root, "out"))
    return sorted((r.site, r.metric, r.bucket, r.previous, r.state, r.value) for r in got.collect())


def _batch(spark, rows, spec, before):
    series = spark.createDataFrame(rows, SCHEMA).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
    got = alarm_transitions(series, ["site", "metric"], spec, F.lit(before).cast("timestamp_ntz"))
    return sorted((r.site, r.metric, r.bucket, r.previous, r.state, r.value) for r in got.collect())


def test_fractional_values_and_key_list(spark, tmpdir_path):
    spec = AlarmSpec("load", "1 hour", ">=", 2.5, 1, "IGNORE")
    rows = _rows([1.0, 2.9, 1.0, 1.0]) + _rows([2.4, 2.5, 2.6, 0.1], site="b")
    got = _stream(spark, tmpdir_path, [rows], spec, False, "0 seconds")
    assert got == _batch(spark, rows, spec, START + dt.timedelta(hours=3)) and len(got) == 4


def test_period_delivered_late_within_the_delay_counts_in_its_place(spark, tmpdir_path):
    spec = AlarmSpec("load", "1 hour", ">=", 1.0, 2, "IGNORE")
    first, late = _rows([0.0, 2.0]) + _rows([0.0], first=3), _rows([2.0], first=2)
    after = _rows([0.0] * 6, first=4)
    got = _stream(spark, tmpdir_path, [first, late, after], spec, True, "3 hours")
    want = _batch(spark, first + late + after, spec, START + dt.timedelta(hours=9))
    assert [r[:5] for r in got] == [r[:5] for r in want if r[2] <= START + dt.timedelta(hours=6)] and len(got) == 2
