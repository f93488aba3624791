"""Q2/Q4 key semantics, U1 cut-off behaviour over time, T4 watermark."""

import datetime as dt
import os

from pyspark.sql import functions as F

from edgelog.functions.timekeys import view_cutoff
from edgelog.operators.layout import compact
from edgelog.operators.view import combined_view
from edgelog.plans.named import run_named
from edgelog.schema import ALL_COLUMNS
from edgelog.streaming.metrics import start_windowed, windowed_counts
from tests.test_layout import _row, _write_hour


def _log(spark, uris):
    rows = []
    for u in uris:
        r = dict(zip(ALL_COLUMNS, [None] * len(ALL_COLUMNS)))
        r.update({"uri": u, "status": 200, "bytes": 1, "year": "2024", "month": "01", "day": "02", "hour": "03"})
        rows.append(tuple(r[c] for c in ALL_COLUMNS))
    from edgelog.schema import FULL_SCHEMA
    return spark.createDataFrame(rows, FULL_SCHEMA)


def test_path_key_and_package_name(spark):
    log = _log(spark, ["/debian/pool/a.deb", "/jobs", "/", "/pypi/web/packages/ab/cd/ef/scikit-learn-1.0.whl",
                       "/pypi/web/packages/ab/cd/ef/numpy_1.0.whl", "/pypi/web/packages/too/short.whl"])
    paths = {r.uriwithprefix: r.total_requests
             for r in run_named(spark, "monthly_requests_stats_per_path", log, "2024", "01").collect()}
    assert paths == {"/debian/": 1, "/": 2, "/pypi/": 3}     # no second slash -> '/'
    ranking = {r.packageName: r.download_count
               for r in run_named(spark, "monthly_pypi_package_download_ranking", log, "2024", "01").collect()}
    assert ranking == {"scikit": 1, "numpy_1.0.whl": 1}       # truncated at the first '-'; 7 segments dropped


def test_view_cutoff_moves_with_now(spark, tmpdir_path):
    hot, cold = os.path.join(tmpdir_path, "hot"), os.path.join(tmpdir_path, "cold")
    for h in ("03", "04", "05"):
        _write_hour(hot, h, [_row(time=f"{h}:00:00")])
    compact(spark, hot, cold, F.col("hour").isin("03", "04", "05"))
    for now, hot_hours in [(dt.datetime(2024, 1, 2, 5, 14), {"03", "04", "05"}),
                           (dt.datetime(2024, 1, 2, 5, 15), {"04", "05"}),    # hour 03 leaves the hot tier at 05:15
                           (dt.datetime(2024, 1, 2, 7, 30), set())]:
        assert view_cutoff(now) == (now - dt.timedelta(minutes=75)).strftime("%Y%m%d%H")
        v = combined_view(spark, hot, cold, now, with_file=True)
        rows = v.select("hour", "file").collect()
        assert sorted(r.hour for r in rows) == ["03", "04", "05"]            # disjoint tiers, nothing lost
        assert {r.hour for r in rows if "/hot/" in r.file} == hot_hours


def test_watermark_drops_too_late_rows(spark, tmpdir_path):
    src, out = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "out")
    schema = "metric string, ts timestamp_ntz, value double"
    t0 = dt.datetime(2024, 1, 2, 3, 0)

    def batch(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(os.path.join(src, name))

    stream = lambda: windowed_counts(spark.readStream.schema(schema).parquet(os.path.join(src, "*")), delay="15 minutes")
    batch([("m", t0, 1.0), ("m", t0 + dt.timedelta(minutes=40), 1.0)], "b1")
    start_windowed(stream(), out, os.path.join(tmpdir_path, "ckpt")).awaitTermination()
    # an event 30 minutes behind the watermark (max 03:40 - 15 min = 03:25) for the 03:00 window
    batch([("m", t0 + dt.timedelta(seconds=30), 1.0), ("m", t0 + dt.timedelta(hours=1), 1.0)], "b2")
    start_windowed(stream(), out, os.path.join(tmpdir_path, "ckpt")).awaitTermination()
    got = {(r.bucket.strftime("%H:%M"), r.samples) for r in spark.read.parquet(out).collect()}
    assert ("03:00", 1) in got and ("03:00", 2) not in got               # late row not counted
    assert ("03:40", 1) in got                                           # closed by the later watermark


def test_windows_independent_of_session_zone(spark):
    from edgelog.functions.timekeys import instant_to_ntz, micros_to_ntz, ntz_as_utc_instant
    prev = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")          # a half-hour offset
    try:
        df = spark.createDataFrame([("m", dt.datetime(2024, 1, 1, 10, 20, 5), 1.0)], "metric string, ts timestamp_ntz, value double")
        r = windowed_counts(df, period="1 hour").first()
        assert r.bucket == dt.datetime(2024, 1, 1, 10, 0)
        back = df.select(instant_to_ntz(ntz_as_utc_instant(F.col("ts"))).alias("t"),
                         micros_to_ntz(F.lit(0)).alias("epoch")).first()
        assert back.t == dt.datetime(2024, 1, 1, 10, 20, 5) and back.epoch == dt.datetime(1970, 1, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)
