"""D3 against a catalog table, D4 registering its hour, S5 result sink,
T1 exactly-once ingest across runs."""

import datetime as dt
import gzip
import os
import uuid

from pyspark.sql import functions as F

from edgelog.operators.layout import compact_hour, register_next_hour
from edgelog.plans.named import run_named, save_result
from edgelog.schema import DATA_COLUMNS
from edgelog.sources.accesslog import read_hot, read_table, register_tier
from edgelog.streaming.delivery import start_delivery
from tests.test_layout import _row, _write_hour


def _gz(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with gzip.open(path, "wt") as f:
        f.write("#Version: 1.0\n#Fields: " + " ".join(DATA_COLUMNS) + "\n")
        for line in lines:
            f.write(line + "\n")


def test_partition_registration_and_compaction_into_table(spark, tmpdir_path):
    hot = os.path.join(tmpdir_path, "hot")
    cold = os.path.join(tmpdir_path, "cold")
    _write_hour(hot, "03", [_row(), _row(uri="/ubuntu/x")])
    tag = uuid.uuid4().hex[:8]
    hot_t = register_tier(spark, f"edgelog_test.hot_{tag}", hot, "csv")
    os.makedirs(cold, exist_ok=True)
    cold_t = register_tier(spark, f"edgelog_test.cold_{tag}", cold, "parquet")
    assert spark.sql(f"SHOW PARTITIONS {hot_t}").count() == 1
    # D3 at 2024-01-02 02:20 registers hour 03 (exists) - no-op; at 03:20 registers hour 04
    assert register_next_hour(spark, hot_t, dt.datetime(2024, 1, 2, 2, 20))["hour"] == "03"
    assert spark.sql(f"SHOW PARTITIONS {hot_t}").count() == 1
    register_next_hour(spark, hot_t, dt.datetime(2024, 1, 2, 3, 20))
    parts = {r[0] for r in spark.sql(f"SHOW PARTITIONS {hot_t}").collect()}
    assert "year=2024/month=01/day=02/hour=04" in parts
    # D4 at 05:10 compacts hour 03 and adds it to the cold table
    compact_hour(spark, hot, cold, dt.datetime(2024, 1, 2, 5, 10), cold_table=cold_t)
    assert read_table(spark, cold_t).where("hour = '03'").count() == 2


def test_result_sink(spark, tmpdir_path):
    hot = os.path.join(tmpdir_path, "hot")
    _write_hour(hot, "03", [_row(), _row(status="500")])
    res = run_named(spark, "monthly_requests_per_day", read_hot(spark, hot), "2024", "01")
    path = save_result(res, os.path.join(tmpdir_path, "results"), "monthly_requests_per_day")
    back = spark.read.option("header", "true").csv(path).collect()
    assert [(r.day, r.total_requests) for r in back] == [("2024-01-02", "1")]


def test_stream_ingest_exactly_once(spark, tmpdir_path):
    lake = tmpdir_path
    target, manifest, ckpt = (os.path.join(lake, d) for d in ("hot", "manifest", "_ckpt"))
    _gz(os.path.join(lake, "new", "d1", "E1.2024-01-02-03.a.gz"), [_row(), _row()])
    _gz(os.path.join(lake, "new", "d1", "notalog.gz"), [_row()])
    start_delivery(spark, lake, target, manifest, ckpt).awaitTermination()
    assert read_hot(spark, target).count() == 2                  # non-log name filtered
    start_delivery(spark, lake, target, manifest, ckpt).awaitTermination()
    assert read_hot(spark, target).count() == 2                  # nothing ingested twice
    _gz(os.path.join(lake, "new", "d2", "E1.2024-01-02-04.b.gz"), [_row()])
    start_delivery(spark, lake, target, manifest, ckpt).awaitTermination()
    df = read_hot(spark, target)
    assert df.count() == 3 and df.where(F.col("hour") == "04").count() == 1


def test_scheduled_jobs_cycle(spark, tmpdir_path):
    """route at arrival, register at :55, compact at :01, repair a late file."""
    from edgelog.plans.jobs import compact_job, register_job, repair_job, route_job
    from edgelog.plans.lake import Lake
    from edgelog.sources.accesslog import read_cold

    root = tmpdir_path
    _gz(os.path.join(root, "new", "a", "E1.2024-01-02-03.a.gz"), [_row(), _row()])
    lake = Lake(root, dt.datetime(2024, 1, 2, 5, 1))
    route_job(spark, lake)
    assert register_job(spark, lake)["hour"] == "06"
    os.makedirs(lake.cold, exist_ok=True)
    assert compact_job(spark, lake)["hour"] == "03"
    assert read_cold(spark, lake.cold).count() == 2
    # a late file for hour 03 arrives after its compaction
    _gz(os.path.join(root, "new", "b", "E1.2024-01-02-03.late.gz"), [_row()])
    route_job(spark, lake)
    repair_job(spark, Lake(root, dt.datetime(2024, 1, 2, 6, 20)))
    assert read_cold(spark, lake.cold).where("hour = '03'").count() == 3


def test_named_query_cli(spark, tmpdir_path):
    """E3 + S5: a named query over a lake's view, result written to the results location."""
    from edgelog.plans.lake import Lake
    from edgelog.plans.named import main

    root = os.path.join(tmpdir_path, "lake")
    _write_hour(os.path.join(root, "hot"), "03", [_row(), _row(status="404"), _row(uri="/pypi/web/simple/x")])
    Lake(root, dt.datetime(2024, 1, 2, 3, 30)).tables(spark)
    path = main(["monthly_requests_stats_per_path", "--lake", root, "--year", "2024", "--month", "01",
                 "--results", os.path.join(tmpdir_path, "results"), "--now", "2024-01-02T03:30"])
    rows = {r.uriwithprefix: r.total_requests for r in spark.read.option("header", "true").csv(path).collect()}
    assert rows == {"/debian/": "1", "/pypi/": "1"}
