"""D1/D2 routing cases, hot-tier text semantics, D4 idempotence."""

import gzip
import os

from pyspark.sql import functions as F

from edgelog.operators.layout import compact, hour_predicate, route_keys
from edgelog.schema import ALL_COLUMNS, DATA_COLUMNS
from edgelog.sources.accesslog import read_cold, read_hot


def test_route_keys_cases(spark):
    keys = ["new/E1.2024-01-02-03.abc.gz", "new/notalog.gz", "2024-01-02-03.gz", "x.2024-01-02-03",
            "new/a.2024-01-02-03.b.2025-05-05-05.c.gz", "new/x-2024-01-02-03-/f.gz"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    rows = {r.key: r for r in route_keys(df).collect()}
    r = rows["new/E1.2024-01-02-03.abc.gz"]
    assert (r.year, r.month, r.day, r.hour, r.basename) == ("2024", "01", "02", "03", "E1.2024-01-02-03.abc.gz")
    assert r.target_key == "partitioned-gz/year=2024/month=01/day=02/hour=03/E1.2024-01-02-03.abc.gz"
    for k in ("new/notalog.gz", "2024-01-02-03.gz", "x.2024-01-02-03"):
        assert rows[k].routed is False and rows[k].target_key is None
    assert (rows["new/a.2024-01-02-03.b.2025-05-05-05.c.gz"].year, rows["new/a.2024-01-02-03.b.2025-05-05-05.c.gz"].hour) == ("2024", "03")
    assert rows["new/x-2024-01-02-03-/f.gz"].basename == "f.gz"
    # totality: matched + unmatched = all
    assert route_keys(df).where("routed").count() + route_keys(df).where("not routed").count() == len(keys)


def _write_hour(root, hour, lines):
    d = os.path.join(root, "year=2024", "month=01", "day=02", f"hour={hour}")
    os.makedirs(d, exist_ok=True)
    with gzip.open(os.path.join(d, "E1.2024-01-02-%s.x.gz" % hour), "wt") as f:
        f.write("#Version: 1.0\n#Fields: " + " ".join(DATA_COLUMNS) + "\n")
        for line in lines:
            f.write(line + "\n")


def _row(**over):
    base = {c: "-" for c in DATA_COLUMNS}
    base.update({"date": "2024-01-02", "time": "03:04:05", "bytes": "10", "uri": "/debian/a.deb", "status": "200",
                 "time_taken": "0.25"})
    base.update(over)
    return "\t".join(base[c] for c in DATA_COLUMNS)


def test_hot_tier_text_semantics(spark, tmpdir_path):
    lines = [_row(), _row(bytes="-", status="-"), "2024-01-02\t03:00:00\tPEK50",
             _row() + "\textra1\textra2", _row(referrer='"q'), _row(time="04:00:00")]
    _write_hour(tmpdir_path, "03", lines)
    df = read_hot(spark, tmpdir_path)
    rows = df.collect()
    assert len(rows) == 6                                     # 2 header lines skipped
    assert {r.hour for r in rows} == {"03"}                   # hour from the folder, not the row
    dash = [r for r in rows if r.bytes is None and r.status is None and r.uri is not None]
    assert len(dash) == 1
    assert df.where("status < 400").count() == 4              # NULL status dropped; short row has NULL status
    short = [r for r in rows if r.location == "PEK50"][0]
    assert short.bytes is None and short.uri is None
    assert any(r.referrer == '"q' for r in rows)              # quote kept as data
    assert df.schema["month"].dataType.simpleString() == "string"


def test_compaction_is_idempotent(spark, tmpdir_path):
    hot = os.path.join(tmpdir_path, "hot")
    cold = os.path.join(tmpdir_path, "cold")
    _write_hour(hot, "03", [_row(), _row(uri="/ubuntu/x")])
    _write_hour(hot, "04", [_row()])
    p = {"year": "2024", "month": "01", "day": "02", "hour": "03"}
    compact(spark, hot, cold, hour_predicate(p))
    compact(spark, hot, cold, hour_predicate(p))
    assert read_cold(spark, cold).count() == 2
    compact(spark, hot, cold, hour_predicate(p), mode="append")
    assert read_cold(spark, cold).count() == 4                # parity mode duplicates
    compact(spark, hot, cold, hour_predicate({**p, "hour": "04"}))
    c = read_cold(spark, cold)
    assert c.where("hour = '04'").count() == 1 and c.columns == ALL_COLUMNS


def test_partition_filters_reach_scan(spark, tmpdir_path):
    _write_hour(tmpdir_path, "03", [_row()])
    df = read_hot(spark, tmpdir_path).where((F.col("year") == "2024") & F.col("uri").startswith("/debian"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "StringStartsWith" in plan


def test_hot_hour_is_split_across_tasks(spark, tmpdir_path):
    """One hour holding most rows: rebalance lets AQE split it into several
    tasks (and files) instead of one straggler."""
    hot = os.path.join(tmpdir_path, "hot")
    cold = os.path.join(tmpdir_path, "cold")
    lines = [_row(uri=f"/debian/pool/file-{i}.deb", referrer="r" * 200) for i in range(20000)]
    _write_hour(hot, "03", lines)
    _write_hour(hot, "04", [_row()])
    # several input splits, as a big hour has many delivered files
    for k in range(4):
        d = os.path.join(hot, "year=2024", "month=01", "day=02", "hour=03")
        with gzip.open(os.path.join(d, f"E1.2024-01-02-03.part{k}.gz"), "wt") as f:
            for line in lines[:5000]:
                f.write(line + "\n")
    prev = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        compact(spark, hot, cold, F.col("day") == "02")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", prev)
    hour_dir = os.path.join(cold, "year=2024", "month=01", "day=02", "hour=03")
    files = [f for f in os.listdir(hour_dir) if f.endswith(".parquet")]
    assert len(files) > 1
    assert read_cold(spark, cold).where("hour = '03'").count() == 40000


def test_compacted_files_skip_pages_by_path(spark, tmpdir_path):
    """Rows of an hour lie by path, so a prefix filter reads only some pages of the file (P5)."""
    hot, cold = os.path.join(tmpdir_path, "hot"), os.path.join(tmpdir_path, "cold")
    _write_hour(hot, "03", [_row(uri=f"/{('debian', 'pypi/web', 'ubuntu')[i % 3]}/{i * 7919 % 60000:05d}") for i in range(60000)])
    compact(spark, hot, cold, F.col("day") == "02")
    df = read_cold(spark, cold).where(F.col("uri").startswith("/pypi/web/0001")).select("uri")
    plan = df._jdf.queryExecution().executedPlan()
    want = sum(1 for i in range(60000) if i % 3 == 1 and f"{i * 7919 % 60000:05d}".startswith("0001"))
    assert len(df.collect()) == want > 0
    scan = plan.collectLeaves().apply(0)
    assert scan.metrics().apply("numOutputRows").value() < 30000
