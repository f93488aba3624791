"""Logs cut into splits and several files: records equal those of the whole text."""

from pyspark.sql import functions as F

from edgelog.operators.stitch import SYNC_START, stitch, stitch_lines
from edgelog.sources.textlogs import read_log_lines

START = "2024-01-02 03:04:05,678 INFO "


def test_records_across_splits_and_files(spark, tmp_path):
    texts = {"a": "orphan\n" + "".join(f"{START}{i}\n" + "  more\n" * (i % 5 * 40) for i in range(60)), "b": "\n" + START + "x\r\n  y\r\n",
             "c": START + "only"}
    for log, text in texts.items():
        folder = tmp_path / f"mirror={log}"
        folder.mkdir()
        lines = text.splitlines(keepends=True)
        cut = len(lines) // 2 + 7 if log == "a" else len(lines)
        for n, part in enumerate((lines[:cut], lines[cut:])):
            (folder / f"part-{n:05d}.txt").write_bytes("".join(part).encode())
    whole = spark.createDataFrame([(k, v) for k, v in texts.items()], "mirror string, text string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        lines = read_log_lines(spark, str(tmp_path))
        assert lines.groupBy("file", "block").count().count() > 20
        for pattern in (SYNC_START, None):
            got = {tuple(r) for r in stitch_lines(lines, pattern).select("mirror", "record_no", "record", "n_lines").collect()}
            want = {tuple(r) for r in stitch(whole, pattern).select("mirror", "record_no", "record", "n_lines").collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_hot_log_is_several_files(spark, tmp_path):
    from edgelog.sources.textlogs import write_sync_logs

    events = spark.range(3000).select(
        F.col("id").alias("event_id"), F.lit(3).cast("long").alias("user_id"), F.lit("view").alias("event_type"),
        F.expr("timestamp_ntz'2024-01-02 00:00:00' + make_dt_interval(0, 0, 0, id)").alias("ts"))
    aqe = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_sync_logs(events, str(tmp_path / "logs"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", aqe)
    lines = read_log_lines(spark, str(tmp_path / "logs"))
    assert lines.select("log").distinct().count() == 1 and lines.select("file").distinct().count() > 1
    recs = stitch_lines(lines, SYNC_START).orderBy("record_no").collect()
    assert [r.record_no for r in recs] == list(range(3000))
    assert [r.n_lines for r in recs] == [i % 3 + 1 for i in range(3000)]
