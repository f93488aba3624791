"""L1-L3 stitching cases, N6 branches and N7."""

import json

from pyspark.sql import functions as F

from edgelog.operators.notify import dead_letters, notifications, shape_notifications
from edgelog.operators.stitch import CONTAINER_START, SYNC_START, container_timestamp, stitch, sync_timestamp


def test_stitch_cases(spark):
    files = spark.createDataFrame([
        ("a", "orphan line\n2024-01-02 03:04:05,678 INFO start\n  cont 1\n  cont 2\n2024-01-02 03:05:00,000 INFO next\n"),
        ("b", ""),
        ("c", "2024-01-02 03:04:05,678 INFO only"),
    ], "file string, text string")
    recs = stitch(files, SYNC_START).orderBy("file", "record_no").collect()
    a = [r for r in recs if r.file == "a"]
    assert [r.record for r in a] == ["orphan line", "2024-01-02 03:04:05,678 INFO start\n  cont 1\n  cont 2",
                                     "2024-01-02 03:05:00,000 INFO next"]
    assert [r.n_lines for r in a] == [1, 3, 1]
    assert not [r for r in recs if r.file == "b"]
    assert len([r for r in recs if r.file == "c"]) == 1
    per_line = stitch(files, None).where("file = 'a'").count()
    assert per_line == 5
    ts = spark.createDataFrame([("2024-01-02 03:04:05,678 INFO x",)], "r string").select(sync_timestamp(F.col("r"))).first()[0]
    assert str(ts) == "2024-01-02 03:04:05"


def test_container_timestamp(spark):
    line = '1.2.3.4 - - [16/Jul/2020:02:24:46 +0200] "GET /debian/ HTTP/1.1" 200 12'
    files = spark.createDataFrame([("f", line + "\n  trace\n" + line)], "file string, text string")
    recs = stitch(files, CONTAINER_START, anchored=False).collect()
    assert len(recs) == 2 and recs[0].n_lines == 2
    ts = files.select(container_timestamp(F.lit(line))).first()[0]
    assert str(ts) == "2020-07-16 00:24:46"


def test_notification_branches(spark):
    msgs = [
        ("1", json.dumps({"AlarmName": "A", "AlarmDescription": "d", "AWSAccountId": "1", "NewStateValue": "ALARM",
                          "NewStateReason": "r"})),
        ("2", json.dumps({"AlarmName": "A", "NewStateValue": "OK"})),
        ("3", json.dumps({"type": "repo-sanity", "sanityTarget": "T"})),
        ("4", json.dumps({"type": "pipeline", "state": "approval"})),
        ("5", json.dumps({"type": "pipeline", "result": "FAILED", "input": "{}"})),
        ("6", json.dumps({"type": "pipeline", "result": "SUCCEEDED", "input": "{\"commit\":\"c1\"}",
                          "output": "{\"Error\":\"States.Timeout\"}"})),
        ("7", json.dumps({"type": "pipeline", "result": "ABORTED", "input": "{}"})),
        ("8", "Service x is scaled from 1 to 2"),
        ("9", json.dumps({"type": "certificate"})),
        ("10", "{not json"),
    ]
    df = spark.createDataFrame(msgs, "msg_id string, message string")
    shaped = shape_notifications(df, region="cn-north-1")
    got = {r.msg_id: r for r in notifications(shaped).collect()}
    assert got["1"].icon_emoji == ":scream:" and "amazonaws.cn" in got["1"].text
    assert got["2"].icon_emoji == ":relaxed:"
    assert got["3"].username == "Repo Sanity Testing"
    assert got["4"].icon_emoji == ":question:"
    assert got["5"].icon_emoji == ":thumbsdown:" and "on commit 'unknown'" in got["5"].text
    assert got["6"].icon_emoji == ":open_mouth:" and "approval timeout" in got["6"].text and "'c1'" in got["6"].text
    assert got["7"].icon_emoji == ":point_right:"
    assert {r.msg_id for r in dead_letters(shaped).collect()} == {"8", "9", "10"}
