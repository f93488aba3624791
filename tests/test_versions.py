"""Snapshots of the cold tier: readers keep their version, publishers build on each other, old runs go."""

import os

import pytest
from pyspark.sql import functions as F

from edgelog.operators import versions
from edgelog.operators.versions import cold_rows, current_version, publish_hours, vacuum
from edgelog.sources.accesslog import read_hot
from tests.test_layout import _row, _write_hour


@pytest.fixture
def tier(spark, tmp_path):
    hot = str(tmp_path / "hot")
    _write_hour(hot, "03", [_row(), _row()])
    _write_hour(hot, "04", [_row()])
    return read_hot(spark, hot), str(tmp_path / "cold tier")


def _hours(df):
    return {r["hour"]: r["n"] for r in df.groupBy("hour").agg(F.count("*").alias("n")).collect()}


def test_a_reader_keeps_its_version(spark, tier):
    rows, cold = tier
    assert current_version(spark, cold) == 0 and cold_rows(spark, cold).count() == 0
    assert publish_hours(rows, cold) == 1
    reader = cold_rows(spark, cold)
    assert publish_hours(rows.where("hour = '03'").unionByName(rows.where("hour = '03'")), cold) == 2
    assert _hours(reader) == {"03": 2, "04": 1}  # read after the hour was compacted again
    assert _hours(cold_rows(spark, cold)) == {"03": 4, "04": 1} and _hours(cold_rows(spark, cold, 1)) == {"03": 2, "04": 1}
    assert publish_hours(rows.limit(0), cold) == 3 and _hours(cold_rows(spark, cold)) == {"03": 4, "04": 1}
    with pytest.raises(ValueError):
        publish_hours(rows, cold, "append")


def test_a_reader_during_compaction(spark, tier, monkeypatch):
    rows, cold = tier
    publish_hours(rows, cold)
    seen = []
    publish = versions._publish

    def look_first(spark, source, target):
        seen.append(_hours(cold_rows(spark, cold)))  # data written, not published
        return publish(spark, source, target)

    monkeypatch.setattr(versions, "_publish", look_first)
    publish_hours(rows.unionByName(rows), cold)
    assert seen == [{"03": 2, "04": 1}] and _hours(cold_rows(spark, cold)) == {"03": 4, "04": 2}


def test_an_interrupted_compaction_is_not_seen(spark, tier, monkeypatch):
    rows, cold = tier
    publish_hours(rows, cold)

    def crash(*a):
        raise RuntimeError("driver lost")

    monkeypatch.setattr(versions, "_publish", crash)
    with pytest.raises(RuntimeError):
        publish_hours(rows.unionByName(rows), cold)
    monkeypatch.undo()
    assert current_version(spark, cold) == 1 and _hours(cold_rows(spark, cold)) == {"03": 2, "04": 1}


def test_publishers_build_on_each_other(spark, tier, monkeypatch):
    rows, cold = tier
    publish = versions._publish
    raced = []

    def other_first(spark, source, target):
        if not raced:
            raced.append(1)
            publish_hours(rows.where("hour = '04'"), cold)
        return publish(spark, source, target)

    monkeypatch.setattr(versions, "_publish", other_first)
    assert publish_hours(rows.where("hour = '03'"), cold) == 2
    assert _hours(cold_rows(spark, cold)) == {"03": 2, "04": 1}


def test_vacuum_removes_what_only_old_versions_name(spark, tier):
    rows, cold = tier
    for _ in range(3):
        publish_hours(rows.where("hour = '03'"), cold)
    publish_hours(rows.where("hour = '04'"), cold)
    assert len(vacuum(spark, cold)) == 2 and vacuum(spark, cold) == []
    assert _hours(cold_rows(spark, cold)) == {"03": 2, "04": 1}
    assert len(os.listdir(f"{cold}/year=2024/month=01/day=02/hour=03")) == 1
