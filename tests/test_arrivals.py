"""Name-keeping routing and the arrival manifest: names, failed tasks, crashes between data and manifest, late files."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from edgelog.operators import arrivals
from edgelog.operators.arrivals import compact_arrived, deliver, late_arrivals, listed_files, manifest_of, repair_arrivals
from edgelog.sources import namedfiles
from edgelog.sources.accesslog import read_cold, read_hot
from edgelog.streaming.delivery import start_delivery
from tests.test_layout import _row

HOURS = "true"


class Lake:
    def __init__(self, root):
        self.root = str(root)
        self.new, self.hot, self.cold, self.manifest, self.ledger = (f"{self.root}/{d}" for d in ("new", "hot", "cold", "manifest", "ledger"))
        os.makedirs(self.new)

    def put(self, name, rows=1):
        os.makedirs(os.path.dirname(f"{self.new}/{name}"), exist_ok=True)
        with (gzip.open if name.endswith(".gz") else open)(f"{self.new}/{name}", "wt") as f:
            f.write("#Version: 1.0\n" + (_row() + "\n") * rows)

    def files(self):
        return sorted(os.path.relpath(os.path.join(d, n), self.hot) for d, _, names in os.walk(self.hot) for n in names if not n.startswith("."))

    def stream(self, spark, **kw):
        q = start_delivery(spark, self.root, self.hot, self.manifest, f"{self.root}/_ck", **kw)
        q.awaitTermination()
        if q.exception():
            raise q.exception()

    def recorded(self, spark):
        return sorted((r["file"], r["batch"]) for r in manifest_of(spark, self.manifest).collect())


@pytest.fixture
def lake(tmp_path):
    return Lake(tmp_path / "my lake")  # a space in the path: metadata paths are encoded


HOUR3 = "year=2024/month=01/day=02/hour=03"


def test_files_keep_their_names(spark, lake):
    lake.put("E1.2024-01-02-03.aa+b.gz", 2)
    lake.put("deep/er/E1.2024-01-02-04.c.gz")
    lake.put("notalog.txt")
    lake.stream(spark)
    assert lake.files() == [f"{HOUR3}/E1.2024-01-02-03.aa+b.gz", "year=2024/month=01/day=02/hour=04/E1.2024-01-02-04.c.gz"]
    assert open(f"{lake.hot}/{HOUR3}/E1.2024-01-02-03.aa+b.gz", "rb").read() == open(f"{lake.new}/E1.2024-01-02-03.aa+b.gz", "rb").read()
    assert [f for f, _ in lake.recorded(spark)] == lake.files()
    assert read_hot(spark, lake.hot).count() == 3
    lake.put("E1.2024-01-02-03.later.gz")
    lake.stream(spark)
    assert len(lake.files()) == 3 and [b for _, b in lake.recorded(spark)] == [1, 2, 1]


def test_equal_names_in_one_hour_stay_apart(spark, lake):
    for i, name in enumerate(("a/x.2024-01-02-03.gz", "b/x.2024-01-02-03.gz")):
        lake.put(name, 1 + i)
    lake.stream(spark)
    lake.put("c/x.2024-01-02-03.gz", 4)
    lake.stream(spark)
    assert read_hot(spark, lake.hot).count() == 7
    assert f"{HOUR3}/x.2024-01-02-03.gz" in lake.files() and len(lake.files()) == 3


def test_a_failed_task_leaves_nothing(spark, lake):
    for i in range(6):
        lake.put(f"E1.2024-01-02-03.{i}.gz")
    files = listed_files(spark, lake.new).withColumn("target_key", F.concat(F.lit(HOUR3 + "/"), F.element_at(F.split("path", "/"), -1)))
    broken = files.unionByName(files.limit(1).withColumn("path", F.lit(f"{lake.root}/gone.gz")).withColumn("target_key", F.lit(f"{HOUR3}/z")))
    with pytest.raises(Exception):
        namedfiles.write_named_files(broken, lake.hot)
    assert lake.files() == [] and os.listdir(f"{lake.hot}/_staging") == []
    namedfiles.write_named_files(files, lake.hot)
    assert len(lake.files()) == 6
    namedfiles.write_named_files(files.limit(2), lake.hot, mode="overwrite")
    assert len(lake.files()) == 2
    with pytest.raises(Exception, match="outside the sink"):
        namedfiles.write_named_files(files.withColumn("target_key", F.lit("../x")), lake.hot)


@pytest.mark.parametrize("step", ["before data", "between", "after manifest"])
def test_a_crash_loses_and_doubles_nothing(spark, lake, monkeypatch, step):
    for i in range(5):
        lake.put(f"E1.2024-01-02-0{i}.f.gz", i + 1)
    copy, real = arrivals.write_named_files, arrivals.deliver
    if step == "after manifest":
        def crash(*a):
            real(*a)
            raise RuntimeError("driver lost")
        monkeypatch.setattr("edgelog.streaming.delivery.deliver", crash)
    else:
        def crash(*a, **kw):
            if step == "between":
                copy(*a, **kw)
            raise RuntimeError("driver lost")
        monkeypatch.setattr(arrivals, "write_named_files", crash)
    with pytest.raises(Exception, match="driver lost"):
        lake.stream(spark, files_per_batch=2)
    monkeypatch.undo()
    lake.stream(spark, files_per_batch=2)
    assert read_hot(spark, lake.hot).count() == 15 and len(lake.files()) == 5
    assert sorted(f for f, _ in lake.recorded(spark)) == lake.files()


def test_late_files_come_from_the_manifest(spark, lake, monkeypatch):
    lake.put("E1.2024-01-02-03.a.gz", 2)
    lake.put("E1.2024-01-02-05.b.gz", 3)
    deliver(listed_files(spark, lake.new), lake.root, lake.hot, lake.manifest, 1)
    compact_arrived(spark, lake.hot, lake.cold, lake.manifest, lake.ledger, F.expr(HOURS))
    assert read_cold(spark, lake.cold).count() == 5 and late_arrivals(spark, lake.manifest, lake.ledger, "2030").count() == 0
    lake.put("E1.2024-01-02-03.late.gz", 4)
    fresh = listed_files(spark, lake.new).where(F.col("path").contains(".late."))
    deliver(fresh, lake.root, lake.hot, lake.manifest, 2)
    with gzip.open(f"{lake.hot}/{HOUR3}/not-recorded.gz", "wt") as f:  # copied, its batch not committed
        f.write(_row() + "\n")
    late = late_arrivals(spark, lake.manifest, lake.ledger, "2030")
    assert [r["file"] for r in late.collect()] == [f"{HOUR3}/E1.2024-01-02-03.late.gz"]
    monkeypatch.setattr(arrivals, "SMALL_LIST", 0)  # the list of names by shuffle
    hours = repair_arrivals(spark, lake.hot, lake.cold, lake.manifest, lake.ledger, "2030")
    assert [h["hour"] for h in hours] == ["03"]
    assert read_cold(spark, lake.cold).count() == 9 and late_arrivals(spark, lake.manifest, lake.ledger, "2030").count() == 0


def test_a_file_that_lands_during_compaction_is_late_not_lost(spark, lake):
    lake.put("E1.2024-01-02-03.a.gz")
    deliver(listed_files(spark, lake.new), lake.root, lake.hot, lake.manifest, 1)
    lake.put("E1.2024-01-02-03.b.gz")

    def then_one_more(rows, root, mode="overwrite"):
        arrivals._write_hours(rows, root, mode)
        deliver(listed_files(spark, lake.new).where(F.col("path").contains(".b.")), lake.root, lake.hot, lake.manifest, 2)

    compact_arrived(spark, lake.hot, lake.cold, lake.manifest, lake.ledger, F.expr(HOURS), write=then_one_more)
    assert read_cold(spark, lake.cold).count() == 1 and late_arrivals(spark, lake.manifest, lake.ledger, "2030").count() == 1
    repair_arrivals(spark, lake.hot, lake.cold, lake.manifest, lake.ledger, "2030")
    assert read_cold(spark, lake.cold).count() == 2 and late_arrivals(spark, lake.manifest, lake.ledger, "2030").count() == 0


def test_a_file_delivered_again_counts_once(spark, lake):
    lake.put("E1.2024-01-02-03.a.gz", 2)
    for batch in (1, 2):
        deliver(listed_files(spark, lake.new), lake.root, lake.hot, lake.manifest, batch)
        compact_arrived(spark, lake.hot, lake.cold, lake.manifest, lake.ledger, F.expr(HOURS))
    assert read_cold(spark, lake.cold).count() == 2 and late_arrivals(spark, lake.manifest, lake.ledger, "2030").count() == 0


def test_empty_lake(spark, lake):
    assert late_arrivals(spark, lake.manifest, lake.ledger, "2030").count() == 0
    assert repair_arrivals(spark, lake.hot, lake.cold, lake.manifest, lake.ledger, "2030") == []
