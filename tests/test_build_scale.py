"""The lake's build and the gzip tier's scan at size: one pass to stage, cheap file names, no exception per dash."""

import gzip

from pyspark.sql import functions as F

from edgelog.operators.arrivals import hour_file
from edgelog.schema import ALL_COLUMNS, FULL_SCHEMA
from edgelog.sources import arrivals
from edgelog.sources.accesslog import _HOT_SCHEMA, HOT_OPTIONS, read_hot
from tests.test_layout import _row

NUMBERS = {"fle_encrypted_fields": 25, "sc_range_start": 31, "sc_range_end": 32}


def test_staging_samples_no_ranges(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", lambda *a: 1 / 0)  # its sampling runs the log once more
    lines = [f"{_row()}\t2024\t01\t02\t{h:02d}".split("\t") for h in (3, 3, 4)]
    log = spark.createDataFrame([(*x, *("-",) * (len(ALL_COLUMNS) - len(x)))[:len(ALL_COLUMNS)] for x in lines], ", ".join(f"`{c}` string" for c in ALL_COLUMNS))
    log = log.select(*[F.lit(None).cast("string").alias(c) if c == "result_id" else F.col(c) for c in ALL_COLUMNS])
    arrivals.stage_arrivals(log, f"{tmpdir_path}/new")
    staged = spark.read.text(f"{tmpdir_path}/new", wholetext=True).select("value", "f").collect()
    assert sorted(r["f"] for r in staged) == ["E2EXAMPLE.2024-01-02-03.0", "E2EXAMPLE.2024-01-02-04.0"]
    for r in staged:
        body = r["value"].splitlines()
        assert body[:2] == arrivals.HEADER_LINES and len(body) == (4 if "03.0" in r["f"] else 3)


def test_file_name_of_a_row(spark):
    hour = "year=2024/month=01/day=02/hour=03"
    paths = [(f"file:///a%20b/hot/{hour}/x+y.gz", f"{hour}/x+y.gz"), (f"s3a://b/hot/{hour}/x%20%2B+y.gz", f"{hour}/x ++y.gz")]
    assert [tuple(r) for r in spark.createDataFrame(paths, "p string, want string").select(hour_file(F.col("p")), "want").collect()] == [(w, w) for _, w in paths]


def test_dashes_are_not_parsed_as_numbers(spark, tmpdir_path):
    assert all(_HOT_SCHEMA[c].dataType.simpleString() == "string" for c in NUMBERS)
    odd = ["-", "", "7", "+7", "-7", " 7", "7 ", "1.5", "x", "#7", "99999999999", "99999999999999999999", "\u0663", '"7"', "--", "NaN"]
    lines = []
    for value in odd:
        fields = (_row().split("\t") + ["-"] * 33)[:33]
        for i in NUMBERS.values():
            fields[i] = value
        lines.append("\t".join(fields))
    lines.append("\t".join(lines[0].split("\t")[:20]))  # short row
    folder = f"{tmpdir_path}/year=2024/month=01/day=02/hour=03"
    spark.range(1).select(F.lit("x")).write.text(folder)  # makes the folder
    with gzip.open(f"{folder}/odd.gz", "wt") as f:
        f.write("#Version: 1.0\n" + "\n".join(lines) + "\n")
    parsed = spark.read.schema(FULL_SCHEMA).options(**HOT_OPTIONS).csv(tmpdir_path).select(*ALL_COLUMNS)
    got = read_hot(spark, tmpdir_path)
    assert got.schema == parsed.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, parsed.collect())) and got.where("sc_range_end = 7").count() >= 2
