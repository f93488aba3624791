"""Record reader: whole records wherever the byte ranges are cut, equal to stitching the whole text; one scan, no shuffle."""

import collections
import functools
import json
import random
import re

import pytest

from edgelog.operators.stitch import CONTAINER_START, SYNC_START, stitch
from edgelog.sources import records as records_source
from edgelog.sources.records import RecordReader, read_records, with_record_numbers

START = "2024-01-02 03:04:05,678 INFO "
TEXTS = {
    "a": "orphan\n" + "".join(f"{START}{i}\n" + "  more é\n" * (i % 5 * 9) for i in range(25)),
    "b": "\n" + START + "x\r\n  y\r\n", "c": START + "only", "d": START + "long\n" + "  line of a record over many ranges\n" * 30 + START + "z\n",
    "e": "no start\nat all\n\nin here\n", "f": f"{START}1\n\n\n{START}2\n",
}


def _write(root, cuts):
    for log, text in TEXTS.items():
        folder = root / f"mirror={log}"
        folder.mkdir()
        lines = text.splitlines(keepends=True)
        edges = sorted({0, len(lines), *(random.Random(cuts).randrange(len(lines) + 1) for _ in range(cuts))})
        for n, (x, y) in enumerate(zip(edges, edges[1:])):
            (folder / f"part-{n:05d}.txt").write_bytes("".join(lines[x:y]).encode())
        (folder / "_SUCCESS").write_text("hidden\n")
        (folder / "part-99999.txt").write_text("")


@functools.cache
def _whole(pattern):
    """Records of the whole texts, by the rule alone."""
    out = []
    for mirror, text in TEXTS.items():
        records = []
        for i, line in enumerate(text.removesuffix("\n").split("\n")):
            if not i or pattern is None or re.match(pattern, line):
                records.append([])
            records[-1].append(line)
        out += [(mirror, n, "\n".join(r).removesuffix("\r"), len(r)) for n, r in enumerate(records)]
    return sorted(x for x in out if x[2])


@pytest.mark.parametrize("size", [1, 2, 7, 40, 1 << 20])
@pytest.mark.parametrize("cuts", [0, 3])
@pytest.mark.parametrize("block", [5, 4096])
def test_any_cut_gives_whole_records(tmp_path, monkeypatch, size, cuts, block):
    monkeypatch.setattr(records_source, "BLOCK", block)
    _write(tmp_path, cuts)
    for pattern in (SYNC_START, None):
        reader = RecordReader({"path": str(tmp_path), "rangebytes": str(size), "patterns": json.dumps({"": pattern})})
        before, got = collections.Counter(), []
        dealt = [r for p in reader.partitions() for r in p.parts]
        assert dealt == reader.ranges()
        for part in dealt:  # in the order of the log
            n = 0
            for batch in reader.read(records_source.Ranges([part])):
                for r in batch.to_pylist():
                    assert r["no_in_range"] == n and r["range_no"] == part.number
                    got.append((r["mirror"], before[part.log] + n, r["record"], r["n_lines"]))
                    n += 1
            before[part.log] += n
        assert sorted(g for g in got if g[2]) == _whole(pattern)


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_query_equals_stitching_the_whole_text(spark, tmp_path, size):
    root = tmp_path / "some logs"
    root.mkdir()
    _write(root, 2)
    whole = spark.createDataFrame(list(TEXTS.items()), "mirror string, text string")
    got = with_record_numbers(spark, str(root), read_records(spark, str(root), {"": SYNC_START}, range_bytes=size), size).where("record != ''")
    got = sorted(map(tuple, got.select("mirror", "record_no", "record", "n_lines").collect()))
    assert got == _whole(SYNC_START)
    assert got == sorted(map(tuple, stitch(whole, SYNC_START).select("mirror", "record_no", "record", "n_lines").collect()))


def test_patterns_by_mirror_and_anywhere_in_the_line(spark, tmp_path):
    line = '1.2.3.4 - - [02/Jan/2024:03:04:05 +0000] "GET / HTTP/1.1" 200 5'
    for mirror in ("x", "y"):
        (tmp_path / f"mirror={mirror}").mkdir()
        (tmp_path / f"mirror={mirror}" / "f").write_text(f"{line}\n at a\n at b\n{line}\n")
    got = read_records(spark, str(tmp_path), {"x": CONTAINER_START, "": None}, anchored=False, range_bytes=50)
    assert sorted((r["mirror"], r["record"], r["n_lines"]) for r in got.collect()) == sorted(
        [("x", f"{line}\n at a\n at b", 3), ("x", line, 1)] + [("y", t, 1) for t in (line, " at a", " at b", line)])
    assert read_records(spark, str(tmp_path), {"": CONTAINER_START}, anchored=True).count() == 2  # nothing starts: one record a log


def test_one_scan_without_shuffle(spark, tmp_path):
    root = tmp_path / "logs"
    root.mkdir()
    _write(root, 0)
    records = with_record_numbers(spark, str(root), read_records(spark, str(root), {"": SYNC_START}))
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("BatchScan") == 1
    assert read_records(spark, str(tmp_path / "nothing"), {"": None}).count() == 0
