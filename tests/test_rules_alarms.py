"""C1/C2/C4 examples, W1-W3 on hand-made series."""

import datetime as dt

from pyspark.sql import functions as F

from edgelog.operators.alarms import AlarmSpec, alarm_transitions
from edgelog.operators.classify import cache_class, cdn_behaviour, route_target


def test_cache_and_behaviour(spark):
    uris = {"/debian/pool/a.deb": "1M", "/debian/by-hash/SHA256/ab": "1M", "/centos/repodata/primary.xml.gz": "30m",
            "/archlinux/core.db": "30m", "/ubuntu/dists/Packages.gz": "30m", "/pypi/web/x.whl": "off"}
    df = spark.createDataFrame([(u,) for u in uris], "uri string")
    got = {r.uri: r.c for r in df.select("uri", cache_class(F.col("uri")).alias("c")).collect()}
    assert got == uris
    b = {r.uri: (r.b.pattern, r.b.ttl) for r in spark.createDataFrame(
        [("/rubygems/gems/x.gem",), ("/rubygems/specs",), ("/jobs",), ("/debian/x",), ("/other",)], "uri string")
        .select("uri", cdn_behaviour(F.col("uri")).alias("b")).collect()}
    assert b["/rubygems/gems/x.gem"] == ("/rubygems/gems/*", 604800)
    assert b["/rubygems/specs"] == ("/rubygems/*", 3600)
    assert b["/jobs"] == ("/jobs", 300) and b["/debian/x"][1] == 86400 and b["/other"][0] == "default"


def test_routes(spark):
    rows = [("/static/tunasync.json", "https", "redirect:/jobs"), ("/static/x.css", "https", "web-portal"),
            ("/", "https", "web-portal"), ("/jobs", "https", "sync-manager"), ("/debian/a", "https", "content-server"),
            ("/debian/a", "http", "content-server"), ("/jobs", "http", "redirect:https:443")]
    df = spark.createDataFrame(rows, "uri string, proto string, want string")
    for r in df.select("want", route_target(F.col("uri"), F.col("proto")).alias("got")).collect():
        assert r.got == r.want


def _series(spark, values):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("m", t0 + dt.timedelta(hours=i), v) for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "metric string, bucket timestamp_ntz, value long")


def test_breaching_counts_missing(spark):
    # 1,1,missing -> ALARM at hour 2 (missing breaches); 0 -> OK at hour 3
    s = _series(spark, [1, 1, None, 0])
    out = alarm_transitions(s, ["metric"], AlarmSpec("a", "1 hour", ">=", 1, 3, "BREACHING")).orderBy("bucket").collect()
    assert [(r.previous, r.state) for r in out] == [("OK", "ALARM"), ("ALARM", "OK")]


def test_ignore_keeps_state(spark):
    s = _series(spark, [5, 5, 5, None, 0, 0, 0])
    out = alarm_transitions(s, ["metric"], AlarmSpec("a", "1 hour", ">=", 3, 3, "IGNORE")).orderBy("bucket").collect()
    states = [(r.bucket.hour, r.state) for r in out]
    assert states == [(2, "ALARM"), (6, "OK")]               # missing hour 3 keeps ALARM until a full OK window
    assert all(a.state != b.state for a, b in zip(out, out[1:]))


def test_mirror_catalog_shape(spark):
    from collections import Counter

    from edgelog.sources.catalog import mirror_catalog
    prod = mirror_catalog(spark, "prod").collect()
    assert len(prod) == 54 and len({r.name for r in prod}) == 54
    assert Counter(r.provider for r in prod) == {"rsync": 50, "two-stage-rsync": 2, "command": 2}
    assert Counter(r.interval for r in prod) == {1440: 39, 720: 11, 60: 2, 120: 1, 5: 1}
    assert [r.log_start_pattern for r in prod if r.name == "pypi"][0].startswith("^\\d{4}")
    assert {r.name for r in mirror_catalog(spark, "other").collect()} == {"elrepo", "pypi"}


def test_streaming_alarm_equals_batch(spark, tmpdir_path):
    """T5: the stateful stream (gap filling, IGNORE state keeping, trailing
    periods on timeout) gives the batch transitions over closed periods."""
    import os

    from edgelog.functions.timekeys import ntz_as_utc_instant
    from edgelog.streaming.alarms import evaluate_stream
    t0 = dt.datetime(2024, 1, 1)
    values = {"a": [5, 5, 5, None, 0, 0, 0, 5, None, None, 5, 5, 5],
              "b": [0, None, None, 5, 5, 5, 5, 0, 0, 0, None, None, None]}
    rows = [(m, t0 + dt.timedelta(hours=i), v) for m, vs in values.items() for i, v in enumerate(vs) if v is not None]
    rows.append(("a", t0 + dt.timedelta(hours=13), 5))            # the clock: last closed hour for every key
    src = os.path.join(tmpdir_path, "closed")
    schema = "metric string, bucket timestamp_ntz, value long"
    spark.createDataFrame(rows, schema).write.parquet(src)
    for spec in (AlarmSpec("i", "1 hour", ">=", 3, 3, "IGNORE"), AlarmSpec("b", "1 hour", ">=", 3, 2, "BREACHING", False)):
        batch = alarm_transitions(spark.read.parquet(src), ["metric"], spec)
        want = sorted((r.metric, r.bucket, r.previous, r.state) for r in batch.collect())
        closed = (spark.readStream.schema(schema).parquet(src)
                  .select("metric", ntz_as_utc_instant(F.col("bucket")).alias("bucket"), "value")
                  .withWatermark("bucket", "0 seconds"))
        out = os.path.join(tmpdir_path, "out_" + spec.name)
        (evaluate_stream(closed, spec, 3600).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", out + "_ckpt").trigger(availableNow=True).start().awaitTermination())
        got = sorted((r.metric, r.bucket, r.previous, r.state) for r in spark.read.parquet(out).collect())
        assert got == want, spec


def test_alarm_table_equals_one_alarm_at_a_time(spark):
    """Gaps and islands against filled periods: every comparator, N of 1 to 4, both policies, gaps, null values, a late clock."""
    import itertools
    import random
    from edgelog.operators.alarms import alarm_transitions_by_table, bucket_us, spec_table
    rng = random.Random(3)
    specs = [AlarmSpec(f"a{i}", ["1 hour", "5 minutes", "1 minute"][i % 3], op, 2, n, missing, notify_ok) for i, (op, n, missing, notify_ok) in
             enumerate(itertools.product([">=", ">", "<", "<="], [1, 3, 4], ["BREACHING", "IGNORE"], [True, False]))]
    start, clock = dt.datetime(2024, 3, 9, 22), dt.datetime(2024, 3, 13, 4, 31)
    rows, step = [], {"1 hour": 60, "5 minutes": 5, "1 minute": 1}
    for s in specs:
        at = start + dt.timedelta(minutes=60 * rng.randrange(3))
        for _ in range(60):
            rows.append((s.name, rng.choice("xy"), at, rng.choice([0, 1, 2, 3, 3, 3, None])))
            at += dt.timedelta(minutes=step[s.period] * rng.choice([1, 1, 1, 1, 2, 3, 6]))
    series = spark.createDataFrame(rows, "alarm string, site string, bucket timestamp_ntz, value long").where("bucket <= '2024-03-13 04:00:00'")
    end = F.lit(clock).cast("timestamp_ntz")
    table = spec_table(spark, specs)
    placed = series.join(table.select("alarm", "period_seconds"), "alarm").select(
        "alarm", "site", bucket_us(F.col("bucket"), F.col("period_seconds")).alias("bucket_us"), "value")
    got = sorted(map(repr, alarm_transitions_by_table(placed, table, end, ["site"]).collect()))
    want = None
    for s in specs:
        last = F.lit(clock.replace(minute=clock.minute - clock.minute % step[s.period] if step[s.period] < 60 else 0)).cast("timestamp_ntz")
        one = alarm_transitions(series.where(F.col("alarm") == s.name), ["alarm", "site"], s, last)
        want = one if want is None else want.unionByName(one)
    want = sorted(map(repr, want.collect()))
    assert got == want and len(got) > 200
    assert alarm_transitions_by_table(placed.limit(0), table, end, ["site"]).count() == 0


def test_rule_table_forms_agree(spark, monkeypatch):
    """A few rules as literals or as an array: the same first match; null patterns fit nothing, ties by pattern and value."""
    from edgelog.operators import classify
    rules = spark.createDataFrame([(2, "^/a", "late"), (1, "^/a/b", "early"), (3, None, "never"), (1, "^/a/b/c", "tie"), (None, "z$", "first")],
                                  "priority int, pattern string, value string")
    rows = spark.createDataFrame([("/a/x",), ("/a/b/c",), ("/a/bz",), ("/q",), (None,)], "uri string")
    want = {"/a/x": "late", "/a/b/c": "early", "/a/bz": "first", "/q": None, None: None}
    for limit in (256, 2):
        monkeypatch.setattr(classify, "LITERAL_RULES", limit)
        assert {r.uri: r.k for r in classify.classify_by_table(rows, "uri", rules, "k").collect()} == want
        empty = classify.classify_by_table(rows, "uri", rules.where("false"), "k")
        assert empty.schema["k"].dataType.simpleString() == "string" and empty.where("k IS NOT NULL").count() == 0
