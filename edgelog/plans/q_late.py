"""D1, T3 and snapshot query keys: delivered names, and files that arrive after their hour was compacted.

Scenario lake: every edge location delivers on time except ``NRT12``, whose
files arrive after the backfill compaction.  All rows of the log end up in
the lake; the late ones are found and re-compacted."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgelog.functions.timekeys import hour_key, view_cutoff
from edgelog.operators.arrivals import compact_arrived, deliver, ledger_of, listed_files, repair_arrivals
from edgelog.operators.arrivals import late_arrivals as find_late
from edgelog.operators.layout import object_key
from edgelog.operators.versions import cold_rows, current_version, publish_hours
from edgelog.operators.view import combine_tiers
from edgelog.plans.lake import LAKE_NOW, Lake, build_lock
from edgelog.plans.oracle import LOG_CTE
from edgelog.plans.registry import register
from edgelog.session import has_marker, input_tag, remove_path, scratch_path, work_path, write_marker
from edgelog.sources.accesslog import read_hot, to_tsv_line
from edgelog.sources.arrivals import stage_arrivals
from edgelog.sources.fixture import access_log
from edgelog.sources.namedfiles import write_named_files
from edgelog.streaming.delivery import start_delivery

LATE_EDGE = "NRT12"
CUT = view_cutoff(LAKE_NOW)


def late_lake(spark, sf):
    tag = input_tag(spark, sf, "late", "v7")
    lake = Lake(work_path(spark, "late_lake", tag), LAKE_NOW)
    with build_lock(lake.root):
        return _build_late(spark, sf, lake)


def _build_late(spark, sf, lake):
    """Compacted hours are published as versions of the cold tier."""
    if has_marker(spark, lake.root):
        return lake
    remove_path(spark, lake.root)  # what a build interrupted before _READY left
    log = access_log(spark, sf)
    stage_arrivals(log.where(F.col("location") != LATE_EDGE), f"{lake.root}/new", distribution="E2ONTIME", mode="overwrite")
    deliver(listed_files(spark, f"{lake.root}/new"), lake.root, lake.hot, lake.manifest, 1)
    compact_arrived(spark, lake.hot, lake.cold, lake.manifest, lake.ledger, hour_key() < F.lit(CUT), write=publish_hours)
    stage_arrivals(log.where(F.col("location") == LATE_EDGE), f"{lake.root}/late", distribution="E2LATE", mode="overwrite")
    deliver(listed_files(spark, f"{lake.root}/late"), lake.root, lake.hot, lake.manifest, 2)
    write_marker(spark, lake.root)
    return lake


@register("late_files", LOG_CTE + f"""
SELECT year, month, day, hour, count(*) AS late_rows
FROM log WHERE location = '{LATE_EDGE}' AND year||month||day||hour < '{CUT}' GROUP BY 1, 2, 3, 4""")
def late_files(spark, sf):
    """Per compacted hour, the rows in late files (what the view misses).  The manifest and the ledger tell the files;
    the semi-join on the late hours lets dynamic partition pruning restrict the hot scan to those hours."""
    lake = late_lake(spark, sf)
    late = find_late(spark, lake.manifest, lake.ledger, CUT)
    keys = ["year", "month", "day", "hour"]
    rows = read_hot(spark, lake.hot, with_file=True).withColumn("file", object_key(F.col("file"), lake.hot))
    rows = rows.join(late.select(*keys).distinct(), keys, "left_semi").join(late.select("file"), "file", "left_semi")
    return rows.groupBy(*keys).agg(F.count("*").alias("late_rows"))


@register("late_files_recompacted", LOG_CTE + f"""
SELECT year, month, day, hour, count(*) AS rows_in_cold FROM log WHERE year||month||day||hour < '{CUT}'
GROUP BY 1, 2, 3, 4""")
def late_files_recompacted(spark, sf):
    """T3 repair: every hour with late files is compacted again and published as the cold tier's next version, which then
    holds every row of those hours."""
    lake = late_lake(spark, sf)
    return cold_rows(spark, lake.cold, _repaired(spark, lake)).groupBy("year", "month", "day", "hour").agg(F.count("*").alias("rows_in_cold"))


def _repaired(spark, lake):
    """Version of the repaired tier.  The repair keeps a ledger of its own, so ``late_files`` still sees the lake before it."""
    with build_lock(f"{lake.root}/repair"):
        done = f"{lake.root}/repaired"
        if not has_marker(spark, done):
            ledger = f"{lake.root}/ledger_repaired"
            ledger_of(spark, lake.ledger).write.mode("overwrite").option("partitionOverwriteMode", "static") \
                .partitionBy("year", "month", "day", "hour").parquet(ledger)
            repair_arrivals(spark, lake.hot, lake.cold, lake.manifest, ledger, CUT, publish_hours)
            write_marker(spark, done)
    return current_version(spark, lake.cold)


@register("view_versions", LOG_CTE + f"""
SELECT version, year, month, day, hour, count(*) AS requests FROM log, (VALUES ('before'), ('after')) AS t(version)
WHERE version = 'after' OR location <> '{LATE_EDGE}' OR year||month||day||hour >= '{CUT}' GROUP BY ALL""")
def view_versions(spark, sf):
    """U1 + D4: a view made before hours are compacted again, read after that, and one made since."""
    lake = late_lake(spark, sf)
    hot = read_hot(spark, lake.hot)
    before = combine_tiers(hot, cold_rows(spark, lake.cold, 1), LAKE_NOW)
    after = combine_tiers(hot, cold_rows(spark, lake.cold, _repaired(spark, lake)), LAKE_NOW)
    keys = ["version", "year", "month", "day", "hour"]
    both = before.withColumn("version", F.lit("before")).unionByName(after.withColumn("version", F.lit("after")))
    return both.groupBy(*keys).agg(F.count("*").alias("requests"))


@register("delivered_files", LOG_CTE + """
SELECT 'E2EXAMPLE.' || year || '-' || month || '-' || day || '-' || hour || '.gz' AS delivered, count(*) AS requests,
       CAST(count(DISTINCT result_id) AS BIGINT) AS request_ids
FROM log GROUP BY 1""")
def delivered_files(spark, sf):
    """The names under which logs were delivered, from the rows' ``file`` in the hot tier.  Each hour of the log is staged,
    moved to a folder under its delivered name and routed by the stream."""
    run = scratch_path(spark, "delivered")
    log = access_log(spark, sf)
    hour = F.concat_ws("-", "year", "month", "day", "hour")
    (to_tsv_line(log).select("value", F.concat(F.lit("E2EXAMPLE."), hour).alias("f")).repartition("f").write.partitionBy("f")
     .option("compression", "gzip").text(f"{run}/staged"))
    staged = listed_files(spark, f"{run}/staged")
    name = F.regexp_extract("path", "/f=([^/]+)/", 1)
    folder = F.element_at(F.array(F.lit(""), F.lit("a/"), F.lit("a/b/c/")), (F.pmod(F.crc32(name.cast("binary")), F.lit(3)) + 1).cast("int"))
    write_named_files(staged.select("path", F.concat(folder, name, F.lit(".gz")).alias("target_key")), f"{run}/new")
    q = start_delivery(spark, run, f"{run}/hot", f"{run}/manifest", f"{run}/_checkpoint", files_per_batch=500)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    rows = read_hot(spark, f"{run}/hot", with_file=True)
    return (rows.groupBy(F.element_at(F.split("file", "/"), -1).alias("delivered"))
            .agg(F.count("*").alias("requests"), F.countDistinct("result_id").alias("request_ids")))
