"""Build (once per input folder) a two-tier access-log lake from the driver
tables: CDN delivery into ``new/`` -> D1 routing into ``hot/`` -> D4 backfill
compaction of every hour before the view cut-off into ``cold/``.

The lake lives under the cluster's shared folder (``spark.checkpoint.dir``);
a ``_READY`` marker makes later calls reuse it.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgelog.functions.timekeys import hour_key, view_cutoff
from edgelog.operators.arrivals import compact_arrived, deliver, listed_files
from edgelog.operators.view import combine_tiers, combined_view
from edgelog.session import has_marker, input_tag, remove_path, work_path, write_marker
from edgelog.sources.accesslog import read_table, register_tier
from edgelog.sources.arrivals import stage_arrivals
from edgelog.sources.fixture import access_log

# Fixed value: the wall clock the lake and its view are evaluated at.  Hours
# from 2024-01-30 21:00 on stay in the gzip tier, earlier hours are compacted.
LAKE_NOW = dt.datetime(2024, 1, 30, 22, 20)
LAKE_VERSION = "v7"


class Lake:
    def __init__(self, root: str, now: dt.datetime):
        self.root = root.rstrip("/")
        self.now = now

    @property
    def new(self) -> str:
        return f"{self.root}/new"

    @property
    def hot(self) -> str:
        return f"{self.root}/hot"

    @property
    def cold(self) -> str:
        return f"{self.root}/cold"

    @property
    def ledger(self) -> str:
        return f"{self.root}/ledger"

    @property
    def manifest(self) -> str:
        return f"{self.root}/manifest"

    @property
    def tag(self) -> str:
        """Identifier-safe name of this lake (hash of its root)."""
        return hashlib.sha1(self.root.encode()).hexdigest()[:16]

    def tables(self, spark: SparkSession) -> tuple[str, str]:
        """The tiers as partitioned catalog tables (registered once per session catalog)."""
        hot = register_tier(spark, f"edgelog.hot_{self.tag}", self.hot, "csv")
        cold = register_tier(spark, f"edgelog.cold_{self.tag}", self.cold, "parquet")
        return hot, cold

    def view(self, spark: SparkSession, with_file: bool = False) -> DataFrame:
        """U1 through the catalog tables: both cut-off predicates and the query's
        year/month filters prune partitions in the catalog."""
        hot, cold = self.tables(spark)
        spark.catalog.refreshTable(hot)  # files that landed in a registered hour since; the cold tier keeps its cache
        return combine_tiers(read_table(spark, hot, with_file), read_table(spark, cold, with_file), self.now, with_file=with_file)

    def path_view(self, spark: SparkSession, with_file: bool = False) -> DataFrame:
        """U1 over the tier folders directly (no catalog)."""
        return combined_view(spark, self.hot, self.cold, self.now, with_file=with_file)


_BUILD_LOCKS: dict[str, threading.Lock] = {}
_LOCKS_GUARD = threading.Lock()


def build_lock(root: str) -> threading.Lock:
    """One builder per derived dataset within this driver (queries may run on threads)."""
    with _LOCKS_GUARD:
        return _BUILD_LOCKS.setdefault(root, threading.Lock())


def lake_for(spark: SparkSession, sf_dir: str, now: dt.datetime = LAKE_NOW) -> Lake:
    tag = input_tag(spark, sf_dir, now.isoformat(), LAKE_VERSION)
    lake = Lake(work_path(spark, "lake", tag), now)
    with build_lock(lake.root):
        return _build(spark, sf_dir, lake)


def _build(spark: SparkSession, sf_dir: str, lake: Lake) -> Lake:
    now = lake.now
    if has_marker(spark, lake.root):
        return lake
    remove_path(spark, lake.root)  # what a build interrupted before _READY left
    stage_arrivals(access_log(spark, sf_dir), lake.new, mode="overwrite")
    deliver(listed_files(spark, lake.new), lake.root, lake.hot, lake.manifest, 1)
    compact_arrived(spark, lake.hot, lake.cold, lake.manifest, lake.ledger, hour_key() < F.lit(view_cutoff(now)))
    write_marker(spark, lake.root)
    return lake
