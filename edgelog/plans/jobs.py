"""The lake's recurring jobs as single runs (T7: the caller's scheduler -
cron, an orchestrator - decides when; each job takes ``now``):

- ``route``     on arrival / every few minutes: D1 via the exactly-once file stream (T1), names kept, manifest written
- ``register``  at minute 55: D3, the next hour's partition in the hot table
- ``compact``   at minute 1: D4 for hour ``now - 2h``, registered in the cold table, ledger updated
- ``repair``    any time: T3, re-compact every compacted hour that received late files

Usage: ``python -m edgelog.plans.jobs <job> --lake ROOT [--now 2024-01-30T22:20]``
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from edgelog.functions.timekeys import view_cutoff
from edgelog.operators.arrivals import compact_arrived_hour, last_batch, manifest_of, repair_arrivals
from edgelog.operators.layout import add_hours, register_next_hour
from edgelog.plans.lake import Lake
from edgelog.schema import PARTITION_KEYS
from edgelog.session import get_session
from edgelog.streaming.delivery import start_delivery


def route_job(spark: SparkSession, lake: Lake) -> None:
    """Hours that the new batches touched are added to the hot table (a few calendar entries)."""
    before = last_batch(manifest_of(spark, lake.manifest))
    q = start_delivery(spark, lake.root, lake.hot, lake.manifest, f"{lake.root}/_checkpoints/route")
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    fresh = manifest_of(spark, lake.manifest).where(F.col("batch") > before)
    add_hours(spark, lake.tables(spark)[0], [r.asDict() for r in fresh.select(*PARTITION_KEYS).distinct().collect()])


def register_job(spark: SparkSession, lake: Lake) -> dict[str, str]:
    """D3."""
    return register_next_hour(spark, lake.tables(spark)[0], lake.now)


def compact_job(spark: SparkSession, lake: Lake) -> dict[str, str]:
    p = compact_arrived_hour(spark, lake.hot, lake.cold, lake.manifest, lake.ledger, lake.now)
    add_hours(spark, lake.tables(spark)[1], [p])
    return p


def repair_job(spark: SparkSession, lake: Lake) -> None:
    repaired = repair_arrivals(spark, lake.hot, lake.cold, lake.manifest, lake.ledger, view_cutoff(lake.now))
    add_hours(spark, lake.tables(spark)[1], repaired)


JOBS = {"route": route_job, "register": register_job, "compact": compact_job, "repair": repair_job}


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("job", choices=sorted(JOBS))
    ap.add_argument("--lake", required=True, help="lake root folder (contains new/ hot/ cold/ manifest/ ledger/)")
    ap.add_argument("--now", default=None, help="UTC wall time, ISO format (default: now)")
    a = ap.parse_args(argv)
    now = dt.datetime.fromisoformat(a.now) if a.now else dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    spark = get_session(app_name=f"edgelog-{a.job}")
    print(JOBS[a.job](spark, Lake(a.lake, now)))


if __name__ == "__main__":
    main()
