"""CDN-style delivery of log files into ``new/`` (used to build a lake from
the driver tables): gzip text, two ``#`` header lines per file, the file name
``<distribution>.<yyyy-MM-dd-HH>.<slice>`` carrying the request hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelog.schema import DATA_COLUMNS
from edgelog.sources.accesslog import to_tsv_line

# The two header lines of a delivered log file.
HEADER_LINES = ["#Version: 1.0", "#Fields: " + " ".join(DATA_COLUMNS)]


def stage_arrivals(log: DataFrame, new_root: str, distribution: str = "E2EXAMPLE", slices: int = 1,
                   mode: str = "append") -> None:
    """Write ``log`` as delivered files, named by hour and ``slices`` (a hash
    of the request id); a big hour is also split by AQE's rebalancing.
    ``mode="overwrite"`` replaces the whole folder (an idempotent rebuild)."""
    part = F.pmod(F.xxhash64("result_id"), F.lit(slices)) if slices > 1 else F.lit(0)
    name = F.concat(F.lit(distribution + "."), F.col("year"), F.lit("-"), F.col("month"), F.lit("-"),
                    F.col("day"), F.lit("-"), F.col("hour"), F.lit("."),
                    part.cast("string"))
    body = to_tsv_line(log.withColumn("f", name).withColumn("k", F.col("result_id"))).select(
        "value", "f", F.lit(len(HEADER_LINES)).alias("ord"), "k")
    heads = (body.select("f").distinct()
             .select("f", F.posexplode(F.array(*[F.lit(h) for h in HEADER_LINES])).alias("ord", "value"))
             .withColumn("k", F.lit("")))
    lines = body.unionByName(heads.select("value", "f", "ord", "k"))
    # dealt by file name: no sampling run over the whole log, as ranges need.
    # AQE splits a huge hour over several tasks (several delivered files); the
    # header lines come first in the file that they fall into
    (lines.hint("rebalance", "f").sortWithinPartitions("f", "ord", "k").select("value", "f")
     .write.mode(mode).option("partitionOverwriteMode", "static").partitionBy("f")
     .option("compression", "gzip").text(new_root))
