"""T4: tumbling one-minute metric windows over a stream of samples with a
15-minute watermark, emitted in append mode once a window has closed; and a form
that also keeps the rows that came too late for their window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from edgelog.functions.timekeys import instant_to_ntz, ntz_as_utc_instant
from edgelog.operators.metrics import bucket_start


def windowed_counts(samples: DataFrame, period: str = "1 minute", delay: str = "15 minutes") -> DataFrame:
    """``samples``: streaming (metric, ts TIMESTAMP_NTZ, value).  Watermarks
    need TIMESTAMP: the NTZ wall clock is read as UTC (independent of the
    session zone, so windows align to UTC periods) and window starts are
    turned back into NTZ the same way."""
    s = samples.withColumn("ts", ntz_as_utc_instant(F.col("ts"))).withWatermark("ts", delay)
    agg = (s.groupBy(F.window("ts", period).alias("w"), "metric")
           .agg(F.count("*").alias("samples"), F.sum("value").alias("total")))
    return agg.select(instant_to_ntz(F.col("w.start")).alias("bucket"), "metric", "samples", "total")


def start_windowed(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    return (stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def start_windowed_with_late(stream: DataFrame, target: str, checkpoint: str, period: str = "1 minute",
                             delay: str = "15 minutes") -> StreamingQuery:
    """T4 with nothing lost: ``closed`` windows as above, and each row behind the watermark in ``late``, so that for every
    closed window input rows = counted + late.  Spark's own watermark drops such rows without a trace, so each batch
    closes windows itself: it merges its partial sums with the ``open`` ones of the batch before.

    ``stream``: (metric, ts TIMESTAMP_NTZ, value), without null ``ts`` (a row of no window, dropped as by Spark).  Every batch
    replaces its own folders and reads only those of the batch before, so a repeated batch changes nothing."""
    w = stream.writeStream.option("checkpointLocation", checkpoint)
    return (w.foreachBatch(lambda batch, number: close_windows(batch, number, target, period, delay))
            .trigger(availableNow=True).start())


def close_windows(batch: DataFrame, number: int, target: str, period: str, delay: str) -> None:
    """One batch of ``start_windowed_with_late``.  A window is closed once its end is not after the newest time stamp seen less
    ``delay``; a row is late if its window was closed before the batch."""
    spark = batch.sparkSession

    def folder(table: str, n: int) -> str:
        return f"{target}/{table}/batch={n}"

    def put(table: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(folder(table, number))
        return spark.read.schema(df.schema).parquet(folder(table, number))

    def instant(value) -> Column:
        return F.lit(None if value is None else str(value)).cast("timestamp_ntz")

    def passed(newest: Column) -> Column:  # of a window beginning at ``bucket``
        return F.coalesce(F.col("bucket") + F.expr(f"INTERVAL {period}") <= newest - F.expr(f"INTERVAL {delay}"), F.lit(False))

    seen = spark.read.parquet(folder("newest", number - 1)).first()[0] if number else None
    rows = batch.where("ts IS NOT NULL").withColumn("bucket", bucket_start(F.col("ts"), period))
    # the window of a late row ended before the newest time stamp: that plainer limit on ts reaches the scan
    put("late", rows.where(F.col("ts") < instant(seen)).where(passed(instant(seen))))
    sums = put("sums", rows.groupBy("bucket", "metric").agg(F.count("*").alias("samples"), F.sum("value").alias("total"),
                                                            F.max("ts").alias("newest")))
    newest = put("newest", sums.agg(F.greatest(F.max("newest"), instant(seen)).alias("newest"))).first()[0]
    merged = sums.drop("newest").where(~passed(instant(seen)))
    if number:
        merged = merged.unionByName(spark.read.schema(merged.schema).parquet(folder("open", number - 1)))
    merged = merged.groupBy("bucket", "metric").agg(F.sum("samples").alias("samples"), F.sum("total").alias("total"))
    put("closed", merged.where(passed(instant(newest))))
    put("open", merged.where(~passed(instant(newest))))
