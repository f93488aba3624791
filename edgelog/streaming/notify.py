"""The notification stream - topic envelopes arrive as JSON lines, are
unwrapped (S7), shaped (N6) and split into notifications and dead letters
(N7) in one ``foreachBatch`` per micro-batch (idempotent by batch id).

Topics deliver at least once.  A message whose id was seen within ``remember`` is dropped; the watermark runs on the batch's
own time, so no message is ever too late and the state holds the ids of that span only.  Messages without an id are told
apart by their text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from edgelog.operators.notify import shape_notifications
from edgelog.sources.eventsrc import messages_of


def start_notifications(spark: SparkSession, envelopes_dir: str, out_dir: str, checkpoint: str, remember: str = "24 hours",
                        files_per_batch: int | None = None) -> StreamingQuery:
    reader = spark.readStream.schema("msg_id string, envelope string")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    envs = (reader.json(envelopes_dir)
            .withColumn("_known_by", F.coalesce(F.concat(F.lit("id "), "msg_id"), F.concat(F.lit("text "), F.sha2("envelope", 256)), F.lit("nothing")))
            .withColumn("_seen", F.current_timestamp()).withWatermark("_seen", remember)
            .dropDuplicatesWithinWatermark(["_known_by"]).select("msg_id", "envelope"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        shaped = shape_notifications(messages_of(batch)).withColumn("batch_id", F.lit(batch_id))
        # overwrite this batch's own partition: a replayed batch replaces, never duplicates
        (shaped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(out_dir))

    return (envs.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
