"""Event-time windows over a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.session import shared_dir


def tumbling_counts(events: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n) of a stream or a table of events (ts, event_type).

    Events later than ``late`` behind the newest are dropped from a stream; append
    mode holds a window back until the watermark has passed it.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    counted = rows.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n")


def streamed_counts(spark: SparkSession, path: str, every: str = "1 hour") -> DataFrame:
    """``tumbling_counts`` of all that a Parquet path holds now, as a stream that has ended.

    Checkpoints and the result are in the shared folder; every window is in the result,
    also those that a watermark would hold back.
    """
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    counts = tumbling_counts(spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]"), every)  # a pattern may also be one file
    put = lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/out")
    counts.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")
