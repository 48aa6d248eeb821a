"""A streaming admission monitor: reject rates by tumbling window."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources import shared_dir, table


def windowed(stream: DataFrame, window: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Counts by window of events (ts, rejected); windows that ended `late` before the stream's latest event are closed and leave the state."""
    rates = stream.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.count("*").alias("n"), F.count_if("rejected").alias("rejected"))
    return rates.select(F.col("window.start").alias("window_start"), "n", "rejected", F.round(F.col("rejected") / F.col("n"), 3).alias("reject_rate"))


def reject_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the monitor over what the events table holds now and returns the latest counts of each window.

    State, progress and output lie in the folder that executors share, so a lost executor or a
    restart goes on from the last batch. Each batch writes the windows that it changed under its
    own number, so a batch that is run again replaces its own output.
    """
    here = f"{shared_dir(spark)}/monitor-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    stream = events.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("rejected"))

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).write.mode("overwrite").parquet(f"{here}/out/batch={number}")

    query = windowed(stream).writeStream.outputMode("update").option("checkpointLocation", f"{here}/state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{here}/out")
    return out.groupBy("window_start").agg(F.max_by(F.struct("n", "rejected", "reject_rate"), "batch").alias("r")).select("window_start", "r.*")
