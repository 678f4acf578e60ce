"""Extension (the batch engine needs no streams): windowed counts of an event stream with a watermark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) by tumbling hours; a window closes when the watermark passes it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    sums = timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select("event_type", F.unix_micros(F.col("window.start")).alias("hour_us"), "n", F.round("total", 4).alias("total"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run the stream over the events there are, and return its final counts."""
    source = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = f"hourly_{uuid.uuid4().hex[:8]}"
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp()
    q = hourly_counts(source).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{base}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
