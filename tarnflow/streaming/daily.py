"""Streams of events: windows that are final once the watermark has passed them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """``(d, event_type, n, total)`` of days; events later than ``delay`` no longer count."""
    t = events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", delay)
    return t.groupBy(F.window("t", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.to_date("w.start").alias("d"), "event_type", "n", "total")


def deduplicated(events: DataFrame, key: str = "event_id", delay: str = "1 day") -> DataFrame:
    return events.withColumn("t", F.col("ts").cast("timestamp")).withWatermark("t", delay).dropDuplicatesWithinWatermark([key])


def run_available(events: DataFrame, at: str, mode: str = "complete") -> DataFrame:
    """Process all that is there into files below ``at``, each batch's result in its own folder, and return the last one's.

    The last result is the folder of the highest number, whichever run wrote it; so a restart without new events gives
    what the run before it gave.
    """
    spark = events.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/result/{number}")

    q = events.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").foreachBatch(save).trigger(availableNow=True).start()
    q.awaitTermination()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/result")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = [int(f.getPath().getName()) for f in (store.listStatus(path) if store.exists(path) else ()) if store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return spark.read.schema(events.schema).parquet(f"{at}/result/{max(whole)}") if whole else spark.createDataFrame([], events.schema)
