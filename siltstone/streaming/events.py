"""Event streams: windowed counts with a watermark, and draining what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import table_path


def counted_by_window(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums for each event type and window; rows later than ``late`` behind the newest are dropped."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("event_type", F.window("ts", width).alias("w"))
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("day"), "n", "total")


def drained(stream: DataFrame) -> DataFrame:
    """Run a stream over all that its source holds now, and return its final state.

    The state is written to the workspace after each batch; the last one
    written is read, so nothing gathers on the driver.
    """
    spark, folder = stream.sparkSession, table_path(stream.sparkSession, "drained")
    done: list[str] = []

    def save(batch: DataFrame, number: int) -> None:
        path = f"{folder}/{number}"
        batch.write.mode("overwrite").parquet(path)
        done.append(path)

    q = stream.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", table_path(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return spark.read.schema(stream.schema).parquet(done[-1]) if done else spark.createDataFrame([], stream.schema)
