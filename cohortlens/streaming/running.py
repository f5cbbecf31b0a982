"""Running levels over an event stream: an extension, the surveyed workflow has no streams.

Tumbling windows with a watermark; late events beyond it are dropped, windows come out once
they are closed.  State is one row of sums for each open window and key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def windowed_totals(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window_start, event_type, n, total) by event time."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(user_id, session_start, n) of events less than ``gap`` apart."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("session_start"), "n")


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over what there is, append its closed windows to Parquet and stop; a restart goes on from the checkpoint."""
    stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, name: str = "events.parquet") -> DataFrame:
    """The files of one table in a folder as a stream; event times without a zone are those of the session."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))
