"""Link history as a stream: when each key was first and last seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from graphloom.functions.scalars import millis


def first_seen_updates(events: DataFrame, key: str = "key", ts: str = "ts") -> DataFrame:
    """key, first_seen, last_seen in milliseconds over a stream or a table; state holds one row per key."""
    return events.groupBy(F.col(key).alias("key")).agg(F.min(millis(F.col(ts))).alias("first_seen"), F.max(millis(F.col(ts))).alias("last_seen"))


def keep_history(events: DataFrame, path: str, checkpoint: str, *, key: str = "key", ts: str = "ts", every: str | None = None) -> StreamingQuery:
    """Write each batch's changed keys to Parquet below path; latest() reads what holds.

    A batch that is written again replaces itself, so a restart adds nothing twice.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}/")

    query = first_seen_updates(events, key, ts).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (query.trigger(processingTime=every) if every else query.trigger(availableNow=True)).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """key, first_seen, last_seen as of the last batch that touched each key."""
    return spark.read.schema("key string, first_seen long, last_seen long").parquet(f"{path}/batch=*").groupBy("key").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 days", ts: str = "ts", term: str = "event_type") -> DataFrame:
    """term, start, n of each window; rows later than late don't count, which bounds the state."""
    counted = events.withWatermark(ts, late).groupBy(F.col(term).alias("term"), F.window(ts, window).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("term", F.col("w.start").alias("start"), "n")
