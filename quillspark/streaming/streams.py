"""Structured Streaming versions of the incremental operators. Every sink runs until its input is used up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans.session import shared_dir


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the pipeline as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what there is and give the result as a table in the shared folder."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def last_result(stream: DataFrame) -> DataFrame:
    """Process what there is in complete mode and give the result after the last batch, open windows included."""
    at, done = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}", []

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out-{n}")
        done.append(n)

    stream.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{at}/out-{done[-1]}") if done else spark.createDataFrame([], stream.schema)


def first_deliveries(messages: DataFrame, key: str, at: str, late: str = "7 days") -> DataFrame:
    """Each key once, as long as its deliveries lie within `late` of each other; the state is bounded by that time."""
    return messages.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per tumbling window and `by`. In append mode a window is given out once the watermark has passed it."""
    w = events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))
    return w.select(F.unix_micros("window.start").alias("window_start"), by, "n")


def st3_message_stream(spark: SparkSession, d: str) -> DataFrame:
    """Messages per channel after dropping second deliveries on the way."""
    s = first_deliveries(stream_table(spark, d, "slack_messages").select("msg_id", "channel", "ingested_at"), "msg_id", "ingested_at", "400 days")
    return run_to_end(s.select("msg_id", "channel")).groupBy("channel").agg(F.count("*").alias("n_messages"))


def st8_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts by type of the event stream, the windows that are still open at its end included."""
    e = stream_table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"), "event_type")
    return last_result(windowed_counts(e, "at", "event_type"))


QUERIES = {"st3_message_stream": st3_message_stream, "st8_event_windows": st8_event_windows}
ORACLES = {
    "st3_message_stream": "select channel, count(distinct msg_id) as n_messages from slack_messages group by 1",
    "st8_event_windows": "select epoch_us(date_trunc('hour', ts)) as window_start, event_type, count(*) as n from events group by 1, 2",
}
