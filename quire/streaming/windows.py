"""Structured Streaming over event logs: windows with watermarks, sessions, latest states and duplicates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import shared_folder

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """The events table as a stream, its times with a zone so that watermarks apply."""
    r = spark.readStream.schema(SCHEMA)
    r = r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r
    return r.parquet(f"{folder}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 days", slide: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def latest(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x")).select("user_id", F.col("x.event_id").alias("event_id"), F.col("x.event_type").alias("event_type"))


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Process all that is there and return the result, written to the shared checkpoint folder.

    In complete mode each batch replaces the table, in append mode it adds to it under its own id, so that a batch that
    is run again after a failure doesn't count twice.
    """
    spark = stream.sparkSession

    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch={k}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)
