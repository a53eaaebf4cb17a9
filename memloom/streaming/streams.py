"""Structured Streaming counterparts: windows, sessions, triggers, feedback, dedup.

Each function takes a streaming (or batch) frame of events with an event-time
column ``ts`` and returns a frame; watermarks bound the state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import fresh_path

LATE = "2 hours"


def read_events(spark: SparkSession, sf_dir: str, streaming: bool = True) -> DataFrame:
    """The ``events`` table, as a file stream or a batch."""
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir) if streaming else batch
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))  # event time needs an instant


def tumbling(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sliding(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", "1 hour", "15 minutes")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "v")


def sessions(events: DataFrame) -> DataFrame:
    """STM3: sessions of a user, closed by 30 idle minutes."""
    return events.withWatermark("ts", LATE).groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end"), "n")


def fired_triggers(events: DataFrame, triggers: DataFrame) -> DataFrame:
    """STM1: stream-static join with (event_type, least, action) conditions."""
    return events.join(F.broadcast(triggers), "event_type").where("value >= least").select("event_id", "action")  # a registry of rules: small by nature


def access_patterns(events: DataFrame) -> DataFrame:
    """STM2: count, first and last access by user and kind of event."""
    return events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").cast("timestamp_ntz").alias("first_ts"), F.max("ts").cast("timestamp_ntz").alias("last_ts"))


def feedback_scores(events: DataFrame) -> DataFrame:
    """STM5: mean feedback by user."""
    score = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "click", 0.6).when(F.col("event_type") == "view", 0.1).otherwise(0.0)
    return events.groupBy("user_id").agg(F.round(F.avg(score), 8).alias("score"))


def first_of_kind(events: DataFrame) -> DataFrame:
    """STM6: exact duplicates (user, kind, props) dropped within the watermark."""
    return events.withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["user_id", "event_type", "props"]).select("user_id", "event_type", "props")


def effectiveness(events: DataFrame) -> DataFrame:
    """STM7: exponential moving average 0.9 old + 0.1 new of success, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", F.when(F.col("event_type") == "error", 0.0).otherwise(1.0).alias("x"))))
    return events.groupBy("user_id").agg(F.round(F.aggregate(ordered, F.lit(0.5), lambda acc, e: acc * 0.9 + e["x"] * 0.1), 8).alias("ema"))


def run_once(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Drive a stream over what is there (availableNow) and return its last state.

    Every micro-batch is written to files of the shared folder under its number, so a
    repeated batch replaces itself; nothing passes through the driver. In append mode
    all batches count, in update mode the last row of each key, and in complete mode
    the last batch. Windows of a watermarked stream leave the state once they are
    closed in update mode; sessions, and totals by user, keep theirs.
    """
    spark = stream.sparkSession
    top = fresh_path(spark, "stream")
    schema = stream.schema

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    number = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    out = spark.read.schema(number).parquet(f"{top}/out")
    if mode == "update":
        last = out.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in schema.names if c not in keys]), "batch").alias("_r"))
        return last.select(*keys, "_r.*").select(*schema.names)
    if mode == "complete":
        return out.where(F.col("batch") == out.agg(F.max("batch")).first()[0]).select(*schema.names)
    return out.select(*schema.names)


def replay(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame], mode: str = "complete", keys: list[str] | None = None) -> DataFrame:
    return run_once(build(read_events(spark, sf_dir)), mode, keys)
