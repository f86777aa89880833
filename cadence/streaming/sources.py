"""Builders of event streams: landed JSON files, or a Kafka topic by its options.

A line that is no JSON object with the needed keys goes to its own lane, with the file and the reason,
instead of stopping the stream or vanishing. Repeated deliveries of an event within the watermark are
dropped (the stream form of W11), with state that expires with the watermark.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.operators import prefs as P
from cadence.streaming.feedback_stream import ALLOWED_LATENESS

RAW = "value string"


def file_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None, bytes_per_trigger: str | None = None) -> DataFrame:
    """``(value, origin)``: the lines of files that land in a folder, at a bounded rate: a number of
    files, or of bytes (``"512m"``), a micro-batch."""
    r = spark.readStream
    if files_per_trigger is not None and bytes_per_trigger is not None:
        raise ValueError("one rate bound: files or bytes")
    if files_per_trigger is not None:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger is not None:
        r = r.option("maxBytesPerTrigger", bytes_per_trigger)
    return r.text(path).select("value", F.col("_metadata.file_path").alias("origin"))


def kafka_lines(spark: SparkSession, options: dict) -> DataFrame:
    """``(value, origin)`` of a topic; ``options`` are Spark's Kafka options (``maxOffsetsPerTrigger``
    is the rate bound). Needs the connector on the cluster's class path."""
    r = spark.readStream.format("kafka").options(**options).load()
    return r.select(F.col("value").cast("string").alias("value"),
                    F.concat_ws(":", "topic", F.col("partition").cast("string"), F.col("offset").cast("string")).alias("origin"))


@dataclass(frozen=True)
class Lanes:
    """The two lanes of a raw stream: parsed events, and what could not be parsed."""

    events: DataFrame
    corrupt: DataFrame


def music_lanes(raw: DataFrame) -> Lanes:
    """F5 on a stream: events with ``ts``, and ``(value, origin, reason)`` of the lines left out."""
    t = F.col("value")
    keyed, readable = P.has_keys(t, ("room_id", "song_id")), P.has_keys(t, ())
    tagged = raw.select("value", "origin", keyed.alias("keyed"), readable.alias("readable"))
    reason = F.when(~F.col("readable"), "not a JSON object").otherwise("room_id or song_id missing")
    events = P.parse_music_events(tagged.where("keyed").select("value"))
    return Lanes(events.withColumn("ts", F.col("timestamp").try_cast("timestamp")),
                 tagged.where("not keyed").select("value", "origin", reason.alias("reason")))


def once(events: DataFrame, keys: list[str], lateness: str = ALLOWED_LATENESS) -> DataFrame:
    """W11 / repeated deliveries: the first event of each key; a key is remembered for as long as the
    watermark allows late events, so state is bounded by the rate and not by the stream's length."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def start_corrupt_lane(lanes: Lanes, path: str, checkpoint: str, trigger: dict | None = None):
    """The corrupt lane as JSON, one folder per reason."""
    return (lanes.corrupt.writeStream.format("json").partitionBy("reason").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
