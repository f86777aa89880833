"""Streaming forms equal the batch forms of the same rows; T8 state fires every 10 plays."""

import os
import tempfile

from pyspark.sql import functions as F

from cadence.streaming import feedback_stream as T


def events(spark, n=120):
    rows = [(f"AUX-R{i % 3}", str(i % 7), str(i % 11), "Unknown" if i % 4 == 0 else f"song {i % 11}", "artist",
             ["play", "skip", "complete", "like"][i % 4], f"2024-01-01 00:{i // 10:02d}:{(i * 7) % 60:02d}")
            for i in range(n)]
    return spark.createDataFrame(rows, "room_id string, user_id string, song_id string, song_name string, "
                                       "artist string, action string, timestamp string")


def test_metrics_stream_equals_batch(spark):
    base = tempfile.mkdtemp(dir="/tmp", prefix="cadence-test-")
    src = os.path.join(base, "src")
    ev = events(spark)
    for i in range(4):  # four landed files -> four micro-batches
        ev.where(F.col("user_id").cast("int") % 4 == i).coalesce(1).write.mode("append").json(src)
    stream = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).json(src))
    q = T.start_metrics_stream(T.event_time(stream), os.path.join(base, "out"), os.path.join(base, "chk"),
                               lateness="1 day")
    q.awaitTermination()
    cur = T.read_current(spark, os.path.join(base, "out"), ["window_start", "room_id", "song_id"])
    batch = T.window_metrics(T.event_time(ev))
    cols = ["window_start", "room_id", "song_id", "play_count", "skip_count", "complete_count", "total_events",
            "song_name", "completion_rate"]
    assert sorted(map(tuple, cur.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))


def test_refresh_trigger_state(spark):
    base = tempfile.mkdtemp(dir="/tmp", prefix="cadence-test-")
    src = os.path.join(base, "src")
    plays = spark.createDataFrame([("s1",)] * 25 + [("s2",)] * 9, "session_id string")
    plays.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(plays.schema).parquet(src)
    q = (T.refresh_triggers(stream).writeStream.format("memory").queryName("refresh_out")
         .option("checkpointLocation", os.path.join(base, "chk")).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted(map(tuple, spark.sql("select * from refresh_out").collect()))
    assert got == [("s1", 10), ("s1", 20)]
    batch = sorted(map(tuple, T.refresh_points_batch(plays).collect()))
    assert batch == got
