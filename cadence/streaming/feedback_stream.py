"""Structured Streaming: music-event and feedback streams.

The aggregations are plain DataFrame functions, so the same code runs on a batch frame
(tests, back-fills) and on a ``readStream`` frame; only the sources / sinks differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.functions import scalars as S
from cadence.operators import prefs as P
from cadence.streaming.results import Results, newest

# Fixed values of the reference's stream (params file): window, lateness, refresh cadence.
WINDOW = "60 seconds"
ALLOWED_LATENESS = "30 seconds"
REFRESH_EVERY = 10


def event_time(df: DataFrame, col: str = "timestamp") -> DataFrame:
    """Event time as a UTC ``timestamp`` (``timestamp_ntz`` cannot carry a watermark)."""
    return df.withColumn("ts", F.col(col).cast("timestamp"))


def with_watermark(df: DataFrame, lateness: str = ALLOWED_LATENESS) -> DataFrame:
    """Keep state for events up to ``lateness`` behind the max event time seen."""
    return df.withWatermark("ts", lateness)


def window_metrics(events: DataFrame, size: str = WINDOW) -> DataFrame:
    """T1 + T4 (+ W7): per (tumbling window, room_id, song_id): play / skip / complete counts,
    completion rate (4 dp, 0 if none), first non-'Unknown' song name and artist (earliest
    event wins, D22). Works in update mode on a stream: all aggregates are incremental."""
    a = F.col("action")
    plays, skips, comps = F.count_if(a == "play"), F.count_if(a == "skip"), F.count_if(a == "complete")

    def first_known(c):
        return F.coalesce(F.min_by(F.col(c), F.when(F.col(c) != "Unknown", F.col("ts"))), F.lit("Unknown"))

    agg = (events.groupBy(F.window("ts", size).alias("w"), "room_id", "song_id")
           .agg(plays.alias("play_count"), skips.alias("skip_count"), comps.alias("complete_count"),
                first_known("song_name").alias("song_name"), first_known("artist").alias("artist")))
    total = F.col("play_count") + F.col("skip_count") + F.col("complete_count")
    return agg.select("room_id", "song_id", "song_name", "artist", "play_count", "skip_count", "complete_count",
                      F.when(total > 0, S.round_to(F.col("complete_count") / total, 4))
                      .otherwise(F.lit(0.0)).alias("completion_rate"),
                      total.alias("total_events"),
                      F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"))


def archive_records(events: DataFrame, size: str = WINDOW) -> DataFrame:
    """Raw events tagged with their window bounds, as JSON lines."""
    w = F.window("ts", size)
    return events.select(F.to_json(F.struct(*[F.col(c) for c in events.columns if c != "ts"],
                                            w.start.cast("string").alias("_window_start"),
                                            w.end.cast("string").alias("_window_end"))).alias("value"),
                         F.to_date(w.start).alias("window_date"))


def music_to_feedback(events: DataFrame) -> DataFrame:
    """The score branch keys by session and video: room_id -> session_id (P18), song_id -> video_id."""
    return events.select(S.room_to_session("room_id").alias("session_id"), "user_id",
                         F.col("song_id").alias("video_id"), "action", "ts")


def score_state(feedback: DataFrame) -> DataFrame:
    """Running score and per-action counters per (session_id, video_id)."""
    return P.track_scores(P.with_feedback_weight(feedback), "ts" if "ts" in feedback.columns else None)


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """Last action per (session, user, video) by event time."""
    return P.latest_action(P.with_feedback_weight(feedback), ts="ts")


# ---- T8: refresh trigger (custom state per session) -------------------------------------

REFRESH_STATE = "played long, last_refresh long"
REFRESH_OUT = "session_id string, refresh_at long"


def _refresh_fn(every: int):
    import pandas as pd

    def fn(key, batches, state):
        played, last = (state.get if state.exists else (0, 0))
        fired = []
        for pdf in batches:
            played += int(len(pdf))
            while played >= last + every:
                last += every
                fired.append(last)
        state.update((played, last))
        yield pd.DataFrame({"session_id": [key[0]] * len(fired), "refresh_at": fired})

    return fn


def refresh_triggers(plays: DataFrame, every: int = REFRESH_EVERY) -> DataFrame:
    """Emit (session_id, refresh_at) each time a session's play count passes the next
    multiple of ``every`` (count-based, no polling). State per session: (played, last_refresh)."""
    return (plays.select(F.col("session_id").cast("string").alias("session_id"))
            .groupBy("session_id")
            .applyInPandasWithState(_refresh_fn(every), REFRESH_OUT, REFRESH_STATE, "append", "NoTimeout"))


def refresh_points_batch(plays: DataFrame, every: int = REFRESH_EVERY) -> DataFrame:
    """Batch form of T8: the same refresh points from play counts."""
    n = plays.groupBy(F.col("session_id").cast("string").alias("session_id")).agg(F.count(F.lit(1)).alias("n"))
    return (n.where(F.col("n") >= every)
            .select("session_id", F.explode(F.sequence(F.lit(every).cast("long"),
                                                       (F.col("n") - F.pmod("n", F.lit(every))).cast("long"),
                                                       F.lit(every).cast("long"))).alias("refresh_at")))


# ---- sinks ----------------------------------------------------------------------------

def versioned_upsert(path: str, keys: list[str]):
    """``foreachBatch`` writer for update-mode output. Each micro-batch is written to
    ``path/batch_id=N`` (overwritten if the batch is replayed, so at-least-once delivery is
    idempotent); ``read_current`` keeps the newest version per key."""
    def write(batch: DataFrame, batch_id: int):
        Results(path, newest(keys)).write(batch, batch_id)
    write.keys = keys
    return write


def read_current(spark, path: str, keys: list[str]) -> DataFrame:
    """Current state of a versioned-upsert table: the newest batch per key, from the base that
    ``results`` has compacted and the later versions."""
    return Results(path, newest(keys)).current(spark)


def start_metrics_stream(events_stream: DataFrame, out_path: str, checkpoint: str,
                         size: str = WINDOW, lateness: str = ALLOWED_LATENESS, trigger: dict | None = None):
    """T3 + T5 + S9: windowed metrics in update mode (a window is re-emitted with its running
    totals when late data arrives, like accumulating late firings) into a versioned upsert."""
    m = window_metrics(with_watermark(events_stream, lateness), size)
    w = m.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.foreachBatch(versioned_upsert(out_path, ["window_start", "room_id", "song_id"])).start()


def start_archive_stream(events_stream: DataFrame, out_path: str, checkpoint: str, trigger: dict | None = None):
    """Raw events archived as JSON, partitioned by window date."""
    return (archive_records(events_stream).writeStream.format("json").partitionBy("window_date")
            .option("path", out_path).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def start_score_stream(events_stream: DataFrame, out_path: str, checkpoint: str, trigger: dict | None = None):
    """Running score state per (session, video) in update mode, versioned upsert. Its state is kept
    for good; see ``expiring`` for the form whose state ends with a silent session."""
    s = score_state(music_to_feedback(events_stream))
    return (s.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .foreachBatch(versioned_upsert(out_path, ["session_id", "video_id"])).start())
