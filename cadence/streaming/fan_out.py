"""T5: one parsed stream to three results, in one query.

Each micro-batch is read and parsed once and written to the branches, as parts that add up:

* ``archive``   S8: the raw events with their window bounds, as JSON lines
* ``metrics``   T1 / T4: counts per (window, room, song), with the first known names
* ``scores``    T6: score and counters per (session, video)
* ``actions``   T7: the last action per (session, user, video)

A branch's part of a batch is one folder that Spark commits as a whole. If a run fails between
branches, the batch is replayed: the branches that were complete are left as they are, the others are
written anew, so each holds each batch once. The parts need no state in the engine, whatever the
number of sessions; ``Results.compact`` keeps the number of versions small, and any late event simply
adds to its window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions import scalars as S
from cadence.operators import prefs as P
from cadence.sources import folders
from cadence.streaming import feedback_stream as T
from cadence.streaming.results import Results, added

METRIC_KEYS = ["window_start", "window_end", "room_id", "song_id"]
METRIC_COUNTS = ["play_count", "skip_count", "complete_count"]
SCORE_KEYS = ["session_id", "video_id"]
SCORE_LAST = {"last_updated": "last_updated"}
SCORE_SUMS = ["score", *[f"{a}_count" for a in P.FEEDBACK_ACTIONS]]
ACTION_KEYS = ["session_id", "user_id", "video_id"]


def metric_parts(events: DataFrame, size: str = T.WINDOW) -> DataFrame:
    """Counts of a batch per window, room and song; a name with the time of the event it is from."""
    known = lambda c: F.when(F.col(c) != "Unknown", F.col("ts"))
    a = F.col("action")
    g = events.where("ts is not null").groupBy(F.window("ts", size).alias("w"), "room_id", "song_id").agg(
        *[F.count_if(a == x).alias(f"{x}_count") for x in ("play", "skip", "complete")],
        *[F.min_by(c, known(c)).alias(c) for c in ("song_name", "artist")],
        *[F.min(known(c)).alias(f"{c}_ts") for c in ("song_name", "artist")])
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "room_id", "song_id",
                    *METRIC_COUNTS, "song_name", "song_name_ts", "artist", "artist_ts")


def metric_rows(parts: DataFrame) -> DataFrame:
    """The folded parts as T4's rows."""
    total = F.col("play_count") + F.col("skip_count") + F.col("complete_count")
    return parts.select("room_id", "song_id", *[F.coalesce(c, F.lit("Unknown")).alias(c) for c in ("song_name", "artist")], *METRIC_COUNTS,
                        F.when(total > 0, S.round_to(F.col("complete_count") / total, 4)).otherwise(F.lit(0.0)).alias("completion_rate"),
                        total.alias("total_events"), "window_start", "window_end")


def action_parts(feedback: DataFrame) -> DataFrame:
    """The last action of a batch per key, with what decides between batches."""
    last = P.latest_action(P.with_feedback_weight(feedback), ts="ts")
    return last.select(*ACTION_KEYS, F.struct("last_updated", "action").alias("at"), "action", "score_delta")


class FanOut:
    """The branches below one folder and the query that feeds them."""

    def __init__(self, path: str, size: str = T.WINDOW):
        self.size = size
        root = path.rstrip("/")
        self.archive = f"{root}/archive"
        self.metrics = Results(f"{root}/metrics", added(METRIC_KEYS, METRIC_COUNTS, first={"song_name": "song_name_ts", "artist": "artist_ts"}))
        self.scores = Results(f"{root}/scores", added(SCORE_KEYS, SCORE_SUMS))
        self.actions = Results(f"{root}/actions", added(ACTION_KEYS, [], last={"action": "at", "score_delta": "at"}))

    def _archived(self, batch_id: int) -> str:
        return f"{self.archive}/batch_id={batch_id}"

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` function for parsed events (F5) with ``ts``."""
        spark = batch.sparkSession
        columns = [c for c in batch.columns if c != "_row"]
        batch = batch.select(*columns).persist()      # parsed once; a lost block is parsed again
        try:
            if not folders.committed(spark, self._archived(batch_id)):
                T.archive_records(batch, self.size).select("value").write.mode("overwrite").text(self._archived(batch_id))
            if not self.metrics.written(spark, batch_id):
                self.metrics.write(metric_parts(batch, self.size), batch_id)
            feedback = T.music_to_feedback(batch)
            if not self.scores.written(spark, batch_id):
                self.scores.write(P.track_scores(P.with_feedback_weight(feedback)), batch_id)
            if not self.actions.written(spark, batch_id):
                self.actions.write(action_parts(feedback), batch_id)
        finally:
            batch.unpersist()

    def start(self, events: DataFrame, checkpoint: str, trigger: dict | None = None):
        """``events``: a parsed stream with ``ts``. One query, one checkpoint."""
        return (events.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
                .foreachBatch(self.write).start())

    def current_metrics(self, spark: SparkSession) -> DataFrame | None:
        parts = self.metrics.current(spark)
        return None if parts is None else metric_rows(parts)

    def current_scores(self, spark: SparkSession) -> DataFrame | None:
        return self.scores.current(spark)

    def latest_actions(self, spark: SparkSession) -> DataFrame | None:
        rows = self.actions.current(spark)
        return None if rows is None else rows.select(*ACTION_KEYS, "action", "score_delta", F.col("at.last_updated").alias("last_updated"))

    def compact(self, spark: SparkSession) -> None:
        for r in (self.metrics, self.scores, self.actions):
            r.compact(spark)
