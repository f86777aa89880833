"""T6-T8 with state that expires: running totals that the engine holds only while a key is active.

A key that gets no event for ``SILENCE`` of event time is dropped by a timer. An event that comes
later starts a new *run* of the key: results are kept per (key, run), and the total of a key is the sum
over its runs, so it goes on from what is stored. A run is named by the time of its first event,
which is later than the end of the run before.

State is therefore bounded by the keys that are active within the silence, not by all that the stream
has ever seen. Rows older than the watermark are dropped by the engine (T2).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.operators import prefs as P
from cadence.streaming import feedback_stream as T
from cadence.streaming.results import Results, added, newest

SILENCE = "6 hours"
COUNTS = [f"{a}_count" for a in P.FEEDBACK_ACTIONS]


def _ms():
    return F.unix_millis("ts").alias("ms")


def _expire_at(state, last: int, silence_ms: int) -> None:
    state.setTimeoutTimestamp(max(last + silence_ms, state.getCurrentWatermarkMs() + 1))


def _millis(silence: str) -> int:
    return int(pd.Timedelta(silence).total_seconds() * 1000)


# ---- T6: score and counters ------------------------------------------------------------

RUN_SCORES = "session_id string, video_id string, run long, score double, " + ", ".join(f"{c} long" for c in COUNTS)
_SCORE_STATE = "run long, last long, score double, " + ", ".join(f"{c} long" for c in COUNTS)


def _score_fn(silence_ms: int):
    def fn(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        run, last, score, *counts = state.get if state.exists else (None, 0, 0.0, *[0] * len(COUNTS))
        for pdf in batches:
            run = int(pdf["ms"].min()) if run is None else run
            last = max(last, int(pdf["ms"].max()))
            score += float(pdf["score_delta"].sum())
            action = pdf["action"].str.lower()
            counts = [n + int((action == a).sum()) for n, a in zip(counts, P.FEEDBACK_ACTIONS)]
        state.update((run, last, score, *counts))
        _expire_at(state, last, silence_ms)
        yield pd.DataFrame([[key[0], key[1], run, score, *counts]], columns=["session_id", "video_id", "run", "score", *COUNTS])

    return fn


def score_runs(feedback: DataFrame, lateness: str = T.ALLOWED_LATENESS, silence: str = SILENCE) -> DataFrame:
    """T6 as a stream: running totals per (session, video, run), for ``feedback(session_id, video_id,
    action, ts)``."""
    rows = P.with_feedback_weight(T.with_watermark(feedback, lateness)).select("session_id", "video_id", "action", "score_delta", _ms(), "ts")
    return rows.groupBy("session_id", "video_id").applyInPandasWithState(_score_fn(_millis(silence)), RUN_SCORES, _SCORE_STATE, "update", "EventTimeTimeout")


def run_scores(path: str) -> Results:
    return Results(path, newest(["session_id", "video_id", "run"]))


def stored_scores(results: Results, spark: SparkSession) -> DataFrame | None:
    """The totals of every (session, video), over all runs."""
    rows = results.current(spark)
    return None if rows is None else rows.groupBy("session_id", "video_id").agg(*[F.sum(c).alias(c) for c in ("score", *COUNTS)])


# ---- T7: latest action -----------------------------------------------------------------

LATEST = "session_id string, user_id string, video_id string, ms long, action string, score_delta double"
ACTION_KEYS = ["session_id", "user_id", "video_id"]


def _latest_fn(silence_ms: int):
    def fn(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        before = best = tuple(state.get) if state.exists else None
        for pdf in batches:
            row = max(zip(pdf["ms"].tolist(), pdf["action"].tolist(), pdf["score_delta"].tolist()))
            best = row if best is None else max(best, row)
        state.update(best)
        _expire_at(state, best[0], silence_ms)
        if best != before:
            yield pd.DataFrame([[*key, *best]], columns=[*ACTION_KEYS, "ms", "action", "score_delta"])

    return fn


def latest_runs(feedback: DataFrame, lateness: str = T.ALLOWED_LATENESS, silence: str = SILENCE) -> DataFrame:
    """T7 as a stream: the last action per (session, user, video), emitted when it changes."""
    rows = P.with_feedback_weight(T.with_watermark(feedback.where("action is not null"), lateness)).select(*ACTION_KEYS, "action", "score_delta", _ms(), "ts")
    return rows.groupBy(*ACTION_KEYS).applyInPandasWithState(_latest_fn(_millis(silence)), LATEST, "ms long, action string, score_delta double", "update", "EventTimeTimeout")


def run_actions(path: str) -> Results:
    """The newest action by time, then by text, whatever order the runs were written in."""
    return Results(path, added(ACTION_KEYS, [], last={"action": "at", "score_delta": "at"}))


def stored_actions(results: Results, spark: SparkSession) -> DataFrame | None:
    rows = results.current(spark)
    return None if rows is None else rows.select(*ACTION_KEYS, "action", "score_delta", F.timestamp_millis("at.ms").alias("last_updated"))


# ---- T8: refresh points ----------------------------------------------------------------

RUN_PLAYS = "session_id string, run long, before long, after long"


def _plays_fn(silence_ms: int):
    def fn(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        run, last, before = state.get if state.exists else (None, 0, 0)
        after = before
        for pdf in batches:
            run = int(pdf["ms"].min()) if run is None else run
            last, after = max(last, int(pdf["ms"].max())), after + len(pdf)
        state.update((run, last, after))
        _expire_at(state, last, silence_ms)
        yield pd.DataFrame({"session_id": [key[0]], "run": [run], "before": [before], "after": [after]})

    return fn


def play_runs(plays: DataFrame, lateness: str = T.ALLOWED_LATENESS, silence: str = SILENCE) -> DataFrame:
    """Plays of a session's run before and after each micro-batch, for ``plays(session_id, ts)``."""
    rows = T.with_watermark(plays, lateness).select("session_id", _ms(), "ts")
    return rows.groupBy("session_id").applyInPandasWithState(_plays_fn(_millis(silence)), RUN_PLAYS, "run long, last long, played long", "update", "EventTimeTimeout")


class Refreshes:
    """A refresh point each time a session's plays, over all its runs, pass a multiple of ``every``."""

    def __init__(self, path: str, every: int = T.REFRESH_EVERY):
        self.every = every
        self.runs = Results(f"{path.rstrip('/')}/runs", newest(["session_id", "run"]))
        self.fired = Results(f"{path.rstrip('/')}/fired", newest(["session_id", "refresh_at"]))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        self.runs.write(batch, batch_id)
        rows = spark.read.schema(batch.schema).parquet(self.runs.version(batch_id))
        # plays of the session's other runs: they ended before this one began
        others = self.runs.current(spark).select("session_id", F.col("run").alias("other"), F.col("after").alias("n"))
        others = others.join(rows.select("session_id", "run"), "session_id").where("other < run").groupBy("session_id", "run").agg(F.sum("n").alias("stored"))
        span = rows.join(others, ["session_id", "run"], "left").withColumn("stored", F.coalesce("stored", F.lit(0).cast("long")))
        e = self.every
        first = F.expr(f"((stored + before) div {e} + 1) * {e}L")
        points = span.withColumn("first", first).where(F.col("first") <= F.col("stored") + F.col("after")).select(
            "session_id", F.explode(F.expr(f"sequence(first, stored + after, {e}L)")).alias("refresh_at"))
        self.fired.write(points, batch_id)

    def start(self, plays: DataFrame, checkpoint: str, lateness: str = T.ALLOWED_LATENESS, silence: str = SILENCE, trigger: dict | None = None):
        return (play_runs(plays, lateness, silence).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True})).foreachBatch(self.write).start())

    def points(self, spark: SparkSession) -> DataFrame | None:
        return self.fired.current(spark)


# ---- launchers -------------------------------------------------------------------------

def start_scores(feedback: DataFrame, results: Results, checkpoint: str, lateness: str = T.ALLOWED_LATENESS, silence: str = SILENCE,
                 trigger: dict | None = None):
    """Into versioned results per (session, video, run)."""
    return (score_runs(feedback, lateness, silence).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).foreachBatch(results.write).start())


def start_latest(feedback: DataFrame, results: Results, checkpoint: str, lateness: str = T.ALLOWED_LATENESS, silence: str = SILENCE,
                 trigger: dict | None = None):
    """Into versioned results per (session, user, video)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        results.write(batch.select(*ACTION_KEYS, F.struct("ms", "action").alias("at"), "action", "score_delta"), batch_id)

    return (latest_runs(feedback, lateness, silence).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start())
