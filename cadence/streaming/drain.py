"""The end of sessions. Drain the stream, append the history (S15), merge the preferences.

``end_sessions`` runs the fan-out query until all that has landed is processed, then syncs the given
sessions, many at a time. It can be run again at any time: a session's history is replaced, not added
to, so a second run changes nothing and a late event that came between the runs is included.

The preference table has versions, each a folder that one Spark job wrote, and claims: a small file
``_claims/N`` that says which folder is version N. A merge reads version N, writes a new folder and
claims N + 1; the file must not exist yet, so of two merges at a time one is first and the other
merges again with what the first has written. Readers see a version as a whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.functions import scalars as S
from cadence.operators import prefs as P
from cadence.sources import folders
from cadence.streaming.fan_out import FanOut

LISTS = ["liked_songs", "disliked_songs", "skipped_songs", "replayed_songs"]
PREFERENCES = "user_id string, " + ", ".join(f"{c} array<string>" for c in LISTS) + ", last_updated timestamp"
MAX_TRIES = 20


class PreferenceTable:
    """users' liked / disliked / skipped / replayed ids, merged by compare-and-swap."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def version(self, spark: SparkSession) -> int:
        return max(folders.numbered(spark, f"{self.path}/_claims", ""), default=0)

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        n = self.version(spark) if version is None else version
        if n == 0:
            return spark.createDataFrame([], PREFERENCES)
        return spark.read.schema(PREFERENCES).parquet(f"{self.path}/{folders.text_of(spark, f'{self.path}/_claims/{n}')}")

    def merge(self, spark: SparkSession, new: DataFrame, between: Callable[[], None] | None = None) -> int:
        """Stored lists together with those of ``new(user_id, liked_songs, ..)``; users that are not
        stored are added. The version that holds the result. ``between`` is called before the claim."""
        for _ in range(MAX_TRIES):
            n = self.version(spark)
            stored = self.read(spark, n)
            merged = P.merge_preferences(stored, new).join(new.select("user_id", F.lit(True).alias("touched")), "user_id", "left")
            merged = merged.join(stored.select("user_id", "last_updated"), "user_id", "left").select(
                "user_id", *LISTS, F.when(F.col("touched"), F.current_timestamp()).otherwise(F.col("last_updated")).alias("last_updated"))
            folder = f"data-{uuid.uuid4().hex}"
            merged.write.parquet(f"{self.path}/{folder}")
            if between is not None:
                between()
            if folders.claim(spark, f"{self.path}/_claims/{n + 1}", folder):
                return n + 1
            folders.remove(spark, f"{self.path}/{folder}")
        raise RuntimeError(f"{MAX_TRIES} other merges came first")


def session_preferences(latest: DataFrame) -> DataFrame:
    """A12 per user, over the given sessions; rows without user, video or action are skipped."""
    pref = S.action_preference(F.col("action"))
    known = latest.where("coalesce(user_id, '') <> '' and coalesce(video_id, '') <> '' and coalesce(action, '') <> ''")
    return known.groupBy("user_id").agg(*[F.array_sort(F.collect_set(F.when(pref == c.removesuffix("_songs"), F.col("video_id")))).alias(c) for c in LISTS])


def append_history(latest: DataFrame, path: str) -> None:
    """The rows of these sessions, laid out by session; a session that was synced is replaced."""
    rows = P.history_rows(latest).where("user_id <> '' and video_id <> '' and action <> ''")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)


def end_sessions(spark: SparkSession, sessions: DataFrame, fan_out: FanOut, events: DataFrame, checkpoint: str,
                 history: str, preferences: PreferenceTable) -> int:
    """Drain, then sync the sessions of ``sessions(session_id)``; the preference version that holds them.

    ``events`` is the parsed stream of the fan-out query that ``checkpoint`` belongs to."""
    fan_out.start(events, checkpoint, {"availableNow": True}).awaitTermination()
    latest = fan_out.latest_actions(spark)
    if latest is None:
        return preferences.version(spark)
    latest = latest.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    if latest.isEmpty():
        return preferences.version(spark)       # nothing to sync
    append_history(latest, history)
    return preferences.merge(spark, session_preferences(latest))
