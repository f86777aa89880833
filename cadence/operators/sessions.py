"""Session state and queue rules: F9, F10, J7, J11, P14, U4, W3, W12, W13, A25, A28, A29.

Snapshots are long tables ``(session_id, ts_ms, phase, rank, video_id, genre, final_score)``, one
row per recommended song; nothing is cut to a number of rows (the reference reads 20 or 500)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadence.functions.scalars import round_to
from cadence.session import dealt

# Fixed values of the reference.
COMPLETED = ("ended", "done")
LIVE = ("active", "done")
RUNNABLE = ("running", "processing")
FEEDBACK_KINDS = ("like", "dislike", "skip", "replay")
COLD_PHASE = "cold_start"
NEW_BATCH_MIN = 5
CATALOG_COLUMNS = ("video_id", "track_title", "artist_name", "genre", "duration_sec", "popularity_score", "embedding")


def with_status(sessions: DataFrame, statuses) -> DataFrame:
    """Sessions in one of the statuses (a missing status is none of them)."""
    return sessions.where(F.coalesce(F.col("status"), F.lit("")).isin(*statuses))


def catalog_rows(songs: DataFrame) -> DataFrame:
    """The catalog table's columns, in order; columns that are absent are null."""
    return songs.select(*[F.col(c) if c in songs.columns else F.lit(None).alias(c) for c in CATALOG_COLUMNS])


def songs_in_catalog(songs: DataFrame, catalog: DataFrame) -> DataFrame:
    """U4: the distinct songs of each session that the catalog holds."""
    return songs.select("session_id", "video_id").distinct().join(catalog.select("video_id"), "video_id", "left_semi")


def with_song_metadata(events: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Title, artist and genre from the session's current recommendations; '' where absent."""
    cols = ("track_title", "artist_name", "genre")
    meta = (recommendations.groupBy("session_id", "video_id")
            .agg(F.min(F.struct(*cols)).alias("m")).select("session_id", "video_id", *[F.col(f"m.{c}").alias(f"_{c}") for c in cols]))
    out = events.join(meta, ["session_id", "video_id"], "left")
    return out.select(*events.columns, *[F.coalesce(F.col(f"_{c}"), F.lit("")).alias(c) for c in cols])


def latest_cycles(snapshots: DataFrame, n: int = 1, rows: int = 0) -> DataFrame:
    """The rows of each session's last ``n`` cycles (1 to 20), newest first in ``cycle``. ``rows``: about
    how many snapshots there are, if known; many are dealt to as many tasks."""
    if not 1 <= n <= 20:
        raise ValueError("n must be 1 to 20")
    cycles = snapshots.select("session_id", "ts_ms").distinct()
    w = Window.partitionBy("session_id").orderBy(F.desc("ts_ms"))
    last = cycles.withColumn("cycle", F.row_number().over(w)).where(F.col("cycle") <= n)
    return dealt(snapshots, rows, "session_id", "ts_ms").join(last, ["session_id", "ts_ms"])


def diversity_trend(snapshots: DataFrame) -> DataFrame:
    """Per cycle the genre entropy (log2, 4 dp) and the song count; a null genre is 'Unknown'."""
    g = snapshots.groupBy("session_id", "ts_ms", F.coalesce("genre", F.lit("Unknown")).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    # a cycle's genres are few: their counts are one short list, and nothing is joined back
    cycles = (g.where("session_id is not null and ts_ms is not null").groupBy("session_id", "ts_ms")
              .agg(F.sum("n").alias("song_count"), F.sort_array(F.collect_list("n")).alias("_n")))
    share = lambda n: n / F.col("song_count")
    entropy = F.aggregate("_n", F.lit(0.0), lambda a, n: a - share(n) * F.log2(share(n)))
    return cycles.select("session_id", "ts_ms", round_to(entropy, 4).alias("entropy"), "song_count")


def session_state(sessions: DataFrame, plays: DataFrame, feedback: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per session of ``sessions(session_id, status, n_users, user_count, songs_played_count,
    last_refreshed_at)``: users, songs played, feedback counts, phase of the latest cycle.

    Songs played fall back to the session's own count, then to the last refresh; users to the
    stored count; other feedback counts as neutral; without a cycle the phase is the cold one."""
    played = plays.groupBy("session_id").agg(F.count(F.lit(1)).alias("_played"))
    kind = F.when(F.col("action").isin(*FEEDBACK_KINDS), F.col("action")).otherwise("neutral")
    kinds = [*FEEDBACK_KINDS, "neutral"]
    fb = feedback.select("session_id", kind.alias("k")).groupBy("session_id").agg(*[F.count_if(F.col("k") == k).alias(f"n_{k}") for k in kinds])
    phase = snapshots.groupBy("session_id").agg(F.max_by("phase", "ts_ms").alias("_phase"))
    s = sessions.join(played, "session_id", "left").join(fb, "session_id", "left").join(phase, "session_id", "left")

    def nonzero(c):
        return F.nullif(F.col(c).cast("long"), F.lit(0).cast("long"))

    return s.select(
        "session_id", F.coalesce("status", F.lit("active")).alias("status"),
        F.coalesce(nonzero("n_users"), F.col("user_count").cast("long"), F.lit(0).cast("long")).alias("user_count"),
        F.coalesce(nonzero("_played"), nonzero("songs_played_count"), F.col("last_refreshed_at").cast("long"), F.lit(0).cast("long")).alias("songs_played"),
        *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in kinds],
        F.coalesce("_phase", F.lit(COLD_PHASE)).alias("phase"))


def song_reactions(feedback: DataFrame) -> DataFrame:
    """Likes and dislikes per song of a session, and all its events."""
    return feedback.groupBy("session_id", "video_id").agg(
        F.count_if(F.col("action") == "like").alias("likes"), F.count_if(F.col("action") == "dislike").alias("dislikes"),
        F.count(F.lit(1)).alias("events"))


def is_new_batch(batch: DataFrame, played: DataFrame) -> DataFrame:
    """Per session, is the batch a new one: more than five songs and none played before?"""
    hit = played.select("session_id", "video_id").distinct().withColumn("_hit", F.lit(1))
    return (batch.join(hit, ["session_id", "video_id"], "left").groupBy("session_id")
            .agg(F.count(F.lit(1)).alias("songs"), F.count("_hit").alias("played_songs"))
            .withColumn("new_batch", (F.col("songs") > NEW_BATCH_MIN) & (F.col("played_songs") == 0)))


def surviving_songs(cached: DataFrame, batch: DataFrame, played: DataFrame) -> DataFrame:
    """Cached queue songs that are neither in the new batch nor played."""
    keys = ["session_id", "video_id"]
    return cached.join(batch.select(keys), keys, "left_anti").join(played.select(keys), keys, "left_anti")


def queue_order(queue: DataFrame, played: DataFrame) -> DataFrame:
    """Queue position per session: the playing song first, the others by score desc and id;
    played songs are left out (the playing one stays)."""
    keys = ["session_id", "video_id"]
    left = queue.where("playing").unionByName(queue.where("NOT playing").join(played.select(keys), keys, "left_anti"))
    w = Window.partitionBy("session_id").orderBy(F.desc("playing"), F.desc("score"), "video_id")
    return left.withColumn("position", F.row_number().over(w))
