"""Feedback and preferences: F3-F8, P15-P17, A11-A12, S13-S16, W8, W11."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.functions import scalars as S

# Fixed values of the reference: the keys of a feedback event and the known actions.
FEEDBACK_KEYS = ("session_id", "user_id", "video_id", "action")
FEEDBACK_ACTIONS = ("like", "dislike", "skip", "replay")
MUSIC_EVENT_ACTIONS = ("play", "skip", "like", "dislike", "replay", "complete")
_OBJECT_TEXT = r"(?s)^\s*\{.*\}\s*$"


# ---- F3: parse feedback JSON -----------------------------------------------------------

def has_keys(text: Column, keys) -> Column:
    """True when ``text`` is a JSON object holding every key (a null value still counts, D11)."""
    ks = F.json_object_keys(text)
    ok = F.coalesce(text.rlike(_OBJECT_TEXT), F.lit(False)) & ks.isNotNull()
    for k in keys:
        ok = ok & F.coalesce(F.array_contains(ks, F.lit(k)), F.lit(False))
    return ok


def parse_feedback(raw: DataFrame, text_col: str = "value") -> DataFrame:
    """keep events that are JSON objects with all four keys; parse them to columns."""
    schema = "session_id string, user_id string, video_id string, action string"
    t = F.col(text_col).cast("string")
    return (raw.where(has_keys(t, FEEDBACK_KEYS))
            .select(F.from_json(t, schema).alias("e"), *[c for c in raw.columns if c != text_col])
            .select("e.*", *[c for c in raw.columns if c != text_col]))


# ---- F6 / F7 request rules ------------------------------------------------------------

def feedback_request_error(df: DataFrame) -> Column:
    """reason a /feedback body is rejected, null when accepted."""
    missing = F.array_compact(F.array(*[F.when(F.col(k).isNull() | (F.col(k) == ""), F.lit(k))
                                        for k in FEEDBACK_KEYS]))
    return (F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ",")))
            .when(~F.col("action").isin(*FEEDBACK_ACTIONS), F.lit("invalid action")))


def music_event_defaults(df: DataFrame) -> DataFrame:
    """rows need room_id and song_id; text fields default to 'Unknown'."""
    return (df.where(F.col("room_id").isNotNull() & (F.col("room_id") != "")
                     & F.col("song_id").isNotNull() & (F.col("song_id") != ""))
            .withColumn("song_name", S.js_or("song_name", default="Unknown"))
            .withColumn("artist", S.js_or("artist", default="Unknown"))
            .withColumn("event_type", S.js_or("event_type", default="Unknown")))


# ---- F4 / F5 -------------------------------------------------------------------------

def for_session(df: DataFrame, session_id) -> DataFrame:
    """one session's events (a partition filter when the table is partitioned by session)."""
    return df.where(F.col("session_id") == F.lit(session_id))


def parse_music_events(raw: DataFrame, text_col: str = "value") -> DataFrame:
    """JSON music events with the keys room_id and song_id (a null value still counts, D11);
    action = event_type, else action; keep the six known actions."""
    schema = ("room_id string, user_id string, song_id string, song_name string, artist string, "
              "event_type string, action string, timestamp string")
    t = F.col(text_col).cast("string")
    parsed = (raw.where(has_keys(t, ("room_id", "song_id")))
              .select(F.from_json(t, schema).alias("e")).select("e.*"))
    act = F.coalesce(F.nullif(F.col("event_type"), F.lit("")), F.col("action"))
    return (parsed.withColumn("action", act)
            .where(F.col("action").isin(*MUSIC_EVENT_ACTIONS)))


# ---- F8: active session users ------------------------------------------------------------

def active_users(sessions: DataFrame, need_token: bool = False) -> DataFrame:
    """F8: explode ``users``; ``isactive`` defaults to true; non-empty user id (and token)."""
    u = sessions.select("session_id", F.explode("users").alias("u")).select("session_id", "u.*")
    ok = F.coalesce(F.col("isactive"), F.lit(True)) & (F.coalesce(F.col("user_id"), F.lit("")) != "")
    if need_token:
        ok = ok & (F.coalesce(F.col("refresh_token"), F.lit("")) != "")
    return u.where(ok).select("session_id", "user_id")


# ---- P15 / A11 / T6: score state ---------------------------------------------------------

def with_feedback_weight(df: DataFrame, action: str = "action") -> DataFrame:
    return df.withColumn("score_delta", S.feedback_weight(action))


def track_scores(scored: DataFrame, ts: str | None = None) -> DataFrame:
    """Per (session_id, video_id): Σ score_delta and per-action counters (lower-cased, D8); with
    ``ts`` also the time of the last event, ``last_updated``."""
    a = F.lower(F.col("action"))
    last = [F.max(ts).alias("last_updated")] if ts else []
    return (scored.groupBy("session_id", "video_id")
            .agg(F.sum("score_delta").alias("score"),
                 *[F.count_if(a == x).alias(f"{x}_count") for x in FEEDBACK_ACTIONS], *last))


# ---- A12 / P16: preference sets --------------------------------------------------------

def preference_sets(feedback: DataFrame) -> DataFrame:
    """Per (session_id, user_id) the sets of liked / disliked / skipped / replayed ids.
    Users with only unknown actions keep empty sets."""
    pref = S.action_preference(F.col("action"))
    return (feedback.groupBy("session_id", "user_id")
            .agg(*[F.array_sort(F.collect_set(F.when(pref == p, F.col("video_id")))).alias(f"{p}_songs")
                   for p in ("liked", "disliked", "skipped", "replayed")]))


# ---- W8 / T7: latest action; W11: first vote ------------------------------------------

def latest_action(feedback: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Last action per (session, user, video) by time (ties: larger action text)."""
    return (feedback.groupBy("session_id", "user_id", "video_id")
            .agg(F.max_by(F.struct("action", "score_delta"), F.struct(ts, "action")).alias("l"),
                 F.max(ts).alias("last_updated"))
            .select("session_id", "user_id", "video_id", "l.action", "l.score_delta", "last_updated"))


def first_vote(votes: DataFrame, order_cols) -> DataFrame:
    """Only the first vote per (session, user, song) counts. A minimum that is reduced inside
    each task first, so a song that everybody votes on is no hot group."""
    keys = ["session_id", "user_id", "video_id"]
    rest = [c for c in votes.columns if c not in keys]
    return (votes.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order_cols)).alias("_v"))
            .select(*keys, "_v.*").select(*votes.columns))


# ---- S15 / S16: history append and preference merge ------------------------------------

def history_rows(feedback: DataFrame) -> DataFrame:
    """Rows lacking user, video or action are skipped; timestamp normalised."""
    return (feedback.where(F.col("user_id").isNotNull() & F.col("video_id").isNotNull()
                           & F.col("action").isNotNull())
            .select("session_id", "user_id", "video_id", "action",
                    F.coalesce(F.col("score_delta"), F.lit(0.0)).alias("score_delta"),
                    S.event_timestamp(F.col("last_updated")).alias("timestamp")))


def merge_preferences(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Per user, stored arrays ∪ new arrays; users absent from ``stored`` are inserted.

    ``stored``: (user_id, liked_songs, disliked_songs, skipped_songs, replayed_songs).
    ``new``: the same columns (from A12, rolled up over sessions).
    """
    cols = ["liked_songs", "disliked_songs", "skipped_songs", "replayed_songs"]
    empty = F.array().cast("array<string>")
    s = stored.select("user_id", *[F.col(c).alias(f"_s_{c}") for c in cols])
    n = new.select("user_id", *[F.col(c).alias(f"_n_{c}") for c in cols])
    return (s.join(n, "user_id", "full_outer")
            .select("user_id", *[F.array_sort(F.array_union(F.coalesce(f"_s_{c}", empty),
                                                            F.coalesce(f"_n_{c}", empty))).alias(c)
                                 for c in cols]))
