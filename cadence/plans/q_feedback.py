"""Feedback and stream queries (batch forms): F3, F5, P15, P18, A11, A12, A29, T4, T6-T8, W8, W11, S15, S16.

Events adapter (SURVEY §7.3): room = 'AUX-R' || user_id mod 5, song = props $.k;
music action: view->play, click->like, purchase->complete, error->dislike, signup->skip;
feedback action: click->like, error->dislike, signup->skip, purchase->replay, view->view (weight 0).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.functions import scalars as S
from cadence.operators import prefs as P
from cadence.plans.adapters import with_ctes, SQL_ADAPTERS, _SQL_DEPS
from cadence.plans.q_recommend import r4, s4
from cadence.plans.registry import register
from cadence.session import scratch
from cadence.sources.tables import Tables
from cadence.streaming import feedback_stream as T
from cadence.streaming.drain import append_history, session_preferences

MUSIC_MAP = {"view": "play", "click": "like", "purchase": "complete", "error": "dislike", "signup": "skip"}
FEEDBACK_MAP = {"click": "like", "error": "dislike", "signup": "skip", "purchase": "replay", "view": "view"}


def _map(col, m):
    out = None
    for k, v in m.items():
        out = (F.when(F.col(col) == k, F.lit(v)) if out is None else out.when(F.col(col) == k, F.lit(v)))
    return out


def music_events(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.concat(F.lit("AUX-R"), F.pmod("user_id", F.lit(5)).cast("string")).alias("room_id"),
        F.col("user_id").cast("string").alias("user_id"), k.alias("song_id"),
        F.when(F.col("value") < 20, F.lit("Unknown")).otherwise(F.concat(F.lit("song "), k)).alias("song_name"),
        F.when(F.col("value") < 10, F.lit("Unknown"))
        .otherwise(F.concat(F.lit("artist "), F.pmod(k.cast("int"), F.lit(7)).cast("string"))).alias("artist"),
        _map("event_type", MUSIC_MAP).alias("action"), "event_type", "value", "event_id",
        F.col("ts").cast("timestamp").alias("ts"))


def feedback_events(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    return e.select(
        S.room_to_session(F.concat(F.lit("AUX-R"), F.pmod("user_id", F.lit(5)).cast("string"))).alias("session_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.get_json_object("props", "$.k").alias("video_id"),
        _map("event_type", FEEDBACK_MAP).alias("action"), "event_id",
        F.col("ts").cast("timestamp").alias("ts"))


def _sql_map(col, m):
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in m.items()) + " END"


SQL_ADAPTERS["music"] = f"""
    SELECT 'AUX-R' || CAST(user_id % 5 AS VARCHAR) AS room_id, CAST(user_id AS VARCHAR) AS user_id,
           json_extract_string(props, '$.k') AS song_id,
           CASE WHEN value < 20 THEN 'Unknown' ELSE 'song ' || json_extract_string(props, '$.k') END AS song_name,
           CASE WHEN value < 10 THEN 'Unknown'
                ELSE 'artist ' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS VARCHAR) END AS artist,
           {_sql_map('event_type', MUSIC_MAP)} AS action, event_type, value, event_id, ts
    FROM events"""
SQL_ADAPTERS["feedback"] = f"""
    SELECT 'r' || CAST(user_id % 5 AS VARCHAR) AS session_id, CAST(user_id AS VARCHAR) AS user_id,
           json_extract_string(props, '$.k') AS video_id, {_sql_map('event_type', FEEDBACK_MAP)} AS action,
           event_id, ts
    FROM events"""
SQL_WEIGHT = ("CAST(CASE lower(action) WHEN 'like' THEN 2.0 WHEN 'dislike' THEN -2.0 WHEN 'skip' THEN -0.5 "
              "WHEN 'replay' THEN 1.5 ELSE 0.0 END AS DOUBLE)")
_SQL_DEPS.update({"music": [], "feedback": []})


@register("t4_window_metrics_batch", with_ctes(["music"], [("m", """
        SELECT room_id, song_id, time_bucket(INTERVAL 60 SECOND, ts) AS ws,
               count(*) FILTER (WHERE action = 'play') AS play_count,
               count(*) FILTER (WHERE action = 'skip') AS skip_count,
               count(*) FILTER (WHERE action = 'complete') AS complete_count,
               coalesce(arg_min(song_name, ts) FILTER (WHERE song_name <> 'Unknown'), 'Unknown') AS song_name,
               coalesce(arg_min(artist, ts) FILTER (WHERE artist <> 'Unknown'), 'Unknown') AS artist
        FROM music GROUP BY ALL""")], f"""
    SELECT room_id, song_id, song_name, artist, play_count, skip_count, complete_count,
           CASE WHEN play_count + skip_count + complete_count > 0
                THEN {s4('complete_count / (play_count + skip_count + complete_count)')} ELSE 0.0 END
             AS completion_rate,
           play_count + skip_count + complete_count AS total_events,
           CAST(ws AS VARCHAR) AS window_start, CAST(ws + INTERVAL 60 SECOND AS VARCHAR) AS window_end
    FROM m"""))
def t4_window_metrics_batch(spark, sf_dir):
    m = T.window_metrics(music_events(spark, sf_dir))
    return m.withColumn("window_start", F.col("window_start").cast("string")).withColumn(
        "window_end", F.col("window_end").cast("string"))


@register("t6_track_score_state", with_ctes(["feedback"], [], f"""
    SELECT session_id, video_id, {s4(f'sum({SQL_WEIGHT})')} AS score,
           count(*) FILTER (WHERE lower(action) = 'like') AS like_count,
           count(*) FILTER (WHERE lower(action) = 'dislike') AS dislike_count,
           count(*) FILTER (WHERE lower(action) = 'skip') AS skip_count,
           count(*) FILTER (WHERE lower(action) = 'replay') AS replay_count, CAST(max(ts) AS VARCHAR) AS last_updated
    FROM feedback GROUP BY ALL"""))
def t6_track_score_state(spark, sf_dir):
    s = T.score_state(feedback_events(spark, sf_dir))
    return s.withColumn("score", r4(F.col("score"))).withColumn("last_updated", F.col("last_updated").cast("string"))


@register("t7_latest_action", with_ctes(["feedback"], [], f"""
    SELECT session_id, user_id, video_id, action, {SQL_WEIGHT} AS score_delta, CAST(ts AS VARCHAR) AS last_updated
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id, user_id, video_id ORDER BY ts DESC, action DESC) AS rn
          FROM feedback) WHERE rn = 1"""))
def t7_latest_action(spark, sf_dir):
    l = T.latest_feedback(feedback_events(spark, sf_dir))
    return l.withColumn("last_updated", F.col("last_updated").cast("string"))


@register("w11_first_vote", with_ctes(["feedback"], [], """
    SELECT session_id, action, count(*) AS votes FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id, user_id, video_id ORDER BY ts, event_id) AS rn
      FROM feedback) WHERE rn = 1 GROUP BY ALL"""))
def w11_first_vote(spark, sf_dir):
    v = P.first_vote(feedback_events(spark, sf_dir), ["ts", "event_id"])
    return v.groupBy("session_id", "action").agg(F.count(F.lit(1)).alias("votes"))


@register("a12_preference_sets", with_ctes(["feedback"], [], """
    SELECT session_id, user_id,
      coalesce(string_agg(DISTINCT CASE WHEN action = 'like' THEN video_id END, '|' ORDER BY CASE WHEN action = 'like' THEN video_id END), '') AS liked_songs,
      coalesce(string_agg(DISTINCT CASE WHEN action = 'dislike' THEN video_id END, '|' ORDER BY CASE WHEN action = 'dislike' THEN video_id END), '') AS disliked_songs,
      coalesce(string_agg(DISTINCT CASE WHEN action = 'skip' THEN video_id END, '|' ORDER BY CASE WHEN action = 'skip' THEN video_id END), '') AS skipped_songs,
      coalesce(string_agg(DISTINCT CASE WHEN action = 'replay' THEN video_id END, '|' ORDER BY CASE WHEN action = 'replay' THEN video_id END), '') AS replayed_songs
    FROM feedback GROUP BY ALL"""))
def a12_preference_sets(spark, sf_dir):
    p = P.preference_sets(feedback_events(spark, sf_dir))
    return p.select("session_id", "user_id", *[F.array_join(c, "|").alias(c) for c in
                                                ("liked_songs", "disliked_songs", "skipped_songs", "replayed_songs")])


@register("t8_refresh_points", with_ctes(["music"], [("n", """
        SELECT lower(regexp_replace(room_id, '(?i)^AUX-', '')) AS session_id, count(*) AS n
        FROM music WHERE action = 'play' GROUP BY 1""")], """
    SELECT session_id, CAST(r AS BIGINT) AS refresh_at FROM n, generate_series(10, n - n % 10, 10) AS g(r)
    WHERE n >= 10"""))
def t8_refresh_points(spark, sf_dir):
    m = music_events(spark, sf_dir).where(F.col("action") == "play")
    return T.refresh_points_batch(m.select(S.room_to_session("room_id").alias("session_id")))


@register("a29_live_counters", with_ctes([], [], f"""
    SELECT event_type, count(*) AS events, {s4('avg(value)')} AS avg_value FROM events GROUP BY 1"""))
def a29_live_counters(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), r4(F.avg("value")).alias("avg_value"))


def _music_json(spark, sf_dir):
    """Music events as landed JSON text; events of type 'error' above 90 arrive without room_id."""
    m = music_events(spark, sf_dir)
    full = F.to_json(F.struct("room_id", "user_id", "song_id", "song_name", "artist",
                              F.col("action").alias("event_type"), F.col("ts").cast("string").alias("timestamp")))
    partial = F.to_json(F.struct("user_id", "song_id", F.col("action").alias("event_type")))
    return m.select(F.when((F.col("event_type") == "error") & (F.col("value") > 90), partial)
                    .otherwise(full).alias("value"))


@register("f5_parse_music_events", with_ctes(["music"], [], """
    SELECT action, count(*) AS n FROM music WHERE NOT (event_type = 'error' AND value > 90) GROUP BY 1"""))
def f5_parse_music_events(spark, sf_dir):
    p = P.parse_music_events(_music_json(spark, sf_dir))
    return p.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@register("f3_parse_feedback", with_ctes(["feedback"], [], """
    SELECT session_id, count(*) AS n FROM feedback WHERE action <> 'view' GROUP BY 1"""))
def f3_parse_feedback(spark, sf_dir):
    return P.parse_feedback(_feedback_json(spark, sf_dir)).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


def _feedback_json(spark, sf_dir):
    f = feedback_events(spark, sf_dir)
    full = F.to_json(F.struct("session_id", "user_id", "video_id", "action"))
    two = F.to_json(F.struct("session_id", "user_id"))
    return f.select(F.when(F.col("action") == "view", two).otherwise(full).alias("value"))


LISTS = {"liked_songs": "like", "disliked_songs": "dislike", "skipped_songs": "skip", "replayed_songs": "replay"}


def _lists_sql(when: str) -> str:
    lists = ", ".join(f"coalesce(list(DISTINCT video_id) FILTER (WHERE action = '{a}'), []) AS {c}" for c, a in LISTS.items())
    return f"SELECT user_id, {lists} FROM feedback WHERE ts {when} TIMESTAMP '2024-01-15' GROUP BY 1"


@register("s16_merge_preferences", with_ctes(["feedback"], [("old", _lists_sql("<")), ("new", _lists_sql(">="))], f"""
    SELECT coalesce(o.user_id, n.user_id) AS user_id,
           {", ".join(f"array_to_string(list_sort(list_distinct(list_concat(coalesce(o.{c}, []), coalesce(n.{c}, [])))), '|') AS {c}" for c in LISTS)}
    FROM old o FULL OUTER JOIN new n ON o.user_id = n.user_id"""))
def s16_merge_preferences(spark, sf_dir):
    f = feedback_events(spark, sf_dir)
    cut = F.lit("2024-01-15").cast("timestamp")
    merged = P.merge_preferences(session_preferences(f.where(F.col("ts") < cut)), session_preferences(f.where(F.col("ts") >= cut)))
    return merged.select("user_id", *[F.array_join(c, "|").alias(c) for c in LISTS])


@register("s15_history_rows", with_ctes(["feedback"], [], f"""
    SELECT session_id, user_id, video_id, action, {SQL_WEIGHT} AS score_delta, CAST(ts AS VARCHAR) AS timestamp
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id, user_id, video_id ORDER BY ts DESC, action DESC) AS rn
          FROM feedback) WHERE rn = 1"""))
def s15_history_rows(spark, sf_dir):
    """The latest actions, appended as history and read back."""
    path = f"{scratch(spark)}/history"
    append_history(T.latest_feedback(feedback_events(spark, sf_dir)), path)
    h = spark.read.parquet(path)
    return h.select(F.col("session_id").cast("string").alias("session_id"), "user_id", "video_id", "action", "score_delta", F.col("timestamp").cast("string").alias("timestamp"))


@register("f3_feedback_rows", with_ctes(["feedback"], [], """
    SELECT session_id, user_id, video_id, action, count(*) AS n FROM feedback WHERE action <> 'view' GROUP BY ALL"""))
def f3_feedback_rows(spark, sf_dir):
    """what the parsed events hold, session by session."""
    return P.parse_feedback(_feedback_json(spark, sf_dir)).groupBy("session_id", "user_id", "video_id", "action").agg(F.count(F.lit(1)).alias("n"))


@register("f5_music_rows", with_ctes(["music"], [], """
    SELECT room_id, user_id, song_id, song_name, artist, action, CAST(ts AS VARCHAR) AS timestamp, count(*) AS n
    FROM music WHERE NOT (event_type = 'error' AND value > 90) GROUP BY ALL"""))
def f5_music_rows(spark, sf_dir):
    cols = ["room_id", "user_id", "song_id", "song_name", "artist", "action", "timestamp"]
    return P.parse_music_events(_music_json(spark, sf_dir)).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


@register("f6_rejected_requests", with_ctes(["feedback"], [], """
    SELECT session_id, e AS error, count(*) AS n FROM (
      SELECT session_id, CASE WHEN event_id % 7 = 0 AND event_id % 5 = 0 THEN 'missing: user_id,video_id' WHEN event_id % 7 = 0 THEN 'missing: user_id'
                  WHEN event_id % 5 = 0 THEN 'missing: video_id' WHEN action = 'view' THEN 'invalid action' END AS e FROM feedback)
    WHERE e IS NOT NULL GROUP BY ALL"""))
def f6_rejected_requests(spark, sf_dir):
    f = feedback_events(spark, sf_dir)
    f = f.withColumn("user_id", F.when(F.pmod("event_id", F.lit(7)) != 0, F.col("user_id"))).withColumn(
        "video_id", F.when(F.pmod("event_id", F.lit(5)) == 0, "").otherwise(F.col("video_id")))
    return f.select("session_id", P.feedback_request_error(f).alias("error")).where("error is not null").groupBy("session_id", "error").agg(F.count(F.lit(1)).alias("n"))
