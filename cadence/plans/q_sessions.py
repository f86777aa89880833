"""Session queries: F9, F10, J7, J11, S11, U4, W3, W12, W13, A25, A28, A29.

Stand-ins (SURVEY §7.3): a session's orders are its recommendation cycles (ts_ms = order key, songs
= the order's lines, phase by order status, score = extended price); the latest cycle is the new
batch, the one before it the cached queue, the songs of older cycles are played.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cadence.operators import sessions as S
from cadence.operators import sinks
from cadence.plans.adapters import Adapters, with_ctes
from cadence.plans.registry import register
from cadence.session import dealt

SNAP = [
    ("snap", """
        SELECT l.l_orderkey // 4 AS session_id, l.l_orderkey AS ts_ms, l.l_linenumber AS rank, l.l_partkey % (SELECT n FROM ncat) AS video_id,
               CASE l.l_partkey % 9 WHEN 0 THEN NULL ELSE c.genre END AS genre, l.l_extendedprice AS final_score,
               CASE o.o_orderstatus WHEN 'F' THEN 'full_hybrid' WHEN 'O' THEN 'gru_growing' ELSE 'cold_start' END AS phase
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN catalog c ON c.video_id = l.l_partkey % (SELECT n FROM ncat)"""),
    ("cyc", """SELECT session_id, ts_ms, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms DESC) AS cycle
               FROM (SELECT DISTINCT session_id, ts_ms FROM snap)"""),
    ("sc", "SELECT snap.*, cycle FROM snap JOIN cyc USING (session_id, ts_ms)"),
]
QUEUE = SNAP + [
    ("batch", "SELECT DISTINCT session_id, video_id FROM sc WHERE cycle = 1"),
    ("cached", "SELECT session_id, video_id, max(final_score) AS score FROM sc WHERE cycle = 2 GROUP BY ALL"),
    ("old", "SELECT DISTINCT session_id, video_id FROM sc WHERE cycle > 2"),
]


def snapshots(a: Adapters):
    l = dealt(a.t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), a.t.lineitem.count(), "l_orderkey")
    o = a.t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    phase = F.when(F.col("o_orderstatus") == "F", "full_hybrid").when(F.col("o_orderstatus") == "O", "gru_growing").otherwise("cold_start")
    rows = l.join(o, "l_orderkey").withColumn("video_id", a.song("l_partkey")).join(a.catalog().select("video_id", "genre"), "video_id")
    return rows.select(a._session("l_orderkey").alias("session_id"), F.col("l_orderkey").alias("ts_ms"), F.col("l_linenumber").alias("rank"),
                       "video_id", F.when(F.pmod("l_partkey", F.lit(9)) != 0, F.col("genre")).alias("genre"),
                       F.col("l_extendedprice").alias("final_score"), phase.alias("phase"))


def queue(a: Adapters):
    """(batch, cached, played) of each session."""
    cycles = snapshots(a)
    order = cycles.select("session_id", "ts_ms").distinct()
    from pyspark.sql import Window
    order = order.withColumn("cycle", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ts_ms"))))
    sc = dealt(cycles, a.t.lineitem.count(), "session_id", "ts_ms").join(order, ["session_id", "ts_ms"])
    keys = ["session_id", "video_id"]
    return (sc.where("cycle = 1").select(keys).distinct(),
            sc.where("cycle = 2").groupBy(keys).agg(F.max("final_score").alias("score")),
            sc.where("cycle > 2").select(keys).distinct())


@register("w3_latest_cycles", with_ctes(["ncat", "catalog"], SNAP, """
    SELECT session_id, ts_ms, cycle, rank, video_id, phase FROM sc WHERE cycle <= 2"""))
def w3_latest_cycles(spark, sf_dir):
    a = Adapters(spark, sf_dir)
    return S.latest_cycles(snapshots(a), 2, a.t.lineitem.count()).select(
        "session_id", "ts_ms", F.col("cycle").cast("long").alias("cycle"), "rank", "video_id", "phase")


@register("a28_diversity_trend", with_ctes(["ncat", "catalog"], SNAP[:1], """
    SELECT session_id, ts_ms, round(sum(-n / t * log2(n / t)), 4) + 0.0 AS entropy, CAST(any_value(t) AS BIGINT) AS song_count
    FROM (SELECT session_id, ts_ms, coalesce(genre, 'Unknown') AS g, count(*) AS n,
                 sum(count(*)) OVER (PARTITION BY session_id, ts_ms) AS t FROM snap GROUP BY session_id, ts_ms, g)
    GROUP BY session_id, ts_ms"""))
def a28_diversity_trend(spark, sf_dir):
    return S.diversity_trend(snapshots(Adapters(spark, sf_dir)))


SESS = [("sess", """
    SELECT o_orderkey // 4 AS session_id,
           CASE WHEN bool_and(o_orderstatus = 'F') THEN 'ended' WHEN bool_and(o_orderstatus = 'O') THEN 'active'
                WHEN bool_or(o_orderstatus = 'P') THEN 'running' ELSE 'done' END AS status,
           count(DISTINCT o_custkey) % 3 AS n_users, CASE WHEN min(o_custkey) % 2 = 0 THEN 7 END AS user_count,
           min(o_custkey) % 2 AS songs_played_count, max(o_custkey) % 5 AS last_refreshed_at
    FROM orders GROUP BY 1""")]


def sessions(a: Adapters):
    st = F.col("o_orderstatus")
    status = (F.when(F.bool_and(st == "F"), "ended").when(F.bool_and(st == "O"), "active")
              .when(F.bool_or(st == "P"), "running").otherwise("done"))
    low = F.min("o_custkey")
    return a.t.orders.groupBy(a._session("o_orderkey").alias("session_id")).agg(
        status.alias("status"), (F.count_distinct("o_custkey") % 3).alias("n_users"), F.when(low % 2 == 0, 7).alias("user_count"),
        (low % 2).alias("songs_played_count"), (F.max("o_custkey") % 5).alias("last_refreshed_at"))


@register("a25_session_state", with_ctes(["ncat", "catalog", "plays", "votes"], SNAP[:1] + SESS + [
    ("pl", "SELECT session_id, count(*) AS n FROM plays GROUP BY 1"),
    ("fb", """SELECT session_id, count(*) FILTER (WHERE action = 'like') AS n_like, count(*) FILTER (WHERE action = 'dislike') AS n_dislike,
                     count(*) FILTER (WHERE action = 'skip') AS n_skip, count(*) FILTER (WHERE action = 'replay') AS n_replay,
                     count(*) FILTER (WHERE action = 'pause') AS n_neutral
              FROM (SELECT session_id, CASE WHEN action = 'skip' AND video_id % 2 = 0 THEN 'pause' ELSE action END AS action FROM votes) GROUP BY 1"""),
    ("ph", "SELECT session_id, max_by(phase, ts_ms) AS phase FROM snap GROUP BY 1")], """
    SELECT session_id, status, CAST(coalesce(nullif(n_users, 0), user_count, 0) AS BIGINT) AS user_count,
           CAST(coalesce(nullif(pl.n, 0), nullif(songs_played_count, 0), last_refreshed_at, 0) AS BIGINT) AS songs_played,
           coalesce(n_like, 0) AS n_like, coalesce(n_dislike, 0) AS n_dislike, coalesce(n_skip, 0) AS n_skip,
           coalesce(n_replay, 0) AS n_replay, coalesce(n_neutral, 0) AS n_neutral, coalesce(phase, 'cold_start') AS phase
    FROM sess LEFT JOIN pl USING (session_id) LEFT JOIN fb USING (session_id) LEFT JOIN ph USING (session_id)"""))
def a25_session_state(spark, sf_dir):
    a = Adapters(spark, sf_dir)
    fb = a.votes().withColumn("action", F.when((F.col("action") == "skip") & (F.pmod("video_id", F.lit(2)) == 0), "pause").otherwise(F.col("action")))
    return S.session_state(sessions(a), a.plays(), fb, snapshots(a))


@register("a29_song_reactions", with_ctes(["votes"], [], """
    SELECT session_id, video_id, count(*) FILTER (WHERE action = 'like') AS likes,
           count(*) FILTER (WHERE action = 'dislike') AS dislikes, count(*) AS events FROM votes GROUP BY ALL"""))
def a29_song_reactions(spark, sf_dir):
    return S.song_reactions(Adapters(spark, sf_dir).votes())


@register("f9_f10_session_status", with_ctes([], SESS, """
    SELECT session_id, status IN ('ended', 'done') AS completed, status IN ('active', 'done') AS live,
           status IN ('running', 'processing') AS runnable FROM sess"""))
def f9_f10_session_status(spark, sf_dir):
    s = sessions(Adapters(spark, sf_dir))
    marks = {"completed": S.COMPLETED, "live": S.LIVE, "runnable": S.RUNNABLE}
    out = s.select("session_id")
    for name, statuses in marks.items():
        hit = S.with_status(s, statuses).select("session_id", F.lit(True).alias(name))
        out = out.join(hit, "session_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


@register("j7_event_metadata", with_ctes(["ncat", "catalog", "votes"], SNAP, """
    SELECT v.session_id, v.video_id, v.action, coalesce(m.genre, '') AS genre, coalesce(m.t, '') AS track_title, count(*) AS n
    FROM votes v LEFT JOIN (SELECT DISTINCT session_id, video_id, genre, 'song ' || video_id AS t FROM sc WHERE cycle = 1 AND genre IS NOT NULL) m
      ON m.session_id = v.session_id AND m.video_id = v.video_id GROUP BY ALL"""))
def j7_event_metadata(spark, sf_dir):
    a = Adapters(spark, sf_dir)
    rows, song = a.t.lineitem.count(), ("session_id", "video_id")
    now = S.latest_cycles(snapshots(a), 1, rows).where(F.col("genre").isNotNull()).select(
        "session_id", "video_id", "genre", F.concat(F.lit("song "), F.col("video_id").cast("string")).alias("track_title"),
        F.lit("").alias("artist_name"))
    out = S.with_song_metadata(dealt(a.votes(), rows, *song), dealt(now, rows, *song))
    return out.groupBy("session_id", "video_id", "action", "genre", "track_title").agg(F.count(F.lit(1)).alias("n"))


@register("j11_surviving_songs", with_ctes(["ncat", "catalog"], QUEUE, """
    SELECT session_id, video_id, score FROM cached c
    WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.session_id = c.session_id AND b.video_id = c.video_id)
      AND NOT EXISTS (SELECT 1 FROM old p WHERE p.session_id = c.session_id AND p.video_id = c.video_id)"""))
def j11_surviving_songs(spark, sf_dir):
    batch, cached, played = queue(Adapters(spark, sf_dir))
    return S.surviving_songs(cached, batch, played)


@register("w12_queue_order", with_ctes(["ncat", "catalog"], QUEUE + [
    ("q", "SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score, video_id) = 1 AS playing FROM cached")], """
    SELECT session_id, video_id, playing, row_number() OVER (PARTITION BY session_id ORDER BY playing DESC, score DESC, video_id) AS position
    FROM q WHERE playing OR NOT EXISTS (SELECT 1 FROM old p WHERE p.session_id = q.session_id AND p.video_id = q.video_id)"""))
def w12_queue_order(spark, sf_dir):
    from pyspark.sql import Window
    _, cached, played = queue(Adapters(spark, sf_dir))
    first = F.row_number().over(Window.partitionBy("session_id").orderBy("score", "video_id")) == 1
    out = S.queue_order(cached.withColumn("playing", first), played)
    return out.select("session_id", "video_id", "playing", F.col("position").cast("long").alias("position"))


@register("w13_new_batch", with_ctes(["ncat", "catalog"], QUEUE, """
    SELECT b.session_id, count(*) AS songs, count(p.video_id) AS played_songs, count(*) > 5 AND count(p.video_id) = 0 AS new_batch
    FROM batch b LEFT JOIN old p ON p.session_id = b.session_id AND p.video_id = b.video_id GROUP BY 1"""))
def w13_new_batch(spark, sf_dir):
    batch, _, played = queue(Adapters(spark, sf_dir))
    return S.is_new_batch(batch, played)


@register("u4_songs_in_catalog", with_ctes(["catalog"], [], """
    SELECT DISTINCT l_orderkey // 4 AS session_id, l_partkey AS video_id FROM lineitem
    WHERE l_partkey IN (SELECT video_id FROM catalog)"""))
def u4_songs_in_catalog(spark, sf_dir):
    a = Adapters(spark, sf_dir)
    raw = a.t.lineitem.select(a._session("l_orderkey").alias("session_id"), F.col("l_partkey").alias("video_id"))
    return S.songs_in_catalog(raw, a.catalog())


@register("s11_new_catalog_rows", with_ctes(["catalog"], [], """
    SELECT l_partkey AS video_id, min(l_suppkey) AS supplier FROM lineitem
    WHERE l_partkey NOT IN (SELECT video_id FROM catalog) GROUP BY 1"""))
def s11_new_catalog_rows(spark, sf_dir):
    a = Adapters(spark, sf_dir)
    incoming = a.t.lineitem.select(F.col("l_partkey").alias("video_id"), F.col("l_suppkey").alias("supplier"))
    return sinks.new_catalog_rows(incoming, a.catalog().select("video_id"))
